"""Snapshots with append-only journals: operation log, registry, version graph, pack index, small stores.

A journal is text, one record a line. A line that is torn or wrong is skipped. The order of lines is
that of (time of the file, file, offset), which `lines` makes of Spark's file metadata: every append is a
set of files of its own. Compaction writes the folded state beside the old one, and `replace` puts it in
the old one's place by renaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.operators import graph, oplog


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos) of text files; pos orders lines by time of the file, file and place.

    A task reads a file's blocks in order, so that its row ids rise with the offset; blocks of one
    file rise with their start.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    return rows.select("value", F.struct("t", "f", "s", "n").alias("pos"))


def parsed(rows: DataFrame, ddl: str, value: str = "value") -> DataFrame:
    """rows with the fields of JSON lines; lines that are no such objects are dropped."""
    schema = f"{ddl}, _corrupt_record string"
    x = rows.withColumn("_r", F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return x.where("_r is not null and _r._corrupt_record is null").select("pos", "_r.*").drop("_corrupt_record")


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """The log: first occurrence of each id; torn lines skipped."""
    return oplog.dedupe_by_id(parsed(lines(spark, path), schemas.OPS), "pos").drop("pos")


def append_ops(ops: DataFrame, path: str, persisted: DataFrame | None = None) -> None:
    """Append what is not persisted yet."""
    new = ops if persisted is None else ops.join(persisted.select("id"), "id", "left_anti")
    new.select(F.to_json(F.struct(*ops.columns)).alias("value")).write.mode("append").text(path)


def rewrite_ops(ops: DataFrame, path: str) -> None:
    """The whole log anew, in the place of the old one."""
    _write(ops, f"{path}.new")
    replace(ops.sparkSession, path)


def _write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(path)


def replace(spark: SparkSession, path: str) -> None:
    """Put `path`.new in the place of path. A run that was cut short is finished by the next: the old state is at `path`.old until the new one is there."""
    jvm = spark.sparkContext._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.old"), True)
        fs.rename(at(path), at(f"{path}.old"))
    if not fs.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"cannot rename {path}.new")
    fs.delete(at(f"{path}.old"), True)


def fold_registry(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """Last record of each id wins; journal(pos, id, entry, del): a null entry with del removes. snapshot(id, entry) comes before all."""
    old = snapshot.select("id", "entry", F.lit(False).alias("del"), F.struct(F.lit(0).alias("j"), F.lit(None).cast(journal.schema["pos"].dataType).alias("p")).alias("at"))
    new = journal.select("id", "entry", "del", F.struct(F.lit(1).alias("j"), F.col("pos").alias("p")).alias("at"))
    return oplog.last_of(old.unionByName(new), "id", "at").where("not coalesce(del, false) and entry is not null").select("id", "entry")


def registry_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Journal records (id, entry, del) that lead from one state to another."""
    b, a = before.select("id", F.col("entry").alias("_b")), after.select("id", F.col("entry").alias("_a"))
    rows = b.join(a, "id", "full_outer").where("not (_a <=> _b)")
    return rows.select("id", F.col("_a").alias("entry"), F.col("_a").isNull().alias("del"))


_ENTRY = "id string, entry string, del boolean"


def append_registry(delta: DataFrame, path: str) -> None:
    """Append registry_delta() to the journal; an entry is a JSON text."""
    _write(delta.select("id", "entry", "del"), path, "append")


def read_registry(spark: SparkSession, snapshot: str | None, journal: str | None) -> DataFrame:
    """(id, entry) of a snapshot and the journal after it; either may be absent."""
    none = spark.createDataFrame([], _ENTRY)
    old = none if snapshot is None else parsed(lines(spark, snapshot), _ENTRY)
    new = parsed(lines(spark, journal), _ENTRY) if journal is not None else none.withColumn("pos", F.lit(None).cast("int"))
    return fold_registry(old.select("id", "entry"), new)


def compact_registry(spark: SparkSession, snapshot: str, journal: str) -> None:
    """The fold of both as the new snapshot; the journal is empty then. A journal that outlives its snapshot changes nothing when it is folded again."""
    now = read_registry(spark, snapshot, journal).withColumn("del", F.lit(False))
    _write(now, f"{snapshot}.new")
    replace(spark, snapshot)
    _write(now.limit(0), f"{journal}.new")
    replace(spark, journal)


#: Records of a graph's journal after which it is folded into the snapshot.
GRAPH_RECORDS = 500


def append_graph(delta: DataFrame, path: str) -> None:
    """Append rows(versionId, parents, contentHash, fileId) to the graph's journal."""
    _write(delta.select("versionId", "parents", "contentHash", "fileId"), path, "append")


def read_graph(spark: SparkSession, snapshot: str | None, journal: str | None) -> DataFrame:
    """The version graph of a snapshot and the journal after it."""
    none = spark.createDataFrame([], schemas.VERSIONS)
    old = none if snapshot is None else parsed(lines(spark, snapshot), schemas.VERSIONS)
    new = parsed(lines(spark, journal), schemas.VERSIONS) if journal is not None else none.withColumn("pos", F.lit(None).cast("int"))
    return fold_graph(old, new)


def compact_graph(spark: SparkSession, snapshot: str, journal: str, records: int = GRAPH_RECORDS) -> bool:
    """Fold the journal into the snapshot once it has so many records; whether it was done."""
    if lines(spark, journal).limit(records).count() < records:
        return False
    _write(read_graph(spark, snapshot, journal), f"{snapshot}.new")
    replace(spark, snapshot)
    _write(spark.createDataFrame([], schemas.VERSIONS), f"{journal}.new")
    replace(spark, journal)
    return True


def compaction_due(journal_bytes: int, snapshot_bytes: int, records: int, entries: int) -> bool:
    return journal_bytes > snapshot_bytes or records > max(1000, 2 * entries)


def fold_graph(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """The version graph of a snapshot and a journal of rows(versionId, parents, contentHash, fileId, pos)."""
    old = snapshot.select("versionId", "parents", "contentHash", "fileId", F.struct(F.lit(0).alias("j"), F.lit(None).cast(journal.schema["pos"].dataType).alias("p")).alias("pos"))
    new = journal.select("versionId", "parents", "contentHash", "fileId", F.struct(F.lit(1).alias("j"), F.col("pos").alias("p")).alias("pos"))
    return graph.build(old.unionByName(new))


def graph_lost(versions: DataFrame, cursor: int) -> bool:
    """Whether the graph must be rebuilt from the log: something was read, but the graph is empty."""
    return cursor > 0 and versions.limit(1).count() == 0


def read_pack_index(spark: SparkSession, path: str) -> DataFrame:
    """hash, packId, offset, len of lines with four fields; of a hash the last line."""
    f = F.split("value", " ", -1)
    rows = lines(spark, path).withColumn("f", f).where((F.size("f") == 4) & F.col("f")[0].rlike("^[0-9a-f]{64}$") & F.col("f")[2].rlike("^[0-9]+$") & F.col("f")[3].rlike("^[0-9]+$"))
    rows = rows.select(F.col("f")[0].alias("hash"), F.col("f")[1].alias("packId"), F.col("f")[2].cast("bigint").alias("offset"), F.col("f")[3].cast("bigint").alias("len"), "pos")
    return oplog.last_of(rows, "hash", "pos").drop("pos")


def next_pack(index: DataFrame) -> DataFrame:
    """One row, n: the number of the next pack."""
    return index.agg((F.coalesce(F.max(F.regexp_extract("packId", r"(\d+)$", 1).cast("bigint")), F.lit(-1)) + 1).alias("n"))


def read_packed(index: DataFrame, packs: DataFrame) -> DataFrame:
    """hash, bytes of packs(packId, body): null where they are not what the hash says, or beyond the body."""
    rows = index.join(packs, "packId", "left")
    # a body is a string of less than 2 ** 31 characters; an offset beyond is wrong, not wrapped round
    inside = (F.col("offset") >= 0) & (F.col("len") >= 0) & (F.col("offset") + F.col("len") <= F.length("body"))
    data = F.when(inside, F.try_to_binary(F.substring(F.col("body"), F.try_add(F.when(inside, F.col("offset")), F.lit(1)).cast("int"), F.when(inside, F.col("len")).cast("int")), F.lit("base64")))
    return rows.select("hash", F.when(F.sha2(data, 256) == F.col("hash"), data).alias("bytes"))


def write_packs(contents: DataFrame, per_pack: int = 256, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(index, packs) of distinct contents, in order of hash; packs are numbered from `first`."""
    from tidefold.operators.blobs import dedup, numbered

    rows = numbered(dedup(contents).select("hash", F.base64("bytes").alias("t")), ["hash"]).withColumn("packId", F.format_string("pack-%06d", F.floor(F.col("_n") / per_pack) + first))
    at = F.sum(F.length("t")).over(W.partitionBy("packId").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)) - F.length("t")
    index = rows.select("hash", "packId", at.alias("offset"), F.length("t").cast("bigint").alias("len"))
    packs = rows.groupBy("packId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]), "").alias("body"))
    return index, packs


def read_store(spark: SparkSession, path: str, ddl: str, **defaults: object) -> DataFrame:
    """One row of a small JSON store; what is absent or wrong is its default."""
    from tidefold.functions.text import json_or_default

    rows = spark.read.text(path, wholetext=True).select(json_or_default(F.col("value"), ddl, **defaults).alias("s")).select("s.*")
    nothing = spark.range(1).select(*(F.lit(v).alias(k) for k, v in defaults.items()))
    return rows.unionByName(nothing).limit(1)
