"""An operation log, replicas, listings, packs and texts made of the driver's events and documents.

FIXTURE_SQL states the same for DuckDB, as common table expressions that a query is appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold.functions import hlc
from tidefold.scratch import materialize

FIXTURE_SQL = r"""
with ev as (select event_id, user_id, event_type, (epoch_us(ts) // 1000)::bigint as wall, 'f' || lpad(user_id::varchar, 6, '0') as fileId, 'dev-' || (event_id % 3) as device,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
top as (select *, max(wall) over (partition by device order by event_id) as runmax from ev),
clk as (select *, row_number() over (partition by device, runmax order by event_id) - 1 as counter from top),
named as (select *, lpad(runmax::varchar, 15, '0') || '-' || lpad(counter::varchar, 8, '0') || '-' || device as id,
    case when rn = 1 then 'create' when event_type = 'error' then 'delete' when event_type = 'view' then 'move' else 'update' end as type from clk),
prev as (select *, case when type <> 'move' then id end as cid, sum(case when type = 'move' then 1 else 0 end) over (partition by fileId order by rn) as moves from named),
par as (select *, last_value(cid ignore nulls) over (partition by fileId, device order by rn rows between unbounded preceding and 1 preceding) as psame,
    last_value(cid ignore nulls) over (partition by fileId order by rn rows between unbounded preceding and 1 preceding) as pany, first_value(id) over (partition by fileId order by rn) as root from prev),
ndocs as (select count(*) as n from documents),
own as (select par.*, case when rn = 1 then [] when event_type = 'purchase' then list_distinct([coalesce(psame, root), pany]) else [coalesce(psame, root)] end as parents0,
    sha256(d.text) as own_hash from par cross join ndocs left join documents d on d.doc_id = event_id % n),
ops as (select o.event_id, o.id, o.runmax as wall, o.counter, o.device, o.fileId, o.type, 'n/' || o.fileId || '-' || o.moves || '.md' as path,
    case when o.type = 'move' then q.own_hash else o.own_hash end as contentHash, list_sort(o.parents0) as parents, o.parents0[1] as parent1
    from own o left join own q on q.id = o.parents0[1] and o.type = 'move')
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: dict[tuple[str, str], DataFrame] = {}


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the columns of an operation; parents are sorted. The table is written once a session and folder, and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = make_ops(spark, sf_dir)
    return _MADE[key]


def make_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"))
    ev = ev.withColumn("fileId", F.concat(F.lit("f"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).withColumn("device", F.concat(F.lit("dev-"), (F.col("event_id") % 3).cast("string")))
    by_file = W.partitionBy("fileId").orderBy("rn")
    before = lambda *keys: W.partitionBy(*keys).orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    clocked = hlc.issue(ev.withColumn("rn", F.row_number().over(W.partitionBy("fileId").orderBy("ts", "event_id"))), "device", "event_id", "wall")
    rows = clocked.withColumn("id", hlc.to_string(F.col("hlc")))
    rows = rows.withColumn("type", F.when(F.col("rn") == 1, "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "move").otherwise("update"))
    rows = rows.withColumn("cid", F.when(F.col("type") != "move", F.col("id"))).withColumn("moves", F.count_if(F.col("type") == "move").over(by_file))
    rows = rows.withColumn("psame", F.last("cid", True).over(before("fileId", "device"))).withColumn("pany", F.last("cid", True).over(before("fileId"))).withColumn("root", F.first("id").over(by_file))
    parent = F.coalesce("psame", "root")
    rows = rows.withColumn("parent1", F.when(F.col("rn") > 1, parent))
    rows = rows.withColumn("parents", F.when(F.col("rn") == 1, F.array().cast("array<string>")).when(F.col("event_type") == "purchase", F.array_sort(F.array_distinct(F.array(parent, F.col("pany"))))).otherwise(F.array(parent)))
    docs = _read(spark, sf_dir, "documents")
    n = docs.count()
    hashes = docs.select(F.col("doc_id").alias("_d"), F.sha2(F.col("text").cast("binary"), 256).alias("own_hash"))
    rows = rows.withColumn("_d", F.col("event_id") % n).join(hashes, "_d", "left")
    origin = rows.select(F.col("id").alias("parent1"), F.col("own_hash").alias("moved_hash"))
    rows = rows.join(origin, "parent1", "left")
    return materialize(rows.select("event_id", F.lit(1).alias("v"), "id", F.col("hlc").alias("hlcTimestamp"), "fileId", "type", F.format_string("n/%s-%d.md", "fileId", "moves").alias("path"), F.when(F.col("type") == "move", F.col("moved_hash")).otherwise(F.col("own_hash")).alias("contentHash"), "parents", "parent1"))


def plain(rows: DataFrame) -> DataFrame:
    """Operations without the event_id, as the operators take them."""
    return rows.select("v", "id", "hlcTimestamp", "fileId", "type", "path", "contentHash", "parents")


def replica(rows: DataFrame, which: int) -> DataFrame:
    """The operations that a replica (1 local, 2 remote) has: the shared third and its own."""
    return rows.where((F.col("event_id") % 3).isin(0, which))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("text").cast("binary").alias("bytes")).dropDuplicates(["hash"])


def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' hashes in packs of forty documents by doc_id; of a hash the first document counts."""
    docs = _read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id", F.octet_length("text").cast("bigint").alias("len"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.min("len").alias("len"))
    return first.select("hash", F.concat(F.lit("p"), F.floor(F.col("doc_id") / 40).cast("string")).alias("packId"), F.lit(0).cast("bigint").alias("offset"), "len")


def merge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base, ours, theirs: a document's lines; ours has another second line, theirs another last line, some documents both in one place."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("x"))
    n = F.size("x")
    put = lambda i, s: F.transform("x", lambda v, k: F.when(k == i, F.concat(v, F.lit(s))).otherwise(v))
    ours = F.concat(put(F.lit(1), " (ours)"), F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("added by ours"))).otherwise(F.array().cast("array<string>")))
    theirs = F.when(F.col("doc_id") % 3 == 0, put(F.lit(1), " (theirs)")).otherwise(F.concat(put(n - 1, " (theirs)"), F.when(F.col("doc_id") % 4 == 2, F.array(F.lit("added by theirs"))).otherwise(F.array().cast("array<string>"))))
    join = lambda x: F.array_join(x, "\n")
    return docs.select("doc_id", join("x").alias("base"), join(ours).alias("ours"), join(theirs).alias("theirs"))
