"""Content-addressed bytes: dedup, packs, retention, compaction, batches, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold.scratch import materialize


def dedup(contents: DataFrame) -> DataFrame:
    """One row for each hash; bytes of a hash are equal, so any will do."""
    return contents.dropDuplicates(["hash"])


def has(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    return hashes.join(contents.select("hash"), "hash", "left_semi")


def pack_stats(index: DataFrame, keep: DataFrame) -> DataFrame:
    """packId, n, live, bytes, live_bytes of every pack."""
    rows = index.join(keep.select("hash", F.lit(True).alias("live")), "hash", "left")
    live = F.coalesce("live", F.lit(False))
    return rows.groupBy("packId").agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.sum("len").alias("bytes"), F.coalesce(F.sum(F.when(live, F.col("len"))), F.lit(0)).cast("bigint").alias("live_bytes"))


def gc_plan(index: DataFrame, keep: DataFrame, packs: DataFrame, now: int, retention: int, fraction: float = 0.5) -> DataFrame:
    """packId, verdict: packs past retention retire without live blobs, and are compacted below a live fraction; young or undated ones stay."""
    rows = pack_stats(index, keep).join(packs.select("packId", "mtime"), "packId", "left")
    aged = F.coalesce(now - F.col("mtime") >= retention, F.lit(False))
    verdict = F.when(~aged, "keep").when(F.col("live") == 0, "retire").when(F.col("live") / F.col("n") < fraction, "compact").otherwise("keep")
    return rows.select("packId", "n", "live", verdict.alias("verdict"))


def consolidation_plan(index: DataFrame, keep: DataFrame, threshold: int = 64, skip_single: bool = False) -> DataFrame:
    """packId, verdict: retire, merge (few live blobs), compact (some dead) or leave. skip_single: one small pack with nothing dead is left."""
    rows = pack_stats(index, keep)
    verdict = F.when(F.col("live") == 0, "retire").when(F.col("live") < threshold, "merge").when(F.col("live") < F.col("n"), "compact").otherwise("leave")
    rows = rows.withColumn("verdict", verdict)
    if skip_single:
        one = rows.where("verdict = 'merge'").agg(F.count("*").alias("m"), F.sum(F.col("n") - F.col("live")).alias("dead"))
        rows = rows.join(F.broadcast(one), F.lit(True))  # one row
        rows = rows.withColumn("verdict", F.when((F.col("verdict") == "merge") & (F.col("m") == 1) & (F.col("dead") == 0), "leave").otherwise(F.col("verdict")))
    return rows.select("packId", "n", "live", "verdict")


def numbered(rows: DataFrame, order: list[str | Column], name: str = "_n") -> DataFrame:
    """rows numbered from 0 in an order: sorted by range into parts, counted, and numbered within them."""
    cols = rows.columns
    ordered = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ordered = materialize(ordered)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_c"))
    start = counts.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_s"))  # a row for each part
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ordered.withColumn("_w", within).join(F.broadcast(start), "_part").select(*cols, (F.col("_s") + F.col("_w")).alias(name))


def rewrite_plan(index: DataFrame, keep: DataFrame, plan: DataFrame, flush: int = 256) -> DataFrame:
    """hash, newPack for the live blobs of packs to be merged: new packs of `flush` blobs by hash."""
    some = index.join(plan.where("verdict in ('merge', 'compact')").select("packId"), "packId", "left_semi").join(keep, "hash", "left_semi").select("hash").distinct()
    return numbered(some, ["hash"]).select("hash", F.floor(F.col("_n") / flush).alias("newPack"))


def compacted(index: DataFrame, contents: DataFrame, keep: DataFrame) -> DataFrame:
    """hash, bytes of live blobs that verify; others are dropped."""
    return contents.join(index.select("hash"), "hash", "left_semi").join(keep, "hash", "left_semi").where(F.sha2("bytes", 256) == F.col("hash"))


def compact(index: DataFrame, packs: DataFrame, keep: DataFrame, plan: DataFrame, flush: int = 256) -> tuple[DataFrame, DataFrame]:
    """(index, packs) after a plan of gc_plan() or consolidation_plan(): packs to be retired, merged or compacted go, and their
    live blobs that verify are written to new ones; the others stay as they are."""
    from tidefold.sources import journals

    gone = materialize(plan.where("verdict in ('retire', 'merge', 'compact')").select("packId"))
    old = index.join(gone, "packId", "left_semi")
    live = materialize(compacted(old, journals.read_packed(old, packs.join(gone, "packId", "left_semi")), keep))
    first = journals.next_pack(index).first()["n"]
    new_index, new_packs = journals.write_packs(live, flush, first)
    stay = lambda x: x.join(gone, "packId", "left_anti")
    return stay(index).unionByName(new_index), stay(packs).unionByName(new_packs)


def resolve_tiers(wanted: DataFrame, registry: DataFrame, index: DataFrame, remote: DataFrame) -> DataFrame:
    """fileId, hash, tier: 0 the registry has it for this file, 1 a pack has it, 2 the server has it; null: missing."""
    own = registry.where("not deleted").select(F.col("id").alias("fileId"), F.col("contentHash").alias("hash"), F.lit(True).alias("t0")).distinct()
    rows = wanted.join(own, ["fileId", "hash"], "left")
    rows = rows.join(index.select("hash", F.lit(True).alias("t1")).distinct(), "hash", "left").join(remote.select("hash", F.lit(True).alias("t2")).distinct(), "hash", "left")
    return rows.select("fileId", "hash", F.when(F.col("t0"), 0).when(F.col("t1"), 1).when(F.col("t2"), 2).alias("tier"))


def upload_batches(blobs: DataFrame, held: DataFrame, count: int = 256, size: int = 32 << 20) -> DataFrame:
    """hash, len, batch of blobs that the server lacks: at most `count` a batch, and about `size` bytes."""
    missing = blobs.join(held.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    rows = numbered(missing.select("hash", "len"), ["hash"])
    group = F.floor(F.col("_n") / count)
    bytes_ = F.sum("len").over(W.partitionBy("_g").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)) - F.col("len")
    return rows.withColumn("_g", group).withColumn("_b", F.floor(bytes_ / size)).select("hash", "len", F.struct(F.col("_g").alias("group"), F.col("_b").alias("part")).alias("batch"))


def op_chunks(ops: DataFrame, size: int) -> DataFrame:
    return numbered(ops, ["hlcTimestamp"]).withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def safe_cursor(pulled: DataFrame, held: DataFrame, start: int) -> DataFrame:
    """One row, cursor: the last seq pulled, but before any held one, and not before the start."""
    top = pulled.agg(F.max("seq").alias("top"))
    low = held.agg(F.min("seq").alias("low"))
    return top.join(low, F.lit(True)).select(F.greatest(F.lit(start).cast("bigint"), F.least(F.coalesce("top", F.lit(start)), F.coalesce(F.col("low") - 1, F.col("top"), F.lit(start)))).alias("cursor"))
