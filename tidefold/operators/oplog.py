"""The operation log and what is folded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold.functions import hlc, text


def first_of(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position, with a partial aggregate instead of a sort of each group."""
    cols = rows.columns
    kept = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*cols), F.col(position)).alias("_r"))
    return kept.select("_r.*").select(*cols)


def last_of(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position."""
    cols = rows.columns
    kept = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), F.col(position)).alias("_r"))
    return kept.select("_r.*").select(*cols)


def make_op(kind: str, clock: Column, file_id: Column, path: Column, content_hash: Column, heads: Column | None = None) -> Column:
    """An operation as a struct. heads: the known parents, one for an edit, both for a merge ("merge", "merge_delete")."""
    parents = F.array().cast("array<string>") if heads is None or kind == "create" else F.filter(heads, lambda x: x.isNotNull())
    merged = kind in ("merge", "merge_delete")
    own = text.merge_id(content_hash, parents) if merged else hlc.to_string(clock)
    return F.struct(F.lit(1).alias("v"), own.alias("id"), clock.alias("hlcTimestamp"), file_id.alias("fileId"), F.lit({"merge": "update", "merge_delete": "delete"}.get(kind, kind)).alias("type"), path.alias("path"), content_hash.alias("contentHash"), parents.alias("parents"))


def dedupe_by_id(ops: DataFrame, position: str) -> DataFrame:
    """The first occurrence of each op id."""
    return first_of(ops, "id", position)


def without_own(ops: DataFrame, device: str) -> DataFrame:
    return ops.where(F.col("hlcTimestamp.deviceId") != device)


def project(ops: DataFrame) -> DataFrame:
    """The state of every file: its last operation by clock, whatever the order of arrival.

    A move names a new path only; its head is the content version that it renamed, its first parent
    (null if it has none).
    """
    last = ops.groupBy("fileId").agg(F.max_by(F.struct("path", "contentHash", "type", "id", "parents"), F.struct("hlcTimestamp", "id")).alias("o"), F.max("hlcTimestamp").alias("hlcTimestamp"))
    head = F.when(F.col("o.type") == "move", F.try_element_at("o.parents", F.lit(1))).otherwise(F.col("o.id"))
    null = lambda kind: F.lit(None).cast(kind)
    return last.select(F.col("fileId").alias("id"), "o.path", "o.contentHash", "hlcTimestamp", (F.col("o.type") == "delete").alias("deleted"), null("string").alias("lastSyncedPath"), head.alias("headVersionId"), null("array<string>").alias("conflictParents"), null("bigint").alias("mtime"), null("bigint").alias("size"))


def upsert(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last writer wins by clock; of equal clocks what is there stays."""
    both = entries.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)))
    cols = entries.columns
    return both.groupBy(F.col("id").alias("_k")).agg(F.max_by(F.struct(*cols), F.struct("hlcTimestamp", "_old")).alias("r")).select("r.*").select(*cols)


def cancel_pending(pending: DataFrame) -> DataFrame:
    """Pending ops without those of files that were created and later deleted before anything was sent."""
    at = lambda kind, f: f(F.when(F.col("type") == kind, F.col("hlcTimestamp")))
    gone = pending.groupBy("fileId").agg(at("create", F.min).alias("c"), at("delete", F.max).alias("d")).where("c < d").select("fileId")
    return pending.join(gone, "fileId", "left_anti").select(*pending.columns)


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("type").agg(F.count("*").alias("n"))


def pending_list(pending: DataFrame) -> DataFrame:
    return pending.orderBy("hlcTimestamp")


def round_summary(pushed: DataFrame, pulled: DataFrame, deferred: DataFrame, stranded: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counts of a round, one row."""
    one = [x.agg(F.count("*").alias(k)) for k, x in (("pushed", pushed), ("pulled", pulled), ("deferred", deferred), ("stranded", stranded), ("conflicts", conflicts))]
    out = one[0].select(F.struct(*one[0].columns).alias("s"))
    for x in one[1:]:  # each side is one row
        out = out.join(x.select(F.struct(*x.columns).alias("t")), F.lit(True)).select(F.struct("s.*", "t.*").alias("s"))
    return out.select("s.*")


def deferred_only(deferred: DataFrame, conflicts: DataFrame, entries: DataFrame) -> DataFrame:
    """Deferred files that are not conflicts, with their paths."""
    return deferred.join(conflicts.select("fileId"), "fileId", "left_anti").join(entries.select(F.col("id").alias("fileId"), "path"), "fileId", "left")


def live_decisions(decisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Recorded decisions whose file is still in conflict."""
    return decisions.join(conflicts.select("fileId"), "fileId", "left_semi")


def keep_set(entries: DataFrame, reachable: DataFrame) -> DataFrame:
    """Hashes that live entries or reachable versions need."""
    live = entries.where("not deleted and contentHash <> ''").select(F.col("contentHash").alias("hash"))
    return live.union(reachable.select("hash")).distinct()


def running(ops: DataFrame) -> DataFrame:
    """ops with the version before of the same file and device."""
    return ops.withColumn("previous", F.lag("id").over(W.partitionBy("fileId", "hlcTimestamp.deviceId").orderBy("hlcTimestamp")))
