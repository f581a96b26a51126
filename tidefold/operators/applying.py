"""Actions against state: what is to be written, logged and set. Plans only; sources.files carries them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import hlc
from tidefold.functions import text as tx
from tidefold.operators import merging

MAX_FAILURES = 20


def decide(actions: DataFrame, decisions: DataFrame, delete_policy: str | None = None) -> DataFrame:
    """actions with `decision` for deletions and binary conflicts: what was recorded for the file, else the standing policy (deletions only), else defer."""
    rows = actions.join(decisions.select("id", F.col("decision").alias("_d")), "id", "left")
    asks = F.col("action").isin("delete_conflict", "binary_conflict")
    policy = F.when(F.col("action") == "delete_conflict", F.lit(delete_policy))
    return rows.withColumn("decision", F.when(asks, F.coalesce("_d", policy, F.lit("defer")))).drop("_d")


def file_plan(actions: DataFrame, disk: DataFrame) -> DataFrame:
    """id, verb (write, move, trash), path, to_path, contentHash for the files: of decided actions and disk(path, hash).

    A file that already is as it should be is not written; a write to a new path trashes the old one. Conflicts are
    written as marked text, whose hash is given.
    """
    marked = merging.render(actions.where("action = 'conflict'")).select("id", tx.sha256(F.col("marked")).alias("_m"))
    rows = actions.join(marked, "id", "left").join(disk.select("path", F.col("hash").alias("_disk")), "path", "left")
    target = F.when(F.col("action") == "conflict", F.col("_m")).otherwise(F.col("contentHash"))
    kept = F.col("action").isin("delete_conflict", "binary_conflict") & F.col("decision").isin("keep", "local", "remote")
    writes = F.col("action").isin("write_local", "write_merge", "conflict") | kept
    trash = (F.col("action") == "delete_local") | ((F.col("action") == "delete_conflict") & (F.col("decision") == "delete"))
    verb = F.when(writes & ~F.coalesce(F.col("_disk") == target, F.lit(False)), "write").when(F.col("action") == "move_local", "move").when(trash, "trash")
    return rows.select("id", verb.alias("verb"), F.when(F.col("action") == "move_local", F.col("from_path")).otherwise(F.col("path")).alias("path"), F.when(F.col("action") == "move_local", F.col("path")).alias("to_path"), target.alias("contentHash")).where("verb is not null")


def resolution_ops(actions: DataFrame, device: str, wall: Column) -> DataFrame:
    """The operations that merges and decided conflicts add: merge nodes of both heads."""
    decided = F.col("action").isin("delete_conflict", "binary_conflict") & (F.col("decision") != "defer") & F.col("parents").isNotNull()
    rows = actions.where((F.col("action") == "write_merge") | decided)
    gone = F.coalesce(F.col("decision") == "delete", F.lit(False))
    clock = hlc.hlc(wall, F.lit(0), F.lit(device))
    return rows.select(F.lit(1).alias("v"), tx.merge_id(F.col("contentHash"), F.col("parents")).alias("id"), clock.alias("hlcTimestamp"), F.col("id").alias("fileId"), F.when(gone, "delete").otherwise("update").alias("type"), "path", "contentHash", "parents")


def next_entries(registry: DataFrame, actions: DataFrame, ops: DataFrame) -> DataFrame:
    """The registry after the actions: id, path, contentHash, deleted, headVersionId, conflictParents."""
    node = ops.select(F.col("fileId").alias("id"), F.col("id").alias("_node"), (F.col("type") == "delete").alias("_gone"))
    a = actions.select("id", "action", F.col("path").alias("_path"), F.col("contentHash").alias("_hash"), F.col("headVersionId").alias("_head"), "parents", "hlc")
    rows = registry.join(a, "id", "full_outer").join(node, "id", "left")
    acts = F.col("action").isin("write_local", "write_merge") | F.col("_node").isNotNull()
    moved = F.col("action") == "move_local"
    gone = (F.col("action") == "delete_local") | F.coalesce("_gone", F.lit(False))
    head = F.when(acts, F.coalesce("_node", "_head", hlc.to_string(F.col("hlc")))).otherwise(F.col("headVersionId"))
    open_ = F.when(F.col("action") == "conflict", F.col("parents")).when(~acts | F.col("action").isNull(), F.col("conflictParents"))
    out = rows.select("id", F.when(acts | moved, F.col("_path")).otherwise(F.col("path")).alias("path"), F.when(acts, F.col("_hash")).otherwise(F.col("contentHash")).alias("contentHash"), F.coalesce(F.when(gone, True).when(acts, False).otherwise(F.col("deleted")), F.lit(False)).alias("deleted"), head.alias("headVersionId"), open_.alias("conflictParents"))
    return out.where("path is not null")


def settle(actions: DataFrame, failures: DataFrame) -> DataFrame:
    """actions with `status`: applied, deferred, failed (in failures(id)) or skipped.

    One action that fails does not keep others from being done; but after MAX_FAILURES + 1 of them, in
    order of id, nothing more is tried.
    """
    rows = actions.join(failures.select("id", F.lit(True).alias("_f")).distinct(), "id", "left")
    # the limit is the rule: the failure that ends the run
    last = failures.select("id").distinct().join(actions.select("id"), "id", "left_semi").orderBy("id").limit(MAX_FAILURES + 1).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    rows = rows.join(F.broadcast(last), F.lit(True))  # one row
    late = (F.col("n") > MAX_FAILURES) & (F.col("id") > F.col("last"))
    deferred = F.coalesce(F.col("decision") == "defer", F.lit(False))
    status = F.when(late, "skipped").when(F.col("_f"), "failed").when(deferred, "deferred").otherwise("applied")
    return rows.withColumn("status", status).drop("_f", "n", "last")


def outcome(actions: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: applied, deferred, failed, aborted (over MAX_FAILURES) and changes to this side."""
    rows = actions.join(failures.select("id", F.lit(True).alias("_f")), "id", "left")
    failed = F.coalesce("_f", F.lit(False))
    deferred = F.coalesce(F.col("decision") == "defer", F.lit(False)) | (F.col("action") == "conflict")
    return rows.agg(F.count_if(~failed & ~deferred).alias("applied"), F.count_if(deferred).alias("deferred"), F.count_if(failed).alias("failed"), (F.count_if(failed) > MAX_FAILURES).alias("aborted"), F.count_if(tx.affects_local(F.col("action")) & ~deferred).alias("local_changes"))

