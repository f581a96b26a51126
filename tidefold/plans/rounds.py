"""A synchronisation round and the administrative runs, as compositions of operators. Plans and tables only; nothing is written to a vault."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import hlc
from tidefold.operators import applying, blobs, capture, classify, graph, oplog, reconcile
from tidefold.scratch import materialize
from tidefold.sources import journals


@dataclass
class Round:
    """What a round leads to."""

    actions: DataFrame
    files: DataFrame
    new_ops: DataFrame
    entries: DataFrame
    versions: DataFrame
    heads: DataFrame
    cursor: DataFrame
    summary: DataFrame


def run(device: str, registry: DataFrame, pending: DataFrame, pulled: DataFrame, versions: DataFrame, contents: DataFrame, remote_contents: DataFrame, disk: DataFrame, decisions: DataFrame, start: int, wall: int, delete_policy: str | None = None, failures: DataFrame | None = None) -> Round:
    """One round of a device: pulled(seq and an operation) against its registry and pending operations.

    The order is that of the data: the graph grows by pending and pulled operations, the pulled ones of
    others are projected, both sides are classified, decisions are applied, open heads are folded, and the cursor stops
    before what is held. failures(id): actions that could not be carried out; they, and those that were not tried after too
    many of them, leave their files as they were and hold the cursor.
    """
    columns = pending.columns
    incoming = materialize(oplog.dedupe_by_id(pulled, "seq"))
    ops = incoming.select(*columns)
    every = materialize(graph.build(versions.select("versionId", "parents", "contentHash", "fileId", F.struct(hlc.hlc(F.lit(0), F.lit(0), F.lit("")).alias("hlcTimestamp"), F.col("versionId").alias("id")).alias("pos")).unionByName(graph.from_ops(pending.unionByName(ops)))))
    remote = materialize(oplog.project(oplog.without_own(ops, device)))
    actions = materialize(applying.decide(classify.classify(registry, remote, every, contents, remote_contents), decisions, delete_policy))
    files = applying.file_plan(actions, disk)
    if failures is None:
        failures = actions.sparkSession.createDataFrame([], "id string")
    settled = materialize(applying.settle(actions, failures))
    carried = settled.where("status in ('applied', 'deferred')").drop("status")
    made = materialize(applying.resolution_ops(carried, device, F.lit(wall)))
    entries = materialize(applying.next_entries(registry, carried, made))
    # open heads that arrived in this round
    dead = ops.where("type = 'delete'").select(F.col("id").alias("versionId"))
    live = entries.where("not deleted and headVersionId is not null and conflictParents is null").select(F.col("id").alias("fileId"), F.col("headVersionId").alias("head"))
    graph_now = every.unionByName(made.select(F.col("id").alias("versionId"), "parents", "contentHash", "fileId"))
    heads, _, held = reconcile.fold_heads(live, graph_now, contents.unionByName(remote_contents), ops.select(F.col("id").alias("versionId")), dead)
    deferred = settled.where("action = 'conflict' or status <> 'applied'").select(F.col("id").alias("fileId"))
    waiting = incoming.join(deferred, "fileId", "left_semi").select("seq").union(incoming.join(held.select(F.col("leaf").alias("id")), "id", "left_semi").select("seq"))
    cursor = blobs.safe_cursor(incoming.select("seq"), waiting, start)
    summary = applying.outcome(actions, settled.where("status in ('failed', 'skipped')").select("id"))
    return Round(actions, files, made, entries, graph_now, heads, cursor, summary)


def rebaseline(registry: DataFrame, listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """An operation for every live file."""
    return capture.capture(registry, listing, hashes, baseline=True)


def rebuild(registry: DataFrame, listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """A baseline with nothing remembered."""
    return capture.capture(registry.where(F.lit(False)), listing, hashes, baseline=True)


def reset(registry: DataFrame, listing: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry reconciled with the listing, and what is to be captured then."""
    return capture.reconcile(registry, listing), capture.capture(registry, listing, hashes)


def switch(registry: DataFrame, pending: DataFrame, versions: DataFrame, listing: DataFrame, hashes: DataFrame, vault: str, current: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int | None]:
    """(registry, pending, versions, captured, cursor) after a change to another vault.

    What belongs to the old vault is forgotten, contents and the clock are not; the files are captured as a baseline. No
    vault (blank): nothing is captured. The same vault: nothing happens, and the cursor (None) stays.
    """
    if vault.strip() == current:
        captured = capture.capture(registry, listing, hashes).where(F.lit(False))
        return registry, pending, versions, captured, None
    empty = [x.where(F.lit(False)) for x in (registry, pending, versions)]
    captured = rebuild(registry, listing, hashes)
    return *empty, captured if vault.strip() else captured.where(F.lit(False)), 0


def recheck(log: DataFrame) -> DataFrame:
    """The whole log again, from cursor 0."""
    return log.where("seq > 0")


def collect_garbage(entries: DataFrame, pending: DataFrame, versions: DataFrame, index: DataFrame, packs: DataFrame, now: int, retention: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions that stay, tombstones that go, packs' verdicts)."""
    kept, _ = graph.sweep(versions, graph.roots(entries, pending))
    kept = materialize(kept)
    pins = entries.where("size(conflictParents) >= 2").select("id")
    heads = entries.where("not deleted and headVersionId is not null").select(F.col("headVersionId").alias("versionId"))
    reach = kept.join(graph.above(heads, kept), "versionId", "left_semi").where("contentHash <> ''").select(F.col("contentHash").alias("hash")).distinct()
    return kept, capture.reclaimable(entries, pins, now), blobs.gc_plan(index, oplog.keep_set(entries, reach), packs, now, retention)


def rebuild_graph(log: DataFrame, versions: DataFrame, cursor: int) -> DataFrame:
    """The graph, made anew of the log if it was lost."""
    return graph.build(graph.from_ops(log)) if journals.graph_lost(versions, cursor) else versions
