"""Registry against listing: captures, reconciliation, identity, drift, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import text as tx

TOMBSTONE_DAYS = 30


def _joined(registry: DataFrame, listing: DataFrame) -> DataFrame:
    live = registry.where("not deleted").select(F.col("path"), F.col("id").alias("r_id"), F.col("contentHash").alias("r_hash"), F.col("headVersionId").alias("r_head"), F.col("mtime").alias("r_mtime"), F.col("size").alias("r_size"))
    return listing.join(live, "path", "full_outer")


def gate(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the listing whose bytes have to be hashed: new ones, and those whose time or size differ."""
    unchanged = F.col("r_id").isNotNull() & F.col("r_mtime").eqNullSafe(F.col("mtime")) & F.col("r_size").eqNullSafe(F.col("size")) & (F.col("r_hash") != "")
    return _joined(registry, listing).where(F.col("mtime").isNotNull() & ~unchanged).select("path")


def capture(registry: DataFrame, listing: DataFrame, hashes: DataFrame, excluded: Column | None = None, limit_mb: float | None = None, aborted: bool = False, baseline: bool = False) -> DataFrame:
    """What the files on disk say against the registry: path, id, outcome, type, contentHash, parent, by path.

    hashes(path, hash) of at least the files of gate(). Outcomes: excluded, too_large, unchanged,
    refreshed, create, update, delete, dropped (a placeholder's tombstone, no op), held. Files that are too large are on disk
    all the same. With nothing on disk but live entries, as on a cold start, or after an aborted scan, no
    file is deleted ("held"). baseline: every live file gets an op.
    """
    skip = F.coalesce(excluded if excluded is not None else F.lit(False), F.lit(False))
    rows = _joined(registry, listing).withColumn("skip", skip).join(hashes.select("path", F.col("hash").alias("_hash")), "path", "left")
    on_disk = F.col("mtime").isNotNull() & ~F.col("skip")
    seen = rows.agg(F.count_if(on_disk).alias("n_disk")) if not aborted else None
    big, same_stat = tx.is_too_large(F.col("size"), limit_mb), F.col("r_mtime").eqNullSafe(F.col("mtime")) & F.col("r_size").eqNullSafe(F.col("size"))
    known, placeholder = F.col("r_id").isNotNull(), F.coalesce(F.col("r_hash") == "", F.lit(False))
    rows = rows.withColumn("hold", F.lit(True)) if aborted else rows.join(F.broadcast(seen.select((F.col("n_disk") == 0).alias("hold"))), F.lit(True))  # one row
    outcome = (
        F.when(F.col("skip"), "excluded")
        .when(on_disk & big, "too_large")
        .when(on_disk & ~known, "create")
        .when(on_disk & placeholder, "create")
        .when(on_disk & same_stat, "unchanged")
        .when(on_disk & (F.col("_hash") == F.col("r_hash")), "refreshed")
        .when(on_disk, "update")
        .when(F.col("hold"), "held")
        .when(placeholder, "dropped")
        .otherwise("delete")
    )
    rows = rows.withColumn("outcome", outcome)
    live = F.col("outcome").isin("unchanged", "refreshed") & F.lit(baseline)
    kind = F.when(F.col("outcome").isin("create", "update", "delete"), F.col("outcome")).when(live, "update")
    content = F.when(F.col("outcome").isin("create", "update"), F.col("_hash")).otherwise(F.col("r_hash"))
    return rows.select("path", F.coalesce("r_id", tx.stable_id(F.lit("file"), F.col("path"))).alias("id"), "outcome", kind.alias("type"), F.when(kind.isNotNull(), content).alias("contentHash"), F.when(F.col("outcome") != "create", F.col("r_head")).alias("parent"))


def recapture(first: DataFrame, registry: DataFrame, listing: DataFrame, hashes: DataFrame, dirty: DataFrame, **options: object) -> DataFrame:
    """first, with the rows of the paths that were edited while it ran, dirty(path), taken from a second look at registry and files."""
    again = capture(registry, listing, hashes, **options).join(dirty.select("path").distinct(), "path", "left_semi")
    return first.join(dirty.select("path"), "path", "left_anti").unionByName(again)


def mutate(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """registry after changes(kind, id, path, to_path, contentHash, hlcTimestamp, mtime, size, versionId, parents), one a file.

    A change names a file by id, or by the path of its live entry; unknown ones change nothing. Kinds: path,
    content, stat, delete, head, conflict, clear_conflict, synced.
    """
    live = registry.where("not deleted").groupBy(F.col("path").alias("path")).agg(F.max("id").alias("_live"))
    found = changes.select(F.struct(*changes.columns).alias("c"), "id", "path").join(live, "path", "left").select(F.coalesce("id", "_live").alias("id"), "c").where("id is not null")
    rows = registry.join(found, "id", "left")
    kind = F.coalesce("c.kind", F.lit(""))

    def new(column: str, value: Column, *kinds: str) -> Column:
        return F.when(kind.isin(*kinds), value).otherwise(F.col(column)).alias(column)

    stat = kind.isin("stat") | ((kind == "content") & F.col("c.mtime").isNotNull())
    made = {
        "path": new("path", F.col("c.to_path"), "path"),
        "contentHash": new("contentHash", F.col("c.contentHash"), "content", "conflict"),
        "hlcTimestamp": new("hlcTimestamp", F.col("c.hlcTimestamp"), "path", "content", "delete", "conflict"),
        "deleted": new("deleted", F.lit(True), "delete"),
        "lastSyncedPath": new("lastSyncedPath", F.col("path"), "synced"),
        "headVersionId": new("headVersionId", F.col("c.versionId"), "head"),
        "conflictParents": F.when(kind == "conflict", F.col("c.parents")).when(kind != "clear_conflict", F.col("conflictParents")).alias("conflictParents"),
        "mtime": F.when(stat, F.col("c.mtime")).otherwise(F.col("mtime")).alias("mtime"),
        "size": F.when(stat, F.col("c.size")).otherwise(F.col("size")).alias("size"),
    }
    return rows.select(*(made.get(x, F.col(x)) for x in registry.columns))


def capture_stats(captured: DataFrame) -> DataFrame:
    return captured.agg(F.count_if(~F.col("outcome").isin("excluded", "delete", "dropped", "held")).alias("files"), F.count("type").alias("ops"), F.count_if(F.col("outcome") == "too_large").alias("too_large"))


def reconcile(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """path, id, change: added (an untracked file, no hash yet), tombstoned (gone from disk) or kept."""
    change = F.when(F.col("r_id").isNull(), "added").when(F.col("mtime").isNull(), "tombstoned").otherwise("kept")
    return _joined(registry, listing).select("path", F.coalesce("r_id", tx.stable_id(F.lit("file"), F.col("path"))).alias("id"), change.alias("change"))


def register(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """For paths(path): the id that a file there has: its own, that of a tombstone there, or a new one."""
    best = registry.groupBy("path").agg(F.max_by(F.struct("id", "deleted"), F.struct(~F.col("deleted"), "hlcTimestamp")).alias("e"))
    return paths.join(best, "path", "left").select("path", F.coalesce("e.id", tx.stable_id(F.lit("file"), F.col("path"))).alias("id"), F.when(F.col("e").isNull(), "new").when(F.col("e.deleted"), "resurrected").otherwise("tracked").alias("how"))


def adopt(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries of incoming replace those with their id and drop other ids at their path; conflicts and times are cleared."""
    new = incoming.withColumns({"conflictParents": F.lit(None).cast("array<string>"), "mtime": F.lit(None).cast("bigint"), "size": F.lit(None).cast("bigint")})
    rest = registry.join(incoming.select("id"), "id", "left_anti").join(incoming.where("not deleted").select("path"), "path", "left_anti")
    return rest.select(*registry.columns).unionByName(new.select(*registry.columns))


def reclaimable(registry: DataFrame, pinned: DataFrame, now: int, days: float | None = None) -> DataFrame:
    """Tombstones that nothing needs and that are old enough: at least 30 days, whatever is asked."""
    span = int(max(days, TOMBSTONE_DAYS) if days is not None and days == days else TOMBSTONE_DAYS) * 86_400_000
    return registry.where(F.col("deleted") & F.col("conflictParents").isNull() & (F.col("hlcTimestamp.wallTime") <= now - span)).join(pinned.select("id"), "id", "left_anti").select("id")


def identity(registry: DataFrame, listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """Live entries with the hash that is on disk: the recorded one where time and size agree and a head is known, else the one in hashes(path, hash)."""
    rows = registry.where("not deleted").alias("e").join(listing.select("path", F.col("mtime").alias("d_mtime"), F.col("size").alias("d_size")), "path", "left").join(hashes.select("path", "hash"), "path", "left")
    trust = F.col("headVersionId").isNotNull() & (F.col("contentHash") != "") & F.col("mtime").eqNullSafe(F.col("d_mtime")) & F.col("size").eqNullSafe(F.col("d_size"))
    return rows.select("id", "path", F.when(trust, F.col("contentHash")).otherwise(F.coalesce("hash", "contentHash")).alias("contentHash"), (~trust).alias("rehashed"))


def drifted(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose hash now is not that of the snapshot."""
    return snapshot.join(current.select("path", F.col("contentHash").alias("now")), "path").where("not (now <=> contentHash)").select("path")


def advance_synced(registry: DataFrame, actions: DataFrame, deferred: DataFrame) -> DataFrame:
    """registry with lastSyncedPath set for files that are as the other side has them, or were sent for the first time."""
    done = actions.where("action in ('no_op', 'send_remote')").join(deferred.select("id"), "id", "left_anti").select("id", "action")
    rows = registry.join(done, "id", "left")
    moves = F.col("action").isNotNull() & ~F.col("deleted") & ((F.col("action") == "no_op") | F.col("lastSyncedPath").isNull())
    return rows.withColumn("lastSyncedPath", F.when(moves, F.col("path")).otherwise(F.col("lastSyncedPath"))).select(*registry.columns)
