"""What two replicas do about every file: one action for each id of either side.

A full outer join on id, lookups of live paths, facts of the version graph for pairs of heads, and a
CASE whose first true guard names the rule. Texts are fetched and merged only for rows that need it.

Two live ids at one path of a side: the larger id holds the path. Insertions of both sides at one place
are kept local first, as three_way() has it; canonical=True makes it the same on both devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions import text as tx
from tidefold.operators import graph, merging, textmerge
from tidefold.scratch import materialize

_FIELDS = ("id", "path", "contentHash", "hlcTimestamp", "deleted", "lastSyncedPath", "headVersionId", "conflictParents")


def _side(entries: DataFrame, name: str) -> DataFrame:
    return entries.select(F.col("id"), F.struct(*_FIELDS).alias(name))


def _live_paths(entries: DataFrame, name: str) -> DataFrame:
    """The live entry of each path."""
    return entries.where("not deleted").groupBy(F.col("path").alias("_p")).agg(F.max_by(F.struct(*_FIELDS), F.col("id")).alias(name))


def _held(rows: DataFrame, hashes: dict[str, Column], stores: dict[str, DataFrame]) -> DataFrame:
    """rows with a boolean `<hash>_<store>` for each: are the bytes there. The stores are read once, for the hashes that are asked for."""
    asked = rows.select(F.explode(F.array_distinct(F.array(*hashes.values()))).alias("hash")).where("hash is not null").distinct()
    every = None
    for s, contents in stores.items():
        one = contents.select("hash", *(F.lit(x == s).alias(x) for x in stores))
        every = one if every is None else every.unionByName(one)
    there = materialize(every.join(asked, "hash", "left_semi").groupBy("hash").agg(*(F.max(x).alias(x) for x in stores)))
    for k, column in hashes.items():
        rows = rows.withColumn("_q", column).join(there.select(F.col("hash").alias("_h"), *(F.col(x).alias(f"{k}_{x}") for x in stores)), F.col("_q") == F.col("_h"), "left").drop("_q", "_h")
        rows = rows.withColumns({f"{k}_{x}": F.coalesce(f"{k}_{x}", F.lit(False)) for x in stores})
    return rows


def classify(local: DataFrame, remote: DataFrame, versions: DataFrame, local_contents: DataFrame, remote_contents: DataFrame, canonical: bool = False) -> DataFrame:
    """One row per id: rule, action, path, from_path, contentHash, headVersionId, parents, hlc, side and, of text merges, merge."""
    rows = _side(local, "l").join(_side(remote, "r"), "id", "full_outer")
    rows = rows.join(_live_paths(remote, "ro"), F.col("l.path") == F.col("_p"), "left").drop("_p")
    rows = rows.join(_live_paths(local, "lo"), F.col("r.path") == F.col("_p"), "left").drop("_p")
    both, only_l, only_r = F.col("l.id").isNotNull() & F.col("r.id").isNotNull(), F.col("r.id").isNull(), F.col("l.id").isNull()
    # a side alone whose path another id of the other side holds meets that one
    hit = F.when(only_r & ~F.col("r.deleted") & (F.col("lo.id") != F.col("r.id")), "remote").when(only_l & ~F.col("l.deleted") & (F.col("ro.id") != F.col("l.id")), "local")
    rows = rows.withColumn("hit", hit)
    rows = rows.withColumn("a", F.when(F.col("hit") == "remote", F.col("lo")).otherwise(F.col("l"))).withColumn("b", F.when(F.col("hit") == "local", F.col("ro")).otherwise(F.col("r")))
    # files on which both sides agree are done: M13, whatever the graph says
    agreed = F.coalesce(both & ~F.col("a.deleted") & ~F.col("b.deleted") & (F.col("a.headVersionId") == F.col("b.headVersionId")) & (F.col("a.contentHash") == F.col("b.contentHash")) & (F.col("a.path") == F.col("b.path")), F.lit(False))
    rows = materialize(rows.withColumn("agreed", agreed).drop("l", "r", "lo", "ro"))
    done, rows = rows.where("agreed").select("id"), rows.where("not agreed").drop("agreed")

    heads = rows.where("a is not null and b is not null and a.headVersionId is not null and b.headVersionId is not null")
    facts = graph.pair_facts(heads.select(F.col("id").alias("pair"), F.col("a.headVersionId").alias("a"), F.col("b.headVersionId").alias("b"), F.col("a.conflictParents").alias("opens")), versions).drop("a", "b")
    node = lambda key, *more: versions.select(F.col("versionId").alias(key), *more)
    rows = materialize(rows.join(facts.withColumnRenamed("pair", "id"), "id", "left"))
    asked = rows.select(F.explode(F.array_distinct(F.array("a.headVersionId", "b.headVersionId", "base"))).alias("versionId")).distinct()
    versions = materialize(versions.join(asked, "versionId", "left_semi"))
    rows = rows.withColumn("_k", F.col("a.headVersionId")).join(node("_k", F.nullif("contentHash", F.lit("")).alias("head_hash")), "_k", "left").drop("_k")
    rows = rows.withColumn("_k", F.col("b.headVersionId")).join(node("_k", graph.is_merge_node(F.col("parents")).alias("b_merges")), "_k", "left").drop("_k")
    rows = rows.withColumn("_k", F.col("base")).join(node("_k", F.nullif("contentHash", F.lit("")).alias("base_hash")), "_k", "left").drop("_k")
    rows = _held(rows, {"ah": F.col("a.contentHash"), "bh": F.col("b.contentHash"), "zh": F.col("base_hash")}, {"l": local_contents, "r": remote_contents})

    yes = lambda x: F.coalesce(x, F.lit(False))
    le, re = F.col("a"), F.col("b")
    known = le["headVersionId"].isNotNull() & re["headVersionId"].isNotNull()
    fwd, back = yes(F.col("a_above_b")), yes(F.col("b_above_a"))
    at_head = yes(F.col("head_hash") == le["contentHash"])
    a_any, b_any = F.col("ah_l") | F.col("ah_r"), F.col("bh_l") | F.col("bh_r")
    same, live = le["contentHash"] == re["contentHash"], ~le["deleted"] & ~re["deleted"]
    local_wins = le["hlcTimestamp"] >= re["hlcTimestamp"]
    same_heads = le["headVersionId"] == re["headVersionId"]
    resolved = known & yes(F.col("b_merges")) & fwd
    still = lambda x, other: yes(F.col("base_hash") == x["contentHash"]) & yes(~F.col("ambiguous")) & yes(F.coalesce(x["path"] == F.coalesce(x["lastSyncedPath"], other["lastSyncedPath"]), F.lit(True)))
    mine = F.col("hit") == "local"  # whose branch a collision is judged in
    remote_wins_id = F.struct(re["hlcTimestamp"], re["id"]) > F.struct(le["hlcTimestamp"], le["id"])
    two_headed = F.coalesce(F.size(le["conflictParents"]) >= 2, F.lit(False))
    opens_ok = yes(F.col("b_merges")) & yes(F.col("opens_above_b"))

    def adopt(rule: str) -> list[tuple[Column, str]]:
        return [(~mine & (b_any | F.col("ah_l")), f"{rule}:adopt"), (F.lit(True), f"{rule}:no_op")]

    def nest(options: list[tuple[Column, str]]) -> Column:
        out = F.lit(None).cast("string")
        for guard, x in reversed(options):
            out = F.when(guard, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
        return out

    is_hit = F.col("hit").isNotNull()
    collision = nest([
        (known & fwd, nest(adopt("M20"))),
        (known & back, "M20:no_op"),
        (same & remote_wins_id, nest(adopt("M20"))),
        (same, "M20:no_op"),
        (~F.col("ah_l") | ~F.col("bh_r"), "M20:no_op"),
        (F.when(mine, ~remote_wins_id).otherwise(remote_wins_id), "M20:whole"),
        (F.lit(True), "M20:no_op"),
    ])
    same_content = nest([
        ((le["path"] != re["path"]) & local_wins, "M9:no_op"),
        (le["path"] != re["path"], "M9:move_local"),
        (~known | same_heads, "M13:no_op"),
        (back, "M10:no_op"),
        (at_head & fwd & a_any, "M11:adopt"),
        (at_head & ~fwd & a_any, "M12:unite"),
        (F.lit(True), "M13:no_op"),
    ])
    one_deleted = nest([
        (le["deleted"] & resolved & b_any, "M14:adopt"),
        (le["deleted"] & still(re, le), "M15:delete_remote"),
        (le["deleted"] & ~b_any, "M16:no_op"),
        (le["deleted"], "M16:delete_conflict"),
        (resolved, "M17:delete_local"),
        (still(le, re), "M17:delete_local"),
        (~a_any, "M17:no_op"),
        (F.lit(True), "M17:delete_conflict"),
    ])
    texts_there = F.col("ah_l") & F.col("bh_r")
    content = nest([
        (two_headed & known & opens_ok & b_any, "M21:adopt"),
        (two_headed, "M21:no_op"),
        (known & at_head & fwd & b_any, "M22:adopt"),
        (known & at_head & fwd, "M22:no_op"),
        (known & back, "M23:no_op"),
        (~texts_there & local_wins & F.col("ah_l"), "M24:keep"),
        (~texts_there & ~local_wins & F.col("bh_r"), "M24:adopt"),
        (~texts_there, "M24:no_op"),
        (F.lit(True), "text"),
    ])
    rule = nest([
        (only_r_of(is_hit) & re["deleted"], "M1:no_op"),
        (is_hit, collision),
        (only_r_of(is_hit) & ~F.col("bh_r"), "M3:no_op"),
        (only_r_of(is_hit), "M4:adopt"),
        (re.isNull() & le["deleted"], "M5:no_op"),
        (re.isNull(), "M7:send_remote"),
        (le["deleted"] & re["deleted"], "M8:no_op"),
        (live & same, same_content),
        (~live, one_deleted),
        (F.lit(True), content),
    ])
    told = materialize(rows.withColumn("told", rule))

    # --- texts, for those that need them ------------------------------------------------------
    need = told.where("told in ('text', 'M20:whole')")
    wanted = need.select(F.explode(F.array("a.contentHash", "b.contentHash", "base_hash")).alias("hash")).distinct()
    bytes_of = materialize(local_contents.select("hash", "bytes").unionByName(remote_contents.select("hash", "bytes")).join(wanted, "hash", "left_semi").dropDuplicates(["hash"]))
    for k, h in (("lb", "a.contentHash"), ("rb", "b.contentHash"), ("zb", "base_hash")):
        need = need.withColumn("_q", F.col(h)).join(bytes_of.select(F.col("hash").alias("_h"), F.col("bytes").alias(k)), F.col("_q") == F.col("_h"), "left").drop("_q", "_h")
    binary = tx.is_binary(F.col("lb")) | tx.is_binary(F.col("rb"))
    single = yes(~F.col("ambiguous")) & F.col("base_hash").isNotNull()
    l_new, r_new = le["contentHash"] != F.col("base_hash"), re["contentHash"] != F.col("base_hash")
    how = nest([
        (F.col("told") == "M20:whole", "M20:conflict"),
        (binary & single & r_new & ~l_new, "M25:adopt"),
        (binary & single & l_new & ~r_new, "M25:no_op"),
        (binary, "M26:binary_conflict"),
        (yes(F.col("ambiguous")), "M27:conflict"),
        (F.col("base").isNotNull() & F.col("zb").isNull(), "M28:conflict"),
        (F.lit(True), "merge"),
    ])
    need = need.withColumn("how", how)
    decode = lambda x: F.coalesce(F.decode(x, "utf-8"), F.lit(""))
    sides = need.where("how = 'merge' or how like '%:conflict'").select("id", "how", decode(F.col("zb")).alias("base"), decode(F.col("lb")).alias("ours"), decode(F.col("rb")).alias("theirs"))
    merged = merging.map_rows(sides, "merge", schemas.MERGED, ["how", "base", "ours", "theirs"], lambda h, z, x, y: textmerge.three_way(z, x, y, canonical) if h == "merge" else textmerge.whole_conflict(x, y))
    need = need.drop("lb", "rb", "zb").join(merged.select("id", "merge"), "id", "left")
    clean = ~F.col("merge.hasConflicts")
    verb = F.when(clean & known, "write_merge").when(clean, "write_merged").otherwise("conflict")
    # two sides of which no common base is known merge over an empty text, M29, with one of the three outcomes
    outcome = F.when(known & F.col("base").isNull(), "M29").when(verb == "write_merge", "M30").when(verb == "write_merged", "M31").otherwise("M32")
    end = F.when(F.col("how") != "merge", F.col("how")).otherwise(F.concat_ws(":", outcome, verb))
    need = need.withColumn("told", end).drop("how")
    rest = told.where("told not in ('text', 'M20:whole')").withColumn("merge", F.lit(None).cast(schemas.MERGED))
    out = rest.unionByName(need)

    # --- the action ---------------------------------------------------------------------------
    part = F.split("told", ":")
    verb = part[1]
    merged_text = F.array_join("merge.merged", "\n")
    is_adopt, is_merge = verb == "adopt", verb == "write_merge"
    win = F.when(local_wins, le["path"]).otherwise(re["path"])
    action = F.when(verb.isin("adopt", "keep", "write_merged"), "write_local").when(verb == "unite", "write_merge").otherwise(verb)
    path = F.when(is_adopt | verb.isin("delete_remote", "move_local"), re["path"]).when(is_merge | (verb == "write_merged"), win).when((verb == "delete_conflict") & le["deleted"], re["path"]).when(verb == "no_op", F.lit(None)).otherwise(F.coalesce(le["path"], re["path"]))
    content_hash = F.when(is_adopt, re["contentHash"]).when(verb.isin("keep", "unite"), le["contentHash"]).when(is_merge | (verb == "write_merged"), tx.sha256(merged_text)).when(verb == "delete_conflict", F.when(le["deleted"], re["contentHash"]).otherwise(le["contentHash"]))
    head = F.when(is_adopt, re["headVersionId"]).when(verb == "keep", le["headVersionId"])
    clock = F.when(is_adopt, re["hlcTimestamp"]).when(verb.isin("keep", "send_remote"), le["hlcTimestamp"]).when(verb == "write_merged", F.greatest(le["hlcTimestamp"], re["hlcTimestamp"]))
    parents = F.when(verb.isin("unite", "write_merge", "conflict", "delete_conflict", "binary_conflict") & known, F.array(le["headVersionId"], re["headVersionId"]))
    told = out.select("id", part[0].alias("rule"), action.alias("action"), path.alias("path"), F.when(verb == "move_local", le["path"]).alias("from_path"), content_hash.alias("contentHash"), head.alias("headVersionId"), parents.alias("parents"), clock.alias("hlc"), F.when(verb == "delete_conflict", F.when(le["deleted"], "local_deleted").otherwise("remote_deleted")).alias("side"), "merge")
    nothing = [F.lit(None).cast(told.schema[x].dataType).alias(x) for x in told.columns[3:]]
    return told.unionByName(done.select("id", F.lit("M13").alias("rule"), F.lit("no_op").alias("action"), *nothing))


def only_r_of(is_hit: Column) -> Column:
    """Rows of the remote side alone that met no other file."""
    return F.col("a").isNull() & ~is_hit


def converged(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Ids for which nothing is to be done: live on both sides with equal known heads, hash and path."""
    other = remote.select("id", *(F.col(x).alias(f"_{x}") for x in ("path", "contentHash", "headVersionId", "deleted")))
    return local.join(other, "id").where("not deleted and not _deleted and headVersionId is not null and headVersionId = _headVersionId and contentHash = _contentHash and path = _path").select("id")


def needed_hashes(local: DataFrame, remote: DataFrame, reachable: DataFrame) -> DataFrame:
    """Hashes that a merge may need: of files not converged, and of local files whose path another remote id has. reachable(id, hash)."""
    ids = remote.select("id").join(converged(local, remote), "id", "left_anti")
    met = local.alias("l").join(remote.where("not deleted").select(F.col("path").alias("p"), F.col("id").alias("rid")), F.col("path") == F.col("p")).where("id <> rid and not deleted").join(remote.select("id"), "id", "left_anti").select("id")
    ids = ids.union(met).distinct()
    own = local.unionByName(remote).join(ids, "id", "left_semi").where("contentHash <> ''").select(F.col("contentHash").alias("hash"))
    return own.union(reachable.join(ids, "id", "left_semi").select("hash")).distinct()
