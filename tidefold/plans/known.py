"""Queries with known answers: every rule of merging, texts and small operators over whole tables, and what SQL says of them."""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas, scratch
from tidefold.functions import hlc
from tidefold.functions import text as tx
from tidefold.operators import applying, blobs, capture, classify, graph, merging, oplog
from tidefold.plans import fixtures, rounds
from tidefold.plans.queries import HEADS, PACKS, PROJECT, RECURSIVE, REGISTRY, SQL, _disk, _entries, _keep, _list, _ops, _t, _versions, query
from tidefold.scratch import materialize
from tidefold.sources import crypto, files, journals
from tidefold.streaming import ingest

# --- merge rules: each customer is a vault with one case ------------------------------------------

#: Texts of the cases.
TEXTS = {"base": "a\nb\nc", "left": "A\nb\nc", "right": "a\nb\nC", "clash": "X\nb\nc", "bin": "a\0b", "bin2": "a\0c", "gone": "lost"}
#: versionId, parents, text of the cases' graph.
GRAPH = [("v0", [], "base"), ("l1", ["v0"], "left"), ("r1", ["v0"], "right"), ("x1", ["v0"], "clash"), ("m", ["l1", "r1"], "right"), ("P", [], "left"), ("Q", [], "right"), ("c1", ["P", "Q"], "left"), ("c2", ["P", "Q"], "right"), ("s1", ["lost"], "left"), ("s2", ["lost"], "right"), ("b0", [], "bin"), ("b1", ["b0"], "bin2"), ("b2", ["b0"], "left"), ("w", ["v0"], "base")]


def _e(i="f", path="p", text="base", wall=10, head=None, deleted=False, synced=None, opens=None):
    return (i, path, text, wall, head, deleted, synced, opens)


#: (local entries, remote entries, answers: id, rule, action, path, text, head, parents).
CASES = [
    ([], [_e(deleted=True)], [("f", "M1", "no_op", None, None, None, None)]),
    ([_e("a", text="left", wall=9)], [_e("b", text="right", wall=5)], [("a", "M20", "conflict", "p", None, None, None), ("b", "M20", "no_op", None, None, None, None)]),
    ([_e("a", text="left", wall=5)], [_e("b", text="right", wall=9)], [("a", "M20", "no_op", None, None, None, None), ("b", "M20", "conflict", "p", None, None, None)]),
    ([_e("a", wall=5)], [_e("b", wall=5)], [("a", "M20", "no_op", None, None, None, None), ("b", "M20", "write_local", "p", "base", None, None)]),
    ([_e("a", text="left", head="l1")], [_e("b", text="right", head="m")], [("a", "M20", "no_op", None, None, None, None), ("b", "M20", "write_local", "p", "right", "m", None)]),
    ([], [_e(text="gone")], [("f", "M3", "no_op", None, None, None, None)]),
    ([], [_e(head="r1")], [("f", "M4", "write_local", "p", "base", "r1", None)]),
    ([_e(deleted=True)], [], [("f", "M5", "no_op", None, None, None, None)]),
    ([_e(text="gone")], [], [("f", "M7", "send_remote", "p", None, None, None)]),
    ([_e(deleted=True)], [_e(deleted=True)], [("f", "M8", "no_op", None, None, None, None)]),
    ([_e(path="a", wall=5)], [_e(path="b", wall=9)], [("f", "M9", "move_local", "b", None, None, None)]),
    ([_e(path="a", wall=9)], [_e(path="b", wall=9)], [("f", "M9", "no_op", None, None, None, None)]),
    ([_e(text="right", head="m")], [_e(text="right", head="r1")], [("f", "M10", "no_op", None, None, None, None)]),
    ([_e(text="right", head="r1")], [_e(text="right", head="m")], [("f", "M11", "write_local", "p", "right", "m", None)]),
    ([_e(text="left", head="l1")], [_e(text="left", head="P")], [("f", "M12", "write_merge", "p", "left", None, ["P", "l1"])]),
    ([_e()], [_e()], [("f", "M13", "no_op", None, None, None, None)]),
    ([_e(text="right", head="v0")], [_e(text="right", head="r1")], [("f", "M13", "no_op", None, None, None, None)]),
    ([_e(text="right", head="r1")], [_e(text="right", head="r1")], [("f", "M13", "no_op", None, None, None, None)]),
    ([_e(deleted=True, head="l1")], [_e(text="right", head="m")], [("f", "M14", "write_local", "p", "right", "m", None)]),
    ([_e(deleted=True, head="w")], [_e(head="v0", synced="p")], [("f", "M15", "delete_remote", "p", None, None, None)]),
    ([_e(deleted=True, head="l1")], [_e(text="right", head="r1")], [("f", "M16", "delete_conflict", "p", "right", None, ["l1", "r1"])]),
    ([_e(deleted=True, head="l1")], [_e(text="gone", head="r1")], [("f", "M16", "no_op", None, None, None, None)]),
    ([_e(text="left", head="l1")], [_e(deleted=True, head="m")], [("f", "M17", "delete_local", "p", None, None, None)]),
    ([_e(text="left", head="l1")], [_e(deleted=True, head="r1")], [("f", "M17", "delete_conflict", "p", "left", None, ["l1", "r1"])]),
    ([_e(text="clash", head="l1", opens=["l1", "r1"])], [_e(text="right", head="m")], [("f", "M21", "write_local", "p", "right", "m", None)]),
    ([_e(text="clash", head="l1", opens=["l1", "x1"])], [_e(text="right", head="m")], [("f", "M21", "no_op", None, None, None, None)]),
    ([_e(head="v0")], [_e(text="right", head="r1")], [("f", "M22", "write_local", "p", "right", "r1", None)]),
    ([_e(head="v0")], [_e(text="gone", head="r1")], [("f", "M22", "no_op", None, None, None, None)]),
    ([_e(text="left", head="l1")], [_e(head="v0")], [("f", "M23", "no_op", None, None, None, None)]),
    ([_e(text="left", wall=9)], [_e(text="gone")], [("f", "M24", "no_op", None, None, None, None)]),
    ([_e(text="left", wall=99)], [_e(text="gone")], [("f", "M24", "write_local", "p", "left", None, None)]),
    ([_e(text="bin", head="b2")], [_e(text="bin2", head="b1")], [("f", "M25", "write_local", "p", "bin2", "b1", None)]),
    ([_e(text="bin2", head="b1")], [_e(text="left", head="b2")], [("f", "M26", "binary_conflict", "p", None, None, ["b1", "b2"])]),
    ([_e(text="left", head="c1")], [_e(text="right", head="c2")], [("f", "M27", "conflict", "p", None, None, ["c1", "c2"])]),
    ([_e(text="left", head="s1")], [_e(text="right", head="s2")], [("f", "M28", "conflict", "p", None, None, ["s1", "s2"])]),
    ([_e(text="left", head="P")], [_e(text="right", head="Q")], [("f", "M29", "conflict", "p", None, None, ["P", "Q"])]),
    ([_e(path="a", text="left", head="l1", wall=20)], [_e(path="b", text="right", head="r1")], [("f", "M30", "write_merge", "a", "A\nb\nC", None, ["l1", "r1"])]),
    ([_e(text="left", wall=20)], [_e(text="right")], [("f", "M32", "conflict", "p", None, None, None)]),
    ([_e(text="left", head="l1")], [_e(text="clash", head="x1")], [("f", "M32", "conflict", "p", None, None, ["l1", "x1"])]),
]
_SIDE = "k int, id string, path string, text string, wall bigint, head string, deleted boolean, synced string, opens array<string>"


def _vaults(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("vault"), F.pmod(F.col("c_custkey"), F.lit(len(CASES))).cast("int").alias("k"))


def _own(x: str) -> F.Column:
    return F.concat("vault", F.lit("."), F.col(x))


def case_replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, versions, contents): a case for each customer, with ids, paths and a graph of its own."""
    vaults = _vaults(spark, d)

    def side(n: int) -> DataFrame:
        rows = spark.createDataFrame([(k, i, path, TEXTS[text], *rest) for k, case in enumerate(CASES) for i, path, text, *rest in case[n]], _SIDE)
        rows = vaults.join(F.broadcast(rows), "k")  # as many rows as there are cases
        return materialize(rows.select(_own("id").alias("id"), _own("path").alias("path"), tx.sha256(F.col("text")).alias("contentHash"), hlc.hlc(F.col("wall"), F.lit(0), F.lit("d")).alias("hlcTimestamp"), "deleted", _own("synced").alias("lastSyncedPath"), _own("head").alias("headVersionId"), F.transform("opens", lambda x: F.concat("vault", F.lit("."), x)).alias("conflictParents"), F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("bigint").alias("size")))

    strings = lambda x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    nodes = vaults.select("vault", F.inline(F.array(*(F.struct(F.lit(v).alias("v"), strings(p).alias("parents"), F.lit(TEXTS[t]).alias("text")) for v, p, t in GRAPH))))
    versions = nodes.select(_own("v").alias("versionId"), F.transform("parents", lambda x: F.concat("vault", F.lit("."), x)).alias("parents"), tx.sha256(F.col("text")).alias("contentHash"), F.col("vault").alias("fileId"))
    held = spark.createDataFrame([(v,) for k, v in TEXTS.items() if k != "gone"], "text string")
    return side(0), side(1), materialize(versions), held.select(tx.sha256(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("bytes"))


def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _answers() -> str:
    rows = []
    for k, (_, _, told) in enumerate(CASES):
        for i, rule, action, path, text, head, parents in told:
            content = None if text is None else hashlib.sha256(TEXTS.get(text, text).encode()).hexdigest()
            rows.append(f"({k}, {_quoted(i)}, {_quoted(rule)}, {_quoted(action)}, {_quoted(path)}, {_quoted(content)}, {_quoted(head)}, {_quoted(parents and ','.join(sorted(parents)))})")
    return ", ".join(rows)


@query(f"""with c(k, i, rule, action, path, h, head, parents) as (values {_answers()})
select c_custkey || '.' || i as id, rule, action, c_custkey || '.' || path as path, h as "contentHash", c_custkey || '.' || head as "headVersionId",
    array_to_string(list_sort(list_transform(string_split(parents, ','), lambda x: c_custkey || '.' || x)), ',') as parents from customer join c on c_custkey % {len(CASES)} = k""", fixture=False)
def merge_rules(spark, d):
    """A case of each rule for every customer, its answer known."""
    out = classify.classify(*case_replicas(spark, d)[:3], *[case_replicas(spark, d)[3]] * 2)
    return out.select("id", "rule", "action", "path", "contentHash", "headVersionId", F.when(F.col("parents").isNotNull(), _list("parents")).alias("parents"))


@query(f"""with c(k, i, rule, action, path, h, head, parents) as (values {_answers()}), a as (select c_custkey || '.' || i as id, c.* from customer join c on c_custkey % {len(CASES)} = k)
select id, case when action in ('write_local', 'write_merge', 'delete_conflict') then 'write' when action = 'conflict' then 'write' when action = 'move_local' then 'move' else 'trash' end as verb,
    split_part(id, '.', 1) || '.' || (case when action = 'move_local' then 'a' else path end) as path, case when action = 'move_local' then split_part(id, '.', 1) || '.' || path end as to_path
from a where action in ('write_local', 'write_merge', 'conflict', 'delete_conflict', 'move_local', 'delete_local')""", fixture=False)
def file_plan(spark, d):
    """What the cases' actions do to files; deletions in conflict are kept, as the policy says."""
    l, r, v, x = case_replicas(spark, d)
    actions = materialize(applying.decide(classify.classify(l, r, v, x, x), spark.createDataFrame([], "id string, decision string"), "keep"))
    return applying.file_plan(actions, spark.createDataFrame([], "path string, hash string")).select("id", "verb", "path", "to_path")


@query(f"""with c(k, i, rule, action, path, h, head, parents) as (values {_answers()}), a as (select c_custkey, i, c.* exclude (i) from customer join c on c_custkey % {len(CASES)} = k where action in ('write_merge', 'delete_conflict')),
p as (select *, list_sort(list_transform(string_split(parents, ','), lambda x: c_custkey || '.' || x)) as ps from a)
select 'm-' || sha256(concat_ws('|', h, array_to_string(ps, '|'))) as id, c_custkey || '.' || i as "fileId", case when action = 'delete_conflict' then 'delete' else 'update' end as type, c_custkey || '.' || path as path, h as "contentHash", array_to_string(ps, ',') as parents from p""", fixture=False)
def merge_ops(spark, d):
    """The operations that merges and conflicts decided by record add; ids of merge nodes."""
    l, r, v, x = case_replicas(spark, d)
    told = materialize(classify.classify(l, r, v, x, x))
    decided = told.where("action in ('delete_conflict', 'binary_conflict')").select("id", F.when(F.col("action") == "delete_conflict", "delete").otherwise("defer").alias("decision"))
    made = applying.resolution_ops(applying.decide(told, decided, "keep"), "dev-1", F.lit(1_800_000_000_000))
    return made.select("id", "fileId", "type", "path", "contentHash", _list("parents").alias("parents"))


@query(f"""with c(k, i, rule, action, path, h, head, parents) as (values {_answers()}), a as (select c_custkey || '.' || i as id, action from customer join c on c_custkey % {len(CASES)} = k),
n as (select id, action, id in (select id from a order by id limit 21) as early, row_number() over (order by id) as rn from a where action = 'no_op'),
last as (select max(id) as last from (select id from a where action = 'no_op' order by id limit 21))
select status, count(*) as n from (select case when id > last then 'skipped' when action = 'no_op' then 'failed' when action in ('delete_conflict', 'binary_conflict') then 'deferred' else 'applied' end as status from a, last) group by status""", fixture=False)
def apply_failures(spark, d):
    """Every no-op said to have failed; after the twenty-first, in order of id, nothing is tried."""
    l, r, v, x = case_replicas(spark, d)
    actions = materialize(applying.decide(classify.classify(l, r, v, x, x), spark.createDataFrame([], "id string, decision string")))
    return applying.settle(actions, actions.where("action = 'no_op'").select("id")).groupBy("status").agg(F.count("*").alias("n"))


def _after() -> str:
    """The registry of each case after its actions, deletions in conflict kept: case, id, path, hash, deleted, head, parents of a new merge node, open heads."""
    rows = []
    for k, (local, remote, told) in enumerate(CASES):
        mine, other = {e[0]: e for e in local}, {e[0]: e for e in remote}
        for i, _, action, path, text, head, parents in told:
            old = mine.get(i)
            sha = lambda t: hashlib.sha256(TEXTS.get(t, t).encode()).hexdigest()
            if action in ("write_local", "write_merge", "delete_conflict"):
                merged = action != "write_local"
                clock = max(e[3] for e in (old, other.get(i)) if e and e[2] == text) if not merged else 0
                row = (path, sha(text), False, None if merged else head, None, parents if merged else None, None if merged or head else f"{clock:015d}-00000000-d")
            elif old is None:
                continue
            else:
                row = (path if action == "move_local" else old[1], sha(old[2]), old[5] or action == "delete_local", old[4], parents if action == "conflict" else old[7], None, None)
            path_, h, deleted, head_, open_, node, own = row
            rows.append("(" + ", ".join([str(k), _quoted(i), _quoted(path_), _quoted(h), str(deleted).lower(), _quoted(head_), _quoted(open_ and ",".join(sorted(open_))), _quoted(node and ",".join(sorted(node))), _quoted(own)]) + ")")
    return ", ".join(rows)


@query(f"""with c(k, i, path, h, deleted, head, open, node, own) as (values {_after()}), a as (select c_custkey as v, c.* from customer join c on c_custkey % {len(CASES)} = k),
s as (select *, list_sort(list_transform(string_split(node, ','), lambda x: v || '.' || x)) as ps, array_to_string(list_sort(list_transform(string_split(open, ','), lambda x: v || '.' || x)), ',') as os from a)
select v || '.' || i as id, v || '.' || path as path, h as "contentHash", deleted, case when node is not null then 'm-' || sha256(concat_ws('|', h, array_to_string(ps, '|'))) when own is not null then own else v || '.' || head end as "headVersionId", os as "conflictParents" from s""", fixture=False)
def applied_entries(spark, d):
    """The registry after the actions of every case."""
    l, r, v, x = case_replicas(spark, d)
    told = materialize(applying.decide(classify.classify(l, r, v, x, x), spark.createDataFrame([], "id string, decision string"), "keep"))
    made = applying.resolution_ops(told, "dev-1", F.lit(1_800_000_000_000))
    out = applying.next_entries(l, told, made)
    return out.select("id", "path", "contentHash", "deleted", "headVersionId", F.when(F.col("conflictParents").isNotNull(), _list("conflictParents")).alias("conflictParents"))


# --- texts: documents with numbered lines, so that every line is its own ---------------------------


def known_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, base, ours, theirs: ours changes the first line, theirs the first (every third document) or adds one at the end; of every fourth ours adds one too."""
    docs = _t(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)).alias("x"))
    first = lambda s: F.transform("x", lambda v, i: F.when(i == 0, F.concat(v, F.lit(s))).otherwise(v))
    more = lambda ok, s: F.when(ok, F.array(F.lit(s))).otherwise(F.array().cast("array<string>"))
    third, fourth = F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 == 1
    ours = F.concat(first(" (ours)"), more(fourth, "end of ours"))
    theirs = F.when(third, first(" (theirs)")).otherwise(F.concat("x", more(F.lit(True), "end of theirs")))
    join = lambda x: F.array_join(x, "\n")
    return docs.select("doc_id", join("x").alias("base"), join(ours).alias("ours"), join(theirs).alias("theirs"))


KNOWN = """with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x, i: (i - 1) || ': ' || x) as x from documents),
p as (select doc_id, x[1] as a, doc_id % 3 = 0 as clash, list_concat(x[2:], case when doc_id % 4 = 1 then ['end of ours'] else [] end) as rest, len(x) as n from l),
t as (select *, case when clash and n = 1 then [] else list_concat(rest, case when clash then [] else ['end of theirs'] end) end as tail,
    case when clash and n = 1 then list_concat([a || ' (ours)'], rest) else [a || ' (ours)'] end as mine from p),  -- an only line and what follows it are changed as one
h as (select *, case when clash then list_concat(['<<<<<<< Mine'], mine, ['||||||| Original', a, '=======', a || ' (theirs)', '>>>>>>> Theirs']) else mine end as head from t),
j as (select *, array_to_string(list_concat(mine, tail), chr(10)) as merged, array_to_string(list_concat(head, tail), chr(10)) as marked,
    array_to_string(list_concat(case when clash then [a || ' (theirs)'] else mine end, tail), chr(10)) as remote,
    array_to_string(list_concat(case when clash then list_concat(mine, [a || ' (theirs)']) else mine end, tail), chr(10)) as twice,
    array_to_string(list_concat(case when clash then ['mine'] else mine end, tail), chr(10)) as own from h)
"""


@query(KNOWN + "select doc_id, sha256(merged) as merged_sha, clash::int as n_conflicts, clash as has_conflicts, sha256(marked) as marked_sha, clash as marked, clash::int as counted from j", fixture=False)
def known_merge(spark, d):
    """Merges of texts, their rendering, and conflicts counted in it."""
    out = merging.count_conflicts(merging.render(merging.three_way(known_texts(spark, d))), "marked", "counted")
    return out.select("doc_id", F.sha2(F.array_join("merge.merged", "\n"), 256).alias("merged_sha"), F.size("merge.conflicts").alias("n_conflicts"), F.col("merge.hasConflicts").alias("has_conflicts"), F.sha2("marked", 256).alias("marked_sha"), tx.has_markers(F.col("marked")).alias("marked"), "counted")


@query(KNOWN + "select doc_id, sha256(case doc_id % 5 when 1 then remote when 2 then twice when 3 then own else merged end) as resolved_sha from j", fixture=False)
def known_resolve(spark, d):
    """Conflicts replaced by what their picks take: local, remote, both or a text."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("local", "remote", "both", "custom", "local"))), (F.col("doc_id") % 5 + 1).cast("int"))
    picks = F.create_map(F.lit(0), F.struct(kind.alias("kind"), F.array(F.lit("mine")).alias("text"))).cast(schemas.PICKS)
    rows = merging.render(merging.three_way(known_texts(spark, d))).select("doc_id", F.col("marked").alias("text")).withColumn("picks", picks)
    return merging.resolve(rows).select("doc_id", F.sha2("resolved", 256).alias("resolved_sha"))


@query(KNOWN + """, s as (select doc_id, 0 as pos, 'conflict' as kind, 0 as n_lines, len(mine) as n_ours, 1 as n_base, 1 as n_theirs from j where clash union all
    select doc_id, case when clash then 1 else 0 end, 'clean', len(tail) + (not clash)::int, 0, 0, 0 from j) select * from s where kind = 'conflict' or n_lines > 0""", fixture=False)
def known_segments(spark, d):
    """Segments of marked texts."""
    rows = merging.segments(merging.render(merging.three_way(known_texts(spark, d))).select("doc_id", F.col("marked").alias("text")))
    return rows.select("doc_id", "pos", "kind", *(F.size(x).alias(y) for x, y in (("lines", "n_lines"), ("ours", "n_ours"), ("base", "n_base"), ("theirs", "n_theirs"))))


@query(KNOWN + """select 'd' || doc_id as path, case when doc_id % 7 = 6 then null else sha256(remote) end as resolved_sha, doc_id % 7 = 6 as failed from j""", fixture=False)
def known_bulk_resolve(spark, d):
    """All files with picks resolved at once; a file that is not there fails by itself."""
    every = merging.render(merging.three_way(known_texts(spark, d))).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("marked").alias("text"), "doc_id")
    picks = every.select("path", F.create_map(F.lit(0), F.struct(F.lit("remote").alias("kind"), F.lit(None).cast("array<string>").alias("text"))).cast(schemas.PICKS).alias("picks"))
    out = merging.bulk_resolve(every.where("doc_id % 7 <> 6").select("path", "text"), picks)
    return out.select("path", F.sha2("resolved", 256).alias("resolved_sha"), "failed")


@query(KNOWN + """, d as (select doc_id, 0 as pos, 'delete' as kind, 1 as n from p where clash union all select doc_id, 1, 'insert', 1 from p where clash union all select doc_id, 2, 'equal', n - 1 from p where clash and n > 1
    union all select doc_id, 0, 'equal', n from p where not clash union all select doc_id, 1, 'insert', 1 from p where not clash) select doc_id, pos, kind, n from d""", fixture=False)
def known_diff(spark, d):
    """Runs of equal, deleted and inserted lines."""
    rows = merging.diff_lines(known_texts(spark, d), "base", "theirs")
    return rows.select("doc_id", F.posexplode("diff").alias("pos", "r")).select("doc_id", "pos", "r.kind", F.size("r.lines").alias("n"))


@query("""with s as (select c_custkey as k, 2 + c_custkey % 17 as n, c_custkey % 5 as r, 1 + c_custkey % 13 as m from customer)
select k, greatest(n - r % n, r % n) as moved_equal, least(n, m) as repeated_equal, greatest(n - m, 0) as repeated_deleted, greatest(m - n, 0) as repeated_inserted from s""", fixture=False)
def line_matching(spark, d):
    """A rotated block of unique lines keeps a longest run, and stretches of one line are matched as far as both go."""
    k = F.col("c_custkey")
    n, r, m = F.lit(2) + k % 17, k % 5, F.lit(1) + k % 13
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i + r) % n).cast("string"))
    same = lambda size: F.array_join(F.array_repeat(F.lit("x"), size.cast("int")), "\n")
    rows = _t(spark, d, "customer").select(k.alias("k"), F.array_join(line, "\n").alias("a"), F.array_join(turned, "\n").alias("b"), same(n).alias("x"), same(m).alias("y"))
    rows = merging.diff_lines(merging.diff_lines(rows, "a", "b", "moved"), "x", "y", "repeated")
    count = lambda runs, kind: F.aggregate(F.filter(runs, lambda z: z["kind"] == kind), F.lit(0), lambda s, z: s + F.size(z["lines"])).cast("bigint")
    return rows.select("k", count("moved", "equal").alias("moved_equal"), *(count("repeated", x).alias(f"repeated_{y}") for x, y in (("equal", "equal"), ("delete", "deleted"), ("insert", "inserted"))))


@query("""select doc_id, 'M27' as rule, 'conflict' as action, sha256(concat_ws(chr(10), '<<<<<<< Mine', text || ' ours', '||||||| Original', '=======', 'theirs ' || text, '>>>>>>> Theirs')) as marked_sha from documents""", fixture=False)
def whole_conflict(spark, d):
    """Two texts with an ambiguous base are one conflict as a whole."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit(" ours")).alias("a"), F.concat(F.lit("theirs "), "text").alias("b"))
    side = lambda x, head: docs.select("id", F.col("id").alias("path"), tx.sha256(F.col(x)).alias("contentHash"), hlc.hlc(F.lit(1), F.lit(0), F.lit(x)).alias("hlcTimestamp"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("lastSyncedPath"), F.concat("id", F.lit(head)).alias("headVersionId"), F.lit(None).cast("array<string>").alias("conflictParents"), F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("bigint").alias("size"))
    roots = F.array(F.concat("id", F.lit(".P")), F.concat("id", F.lit(".Q")))
    none = F.array().cast("array<string>")
    nodes = [(F.lit(".L"), roots, "a"), (F.lit(".R"), roots, "b"), (F.lit(".P"), none, "a"), (F.lit(".Q"), none, "b")]
    rows = docs.select("id", F.explode(F.array(*(F.struct(F.concat("id", v).alias("versionId"), p.alias("parents"), tx.sha256(F.col(t)).alias("contentHash")) for v, p, t in nodes))).alias("n"))
    texts = docs.select(F.explode(F.array("a", "b")).alias("t")).select(tx.sha256(F.col("t")).alias("hash"), F.col("t").cast("binary").alias("bytes"))
    out = merging.render(classify.classify(side("a", ".L"), side("b", ".R"), rows.select("n.*", F.col("id").alias("fileId")), texts, texts))
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "rule", "action", F.sha2("marked", 256).alias("marked_sha"))


# --- scalars ------------------------------------------------------------------------------------

_BLIND = crypto.pads(hashlib.sha256(b"a key").digest())


@query(f"""select doc_id, sha256(unhex('{_BLIND[1].hex()}') || unhex(sha256(unhex('{_BLIND[0].hex()}') || encode(sha256(text))))) as blinded from documents""", fixture=False)
def blinding(spark, d):
    """Hashes blinded by HMAC with a given key."""
    return _t(spark, d, "documents").select("doc_id", crypto.blind(tx.sha256(F.col("text")), hashlib.sha256(b"a key").digest()).alias("blinded"))


#: PBKDF2-HMAC-SHA256 of "password" and "salt" (2 and 4096 rounds), HKDF-SHA256 and AES-256-GCM test vectors of RFC 7914's and NIST's kind.
_VECTORS = [
    ("pbkdf2_1", "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"),
    ("pbkdf2_4096", "c5e478d59288c841aa530db6845c4c8d962893a001ce4e11a4963873aa98134a"),
    ("gcm_zero", "cea7403d4d606b6e074ec5d3baf39d18d0d1c8a799996bf0265b98b5d48ab919"),
]


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in _VECTORS) + ") as t(name, value)", fixture=False)
def crypto_vectors(spark, d):
    """Published test vectors of the key derivation and of sealing."""
    derived = [("pbkdf2_1", 1), ("pbkdf2_4096", 4096)]
    rows = [(k, hashlib.pbkdf2_hmac("sha256", b"password", b"salt", n).hex()) for k, n in derived]
    zero = crypto.seal(F.lit(bytes(16)), bytes(32), F.lit(bytes(12)))
    sealed = spark.range(1).select(F.lit("gcm_zero").alias("name"), tx.to_hex(F.substring(zero, 13, 32)).alias("value"))
    return spark.createDataFrame(rows, "name string, value string").unionByName(sealed)


@query("""select id, length(id) > 0 and id like '%-%-%' as sealed, fileId, type from ops""")
def sealed_records(spark, d):
    """Sealed records differ from the plain ones, open with the key, and do not open with another."""
    keys = [crypto.derive(x, "a vault", 1000)["enc"] for x in ("a passphrase", "another")]
    rows = materialize(_ops(spark, d).select("id", crypto.seal_op(F.struct("id", "fileId", "type"), keys[0]).alias("s")))
    ddl = "id string, fileId string, type string"
    good, bad = crypto.unseal_op(F.col("s"), keys[0], ddl), crypto.unseal_op(F.col("s"), keys[1], ddl)
    return rows.select("id", (~F.contains(F.col("s"), F.col("id")) & bad.isNull()).alias("sealed"), good["fileId"].alias("fileId"), good["type"].alias("type"))


@query("""select id, 'm-' || sha256(contentHash || '|' || array_to_string(list_sort(parents), '|')) as merge_id,
    regexp_replace(sha256(fileId || chr(31) || path), '^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '\\1-\\2-\\3-\\4-\\5') as stable,
    type in ('create', 'move') as local from ops where contentHash is not null""")
def ids_and_actions(spark, d):
    """derived ids, and which actions touch this side's files."""
    action = F.when(F.col("type") == "create", "write_local").when(F.col("type") == "move", "move_local").when(F.col("type") == "update", "send_remote").otherwise("no_op")
    return _ops(spark, d).where("contentHash is not null").select("id", tx.merge_id(F.col("contentHash"), F.col("parents")).alias("merge_id"), tx.stable_id(F.col("fileId"), F.col("path")).alias("stable"), tx.affects_local(action).alias("local"))


@query("""select op.id as source, case when len(op.parents) > 1 then 'm-' || sha256(op.contentHash || '|' || array_to_string(list_sort(op.parents), '|')) else op.id end as id, case when op.type = 'create' then 'create' when len(op.parents) > 1 and op.type = 'delete' then 'delete' when op.type = 'update' and len(op.parents) > 1 then 'update' else op.type end as type,
    case when op.type = 'create' then '' else array_to_string(op.parents, ',') end as parents from ops op where contentHash is not null""")
def made_ops(spark, d):
    """operations made anew of the log's columns are the log's."""
    rows = _ops(spark, d).where("contentHash is not null")
    one = lambda kind: oplog.make_op(kind, F.col("hlcTimestamp"), F.col("fileId"), F.col("path"), F.col("contentHash"), F.col("parents"))
    many = F.size("parents") > 1
    op = F.when(many & (F.col("type") == "delete"), one("merge_delete")).when(many, F.when(F.col("type") == "move", one("merge").withField("type", F.lit("move"))).otherwise(one("merge"))).when(F.col("type") == "create", one("create")).when(F.col("type") == "update", one("update")).when(F.col("type") == "move", one("move")).otherwise(one("delete"))
    return rows.select(F.col("id").alias("source"), op.alias("o")).select("source", "o.id", "o.type", F.array_join("o.parents", ",").alias("parents"))


@query("""select id, lag(id) over (partition by fileId, device order by wall, counter) as previous, (select max(event_id) from ops) as head from ops""")
def log_lineage(spark, d):
    """The version before of the same file and device, and the log's last position."""
    from tidefold.sources import remote

    rows = _ops(spark, d)
    head = remote.head_cursor(rows.select(F.col("event_id").alias("seq")))
    return oplog.running(rows).join(F.broadcast(head), F.lit(True)).select("id", "previous", F.col("headCursor").alias("head"))  # one row


@query("""select doc_id, sha256(text) as h, true as same from documents""", fixture=False)
def scalar_decodings(spark, d):
    """F8: Base64 there and back."""
    back = tx.from_base64(tx.to_base64(F.col("text").cast("binary")))
    return _t(spark, d, "documents").select("doc_id", F.sha2(back, 256).alias("h"), (back.cast("string") == F.col("text")).alias("same"))


@query("""select event_id, event_id % 2 = 0 as early, false as late, case event_id % 4 when 0 then 'device,vault' when 1 then 'vault' when 2 then 'device' else '' end as missing,
    case event_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'a,b' else 'c' end as chunk, event_id % 4 in (0, 1) as marked from events""", fixture=False)
def text_helpers(spark, d):
    """Binary content, picks of lines, markers, settings that are missing."""
    e = F.col("event_id")
    zero = F.lit(bytearray(b"\0"))
    early = tx.is_binary(F.concat(F.col("event_type").cast("binary"), F.when(e % 2 == 0, zero).otherwise(F.lit(bytearray(b"x")))))
    late = tx.is_binary(F.concat(F.lit(bytearray(b"x" * 8192)), zero))
    missing = tx.missing_fields(device=F.when(e % 2 == 0, " ").otherwise("d"), vault=F.when((e % 4).isin(0, 1), F.lit(None).cast("string")).otherwise("v"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("local", "remote", "both", "custom"))), (e % 4 + 1).cast("int"))
    chunk = tx.resolve_chunk(F.array(F.lit("a")), F.array(F.lit("b")), F.struct(kind.alias("kind"), F.array(F.lit("c")).alias("text")))
    text = F.element_at(F.array(*(F.lit(x) for x in ("a\n<<<<<<< Mine\nx\n>>>>>>> Theirs", ">>>>>>> Theirs\n<<<<<<< Mine", "<<<<<<< Mine\nno end", "x <<<<<<< Mine\n>>>>>>> Theirs"))), (e % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", early.alias("early"), late.alias("late"), F.array_join(missing, ",").alias("missing"), F.array_join(chunk, ",").alias("chunk"), tx.has_markers(text).alias("marked"))


@query("""select event_id, case event_id % 8 when 0 then '.state/x' when 1 then '.stateful/x' when 2 then 'conf/plugins/me/a' when 3 then 'conf/workspace.json' when 4 then 'conf/app.json' when 5 then '.git' when 6 then 'a/b/.DS_Store' else 'n/' || event_id || '.md' end as path,
    event_id % 8 in (0, 2, 3, 4, 5, 6) as excluded, event_id % 8 in (0, 2, 3, 5, 6) as excluded_with_config from events""", fixture=False)
def excluded_paths(spark, d):
    """paths that take no part, with and without the configuration."""
    e = F.col("event_id")
    path = F.element_at(F.array(*(F.lit(x) for x in (".state/x", ".stateful/x", "conf/plugins/me/a", "conf/workspace.json", "conf/app.json", ".git", "a/b/.DS_Store")), F.concat(F.lit("n/"), e.cast("string"), F.lit(".md"))), (e % 8 + 1).cast("int"))
    rows = _t(spark, d, "events").select("event_id", path.alias("path"))
    out = lambda config: tx.is_excluded(F.col("path"), ".state", "conf/plugins/me", "conf", config)
    return rows.select("event_id", "path", out(False).alias("excluded"), out(True).alias("excluded_with_config"))


@query("""select event_id, case when s < 45 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as ago,
    case event_type when 'view' then 'Pulling' when 'click' then 'Pushing' when 'error' then 'Merging' when 'signup' then 'Rebuilding' else 'Syncing' end || chr(8230) as phase,
    array_to_string(list_filter([case when a > 0 then a || ' deletion' || (case when a = 1 then '' else 's' end) || ' kept' end, case when b > 0 then b || ' restored' end, case when c > 0 then c || ' binary version' || (case when c = 1 then '' else 's' end) || ' chosen' end], lambda x: x is not null), ', ') || '.' as picks,
    case when event_id % 3 = 0 then 'this device' else 'device dev-' || (event_id % 3) end as device
from (select *, event_id * 37 as s, event_id % 3 as a, event_id % 4 as b, event_id % 2 as c from events)""", fixture=False)
def more_labels(spark, d):
    """relative times, phases, summaries of picks, this device."""
    e = F.col("event_id")
    raw = F.when(F.col("event_type") == "view", "Downloading 3 of 9").when(F.col("event_type") == "click", "Uploading").when(F.col("event_type") == "error", "Merging files").when(F.col("event_type") == "signup", "Rebuilding history").otherwise("Waiting")
    now = F.lit(1_800_000_000_000)
    return _t(spark, d, "events").select("event_id", tx.relative_time(now - e * 37_000, now).alias("ago"), tx.coarse_phase(raw).alias("phase"), tx.pick_summary(e % 3, e % 4, e % 2).alias("picks"), tx.device_label(F.concat(F.lit("dev-"), (e % 3).cast("string")), "dev-0").alias("device"))


# --- the graph --------------------------------------------------------------------------------


@query()
def graph_content(spark, d):
    """The content of every version, and of ids that are none."""
    ids = _ops(spark, d).select(F.col("id").alias("versionId")).union(_ops(spark, d).select(F.concat(F.lit("none-"), "id")))
    return graph.content_hash_of(ids, _versions(spark, d))


SQL["graph_content"] = RECURSIVE + """ select id as "versionId", case when type <> 'move' then contentHash end as "contentHash" from ops union all select 'none-' || id, null from ops"""


@query()
def conflict_heads(spark, d):
    """Files with several open heads, and who made each of them; merge nodes tell nothing."""
    lv = graph.leaves(_versions(spark, d)).select(F.col("fileId").alias("id"), F.col("fileId").alias("path"), F.concat("leaves", F.array(F.lit("m-0"))).alias("conflictParents"))
    rows = graph.open_conflicts(lv, by_path=False).select("id", F.explode("heads").alias("h"))
    return rows.select("id", F.col("h.versionId").alias("head"), F.col("h.hlc.wallTime").cast("string").alias("wall"), F.col("h.hlc.deviceId").alias("device"))


SQL["conflict_heads"] = RECURSIVE + """, edg as (select unnest(parents) as p from ops where type <> 'move')
select fileId as id, id as head, wall::varchar as wall, device from ops where type <> 'move' and id not in (select p from edg) union all select distinct fileId, 'm-0', null, null from ops where type <> 'move' and id not in (select p from edg)"""


@query()
def graph_reachable(spark, d):
    """Hashes reachable from the heads, by generation."""
    heads = _entries(spark, d).select(F.col("headVersionId").alias("start")).where("start is not null")
    return graph.reachable_hashes(heads, _versions(spark, d)).select("start", "hash", "generation")


_WALKS = HEADS + """, st as (select distinct headVersionId as s from ent where headVersionId is not null),
walk as (select s, s as v, 0 as g from st union select walk.s, edg.p, walk.g + 1 from walk join edg on edg.v = walk.v)"""
SQL["graph_reachable"] = RECURSIVE + _WALKS + """, near as (select s, v, min(g) as g from walk group by s, v)
select s as start, contentHash as hash, min(g)::int as generation from near join ver using (v) where contentHash is not null group by s, contentHash"""


@query()
def graph_bounded(spark, d):
    """The same where only the contents of even documents are at hand, and three generations at most."""
    heads = _entries(spark, d).select(F.col("headVersionId").alias("start")).where("start is not null")
    held = _t(spark, d, "documents").where("doc_id % 2 = 0").select(tx.sha256(F.col("text")).alias("hash"))
    return graph.reachable_hashes(heads, _versions(spark, d), held, 3).select("start", "hash", "generation")


SQL["graph_bounded"] = RECURSIVE + HEADS + """, st as (select distinct headVersionId as s from ent where headVersionId is not null), held as (select distinct sha256(text) as h from documents where doc_id % 2 = 0),
n as (select ver.*, contentHash is null or contentHash in (select h from held) as ok from ver),
walk as (select s, s as v, 0 as g, true as go from st union select walk.s, edg.p, walk.g + 1, coalesce(n.ok, true) from walk join edg on edg.v = walk.v left join n on n.v = edg.p where walk.go and walk.g < 3),
near as (select s, v, min(g) as g from walk group by s, v)
select s as start, contentHash as hash, min(g)::int as generation from near join ver using (v) where contentHash is not null group by s, contentHash"""


@query()
def graph_roots(spark, d):
    """Versions that entries, open heads and pending operations need."""
    e = _entries(spark, d, 1)
    pending = fixtures.plain(_ops(spark, d).where("event_id % 3 = 2"))
    kept, _ = graph.sweep(_versions(spark, d), graph.roots(e, pending))
    return kept.select("versionId")


SQL["graph_roots"] = RECURSIVE + HEADS + """, l as (select fileId, arg_max(case when type = 'move' then parent1 else id end, (wall, counter, device)) as h from ops where event_id % 3 in (0, 1) group by fileId),
pend as (select * from ops where event_id % 3 = 2), st as (select h as a from l where h is not null union select id from pend union select unnest(parents) from pend),
walk as (select a from st union select edg.p from walk join edg on edg.v = walk.a) select distinct v as "versionId" from ver join walk on a = v"""


@query()
def garbage_collection(spark, d):
    """P7, ST10, A8: versions that stay, tombstones that go and packs' verdicts, with what the graph still reaches."""
    rows = _ops(spark, d)
    entries = materialize(oplog.project(fixtures.plain(rows)))
    index = fixtures.pack_index(spark, d)
    packs = index.select("packId", F.lit(0).cast("bigint").alias("mtime")).distinct()
    none = spark.createDataFrame([], "id string, parents array<string>")
    kept, gone, verdicts = rounds.collect_garbage(entries, none, materialize(graph.build(graph.from_ops(rows))), index, packs, 1_800_000_000_000, 1)
    return kept.select(F.lit("version").alias("kind"), F.col("versionId").alias("id")).union(gone.select(F.lit("tombstone"), "id")).union(verdicts.select(F.concat(F.lit("pack "), "verdict"), "packId"))


SQL["garbage_collection"] = RECURSIVE + HEADS + """, walk as (select headVersionId as a, not deleted as live from ent where headVersionId is not null union select edg.p, live from walk join edg on edg.v = walk.a),
h as (select sha256(text) as hash, min(doc_id) as doc_id from documents group by 1), idx as (select hash, 'p' || (doc_id // 40) as packId from h),
need as (select contentHash as hash from ent where not deleted union select contentHash from ver join walk on a = v where live),
st as (select packId, count(*) as n, count(need.hash) as live from idx left join need using (hash) group by packId)
select 'version' as kind, v as id from ver where v in (select a from walk) union all select 'tombstone', id from ent where deleted and wall <= 1800000000000 - 30 * 86400000::bigint
union all select 'pack ' || case when live = 0 then 'retire' when live / n < 0.5 then 'compact' else 'keep' end, packId from st"""


@query()
def scoped_staging(spark, d):
    """Hashes that the merge needs: of files that have not converged, and of what their local heads reach."""
    rows = _ops(spark, d)
    side = lambda k: materialize(oplog.project(fixtures.plain(fixtures.replica(rows, k))))
    l, r = side(1), side(2)
    reach = graph.reachable_hashes(l.select(F.col("headVersionId").alias("start")).where("start is not null"), graph.build(graph.from_ops(rows)))
    by_id = reach.join(l.select("id", F.col("headVersionId").alias("start")), "start").select("id", "hash")
    return classify.needed_hashes(l, r, by_id)


SQL["scoped_staging"] = RECURSIVE + HEADS + """, side as (select k, fileId as id, arg_max({'path': path, 'h': contentHash, 'head': case when type = 'move' then parent1 else id end, 'dead': type = 'delete'}, (wall, counter, device)) as s
    from ops, (values (1), (2)) w(k) where event_id % 3 in (0, k) group by k, fileId), l as (select id, s.* from side where k = 1), r as (select id, s.* from side where k = 2),
conv as (select id from l join r using (id) where not l.dead and not r.dead and l.head = r.head and l.h = r.h and l.path = r.path),
met as (select l.id from l join r on l.path = r.path where not r.dead and not l.dead and l.id <> r.id and l.id not in (select id from r)),
ids as (select id from r where id not in (select id from conv) union select id from met),
walk as (select head as s, head as v from l where head is not null union select walk.s, edg.p from walk join edg on edg.v = walk.v)
select h as hash from (select * from l union all select * from r) where id in (select id from ids) and h <> '' union
select contentHash from walk join l on l.head = walk.s join ver on ver.v = walk.v where l.id in (select id from ids) and contentHash is not null"""


# --- registry and rounds -------------------------------------------------------------------------


@query(REGISTRY + """select path, case when r.path is null then 'create' when d.path is null then 'held' when d.mtime = r.mtime and d.size = r.size then 'unchanged' when d.hash = r.contentHash then 'refreshed' else 'update' end as outcome from disk d full outer join (select * from reg where not deleted) r using (path)""")
def capture_aborted(spark, d):
    """A scan that was cut short deletes nothing."""
    reg, listing, hashes = _disk(spark, d)
    return capture.capture(reg, listing, hashes, aborted=True).select("path", "outcome")


@query(REGISTRY + """select path, 'held' as outcome from reg where not deleted""")
def capture_phantom(spark, d):
    """R2: with nothing on disk, as on a cold start, nothing is deleted."""
    reg, listing, hashes = _disk(spark, d)
    return capture.capture(reg, listing.where(F.lit(False)), hashes).select("path", "outcome")


@query(REGISTRY + """select path, case when d.path is null then case when r.id like '%1' then 'dropped' else 'delete' end when r.path is null or r.id like '%1' then 'create' when d.mtime = r.mtime and d.size = r.size then 'unchanged' when d.hash = r.contentHash then 'refreshed' else 'update' end as outcome,
    r.path is not null and d.path is null and r.id like '%1' as no_op from disk d full outer join (select * from reg where not deleted) r using (path)""")
def capture_placeholders(spark, d):
    """Entries that were never captured: a tombstone without an operation, or created when the file is there."""
    reg, listing, hashes = _disk(spark, d)
    reg = reg.withColumn("contentHash", F.when(F.col("id").endswith("1"), "").otherwise(F.col("contentHash")))
    return capture.capture(reg, listing, hashes).select("path", "outcome", (F.col("type").isNull() & (F.col("outcome") == "dropped")).alias("no_op"))


@query(REGISTRY + """select path, case when d.path is null then 'delete' when r.path is null then 'create' else 'update' end as type, case when d.path is null then r.contentHash when r.path is not null and d.mtime = r.mtime and d.size = r.size then r.contentHash else coalesce(d.hash, r.contentHash) end as "contentHash" from disk d full outer join (select * from reg where not deleted) r using (path)""")
def capture_baseline(spark, d):
    """An operation for every live file."""
    return rounds.rebaseline(*_disk(spark, d)).select("path", "type", "contentHash")


@query(REGISTRY + """, o as (select path, case when d.path is null then 'delete' when r.path is null then 'create' when d.mtime = r.mtime and d.size = r.size then 'unchanged' when d.hash = r.contentHash then 'refreshed' else 'update' end as outcome from disk d full outer join (select * from reg where not deleted) r using (path))
select (select count(*) from disk)::bigint as files, count(*) filter (outcome in ('create', 'update', 'delete')) as ops, 0::bigint as too_large from o""")
def capture_statistics(spark, d):
    """A10: files seen, operations made, files too large."""
    return capture.capture_stats(capture.capture(*_disk(spark, d)))


@query(REGISTRY + """, dirty as (select path from disk where path like '%1.md'), o as (select path, case when d.path is null then 'delete' when r.path is null then 'create' when d.mtime = r.mtime and d.size = r.size then 'unchanged' when d.hash = r.contentHash then 'refreshed' else 'update' end as outcome from disk d full outer join (select * from reg where not deleted) r using (path))
select o.path, case when dirty.path is not null then case when r.path is null then 'create' else 'update' end else outcome end as outcome, case when dirty.path is not null then repeat('e', 64) end as edited from o left join dirty using (path) left join (select * from reg where not deleted) r on r.path = o.path""")
def capture_live_edits(spark, d):
    """Paths that were edited while the capture ran are looked at again."""
    reg, listing, hashes = _disk(spark, d)
    dirty = listing.where("path like '%1.md'").select("path")
    first = materialize(capture.capture(reg, listing, hashes))
    mark = dirty.select("path", F.lit(True).alias("on"))
    edited = lambda x: x.join(mark, "path", "left")
    later = edited(listing).select("path", F.when(F.col("on"), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size")
    new = edited(hashes).select("path", F.when(F.col("on"), F.lit("e" * 64)).otherwise(F.col("hash")).alias("hash"))
    out = capture.recapture(first, reg, later, new, dirty)
    return out.select("path", "outcome", F.when(F.col("contentHash") == "e" * 64, F.col("contentHash")).alias("edited"))


@query(REGISTRY + """, inc as (select fileId as id, path, contentHash, type = 'delete' as deleted, case when type = 'move' then parent1 else id end as head from al where k = 1)
select id, path, "contentHash", deleted, head as "headVersionId" from inc union all select id, path, contentHash, deleted, head from reg where id not in (select id from inc) and path not in (select path from inc where not deleted)""")
def registry_adopt(spark, d):
    """Entries of the other side taken over."""
    reg, _, _ = _disk(spark, d)
    return capture.adopt(reg, oplog.project(fixtures.plain(_ops(spark, d)))).select("id", "path", "contentHash", "deleted", "headVersionId")


_KINDS = ("path", "content", "stat", "delete", "head", "conflict", "clear_conflict", "synced")


@query(REGISTRY + """, c as (select *, length(path) % 8 as kind from reg where not deleted), one as (select path, max(id) as id from c group by path), m as (select reg.*, case when one.id is not null then length(reg.path) % 8 else -1 end as kind from reg left join one using (id, path))
select id, case when kind = 0 then 'moved/' || path else path end as path, case when kind in (1, 5) then repeat('c', 64) else contentHash end as "contentHash", deleted or kind = 3 as deleted, case when kind = 4 then 'new head' else head end as "headVersionId",
    case when kind = 5 then 'x,y' else '' end as open, case when kind = 7 then path end as "lastSyncedPath", case when kind in (1, 2) then 5 else mtime end as mtime, case when kind in (0, 1, 3, 5) then 99 else mtime end as wall from m""")
def registry_mutate(spark, d):
    """Changes of single entries, found by path."""
    reg, _, _ = _disk(spark, d)
    kind = F.element_at(F.array(*(F.lit(x) for x in _KINDS)), (F.length("path") % 8 + 1).cast("int"))
    names = reg.where("not deleted").select("path").distinct()
    changes = names.select(kind.alias("kind"), F.lit(None).cast("string").alias("id"), "path", F.concat(F.lit("moved/"), "path").alias("to_path"), F.lit("c" * 64).alias("contentHash"), hlc.hlc(F.lit(99), F.lit(0), F.lit("d")).alias("hlcTimestamp"), F.lit(5).cast("bigint").alias("mtime"), F.lit(6).cast("bigint").alias("size"), F.lit("new head").alias("versionId"), F.array(F.lit("x"), F.lit("y")).alias("parents"))
    out = capture.mutate(reg, changes)
    return out.select("id", "path", "contentHash", "deleted", "headVersionId", F.coalesce(F.array_join("conflictParents", ","), F.lit("")).alias("open"), "lastSyncedPath", "mtime", F.col("hlcTimestamp.wallTime").alias("wall"))


@query(PROJECT + """, def as (select distinct fileId, 'keep' as decision from ops where event_id % 20 = 3), con as (select distinct fileId from ops where event_id % 41 = 3) select fileId as "fileId", decision from def where fileId in (select fileId from con)""")
def decisions(spark, d):
    """Recorded decisions whose file is still in conflict."""
    rows = _ops(spark, d)
    pick = lambda n: rows.where(F.col("event_id") % n == 3).select("fileId").distinct()
    return oplog.live_decisions(pick(20).withColumn("decision", F.lit("keep")), pick(41))


@query(REGISTRY + """select 'create' as type, count(*) as n, 0 as "cursor" from disk""")
def vault_switch(spark, d):
    """A change to another vault forgets the registry and captures every file."""
    reg, listing, hashes = _disk(spark, d)
    v = _versions(spark, d)
    new, pending, versions, captured, cursor = rounds.switch(reg, fixtures.plain(_ops(spark, d)), v, listing, hashes, "another", "one")
    left = new.select("id").union(pending.select("id")).union(versions.select("versionId"))
    return captured.groupBy("type").agg(F.count("*").alias("n")).join(left.agg(F.count("*").alias("left")), F.lit(True)).where("left = 0").select("type", "n", F.lit(cursor).alias("cursor"))


# --- files, journals, packs ------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder for files of this query; on one machine."""
    return os.path.join(re.sub("^file:(//)?(?=/)", "", scratch.folder(spark)), uuid.uuid4().hex)


@query("""select 'p/' || (page_id % 7) || '/[' || page_id || '].html' as path, octet_length(encode(html)) as size, sha256(html) as hash from pages where page_id % 5 <> 4 union all select 'p/none', -1, null""", fixture=False)
def vault_files(spark, d):
    """Pages written as files, some moved and some trashed; the listing, and contents of all that are named."""
    root = _folder(spark)
    k = F.col("page_id")
    name = F.concat(F.lit("p/"), (k % 7).cast("string"), F.lit("/["), k.cast("string"), F.lit("].html"))
    pages = _t(spark, d, "pages").select(k, name.alias("name"), F.concat(F.lit("first/"), "name").alias("first"), F.col("html").cast("binary").alias("bytes"))
    null = lambda kind: F.lit(None).cast(kind)
    failed = files.carry_out(pages.select(F.lit("write").alias("verb"), F.when(k % 2 == 0, F.col("first")).otherwise(F.col("name")).alias("path"), null("string").alias("to_path"), "bytes"), root)
    failed += files.carry_out(pages.where(k % 2 == 0).select(F.lit("move").alias("verb"), F.col("first").alias("path"), F.col("name").alias("to_path"), null("binary").alias("bytes")), root)
    failed += files.carry_out(pages.where(k % 5 == 4).select(F.lit("trash").alias("verb"), F.col("name").alias("path"), null("string").alias("to_path"), null("binary").alias("bytes")), root)
    if failed:
        raise OSError(str(failed[:3]))
    there = files.listing(spark, root).where("path not like '.trash/%'")
    wanted = there.select("path").union(spark.createDataFrame([("p/none",)], "path string"))
    return files.contents(spark, root, wanted).join(there.select("path", "size"), "path", "left").select("path", F.coalesce("size", F.lit(-1)).alias("size"), F.sha2("bytes", 256).alias("hash"))


@query("""select event_id as seq, event_type as kind, 'n/' || user_id as path, sha256(props) as hash from events""", fixture=False)
def change_stream(spark, d):
    """Change events read as a stream of JSON files, all of them by one trigger."""
    root = _folder(spark)
    e = _t(spark, d, "events")
    e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.concat(F.lit("n/"), F.col("user_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("oldPath"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), F.base64(F.col("props").cast("binary")).alias("bytes")).write.json(f"{root}/in")
    stream = files.change_events(spark, f"{root}/in").select("seq", "kind", "path", F.sha2("bytes", 256).alias("hash"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("""select id, fileId, type, path, array_to_string(parents, ',') as parents from ops""")
def log_journal(spark, d):
    """The log appended in two parts, the second with the first again, and written anew; a torn line is passed over."""
    at, rows = f"{scratch.folder(spark)}/{uuid.uuid4().hex}", fixtures.plain(_ops(spark, d))
    half = rows.where(F.crc32("id") % 2 == 0)
    journals.append_ops(half, at)
    journals.append_ops(rows, at, journals.read_ops(spark, at))
    spark.createDataFrame([('{"v": 1, "id": "torn',)], "value string").write.mode("append").text(at)
    now = journals.read_ops(spark, at)
    journals.rewrite_ops(materialize(now), at)
    return journals.read_ops(spark, at).select("id", "fileId", "type", "path", _list("parents").alias("parents"))


@query(PROJECT + "select id, path from entries where not deleted")
def registry_stored(spark, d):
    """A registry kept as a snapshot and journalled changes, folded, and compacted when it is due."""
    at = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    state = lambda rows: oplog.project(fixtures.plain(rows)).where("not deleted").select("id", F.to_json(F.struct("path")).alias("entry"))
    rows = _ops(spark, d)
    old, now = materialize(state(rows.where("event_id % 3 = 0"))), materialize(state(rows))
    journals.append_registry(journals.registry_delta(old.where(F.lit(False)), old), f"{at}/snapshot")
    journals.append_registry(journals.registry_delta(old, now), f"{at}/journal")
    records = journals.lines(spark, f"{at}/journal").count()
    if journals.compaction_due(1, 2, records, 1) or records:
        journals.compact_registry(spark, f"{at}/snapshot", f"{at}/journal")
    return journals.read_registry(spark, f"{at}/snapshot", f"{at}/journal").select("id", F.get_json_object("entry", "$.path").alias("path"))


@query()
def graph_stored(spark, d):
    """The graph kept as a snapshot and a journal, compacted after 500 records, and made anew when it is lost."""
    at = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    rows = _ops(spark, d)
    old, now = (materialize(graph.build(graph.from_ops(x))) for x in (rows.where("event_id % 2 = 0"), rows))
    journals.append_graph(old, f"{at}/snapshot")
    journals.append_graph(now.join(old.select("versionId"), "versionId", "left_anti"), f"{at}/journal")
    journals.compact_graph(spark, f"{at}/snapshot", f"{at}/journal")
    journals.append_graph(now.where("size(parents) > 1"), f"{at}/journal")
    stored = journals.read_graph(spark, f"{at}/snapshot", f"{at}/journal")
    again = rounds.rebuild_graph(rows, stored.where(F.lit(False)), 1)
    return stored.join(again.select("versionId", F.col("parents").alias("p"), F.col("contentHash").alias("h")), "versionId", "full_outer").select("versionId", _list("parents").alias("parents"), ((_list("parents") == _list("p")) & (F.col("contentHash") == F.col("h"))).alias("same"))


SQL["graph_stored"] = RECURSIVE + """ select id as "versionId", array_to_string(parents, ',') as parents, true as same from ops where type <> 'move'"""


@query("""select * from (values (1, 7, 'v'), (2, 0, 'none'), (3, 0, 'none'), (4, 0, 'w')) t(n, "cursor", vault)""", fixture=False)
def small_stores(spark, d):
    """Small stores: whole, torn, empty, and with a field of a wrong type."""
    at = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    out = None
    for n, text in enumerate(('{"cursor": 7, "vault": "v"}', '{"cursor": 7, "va', "", '{"cursor": "many", "vault": "w"}'), 1):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{at}/{n}")
        row = journals.read_store(spark, f"{at}/{n}/*.txt", "cursor bigint, vault string", cursor=0, vault="none").select(F.lit(n).alias("n"), F.col("cursor").cast("int").alias("cursor"), "vault")
        out = row if out is None else out.unionByName(row)
    return out


@query("""with h as (select sha256(text) as hash, row_number() over (order by sha256(text)) - 1 as k from (select distinct text from documents)) select hash, 'pack-' || lpad((k // 40)::varchar, 6, '0') as "packId", false as torn from h""", fixture=False)
def pack_lines(spark, d):
    """An index written as lines and read again; a line with another number of fields is passed over, of a hash the last line holds."""
    at = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    index, _ = journals.write_packs(fixtures.contents(spark, d), 40)
    index = materialize(index)
    line = lambda pack: F.concat_ws(" ", "hash", pack, F.col("offset").cast("string"), F.col("len").cast("string")).alias("value")
    index.select(line(F.lit("old"))).write.text(at)
    index.select(line(F.col("packId"))).unionByName(index.select(F.concat("hash", F.lit(" torn 1")).alias("value"))).write.mode("append").text(at)
    got = journals.read_pack_index(spark, at)
    return got.join(index.select("hash", F.col("offset").alias("o"), F.col("len").alias("l")), "hash").select("hash", "packId", ((F.col("offset") != F.col("o")) | (F.col("len") != F.col("l"))).alias("torn"))


@query(PACKS + """, k as (select hash, 'p' || (doc_id // 40) as old, keep.hash is not null as live from h left join keep using (hash)), p as (select old, count(*) as n, count(*) filter (live) as l from k group by old)
select hash, true as ok, l = n as stayed from k join p using (old) where l = n or live""")
def pack_compaction(spark, d):
    """C4: packs with dead blobs are written anew with the live ones, verified by their hash."""
    texts = fixtures.contents(spark, d)
    numbers = fixtures.pack_index(spark, d).select("hash", "packId")
    body = texts.join(numbers, "hash").withColumn("t", F.base64("bytes"))
    packs = materialize(body.groupBy("packId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "t"))), lambda x: x["t"]), "").alias("body")))
    from pyspark.sql import Window as W

    at = F.sum(F.length("t")).over(W.partitionBy("packId").orderBy("hash").rowsBetween(W.unboundedPreceding, 0)) - F.length("t")
    index = materialize(body.select("hash", "packId", at.alias("offset"), F.length("t").cast("bigint").alias("len")))
    keep = materialize(_keep(spark, d))
    plan = blobs.consolidation_plan(index, keep, 1)
    new_index, new_packs = blobs.compact(index, packs, keep, plan, 16)
    got = journals.read_packed(new_index, new_packs).where("bytes is not null").select("hash", F.lit(True).alias("ok"))
    return got.join(new_index.select("hash", F.col("packId").rlike("^p[0-9]").alias("stayed")), "hash")


@query("""select sha256(event_type) as hash, event_id as pos, event_type in ('view', 'click') as held from events""", fixture=False)
def blob_lookup(spark, d):
    """Which of the asked hashes a store has, as often as they are asked for, and the bytes of those it has."""
    from tidefold.sources import remote

    asked = _t(spark, d, "events").select(F.col("event_id").alias("pos"), tx.sha256(F.col("event_type")).alias("hash"))
    store = spark.createDataFrame([("view",), ("click",)], "t string").select(tx.sha256(F.col("t")).alias("hash"), F.col("t").cast("binary").alias("bytes"))
    held, missing = remote.blob_get(asked, store)
    good = blobs.has(asked, held.where(F.sha2("bytes", 256) == F.col("hash")))
    return good.select("hash", "pos", F.lit(True).alias("held")).unionByName(missing.select("hash", "pos", F.lit(False).alias("held")))


# --- streams ----------------------------------------------------------------------------------------


@query(PROJECT + "select id, path, deleted, \"headVersionId\" from entries")
def live_projection(spark, d):
    """ST9, A1: the projection of a stream, whatever the order in which operations arrive."""
    root, rows = f"{scratch.folder(spark)}/{uuid.uuid4().hex}", fixtures.plain(_ops(spark, d))
    rows.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    name = f"live_{uuid.uuid4().hex}"
    ingest.running_projection(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("id", "path", "deleted", "headVersionId")


@query("""select id as "clientOpId", fileId as "fileId" from ops""")
def append_twice(spark, d):
    """ST8: every operation sent twice, in several batches, and kept once."""
    root, rows = f"{scratch.folder(spark)}/{uuid.uuid4().hex}", _ops(spark, d).select(F.col("id").alias("clientOpId"), "fileId")
    rows.unionByName(rows).repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    ingest.append_once(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("clientOpId", "fileId")


_BURSTS = """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 7200 second then 0 else 1 end as new from events),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e)
select 'p' || user_id as path, epoch_us(min(ts)) // 1000 as first_ms, count(*) as n from g group by user_id, g"""


@query(_BURSTS, fixture=False)
def debounce_flush(spark, d):
    """ST1, ST2: bursts of a stream, flushed by a trigger that takes all there is."""
    root = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    rows = _t(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    bursts = ingest.debounce(stream, "7200 seconds")
    ingest.replace_all(bursts, f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{root}/out").select("path", F.unix_millis("first").alias("first_ms"), "n")


@query("""with n as (select event_id as seq, user_id, row_number() over (partition by user_id order by event_id) as k, lag(event_type) over (partition by user_id order by event_id) as before, event_type,
    sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by event_id) as edits from events)
select 'u' || user_id as vault, seq, case when event_type = 'error' then 'delete' when edits = 1 then 'create' else 'update' end as type, 'n/a.md' as path, sha256(case when event_type <> 'error' then seq::varchar else lag(seq::varchar) over (partition by user_id order by seq) end) as "contentHash" from n
where event_type <> 'error' or (k > 1 and before <> 'error')""", fixture=False)
def event_operations(spark, d):
    """ST3-ST5: one file of each vault edited, deleted and created again; a deletion of what is gone, or was never there, is no operation."""
    e = _t(spark, d, "events")
    gone = F.col("event_type") == "error"
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("vault"), F.col("event_id").alias("seq"), F.when(gone, "delete").otherwise("modify").alias("kind"), F.lit("n/a.md").alias("path"), F.lit(None).cast("string").alias("oldPath"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), F.when(~gone, F.col("event_id").cast("string").cast("binary")).alias("bytes"))
    return ingest.fold_batch(rows).select("vault", "seq", "type", "path", "contentHash")
