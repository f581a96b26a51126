"""A query for each group of operators over the driver's tables, with DuckDB SQL where there is a form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions import hlc
from tidefold.functions import text as tx
from tidefold.operators import applying, blobs, capture, classify, graph, merging, oplog, reconcile
from tidefold.plans import fixtures, rounds
from tidefold.plans.fixtures import FIXTURE_SQL
from tidefold.scratch import materialize
from tidefold.sources import crypto, journals, remote
from tidefold.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, fixture: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (FIXTURE_SQL + sql.replace("with ", ", ", 1) if fixture and sql.lstrip().startswith("with ") else (FIXTURE_SQL if fixture else "") + sql)
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ops(spark, d):
    return fixtures.ops(spark, d)


def _entries(spark, d, which: int | None = None) -> DataFrame:
    rows = _ops(spark, d)
    return oplog.project(fixtures.plain(rows if which is None else fixtures.replica(rows, which)))


def _versions(spark, d) -> DataFrame:
    return graph.build(graph.from_ops(_ops(spark, d)))


def _list(x) -> F.Column:
    """An array as one string, for comparisons."""
    return F.array_join(F.array_sort(x), ",")


# --- log ----------------------------------------------------------------------------------------

PROJECT = """, last as (select *, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops),
entries as (select fileId as id, path, contentHash, id as opId, type = 'delete' as deleted, case when type = 'move' then parent1 else id end as headVersionId, wall, counter, device from last where k = 1)
"""


@query(PROJECT + "select id, path, contentHash, deleted, headVersionId, wall, counter, device from entries")
def log_projection(spark, d):
    """A1: the state of every file."""
    e = _entries(spark, d)
    return e.select("id", "path", "contentHash", "deleted", "headVersionId", F.col("hlcTimestamp.wallTime").alias("wall"), F.col("hlcTimestamp.counter").alias("counter"), F.col("hlcTimestamp.deviceId").alias("device"))


@query("select id, wall, counter, device, fileId, type, path, contentHash, array_to_string(parents, ',') as parents from ops")
def log_ops(spark, d):
    """The log itself: HLC closed form (F6), ids (F3), lag and running counts."""
    return _ops(spark, d).select("id", F.col("hlcTimestamp.wallTime").alias("wall"), F.col("hlcTimestamp.counter").alias("counter"), F.col("hlcTimestamp.deviceId").alias("device"), "fileId", "type", "path", "contentHash", _list("parents").alias("parents"))


@query("""select id, split_part(id, '-', 1)::bigint as wall, split_part(id, '-', 2)::bigint as counter, substr(id, 26) as device,
    case when wall > 1704100000000 or (wall = 1704100000000 and (counter > 0 or (counter = 0 and device > 'dev-1'))) then 1 when wall = 1704100000000 and counter = 0 and device = 'dev-1' then 0 else -1 end as cmp,
    case when wall > 1704100000000 or (wall = 1704100000000 and (counter > 0 or (counter = 0 and device > 'dev-1'))) then wall else 1704100000000 end as later_wall from ops""")
def hlc_functions(spark, d):
    """Compare, max, format, parse."""
    rows = _ops(spark, d)
    ref = hlc.hlc(F.lit(1704100000000), F.lit(0), F.lit("dev-1"))
    back = hlc.from_string(F.col("id"))
    return rows.select("id", back["wallTime"].alias("wall"), back["counter"].alias("counter"), back["deviceId"].alias("device"), hlc.compare(F.col("hlcTimestamp"), ref).alias("cmp"), hlc.later(F.col("hlcTimestamp"), ref)["wallTime"].alias("later_wall"))


@query(PROJECT.replace("from ops)", "from ops where device <> 'dev-1')") + "select id, path, deleted, headVersionId from entries")
def own_op_exclusion(spark, d):
    """A2: projection without this device's own operations."""
    return oplog.project(oplog.without_own(fixtures.plain(_ops(spark, d)), "dev-1")).select("id", "path", "deleted", "headVersionId")


@query(""", l as (select *, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops where event_id % 3 in (0, 1)),
r as (select *, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops where event_id % 3 in (0, 2)),
u as (select * from l where k = 1 union all select * from r where k = 1), x as (select *, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as m from u)
select fileId as id, path, contentHash, type = 'delete' as deleted from x where m = 1""")
def lww_upsert(spark, d):
    """A3: entries of one replica upserted with those of the other."""
    return oplog.upsert(_entries(spark, d, 1), _entries(spark, d, 2)).select("id", "path", "contentHash", "deleted")


@query(""", pend as (select * from ops where event_id % 3 = 1), t as (select fileId, min(case when type = 'create' then (wall, counter, device) end) as c, max(case when type = 'delete' then (wall, counter, device) end) as x from pend group by fileId)
select pend.id, fileId, type from pend where fileId not in (select fileId from t where c < x)""")
def cancel_pending(spark, d):
    """A4: files created and deleted before anything was sent."""
    return oplog.cancel_pending(fixtures.plain(_ops(spark, d).where("event_id % 3 = 1"))).select("id", "fileId", "type")


@query("select type, count(*) as n from ops group by type")
def pending_counts(spark, d):
    """A5."""
    return oplog.pending_counts(_ops(spark, d))


@query(""", dup as (select id, fileId, event_id as pos from ops union all select id, 'again-' || fileId, event_id + 1000000 from ops where event_id % 5 = 0),
k as (select *, row_number() over (partition by id order by pos) as rn from dup) select id, fileId from k where rn = 1""")
def journal_dedup(spark, d):
    """First occurrence of each op id."""
    rows = _ops(spark, d).select("id", "fileId", F.col("event_id").alias("pos"))
    again = rows.where("pos % 5 = 0").select("id", F.concat(F.lit("again-"), "fileId").alias("fileId"), (F.col("pos") + 1000000).alias("pos"))
    return oplog.dedupe_by_id(rows.unionByName(again), "pos").select("id", "fileId")


@query(""", j as (select fileId as id, path, event_id as pos, type = 'delete' as del from ops where event_id % 3 <> 0), s as (select fileId as id, min(path) as path, -1 as pos, false as del from ops where event_id % 3 = 0 group by fileId),
k as (select *, row_number() over (partition by id order by pos desc) as rn from (select * from j union all select id, path, pos, del from s)) select id, path from k where rn = 1 and not del""")
def registry_journal(spark, d):
    """Snapshot and journal folded, the last line of an id wins, {del} removes."""
    rows = _ops(spark, d)
    snap = rows.where("event_id % 3 = 0").groupBy(F.col("fileId").alias("id")).agg(F.min("path").alias("entry"))
    journal = rows.where("event_id % 3 <> 0").select(F.col("event_id").alias("pos"), F.col("fileId").alias("id"), F.when(F.col("type") != "delete", F.col("path")).alias("entry"), (F.col("type") == "delete").alias("del"))
    return journals.fold_registry(snap, journal).select("id", F.col("entry").alias("path"))


@query(""", e as (select id, unnest(parents) as p from ops where type <> 'move' union all select id, null from ops where type <> 'move' and len(parents) = 0)
select id as versionId, p as parent from e where id in (select id from ops where event_id % 2 = 1)""")
def graph_delta(spark, d):
    """Edges of the log that a graph of half of it lacks."""
    rows = _ops(spark, d)
    old = graph.build(graph.from_ops(rows.where("event_id % 2 = 0")))
    return graph.new_edges(old, graph.build(graph.from_ops(rows)))


# --- scalars ------------------------------------------------------------------------------------


@query("""select doc_id, sha256(text) as h, base64(encode(text)) as b, lower(hex(encode(text))) as x, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as n_lines,
    octet_length(encode(text)) > 4096 as too_large from documents""", fixture=False)
def scalar_encodings(spark, d):
    """F7, F8, F15, F17."""
    t = F.col("text")
    one_line = lambda x: F.regexp_replace(x, "[\r\n]", "")  # noqa: E731  Spark's base64 has no breaks, some builds have
    return _t(spark, d, "documents").select("doc_id", tx.sha256(t).alias("h"), one_line(tx.to_base64(t.cast("binary"))).alias("b"), tx.to_hex(t.cast("binary")).alias("x"), F.size(tx.lines(t)).cast("bigint").alias("n_lines"), tx.is_too_large(F.octet_length(t), 4096 / 1048576).alias("too_large"))


@query("""select page_id, url, regexp_matches(url, '^https?://[^/]*example\\.org/.*$') as org, regexp_full_match(url, 'https://m\\.[^/]*/en/.*') as mobile_en, regexp_full_match(url, 'http[^/]://[^/]*/[^/]*/[^/]*\\.html') as html3 from pages""", fixture=False)
def glob_match(spark, d):
    """globs as anchored expressions."""
    u = F.col("url")
    g = lambda *globs: F.lit(False) if not globs else u.rlike("|".join(tx.glob_pattern(x) for x in globs))
    return _t(spark, d, "pages").select("page_id", "url", g("http://*example.org/**", "https://*example.org/**").alias("org"), g("https://m.*/en/**").alias("mobile_en"), g("http?://*/*/*.html").alias("html3"))


@query("""select event_id, case when event_id % 7 = 0 then null when value is null then null else round(value) end as v, case when event_id % 600 between 200 and 299 then null when event_id % 600 in (401, 403) then 'auth'
    when event_id % 600 = 404 then 'not_found' when event_id % 600 = 409 then 'stale_cursor' when event_id % 600 = 413 then 'too_large' else 'server' end as error, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k,
    case when event_id % 11 = 0 then false else (1000 - event_id % 2000 >= 86400 or 1000 < event_id % 2000) end as due from events""", fixture=False)
def scalar_predicates(spark, d):
    """F24, F25, F27."""
    e = F.col("event_id")
    k = tx.json_or_default(F.col("props"), "k bigint", k=-1)["k"].cast("bigint")
    return _t(spark, d, "events").select("event_id", F.when(e % 7 == 0, F.lit(None)).otherwise(F.round("value")).alias("v"), tx.error_of_status(e % 600).alias("error"), k.alias("k"), tx.gc_due(F.when(e % 11 != 0, e % 2000), F.lit(1000), 86400).alias("due"))


# --- graph --------------------------------------------------------------------------------------

GRAPH = """, ver as (select id as v, parents, contentHash, fileId from ops where type <> 'move'), edg as (select v, unnest(parents) as p from ver)
"""


@query(GRAPH + "select fileId, array_to_string(list_sort(list(v)), ',') as leaves from ver where v not in (select p from edg) group by fileId")
def graph_leaves(spark, d):
    """Open leaves of every file."""
    return graph.leaves(_versions(spark, d)).select("fileId", _list("leaves").alias("leaves"))


@query(GRAPH + "select v as versionId, array_to_string(parents, ',') as parents, contentHash, fileId, len(parents) >= 2 as merges from ver")
def graph_build(spark, d):
    """The graph of the log."""
    return _versions(spark, d).select("versionId", _list("parents").alias("parents"), "contentHash", "fileId", graph.is_merge_node(F.col("parents")).alias("merges"))


HEADS = PROJECT.replace("entries as", "ent as") + GRAPH


RECURSIVE = FIXTURE_SQL.replace("with ev as", "with recursive ev as", 1)


@query()
def graph_ancestors(spark, d):
    """Ancestors of every head."""
    heads = _entries(spark, d).select(F.col("headVersionId").alias("start"))
    return graph.ancestors(heads, _versions(spark, d)).select("start", "ancestor")


SQL["graph_ancestors"] = RECURSIVE + HEADS + """, walk as (select headVersionId as s, headVersionId as a from ent union select walk.s, edg.p from walk join edg on edg.v = walk.a) select s as start, a as ancestor from walk"""


@query()
def graph_merge_base(spark, d):
    """Common bases of the replicas' heads, or that there are several."""
    l, r, v, _ = _replicas(spark, d)
    pairs = l.select("id", F.col("headVersionId").alias("a")).join(r.select("id", F.col("headVersionId").alias("b")), "id").select(F.col("id").alias("pair"), "a", "b", F.array().cast("array<string>").alias("opens"))
    return graph.pair_facts(pairs, v).select("a", "b", "base", "ambiguous", "a_above_b", "b_above_a")


SQL["graph_merge_base"] = RECURSIVE + GRAPH + """, lh as (select fileId, arg_max(case when type = 'move' then parent1 else id end, (wall, counter, device)) as h from ops where event_id % 3 in (0, 1) group by fileId),
rh as (select fileId, arg_max(case when type = 'move' then parent1 else id end, (wall, counter, device)) as h from ops where event_id % 3 in (0, 2) group by fileId),
pairs as (select lh.h as a, rh.h as b from lh join rh using (fileId)), starts as (select a as s from pairs union select b from pairs),
walk as (select s, s as a from starts union select walk.s, edg.p from walk join edg on edg.v = walk.a),
common as (select p.a as x, p.b as y, u.a as c from pairs p join walk u on u.s = p.a join walk w on w.s = p.b and w.a = u.a),
below as (select x, y, e.p as c from common join edg e on e.v = c union select x, y, e.p from below join edg e on e.v = below.c),
best as (select * from common c where not exists (select 1 from below b where b.x = c.x and b.y = c.y and b.c = c.c)),
n as (select x, y, count(*) as k, min(c) as c from best group by x, y)
select a, b, case when k = 1 then c end as base, coalesce(k, 0) > 1 as ambiguous, exists(select 1 from walk w where w.s = b and w.a = pairs.a) as a_above_b, exists(select 1 from walk w where w.s = pairs.a and w.a = b) as b_above_a from pairs left join n on x = a and y = b"""


@query()
def graph_prune(spark, d):
    """Versions that the heads need."""
    e = _entries(spark, d)
    none = spark.createDataFrame([], "id string, parents array<string>")
    kept, _ = graph.sweep(_versions(spark, d), graph.roots(e, none))
    return kept.select("versionId")


SQL["graph_prune"] = RECURSIVE + HEADS + """, walk as (select headVersionId as a from ent union select edg.p from walk join edg on edg.v = walk.a) select distinct v as versionId from ver join walk on a = v"""


@query()
def graph_closure(spark, d):
    """G6 by joins of the frontier, for components of any size: what the deleted files' heads need."""
    e = _entries(spark, d).where("deleted").select(F.col("headVersionId").alias("versionId"))
    return graph.closure(e, _versions(spark, d)).distinct()


SQL["graph_closure"] = RECURSIVE + HEADS + """, walk as (select headVersionId as a from ent where deleted union select edg.p from walk join edg on edg.v = walk.a) select a as versionId from walk"""


@query(GRAPH + """, lv as (select fileId, list_sort(list(v)) as l from ver where v not in (select p from edg) group by fileId) select fileId as id, array_to_string(l, ',') as heads, len(l) as n from lv where len(l) >= 2""")
def conflict_inventory(spark, d):
    """Files with several open heads."""
    lv = graph.leaves(_versions(spark, d)).select(F.col("fileId").alias("id"), F.col("fileId").alias("path"), F.col("leaves").alias("conflictParents"))
    return graph.open_conflicts(lv, by_path=False).select("id", F.array_join(F.transform("heads", lambda h: h["versionId"]), ",").alias("heads"), F.size("heads").cast("bigint").alias("n"))


# --- merging ------------------------------------------------------------------------------------


def _replicas(spark, d):
    rows = _ops(spark, d)
    side = lambda k: materialize(oplog.project(fixtures.plain(fixtures.replica(rows, k))))
    return side(1), side(2), materialize(graph.build(graph.from_ops(rows))), fixtures.contents(spark, d)


@query()
def merge_classification(spark, d):
    """One action for every file of two replicas."""
    l, r, v, x = _replicas(spark, d)
    out = classify.classify(l, r, v, x, x)
    return out.select("id", "rule", "action", "path", "contentHash", "headVersionId", _list("parents").alias("parents"), F.col("hlc.wallTime").alias("wall"))


@query(""", l as (select fileId, arg_max({'path': path, 'h': contentHash, 'head': case when type = 'move' then parent1 else id end, 'dead': type = 'delete'}, (wall, counter, device)) as s from ops where event_id % 3 in (0, 1) group by fileId),
r as (select fileId, arg_max({'path': path, 'h': contentHash, 'head': case when type = 'move' then parent1 else id end, 'dead': type = 'delete'}, (wall, counter, device)) as s from ops where event_id % 3 in (0, 2) group by fileId)
select fileId as id from l join r using (fileId) where not l.s.dead and not r.s.dead and l.s = r.s""")
def converged_files(spark, d):
    """R14."""
    return classify.converged(_entries(spark, d, 1), _entries(spark, d, 2))


@query()
def text_three_way(spark, d):
    """Three-way merges of documents' lines."""
    out = merging.three_way(fixtures.merge_texts(spark, d))
    return out.select("doc_id", F.sha2(F.array_join("merge.merged", "\n"), 256).alias("merged_sha"), F.size("merge.conflicts").alias("n_conflicts"), "merge.hasConflicts")


@query()
def text_markers(spark, d):
    """Rendered, parsed, counted and resolved conflicts."""
    marked = merging.render(merging.three_way(fixtures.merge_texts(spark, d))).select("doc_id", F.col("marked").alias("text"))
    picks = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit(0), F.struct(F.lit("both").alias("kind"), F.lit(None).cast("array<string>").alias("text")))).cast(schemas.PICKS)
    rows = merging.resolve(merging.count_conflicts(marked).withColumn("picks", picks))
    return rows.select("doc_id", "n_conflicts", tx.has_markers(F.col("text")).alias("marked"), F.sha2("resolved", 256).alias("resolved_sha"), tx.has_markers(F.col("resolved")).alias("still_marked"))


@query()
def text_diff(spark, d):
    """Runs of equal, deleted and inserted lines."""
    rows = merging.diff_lines(fixtures.merge_texts(spark, d), "base", "theirs")
    return rows.select("doc_id", F.posexplode("diff").alias("pos", "r")).select("doc_id", "pos", "r.kind", F.size("r.lines").alias("n"))


@query()
def multi_head_fold(spark, d):
    """Open heads folded into one, pass by pass."""
    rows = _ops(spark, d)
    v = graph.build(graph.from_ops(rows))
    dead = rows.where("type = 'delete'").select(F.col("id").alias("versionId"))
    pulled = rows.where("event_id % 3 <> 0").select(F.col("id").alias("versionId"))
    heads, _, _ = reconcile.fold_heads(oplog.project(fixtures.plain(rows)).where("not deleted").select(F.col("id").alias("fileId"), F.col("headVersionId").alias("head")), v, fixtures.contents(spark, d), pulled, dead)
    return heads


@query()
def apply_plan(spark, d):
    """Files, operations and entries that the actions lead to."""
    l, r, v, x = _replicas(spark, d)
    actions = materialize(classify.classify(l, r, v, x, x))
    told = applying.decide(actions, spark.createDataFrame([], "id string, decision string"), "keep")
    made = applying.resolution_ops(told, "dev-1", F.lit(1_800_000_000_000))
    return applying.next_entries(l, told, made).select("id", "path", "contentHash", "deleted", "headVersionId", _list("conflictParents").alias("conflictParents"))


# --- registry -----------------------------------------------------------------------------------


def _disk(spark, d):
    """Registry after two thirds of the log, and the listing after all of it."""
    rows = _ops(spark, d)
    n = _t(spark, d, "events").count()
    stat = lambda e: e.withColumn("mtime", F.col("hlcTimestamp.wallTime")).withColumn("size", F.length("path").cast("bigint"))
    reg = stat(oplog.project(fixtures.plain(rows.where(F.col("event_id") < n * 2 // 3))))
    now = stat(oplog.project(fixtures.plain(rows))).where("not deleted")
    return reg, now.select("path", "mtime", "size"), now.select("path", F.col("contentHash").alias("hash"))


REGISTRY = """, cut as (select count(*) * 2 // 3 as n from events), rl as (select o.*, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops o, cut where event_id < n),
reg as (select fileId as id, path, contentHash, wall as mtime, length(path) as size, case when type = 'move' then parent1 else id end as head, type = 'delete' as deleted from rl where k = 1),
al as (select *, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops), disk as (select path, contentHash as hash, wall as mtime, length(path) as size from al where k = 1 and type <> 'delete')
"""


@query(REGISTRY + """, j as (select path, d.mtime as dm, d.size as ds, hash, r.id as rid, r.contentHash as rh, r.head, r.mtime as rm, r.size as rs from disk d full outer join (select * from reg where not deleted) r using (path))
select path, rid as known_id, case when dm is null then 'delete' when rid is null then 'create' when dm = rm and ds = rs then 'unchanged' when hash = rh then 'refreshed' else 'update' end as outcome,
case when dm is null then rh when rid is null then hash when dm = rm and ds = rs or hash = rh then null else hash end as contentHash from j""")
def capture_offline(spark, d):
    """Listing against registry, with the gate on time and size."""
    reg, listing, hashes = _disk(spark, d)
    out = capture.capture(reg, listing, hashes)
    known = reg.where("not deleted").select("path", F.col("id").alias("known_id"))
    return out.join(known, "path", "left").select("path", "known_id", "outcome", "contentHash")


@query(REGISTRY + """select path, r.id as known_id, case when r.id is null then 'added' when d.path is null then 'tombstoned' else 'kept' end as change from disk d full outer join (select * from reg where not deleted) r using (path)""")
def registry_reconcile(spark, d):
    """R6."""
    reg, listing, _ = _disk(spark, d)
    known = reg.where("not deleted").select("path", F.col("id").alias("known_id"))
    return capture.reconcile(reg, listing).join(known, "path", "left").select("path", "known_id", "change")


@query(REGISTRY + """, now as (select max(wall) as t from ops) select reg.id from reg, now where deleted and mtime <= t - 10 * 86400000::bigint and reg.id not in (select fileId from ops where event_id % 50 = 0)""")
def tombstone_reclaim(spark, d):
    """R11."""
    reg, _, _ = _disk(spark, d)
    rows = _ops(spark, d)
    now = rows.agg(F.max("hlcTimestamp.wallTime")).first()[0]
    pinned = rows.where("event_id % 50 = 0").select(F.col("fileId").alias("id")).distinct()
    return capture.reclaimable(reg, pinned, (now or 0) + 20 * 86_400_000, days=1)


@query(REGISTRY + """select r.path from reg r join disk d using (path) where r.contentHash <> d.hash""")
def drift(spark, d):
    """R16."""
    reg, _, hashes = _disk(spark, d)
    return capture.drifted(reg.select("path", "contentHash"), hashes.withColumnRenamed("hash", "contentHash"))


# --- blobs --------------------------------------------------------------------------------------

PACKS = """, h as (select sha256(text) as hash, min(doc_id) as doc_id, min(octet_length(encode(text))) as len from documents group by 1), idx as (select hash, 'p' || (doc_id // 40) as packId, len from h),
lst as (select contentHash, type, row_number() over (partition by fileId order by wall desc, counter desc, device desc) as k from ops), keep as (select distinct contentHash as hash from lst where k = 1 and type <> 'delete'),
st as (select packId, count(*) as n, count(k.hash) as live, sum(len) as bytes, sum(case when k.hash is null then 0 else len end) as live_bytes from idx left join keep k using (hash) group by packId)
"""


def _keep(spark, d):
    none = spark.createDataFrame([], "hash string")
    return oplog.keep_set(_entries(spark, d), none)


@query(PACKS + "select packId, n, live, bytes::bigint as bytes, live_bytes::bigint as live_bytes from st")
def pack_stats(spark, d):
    """A8, A9."""
    return blobs.pack_stats(fixtures.pack_index(spark, d), _keep(spark, d))


@query(PACKS + """select packId, n, live, case when substr(packId, 2)::int % 5 = 4 then 'keep' when substr(packId, 2)::int % 3 = 0 then 'keep' when live = 0 then 'retire' when live / n < 0.1 then 'compact' else 'keep' end as verdict from st""")
def gc_plan(spark, d):
    """Every fifth pack has no date, every third is young."""
    idx = fixtures.pack_index(spark, d)
    n = F.substring("packId", 2, 9).cast("int")
    packs = idx.select("packId").distinct().where(n % 5 != 4).select("packId", F.when(n % 3 == 0, 1000).otherwise(0).cast("bigint").alias("mtime"))
    return blobs.gc_plan(idx, _keep(spark, d), packs, 1500, 1000, 0.1)


@query(PACKS + """select packId, n, live, case when live = 0 then 'retire' when live < 6 then 'merge' when live < n then 'compact' else 'leave' end as verdict from st""")
def consolidation_plan(spark, d):
    """C5."""
    return blobs.consolidation_plan(fixtures.pack_index(spark, d), _keep(spark, d), 6)


@query(PACKS + """, w as (select distinct fileId, contentHash as hash from ops where event_id % 4 = 1 and contentHash is not null), reg as (select distinct fileId, contentHash as hash from ops where event_id % 4 = 0)
select w.fileId, w.hash, case when reg.hash is not null then 0 when i.hash is not null then 1 when d.doc_id % 3 = 0 then 2 else -1 end as tier from w left join reg on reg.fileId = w.fileId and reg.hash = w.hash
left join (select * from idx where substr(packId, 2)::int % 2 = 0) i on i.hash = w.hash left join h d on d.hash = w.hash""")
def blob_tiers(spark, d):
    """C7."""
    rows = _ops(spark, d)
    wanted = rows.where("event_id % 4 = 1 and contentHash is not null").select("fileId", F.col("contentHash").alias("hash")).distinct()
    reg = rows.where("event_id % 4 = 0").select(F.col("fileId").alias("id"), "contentHash", F.lit(False).alias("deleted"))
    idx = fixtures.pack_index(spark, d)
    first = _t(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("i")).where("i % 3 = 0")
    out = blobs.resolve_tiers(wanted, reg, idx.where("cast(substring(packId, 2) as int) % 2 = 0"), first)
    return out.select("fileId", "hash", F.coalesce("tier", F.lit(-1)).alias("tier"))


@query("""select least(max(event_id), min(case when contentHash is null or event_id % 997 = 500 then event_id end) - 1) as "cursor" from ops""")
def safe_cursor(spark, d):
    """C9."""
    rows = _ops(spark, d)
    return blobs.safe_cursor(rows.select(F.col("event_id").alias("seq")), rows.where("contentHash is null or event_id % 997 = 500").select(F.col("event_id").alias("seq")), 0)


@query("""select sha256(text) as hash, count(*) as n from documents group by 1""", fixture=False)
def content_dedup(spark, d):
    """Copies of each content."""
    docs = _t(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return blobs.dedup(docs).join(docs.groupBy("hash").agg(F.count("*").alias("n")), "hash")


@query("""select id, (row_number() over (order by wall, counter, device) - 1) // 100 as chunk from ops""")
def op_chunks(spark, d):
    """Operations in chunks of a hundred, in order of their clocks."""
    return blobs.op_chunks(_ops(spark, d).select("id", "hlcTimestamp"), 100).select("id", "chunk")


# --- server, crypto, streams --------------------------------------------------------------------


@query("""select id, event_id as seq from ops where event_id > 100 order by event_id limit 250""")
def remote_pull(spark, d):
    """A page of the log."""
    page, _ = remote.pull(_ops(spark, d).select("id", F.col("event_id").alias("seq")), 100, 250)
    return page


@query("""select id as "clientOpId", row_number() over (order by event_id) + (select max(event_id) from ops where event_id % 2 = 0) as seq from ops where event_id % 2 = 1""")
def remote_append(spark, d):
    """The odd operations sent to a log of the even ones, twice."""
    rows = _ops(spark, d).select(F.col("id").alias("clientOpId"), F.col("event_id").alias("pos"), F.array().cast("array<string>").alias("blobRefs"))
    log = rows.where("pos % 2 = 0").select("clientOpId", F.col("pos").alias("seq"))
    sent = rows.unionByName(rows.withColumn("pos", F.col("pos") + 1000000))
    new, _ = remote.append(log, sent, spark.createDataFrame([], "hash string"))
    return new.select("clientOpId", "seq")


@query("""select distinct contentHash as hash from ops where event_id % 10 = 3 and contentHash not in (select sha256(text) from documents where doc_id % 2 = 0)""")
def remote_blob_check(spark, d):
    """S24."""
    held = _t(spark, d, "documents").where("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return remote.blob_check(_ops(spark, d).where("event_id % 10 = 3 and contentHash is not null").select(F.col("contentHash").alias("hash")), held)


@query("""select id, fileId, type from ops""")
def sealed_ops(spark, d):
    """Every operation sealed and opened again."""
    key = crypto.derive("a passphrase", "a vault", 1000)["enc"]
    rows = _ops(spark, d).select(F.struct("id", "fileId", "type").alias("op"))
    return rows.select(crypto.unseal_op(crypto.seal_op(F.col("op"), key), key, "id string, fileId string, type string").alias("o")).select("o.*")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 7200 second then 0 else 1 end as new from events),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e)
select 'p' || user_id as path, epoch_us(min(ts)) // 1000 as first_ms, epoch_us(max(ts)) // 1000 as last_ms, count(*) as n from g group by user_id, g""", fixture=False)
def debounce(spark, d):
    """ST1: bursts of changes of a path, as gaps and islands (here two hours)."""
    rows = _t(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return ingest.debounce(rows, "7200 seconds").select("path", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "n")


@query()
def event_fold(spark, d):
    """ST3-ST6: change events folded into operations, vault by vault."""
    e = _t(spark, d, "events")
    path = lambda k: F.concat(F.lit("n"), (F.floor(F.col("event_id") / k) % 40).cast("string"))
    kind = F.when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("modify")
    rows = e.select(F.concat(F.lit("v"), (F.col("event_id") % 16).cast("string")).alias("vault"), F.col("event_id").alias("seq"), kind.alias("kind"), path(16).alias("path"), path(48).alias("oldPath"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), F.when(kind != "delete", F.col("props").cast("binary")).alias("bytes"))
    return ingest.fold_batch(rows).select("vault", "seq", "id", "type", "path", "contentHash", _list("parents").alias("parents"))


@query("""with r as (select event_id, value, ntile(4) over (order by event_id) as q from events where value is not null), m as (select q, avg(value) as v from r group by q)
select round(max(case when q = 4 then v end) / max(case when q = 1 then v end), 6) as ratio, max(case when q = 4 then v end) / max(case when q = 1 then v end) < 1.5 as flat from m""", fixture=False)
def append_growth(spark, d):
    """Growth of the last quarter over the first of a series of timings."""
    rows = blobs.numbered(_t(spark, d, "events").where("value is not null").select("event_id", "value"), ["event_id"])
    n = rows.count()
    # ntile: the first n % 4 quarters have one row more
    cut, more = n // 4, n % 4
    q = F.when(F.col("_n") < more * (cut + 1), F.floor(F.col("_n") / (cut + 1))).otherwise(more + F.floor((F.col("_n") - more * (cut + 1)) / max(cut, 1))) + 1
    m = rows.groupBy(q.alias("q")).agg(F.avg("value").alias("v")).agg(*(F.max(F.when(F.col("q") == k, F.col("v"))).alias(f"v{k}") for k in (1, 4)))
    return m.select(F.round(F.col("v4") / F.col("v1"), 6).alias("ratio"), (F.col("v4") / F.col("v1") < 1.5).alias("flat"))


# --- more of the registry, the server and labels -------------------------------------------------


@query("""select 'p' || (doc_id // 40) as packId, hash, true as ok from (select sha256(text) as hash, min(doc_id) as doc_id from documents group by 1)""", fixture=False)
def pack_read(spark, d):
    """Blobs written to packs, the index read, each blob verified by its hash."""
    rows = fixtures.contents(spark, d)
    index, packs = journals.write_packs(rows, 40)
    got = journals.read_packed(index, packs).where("bytes is not null").select("hash", F.lit(True).alias("ok"))
    return got.join(fixtures.pack_index(spark, d).select("hash", "packId"), "hash").select("packId", "hash", "ok")


@query("""select id, wall, type from ops where event_id % 3 = 1""")
def pending_list(spark, d):
    """A5: pending operations, by clock."""
    return oplog.pending_list(_ops(spark, d).where("event_id % 3 = 1")).select("id", F.col("hlcTimestamp.wallTime").alias("wall"), "type")


@query("""select (select count(*) from ops where event_id % 3 = 1) as pushed, (select count(*) from ops where event_id % 3 = 2) as pulled, (select count(distinct fileId) from ops where type = 'delete') as deferred,
    (select count(distinct contentHash) from ops where event_id % 10 = 3) as stranded, (select count(distinct fileId) from ops where len(parents) >= 2) as conflicts""")
def round_summary(spark, d):
    """A6."""
    rows = _ops(spark, d)
    return oplog.round_summary(rows.where("event_id % 3 = 1"), rows.where("event_id % 3 = 2"), rows.where("type = 'delete'").select("fileId").distinct(), rows.where("event_id % 10 = 3 and contentHash is not null").select("contentHash").distinct(), rows.where("size(parents) >= 2").select("fileId").distinct())


@query(PROJECT + """, def as (select distinct fileId from ops where event_id % 20 = 3), con as (select distinct fileId from ops where event_id % 41 = 3) select def.fileId, path from def left join entries on id = def.fileId where def.fileId not in (select fileId from con)""")
def deferred_files(spark, d):
    """Deferred files that are no conflicts."""
    rows = _ops(spark, d)
    pick = lambda n: rows.where(F.col("event_id") % n == 3).select("fileId").distinct()
    return oplog.deferred_only(pick(20), pick(41), oplog.project(fixtures.plain(rows)))


@query(REGISTRY + """, asked as (select path from disk union select path from reg union select 'n/new-' || path from disk), best as (select path, arg_max({'id': id, 'dead': deleted}, (not deleted, mtime)) as e from reg group by path)
select asked.path, e.id as known_id, case when e is null then 'new' when e.dead then 'resurrected' else 'tracked' end as how from asked left join best using (path)""")
def registry_register(spark, d):
    """The id that a file at a path has."""
    reg, listing, _ = _disk(spark, d)
    asked = listing.select("path").union(reg.select("path")).union(listing.select(F.concat(F.lit("n/new-"), "path"))).distinct()
    out = capture.register(reg, asked)
    return out.select("path", F.when(F.col("how") != "new", F.col("id")).alias("known_id"), "how")


@query(REGISTRY + """select r.id, r.path, case when r.head is not null and r.mtime = d.mtime and r.size = d.size then r.contentHash else coalesce(d.hash, r.contentHash) end as contentHash,
    not (r.head is not null and coalesce(r.mtime = d.mtime and r.size = d.size, false)) as rehashed from reg r left join disk d using (path) where not r.deleted""")
def local_identity(spark, d):
    """Entries with the hash that is on disk."""
    return capture.identity(*_disk(spark, d))


@query(REGISTRY + """, act as (select id, case when length(id) % 2 = 0 then 'no_op' else 'send_remote' end as action from reg where right(id, 1) in ('1', '2', '3')) select id, case when id in (select id from act) and id not in (select fileId from ops where event_id % 30 = 3) and not deleted then path end as lastSyncedPath from reg""")
def synced_paths(spark, d):
    """R15."""
    reg, _, _ = _disk(spark, d)
    acts = reg.where(F.substring("id", -1, 1).isin("1", "2", "3")).select("id", F.when(F.length("id") % 2 == 0, "no_op").otherwise("send_remote").alias("action"))
    late = _ops(spark, d).where("event_id % 30 = 3").select(F.col("fileId").alias("id")).distinct()
    return capture.advance_synced(reg, acts, late).select("id", "lastSyncedPath")


@query("""with h as (select sha256(text) as hash, min(doc_id) as i from documents group by 1), n as (select hash, row_number() over (order by hash) - 1 as k from h where i % 3 <> 0) select hash, k // 100 as grp from n""", fixture=False)
def upload_batches(spark, d):
    """Missing blobs in batches of a hundred."""
    rows = fixtures.pack_index(spark, d)
    first = _t(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("i")).where("i % 3 = 0")
    return blobs.upload_batches(rows.select("hash", "len"), first, 100).select("hash", F.col("batch.group").alias("grp"))


@query(PACKS + """, v as (select packId from st where live > 0 and live < n), m as (select distinct hash from idx join keep using (hash) where packId in (select packId from v)) select hash, (row_number() over (order by hash) - 1) // 16 as newPack from m""")
def rewrite_plan(spark, d):
    """Live blobs of packs with dead ones, in new packs of sixteen."""
    index, keep = fixtures.pack_index(spark, d), _keep(spark, d)
    return blobs.rewrite_plan(index, keep, blobs.consolidation_plan(index, keep, 1), 16)


@query("""with h as (select sha256(text) as hash, min(doc_id) as i from documents group by 1) select hash from h where i % 2 = 1""", fixture=False)
def blob_put(spark, d):
    """Blobs that a store of half of them takes; the first write of a hash wins."""
    docs = _t(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("i"))
    return remote.blob_put(first.where("i % 2 = 0").select("hash"), docs.select("hash"))


@query("""select event_id as pos, sha256(event_type) as hash from events where sha256(event_type) <> sha256('view') and event_id % 3 = 0""", fixture=False)
def blob_get(spark, d):
    """Missing hashes as often as they are asked for."""
    wanted = _t(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("pos"), F.sha2(F.col("event_type").cast("binary"), 256).alias("hash"))
    _, missing = remote.blob_get(wanted, wanted.where("hash = sha2('view', 256)").select("hash").distinct())
    return missing.select("pos", "hash")


@query("""select event_id, case when event_id % 200000 < 1024 then (event_id % 200000) || ' B' else printf('%.1f KB', floor((event_id % 200000) / 1024.0 * 10 + 0.5) / 10) end as size, 'device ' || substr('abcdef123' || event_id, 1, 6) as device,
    case event_type when 'view' then 'Moved' when 'error' then 'Deleted' when 'signup' then 'New' else 'Edited' end as op, case event_id % 5 when 0 then 'setup' when 1 then 'setup' when 2 then 'link' when 3 then 'link' else 'other' end as error from events""", fixture=False)
def labels(spark, d):
    """labels of sizes, devices, operations and errors."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "move").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    error = F.element_at(F.array(*(F.lit(x) for x in ("auth", "decrypt", "network", "timeout", "server"))), (e % 5 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", tx.byte_size(e % 200000).alias("size"), tx.device_label(F.concat(F.lit("abcdef123"), e.cast("string"))).alias("device"), tx.op_label(kind).alias("op"), tx.error_class(error).alias("error"))


@query("""with o as (select 'c' || c_custkey as token from customer), q(claim, nobody) as (values ('c1', false), ('c0', false), ('c1', true))
select claim, nobody, case when nobody or (select count(*) from o) = 0 then 'free' when claim in (select token from o) then 'yours' else 'taken' end as verdict, not nobody as opens, false as opens_with_another from q""", fixture=False)
def preflight(spark, d):
    """Verdicts of claims on vaults with owners and without, and a key check that opens with its key only, if it is not too long."""
    key, other = (crypto.derive(x, "a vault", 1000)["verify"] for x in ("a passphrase", "another"))
    owners = _t(spark, d, "customer").select(F.lit("v").alias("vault"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("token"))
    store = spark.range(1).select(F.lit(crypto.slot()).alias("hash"), crypto.seal(F.lit(crypto.KEY_CHECK), key).alias("bytes"))
    out = None
    for claim, nobody in (("c1", False), ("c0", False), ("c1", True)):
        # the vault without owners has a key check that is over the cap
        told = remote.preflight(claim, owners.where(F.lit(not nobody)), store, crypto.slot(), 8 if nobody else 65536)
        row = told.select(F.lit(claim).alias("claim"), F.lit(nobody).alias("nobody"), "verdict", crypto.key_check(F.col("keyCheck"), key).alias("opens"), crypto.key_check(F.col("keyCheck"), other).alias("opens_with_another"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def sync_round(spark, d):
    """A whole round of device 1 against what devices 0 and 2 wrote."""
    rows = _ops(spark, d)
    mine, theirs = fixtures.plain(fixtures.replica(rows, 1)), fixtures.replica(rows, 2)
    registry = materialize(oplog.project(mine))
    pulled = theirs.withColumn("seq", F.col("event_id")).select("seq", *mine.columns)
    x = fixtures.contents(spark, d)
    disk = registry.where("not deleted").select("path", F.col("contentHash").alias("hash"))
    none = spark.createDataFrame([], "id string, decision string")
    out = rounds.run("dev-1", registry, mine, pulled, spark.createDataFrame([], schemas.VERSIONS), x, x, disk, none, 0, 1_800_000_000_000, "keep")
    return out.heads.join(out.cursor, F.lit(True)).select("fileId", "head", "cursor")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live files that the log leaves."""
    return log_projection(spark, sf_dir).where("not deleted")
