from tidefold.plans import fixtures, queries, rounds, views


def test_views_and_table_function(spark, data):
    views.register(spark, data)
    n = spark.sql("select count(*) n from entries e join versions v on e.headVersionId = v.versionId").first().n
    assert n > 0 and spark.table("ops").count() > n
    rows = spark.sql("select s.pos, s.kind from values ('a\n<<<<<<<\nb\n=======\nc\n>>>>>>>\nd') t(x), lateral conflict_segments(t.x) s order by s.pos").collect()
    assert [r.kind for r in rows] == ["clean", "conflict", "clean"]


def test_round_keeps_every_file(spark, data):
    rows = queries.QUERIES["sync_round"](spark, data)
    mine = fixtures.ops(spark, data).where("event_id % 3 in (0, 1)").select("fileId").distinct()
    assert rows.count() > 0 and rows.select("fileId").distinct().count() == rows.count()
    theirs = fixtures.ops(spark, data).where("event_id % 3 = 2").select("fileId").distinct()
    assert rows.join(mine.union(theirs), "fileId", "left_anti").count() == 0


def round_of(spark, data, failures=None):
    from pyspark.sql import functions as F

    from tidefold import schemas
    from tidefold.operators import oplog
    from tidefold.scratch import materialize

    rows = fixtures.ops(spark, data)
    mine = fixtures.plain(fixtures.replica(rows, 1))
    registry = materialize(oplog.project(mine))
    pulled = fixtures.replica(rows, 2).withColumn("seq", F.col("event_id")).select("seq", *mine.columns)
    x = fixtures.contents(spark, data)
    disk = registry.where("not deleted").select("path", F.col("contentHash").alias("hash"))
    none = spark.createDataFrame([], "id string, decision string")
    return registry, pulled, rounds.run("dev-1", registry, mine, pulled, spark.createDataFrame([], schemas.VERSIONS), x, x, disk, none, 0, 1_800_000_000_000, "keep", failures)


def test_round_leaves_no_live_file_out(spark, data):
    _, _, out = round_of(spark, data)
    live = out.entries.where("not deleted and headVersionId is not null and conflictParents is null").collect()
    heads = {r.fileId: r.head for r in out.heads.collect()}
    assert set(heads) == {r.id for r in live}
    known = {r.versionId for r in out.versions.collect()}
    assert all(h in known or h.startswith("m-") for h in heads.values())
    s = out.summary.first()
    assert s.applied > 0 and s.failed == 0 and not s.aborted and s.local_changes > 0


def test_round_with_failures_holds_the_cursor(spark, data):
    registry, pulled, out = round_of(spark, data)
    hit = [r.id for r in out.actions.where("action in ('write_local', 'write_merge')").orderBy("id").collect()][:2]
    assert hit
    _, _, again = round_of(spark, data, spark.createDataFrame([(i,) for i in hit], "id string"))
    before = {r.id: (r.path, r.contentHash, r.headVersionId) for r in registry.collect()}
    after = {r.id: (r.path, r.contentHash, r.headVersionId) for r in again.entries.collect()}
    assert all(after.get(i) == before.get(i) for i in hit)
    first = min(r.seq for r in pulled.collect() if r.fileId in hit)
    assert again.cursor.first().cursor <= max(first - 1, 0) and again.summary.first().failed == len(hit)


def test_administrative_runs(spark, data):
    reg, listing, hashes = queries._disk(spark, data)
    base = rounds.rebaseline(reg, listing, hashes)
    assert base.where("type is not null and outcome <> 'delete'").count() == listing.count()
    assert {r.outcome for r in rounds.rebuild(reg, listing, hashes).collect()} == {"create"}
    before, captured = rounds.reset(reg, listing, hashes)
    assert before.count() == captured.count()
