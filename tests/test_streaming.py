import pytest
from pyspark.sql import functions as F

from tidefold.operators import oplog
from tidefold.plans import fixtures, known
from tidefold.streaming import ingest


def test_event_folding():
    f = ingest.Folder("d")
    a = f.event("create", "a", None, 1, b"x")
    assert [o["type"] for o in a] == ["create"] and a[0]["parents"] == []
    assert f.event("modify", "a", None, 2, b"x") == []
    b = f.event("modify", "a", None, 3, b"y")
    assert b[0]["parents"] == [a[0]["id"]]
    m = f.event("rename", "b", "a", 4, None)
    assert m[0]["type"] == "move" and m[0]["path"] == "b"
    assert f.event("delete", "b", None, 5, b"y", exists=True) == []
    c = f.event("modify", "b", None, 6, b"z")
    assert c[0]["parents"] == [b[0]["id"]]
    d = f.event("delete", "b", None, 7, None)
    assert d[0]["type"] == "delete"
    r = f.event("create", "b", None, 8, b"again")
    assert r[0]["fileId"] == a[0]["fileId"] and r[0]["parents"] == [d[0]["id"]]
    f.files[a[0]["fileId"]]["open"] = ["p", "q"]
    assert f.event("modify", "b", None, 9, b"<<<<<<< a\n>>>>>>> b") == []
    done = f.event("modify", "b", None, 10, b"fixed")
    assert done[0]["parents"] == ["p", "q"] and done[0]["id"].startswith("m-")


@pytest.fixture
def events(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "error", "delete").otherwise("modify")
    path = lambda k: F.concat(F.lit("n"), (F.floor(F.col("event_id") / k) % 10).cast("string"))
    return e.select(F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("vault"), F.col("event_id").alias("seq"), kind.alias("kind"), path(3).alias("path"), path(9).alias("oldPath"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), F.when(kind != "delete", F.col("props").cast("binary")).alias("bytes"))


def test_stream_is_batch(spark, events, tmp_path):
    n = 4
    for i in range(n):
        events.where((F.col("seq") >= 250 * i) & (F.col("seq") < 250 * (i + 1) if i < n - 1 else F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.fold_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(map(str, r)) for r in ingest.fold_batch(events).collect()}
    assert got == want and got


def test_running_projection_and_append_once(spark, data, tmp_path):
    ops = fixtures.plain(fixtures.ops(spark, data))
    ops.repartition(3).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    q = ingest.running_projection(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    pick = lambda df: {(r.id, r.path, r.headVersionId, r.deleted) for r in df.collect()}
    assert pick(spark.table("live")) == pick(oplog.project(ops))
    rows = ops.select(F.col("id").alias("clientOpId"), "fileId")
    rows.unionByName(rows).repartition(4).write.parquet(str(tmp_path / "sent"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sent"))
    ingest.append_once(stream, str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == got.select("clientOpId").distinct().count() == ops.count()


def test_debounce(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.4), ("a", 9.0), ("b", 1.0)], "path string, s double").select("path", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.path, r.n) for r in ingest.debounce(rows).collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_flushed_bursts_are_files(spark, data, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    got = known.debounce_flush(spark, data)
    assert got.inputFiles() and got.count()  # written by executors, not held by the driver
    spark.read.parquet(f"{data}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert known.debounce_flush(spark, str(tmp_path)).collect() == []
    assert spark.conf.get(key) == before


def test_replaced_by_each_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.replace_all(ingest.debounce(stream, "7200 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.lastProgress["batchId"] == 2
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(ingest.debounce(rows, "7200 seconds").collect())
