import hashlib

from pyspark.sql import functions as F

from tidefold.operators import blobs, capture
from tidefold.schemas import ENTRIES, LISTING, PACK_INDEX, PACKS
from tidefold.sources import crypto, files, journals, remote

DAY = 86_400_000


def e(i, path, h="h", deleted=False, wall=0, mtime=1, size=1, opens=None, head="v"):
    return (i, path, h, (wall, 0, "d"), deleted, None, head, opens, mtime, size)


def test_capture(spark):
    reg = spark.createDataFrame([e("1", "same"), e("2", "touched", mtime=0), e("3", "edited", mtime=0), e("4", "gone"), e("5", "stub", h=""), e("6", "stub2", h="", mtime=None)], ENTRIES)
    listing = spark.createDataFrame([("same", 1, 1), ("touched", 1, 1), ("edited", 1, 1), ("new", 1, 1), ("stub2", 1, 1), ("big", 1, 10**9), ("skip.tmp", 1, 1)], LISTING)
    hashes = spark.createDataFrame([(p, "h" if p == "touched" else "h2") for p in ("touched", "edited", "new", "stub2")], "path string, hash string")
    got = {r.path: (r.outcome, r.type) for r in capture.capture(reg, listing, hashes, F.col("path").endswith(".tmp"), 1).collect()}
    assert got == {"same": ("unchanged", None), "touched": ("refreshed", None), "edited": ("update", "update"), "gone": ("delete", "delete"), "stub": ("dropped", None), "stub2": ("create", "create"), "new": ("create", "create"), "big": ("too_large", None), "skip.tmp": ("excluded", None)}
    assert {r.path for r in capture.gate(reg, listing).collect()} == {"touched", "edited", "new", "stub2", "big", "skip.tmp"}
    empty = spark.createDataFrame([], LISTING)
    assert {r.outcome for r in capture.capture(reg, empty, hashes).collect()} == {"held"}
    assert "delete" not in {r.outcome for r in capture.capture(reg, listing, hashes, aborted=True).collect()}
    assert {r.path: r.type for r in capture.capture(reg, listing, hashes, baseline=True).collect()}["same"] == "update"


def test_tombstones(spark):
    reg = spark.createDataFrame([e("old", "a", deleted=True), e("young", "b", deleted=True, wall=80 * DAY), e("pin", "c", deleted=True), e("open", "d", deleted=True, opens=["x", "y"]), e("live", "e")], ENTRIES)
    pins = spark.createDataFrame([("pin",)], "id string")
    for days in (None, 1, float("nan")):
        assert [r.id for r in capture.reclaimable(reg, pins, 100 * DAY, days).collect()] == ["old"]
    assert capture.reclaimable(reg, pins, 100 * DAY, 365).count() == 0


def test_adopt_and_register(spark):
    reg = spark.createDataFrame([e("1", "a"), e("2", "b", deleted=True)], ENTRIES)
    got = capture.adopt(reg, spark.createDataFrame([e("9", "a", h="n")], ENTRIES))
    assert {(r.id, r.mtime) for r in got.collect()} == {("9", None), ("2", 1)}
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r.path: r.how for r in capture.register(reg, paths).collect()} == {"a": "tracked", "b": "resurrected", "c": "new"}


def test_pack_plans(spark):
    index = spark.createDataFrame([(f"{p}{i}", p, 0, 1) for p in ("dead", "half", "full", "nodate") for i in range(4)], PACK_INDEX)
    keep = spark.createDataFrame([("half0",), *((f"full{i}",) for i in range(4))], "hash string")
    packs = spark.createDataFrame([("dead", 0), ("half", 0), ("full", 0)], PACKS)
    assert {r.packId: r.verdict for r in blobs.gc_plan(index, keep, packs, 100, 50).collect()} == {"dead": "retire", "half": "compact", "full": "keep", "nodate": "keep"}
    assert {r.verdict for r in blobs.gc_plan(index, keep, packs, 10, 50).collect()} == {"keep"}
    assert {r.packId: r.verdict for r in blobs.consolidation_plan(index, keep, 3).collect()} == {"dead": "retire", "half": "merge", "full": "leave", "nodate": "retire"}


def test_cursor(spark):
    seq = lambda *x: spark.createDataFrame([(i,) for i in x], "seq bigint")
    assert blobs.safe_cursor(seq(5, 6, 7), seq(), 4).first().cursor == 7
    assert blobs.safe_cursor(seq(5, 6, 7), seq(6), 4).first().cursor == 5
    assert blobs.safe_cursor(seq(5, 6, 7), seq(3), 4).first().cursor == 4
    assert blobs.safe_cursor(seq(), seq(), 4).first().cursor == 4


def test_journals(spark, tmp_path):
    op = lambda i, f: '{"v":1,"id":"%s","hlcTimestamp":{"wallTime":1,"counter":0,"deviceId":"d"},"fileId":"%s","type":"create","path":"p","contentHash":"h","parents":[]}' % (i, f)
    (tmp_path / "log").write_text("\n".join([op("a", "1"), op("b", "2"), op("a", "3"), op("c", "4")[:40]]) + "\n")
    got = journals.read_ops(spark, str(tmp_path / "log"))
    assert {(r.id, r.fileId) for r in got.collect()} == {("a", "1"), ("b", "2")}
    journals.append_ops(got, str(tmp_path / "out"))
    journals.append_ops(got, str(tmp_path / "out"), journals.read_ops(spark, str(tmp_path / "out")))
    assert journals.read_ops(spark, str(tmp_path / "out")).count() == 2 and spark.read.text(str(tmp_path / "out")).count() == 2
    h = "a" * 64
    (tmp_path / "idx").write_text(f"{h} pack-1 0 4\nbad line\n{h} pack-2 4 8\n{'b' * 64} pack-10 x 1\n")
    idx = journals.read_pack_index(spark, str(tmp_path / "idx"))
    assert [(r.packId, r.offset) for r in idx.collect()] == [("pack-2", 4)] and journals.next_pack(idx).first().n == 3
    assert journals.compaction_due(1, 2, 1001, 10) and not journals.compaction_due(1, 2, 900, 10)


def test_packs_round_trip(spark):
    texts = [f"text {i}" * (i + 1) for i in range(7)]
    rows = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), bytearray(t.encode())) for t in texts], "hash string, bytes binary")
    index, packs = journals.write_packs(rows, 3)
    got = journals.read_packed(index, packs)
    assert {bytes(r.bytes).decode() for r in got.collect()} == set(texts) and packs.count() == 3
    wrong = journals.read_packed(index.withColumn("offset", F.col("offset") + 1), packs)
    assert all(r.bytes is None for r in wrong.collect())


def test_remote(spark):
    log = spark.createDataFrame([("x", 1), ("y", 2)], "clientOpId string, seq bigint")
    sent = spark.createDataFrame([("y", 1, []), ("z", 2, ["h1"]), ("w", 3, []), ("z", 4, [])], "clientOpId string, pos bigint, blobRefs array<string>")
    held = spark.createDataFrame([("h1",)], "hash string")
    new, missing = remote.append(log, sent, held)
    assert {(r.clientOpId, r.seq) for r in new.collect()} == {("z", 3), ("w", 4)} and missing.count() == 0
    new, missing = remote.append(log, sent, held.where("hash = ''"))
    assert new.count() == 0 and [r.hash for r in missing.collect()] == ["h1"]
    page, told = remote.pull(log, 0, 1)
    assert [r.seq for r in page.collect()] == [1] and tuple(told.first()) == (1, True)
    assert tuple(remote.pull(log, 2, 5)[1].first()) == (2, False)
    wanted = spark.createDataFrame([(1, "h1"), (2, "no"), (3, "no")], "pos int, hash string")
    got, lost = remote.blob_get(wanted, held)
    assert got.count() == 1 and [r.pos for r in lost.collect()] == [2, 3]


def test_crypto(spark):
    keys = crypto.derive("pass", "vault", 1000)
    assert len({*keys.values()}) == 3 and crypto.derive("pass", "vault", 1000) == keys != crypto.derive("pass", "other", 1000)
    row = spark.range(1).select(crypto.seal(F.lit("hello"), keys["enc"]).alias("s"), crypto.seal(F.lit(crypto.KEY_CHECK), keys["verify"]).alias("k"), crypto.blind(F.lit("ab"), keys["blind"]).alias("b"))
    got = row.select(crypto.unseal(F.col("s"), keys["enc"]).cast("string").alias("t"), crypto.unseal(F.col("s"), keys["verify"]).alias("w"), F.length("s").alias("n"), crypto.key_check(F.col("k"), keys["verify"]).alias("y"), crypto.key_check(F.col("s"), keys["verify"]).alias("x"), "b").first()
    assert (got.t, got.w, got.n, got.y, got.x) == ("hello", None, 12 + 5 + 16, True, False) and len(got.b) == 64


def test_files(spark, tmp_path):
    (tmp_path / "v/sub").mkdir(parents=True)
    (tmp_path / "v/sub/a.md").write_text("a")
    acts = spark.createDataFrame([("write", "new/b.md", None, bytearray(b"b")), ("move", "sub/a.md", "c.md", None), ("trash", "nothing", None, None), ("write", "../x", None, bytearray(b""))], "verb string, path string, to_path string, bytes binary")
    failed = files.carry_out(acts, str(tmp_path / "v"))
    assert [p for p, _ in failed] == ["../x"] and {r.path for r in files.listing(spark, str(tmp_path / "v")).collect()} == {"new/b.md", "c.md"}
