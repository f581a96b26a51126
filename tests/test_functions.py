import pytest
from pyspark.sql import functions as F

from tidefold.functions import hlc
from tidefold.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def clock(w, n, d):
    return hlc.hlc(F.lit(w), F.lit(n), F.lit(d))


def test_hlc_round_trip_and_order(spark):
    a, b = clock(5, 2, "dev-a"), clock(5, 2, "dev-b")
    r = one(spark, s=hlc.to_string(a), back=hlc.from_string(hlc.to_string(clock(10**16, 10**9, "x-y-z"))), bad=hlc.from_string(F.lit("m-abc")), cmp=hlc.compare(a, b), same=hlc.compare(a, a), top=hlc.later(a, b)["deviceId"])
    assert r.s == "000000000000005-00000002-dev-a" and tuple(r.back) == (10**16, 10**9, "x-y-z")
    assert r.bad is None and (r.cmp, r.same, r.top) == (-1, 0, "dev-b")


def test_clock_on_the_driver():
    c = hlc.Clock("a")
    assert c.now(10) == (10, 0, "a") and c.now(9) == (10, 1, "a")
    assert c.merge((10, 7, "b"), 3) == (10, 8, "a") and c.merge((12, 1, "b"), 3) == (12, 2, "a") and c.now(20) == (20, 0, "a")


def test_issued_clocks_are_those_of_the_driver(spark):
    walls = [5, 5, 3, 9, 9, 2, 9, 11, 1, 11]
    rows = spark.createDataFrame([("d", i, w) for i, w in enumerate(walls)] + [("e", i, w) for i, w in enumerate(walls[::-1])], "device string, seq bigint, wall bigint")
    got = {(r.device, r.seq): tuple(r.hlc) for r in hlc.issue(rows, "device", "seq", "wall", block=3).collect()}
    for d, ws in (("d", walls), ("e", walls[::-1])):
        c = hlc.Clock(d)
        assert [got[d, i] for i in range(len(ws))] == [c.now(w) for w in ws]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("attachments/**", "attachments/a/b.png", True), ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("a?c", "abc", True), ("a?c", "a/c", False), (".git", ".git", True), (".git", ".git/x", False), (".git/**", ".git/x", True), ("a.b", "axb", False), ("a", "a\n", False)],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, x=F.lit(path).rlike(tx.glob_pattern(glob))).x is hit


def test_exclusion_order(spark):
    rows = spark.createDataFrame([(p,) for p in (".cfg/plugins/sync/state/x", ".cfg/plugins/sync/main.js", ".cfg/workspace.json", ".cfg/app.json", "note.md", ".git/config")], "path string")
    out = lambda **k: [r.x for r in rows.select(tx.is_excluded(F.col("path"), ".cfg/plugins/sync/state", ".cfg/plugins/sync", ".cfg", **k).alias("x")).collect()]
    assert out() == [True, True, True, True, False, True]
    assert out(sync_config=True) == [True, True, True, False, False, True]


def test_text_helpers(spark):
    r = one(
        spark,
        empty=F.size(tx.lines(F.lit(""))), mixed=tx.lines(F.lit("a\r\nb\rc\n")), nul=tx.is_binary(F.lit("a\0b")), plain=tx.is_binary(F.lit("ab")),
        far=tx.is_binary(F.lit("x" * 8192 + "\0")), marked=tx.has_markers(F.lit(">>>>>>> b\n<<<<<<< a")), half=tx.has_markers(F.lit("<<<<<<< a")),
        m1=tx.merge_id(F.lit("h"), F.array(F.lit("a"), F.lit("b"))), m2=tx.merge_id(F.lit("h"), F.array(F.lit("b"), F.lit("a"))), m3=tx.merge_id(F.lit("g"), F.array(F.lit("b"), F.lit("a"))),
        size=tx.byte_size(F.lit(1536)), ago=tx.relative_time(F.lit(0), F.lit(3 * 3600 * 1000)), big=tx.is_too_large(F.lit(1048577), 1), cap=tx.is_too_large(F.lit(10**9), 0),
        e=tx.sha256(F.lit("")), due=tx.gc_due(F.lit(10), F.lit(5), 100), seed=tx.gc_due(F.lit(None).cast("bigint"), F.lit(5), 100), miss=tx.missing_fields(a=F.lit("x"), b=F.lit(" "), c=F.lit(None).cast("string")),
        js=tx.json_or_default(F.lit('{"a": "no", "b": 4}'), "a int, b int", a=1, b=2), torn=tx.json_or_default(F.lit("{"), "a int, b int", a=1, b=2),
        pick=tx.resolve_chunk(F.array(F.lit("l")), F.array(F.lit("r")), F.struct(F.lit("both").alias("kind"), F.array(F.lit("z")).alias("text"))),
    )
    assert (r.empty, r.mixed, r.nul, r.plain, r.far, r.marked, r.half) == (1, ["a", "b", "c", ""], True, False, False, True, False)
    assert r.m1 == r.m2 != r.m3 and r.m1.startswith("m-") and (r.size, r.ago, r.big, r.cap) == ("1.5 KB", "3h ago", True, False)
    from tidefold.schemas import EMPTY_HASH

    assert r.e == EMPTY_HASH and r.due and not r.seed and r.miss == ["b", "c"] and tuple(r.js) == (1, 4) and tuple(r.torn) == (1, 2) and r.pick == ["l", "r"]
