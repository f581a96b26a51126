import hashlib

import pytest

from tidefold.operators import classify
from tidefold.schemas import CONTENTS, ENTRIES, VERSIONS

TEXTS = {k: v for k, v in (("base", "a\nb\nc"), ("left", "A\nb\nc"), ("right", "a\nb\nC"), ("clash", "X\nb\nc"), ("bin", "a\0b"), ("bin2", "a\0c"))}
H = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in TEXTS.items()} | {"gone": "0" * 64}


def entry(i, path="p", text="base", wall=10, head=None, deleted=False, synced=None, opens=None):
    return (i, path, H[text], (wall, 0, "d"), deleted, synced, head, opens, None, None)


GRAPH = [("v0", [], "base"), ("l1", ["v0"], "left"), ("r1", ["v0"], "right"), ("x1", ["v0"], "clash"), ("m", ["l1", "r1"], "right"), ("P", [], "left"), ("Q", [], "right"), ("c1", ["P", "Q"], "left"), ("c2", ["P", "Q"], "right"), ("s1", ["lost"], "left"), ("s2", ["lost"], "right"), ("b0", [], "bin"), ("b1", ["b0"], "bin2"), ("b2", ["b0"], "left"), ("w", ["v0"], "base")]
CASES = [
    ("M1", None, entry("f", deleted=True), "no_op"),
    ("M3", None, entry("f", text="gone"), "no_op"),
    ("M4", None, entry("f", head="r1"), "write_local"),
    ("M5", entry("f", deleted=True), None, "no_op"),
    ("M7", entry("f", text="gone"), None, "send_remote"),
    ("M8", entry("f", deleted=True), entry("f", deleted=True), "no_op"),
    ("M9", entry("f", path="a", wall=5), entry("f", path="b", wall=9), "move_local"),
    ("M9", entry("f", path="a", wall=9), entry("f", path="b", wall=9), "no_op"),
    ("M10", entry("f", text="right", head="m"), entry("f", text="right", head="r1"), "no_op"),
    ("M11", entry("f", text="right", head="r1"), entry("f", text="right", head="m"), "write_local"),
    ("M12", entry("f", text="left", head="l1"), entry("f", text="left", head="P"), "write_merge"),
    ("M13", entry("f"), entry("f"), "no_op"),
    ("M13", entry("f", text="right", head="v0"), entry("f", text="right", head="r1"), "no_op"),
    ("M14", entry("f", deleted=True, head="l1"), entry("f", text="right", head="m"), "write_local"),
    ("M15", entry("f", deleted=True, head="w"), entry("f", text="base", head="v0", synced="p"), "delete_remote"),
    ("M16", entry("f", deleted=True, head="l1"), entry("f", text="right", head="r1"), "delete_conflict"),
    ("M16", entry("f", deleted=True, head="l1"), entry("f", text="gone", head="r1"), "no_op"),
    ("M17", entry("f", text="left", head="l1"), entry("f", deleted=True, head="m"), "delete_local"),
    ("M17", entry("f", text="left", head="l1"), entry("f", deleted=True, head="r1"), "delete_conflict"),
    ("M21", entry("f", text="clash", head="l1", opens=["l1", "r1"]), entry("f", text="right", head="m"), "write_local"),
    ("M21", entry("f", text="clash", head="l1", opens=["l1", "x1"]), entry("f", text="right", head="m"), "no_op"),
    ("M22", entry("f", head="v0"), entry("f", text="right", head="r1"), "write_local"),
    ("M22", entry("f", head="v0"), entry("f", text="gone", head="r1"), "no_op"),
    ("M23", entry("f", text="left", head="l1"), entry("f", head="v0"), "no_op"),
    ("M24", entry("f", text="left", wall=9), entry("f", text="gone"), "no_op"),
    ("M24", entry("f", text="left", wall=99), entry("f", text="gone"), "write_local"),
    ("M25", entry("f", text="bin", head="b2"), entry("f", text="bin2", head="b1"), "write_local"),
    ("M26", entry("f", text="bin2", head="b1"), entry("f", text="left", head="b2"), "binary_conflict"),
    ("M27", entry("f", text="left", head="c1"), entry("f", text="right", head="c2"), "conflict"),
    ("M28", entry("f", text="left", head="s1"), entry("f", text="right", head="s2"), "conflict"),
    ("M29", entry("f", text="left", head="P"), entry("f", text="right", head="Q"), "conflict"),
    ("M30", entry("f", text="left", head="l1", path="a", wall=20), entry("f", text="right", head="r1", path="b"), "write_merge"),
    ("M32", entry("f", text="left", head="l1"), entry("f", text="clash", head="x1"), "conflict"),
]


@pytest.fixture(scope="module")
def told(spark):
    """All cases at once, each with a graph and files of its own."""
    local, remote, graph = [], [], []
    for n, (_, l, r, _) in enumerate(CASES):
        own = lambda v, n=n: None if v is None else f"{n}.{v}"
        put = lambda e, n=n, own=own: (f"{n}", f"{n}/{e[1]}", e[2], e[3], e[4], e[5] and f"{n}/{e[5]}", own(e[6]), e[7] and [own(x) for x in e[7]], None, None)
        local += [put(l)] if l else []
        remote += [put(r)] if r else []
        graph += [(own(v), [own(p) for p in ps], H[t], f"{n}") for v, ps, t in GRAPH]
    contents = spark.createDataFrame([(H[k], bytearray(v.encode())) for k, v in TEXTS.items()], CONTENTS)
    rows = classify.classify(spark.createDataFrame(local, ENTRIES), spark.createDataFrame(remote, ENTRIES), spark.createDataFrame(graph, VERSIONS), contents, contents).collect()
    assert len(rows) == len({r.id for r in rows})
    return {int(r.id): r for r in rows}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_rule(told, n):
    rule, _, _, action = CASES[n]
    got = told[n]
    assert got.action == action, got
    assert got.rule == rule or {got.rule, rule} <= {"M29", "M32"}, got


def test_clean_merge_has_both_parents_and_text(told):
    n = next(i for i, c in enumerate(CASES) if c[0] == "M30")
    r = told[n]
    assert r.path == f"{n}/a" and r.parents == [f"{n}.l1", f"{n}.r1"] and r.merge.merged == ["A", "b", "C"]
    assert r.contentHash == hashlib.sha256(b"A\nb\nC").hexdigest()


def test_create_collision_has_one_winner(spark):
    contents = spark.createDataFrame([(H[k], bytearray(v.encode())) for k, v in TEXTS.items()], CONTENTS)
    none = spark.createDataFrame([], VERSIONS)

    def run(a, b):
        out = classify.classify(spark.createDataFrame([a], ENTRIES), spark.createDataFrame([b], ENTRIES), none, contents, contents)
        return {r.id: (r.rule, r.action) for r in out.collect()}

    assert run(entry("a", text="left", wall=9), entry("b", text="right", wall=5)) == {"a": ("M20", "conflict"), "b": ("M20", "no_op")}
    assert run(entry("a", text="left", wall=5), entry("b", text="right", wall=9)) == {"a": ("M20", "no_op"), "b": ("M20", "conflict")}
    assert run(entry("a", wall=5), entry("b", wall=5)) == {"a": ("M20", "no_op"), "b": ("M20", "write_local")}
    assert run(entry("b", wall=5), entry("a", wall=5)) == {"b": ("M20", "no_op"), "a": ("M20", "no_op")}
    assert run(entry("a", text="left"), entry("b", text="gone")) == {"a": ("M20", "no_op"), "b": ("M20", "no_op")}
