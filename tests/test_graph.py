import random

import pytest
from pyspark.sql import functions as F

from tidefold.operators import graph, oplog, reconcile
from tidefold.operators.graph import Walk


def versions(spark, rows):
    return spark.createDataFrame([(v, p, h, f) for v, p, h, f in rows], "versionId string, parents array<string>, contentHash string, fileId string")


def walk(edges):
    return Walk(edges, edges.values(), [f"h{v}" for v in edges])


@pytest.mark.parametrize(
    ("edges", "a", "b", "base"),
    [
        ({"A": [], "B": ["A"], "C": ["B"]}, "A", "C", ("A", False)),
        ({"O": [], "X": ["O"], "Y": ["O"]}, "X", "Y", ("O", False)),
        ({"A": [], "B": []}, "A", "B", (None, False)),
        ({"P": [], "Q": [], "L": ["P", "Q"], "R": ["P", "Q"]}, "L", "R", (None, True)),
        ({"A": ["B"], "B": ["A"]}, "A", "B", (None, True)),
        ({"X": ["stub"], "Y": ["stub"]}, "X", "Y", ("stub", False)),
        ({**{f"v{i}": [f"v{i - 1}"] if i else [] for i in range(13)}, "X": ["v12"], "Y": ["v12"]}, "X", "Y", ("v12", False)),
    ],
)
def test_merge_base(edges, a, b, base):
    assert walk(edges).base(a, b) == base


def test_walks_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 9)
        edges = {str(i): [str(p) for p in range(i) if rng.random() < 0.35] for i in range(n)}
        w = walk(edges)
        above = {}
        for i in range(n):
            above[str(i)] = {str(i)}.union(*(above[p] for p in edges[str(i)]))
        for a in edges:
            for b in edges:
                common = above[a] & above[b]
                best = [c for c in common if not any(c in above[d] and c != d for d in common)]
                assert w.base(a, b) == ((best[0], False) if len(best) == 1 else (None, bool(best)))
                assert w.is_ancestor(a, b) == (a in above[b])


def test_reachable_stops_past_lost_bytes():
    w = walk({"A": [], "B": ["A"], "C": ["B"], "D": ["C"]})
    assert w.reachable("D", None, None) == {"hD": 0, "hC": 1, "hB": 2, "hA": 3}
    assert w.reachable("D", {"hB"}, None) == {"hD": 0, "hC": 1}
    assert w.reachable("D", None, 1) == {"hD": 0, "hC": 1} and w.reachable("none", None, None) == {}


def test_build_leaves_and_stubs(spark):
    rows = [("B", ["A"], "", "f", 1), ("A", [], "hA", "f", 2), ("B", ["C", "B"], "hB", "", 3), ("D", ["A"], "hD", "g", 4)]
    g = graph.build(spark.createDataFrame(rows, "versionId string, parents array<string>, contentHash string, fileId string, pos int"))
    got = {r.versionId: (r.parents, r.contentHash, r.fileId) for r in g.collect()}
    assert got == {"A": ([], "hA", "f"), "B": (["A", "C"], "hB", "f"), "D": (["A"], "hD", "g")}
    assert {r.fileId: r.leaves for r in graph.leaves(g).collect()} == {"f": ["B"], "g": ["D"]}
    comps = {r.versionId: r.component for r in graph.components(g).collect()}
    assert len({comps[x] for x in "ABCD"}) == 1 and set(comps) == set("ABCD")


def test_closure_is_ancestors(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", [f"n{p}" for p in range(max(0, i - 3), i) if rng.random() < 0.5], f"h{i}", f"f{i % 3}") for i in range(40)]
    g = versions(spark, rows)
    starts = spark.createDataFrame([("n39",), ("n20",), ("unknown",)], "versionId string")
    a = {r.ancestor for r in graph.ancestors(starts.withColumnRenamed("versionId", "start"), g).collect()}
    b = [r.versionId for r in graph.closure(starts, g, hops=3).collect()]
    assert set(b) == a and len(b) == len(a)


def test_sweep_declines(spark):
    g = versions(spark, [("A", [], "h", "f"), ("B", ["A"], "h", "f"), ("X", [], "h", "f")])
    none = spark.createDataFrame([("zzz",)], "versionId string")
    assert graph.sweep(g, none)[1] is False
    kept, done = graph.sweep(g, spark.createDataFrame([("B",)], "versionId string"))
    assert done and {r.versionId for r in kept.collect()} == {"A", "B"}


def test_three_heads_fold_into_one(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    base, b, c, d = "l1\nl2\nl3\n", "B\nl2\nl3\n", "l1\nl2\nC\n", "D\nl2\nl3\n"
    g = versions(spark, [("v0", [], sha(base), "f"), ("v1", ["v0"], sha(b), "f"), ("v2", ["v0"], sha(c), "f"), ("v3", ["v0"], sha(d), "f")])
    contents = spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in (base, b, c, d)], "hash string, bytes binary")
    pulled = spark.createDataFrame([("v2",), ("v3",)], "versionId string")
    none = spark.createDataFrame([], "versionId string")
    heads, nodes, held = reconcile.fold_heads(spark.createDataFrame([("f", "v1")], "fileId string, head string"), g, contents, pulled, none)
    made = nodes.collect()
    assert [m.text for m in made] == ["B\nl2\nC\n"] and heads.first().head == made[0].versionId and held.count() == 0


def test_projection_cases(spark):
    op = lambda i, w, f, t, p, h, par: (1, i, (w, 0, "d"), f, t, p, h, par)
    from tidefold.schemas import OPS

    rows = [op("c1", 100, "f1", "create", "a", "h1", []), op("u1", 200, "f1", "update", "a", "h2", ["c1"]), op("c2", 100, "f2", "create", "b", "h", []), op("d2", 300, "f2", "delete", "b", "h", ["c2"]), op("c3", 100, "f3", "create", "a.md", "h", []), op("m3", 150, "f3", "move", "b.md", "h", ["c3"])]
    for order in (rows, rows[::-1]):
        got = {r.id: r for r in oplog.project(spark.createDataFrame(order, OPS)).collect()}
        assert got["f1"].contentHash == "h2" and got["f2"].deleted and (got["f3"].path, got["f3"].headVersionId) == ("b.md", "c3")
    assert oplog.project(spark.createDataFrame([], OPS)).count() == 0
    left = oplog.cancel_pending(spark.createDataFrame(rows, OPS))
    assert {r.fileId for r in left.collect()} == {"f1", "f3"} and left.agg(F.count("*")).first()[0] == 4


def test_hundred_leaves_fold_into_one(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = [f"line {i}" for i in range(101)]
    texts = ["\n".join(lines)] + ["\n".join(x + ("!" if i == k else "") for i, x in enumerate(lines)) for k in range(101)]
    g = versions(spark, [("v", [], sha(texts[0]), "f")] + [(f"x{k:03d}", ["v"], sha(texts[k + 1]), "f") for k in range(101)])
    contents = spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in texts], "hash string, bytes binary")
    pulled = spark.createDataFrame([(f"x{k:03d}",) for k in range(1, 101)], "versionId string")
    files = spark.createDataFrame([("f", "x000"), ("other", "v")], "fileId string, head string")
    heads, nodes, held = reconcile.fold_heads(files, g, contents, pulled, spark.createDataFrame([], "versionId string"))
    made = {r.versionId: r.text for r in nodes.collect()}
    now = {r.fileId: r.head for r in heads.collect()}
    assert len(made) == 100 and made[now["f"]] == "\n".join(x + "!" for x in lines) and now["other"] == "v" and held.count() == 0


def test_folding_against_brute_force(spark, data):
    from tidefold.operators import textmerge
    from tidefold.plans import fixtures

    rows = fixtures.ops(spark, data)
    g = graph.build(graph.from_ops(rows))
    entries = oplog.project(fixtures.plain(rows)).where("not deleted")
    # texts that differ in a line or two, so that many merges are clean
    import hashlib

    body = lambda v: "\n".join(f"line {i}" + ("!" * (len(v[0]) + 1) if i == int(hashlib.sha256(v[0].encode()).hexdigest(), 16) % 40 else "") for i in range(40))
    rewritten = [(v, list(p), body((v,)), f) for v, p, _, f in ((r.versionId, r.parents, r.contentHash, r.fileId) for r in g.collect())]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = {sha(t): t for _, _, t, _ in rewritten}
    g = versions(spark, [(v, p, sha(t), f) for v, p, t, f in rewritten])
    contents = spark.createDataFrame([(h, bytearray(t.encode())) for h, t in text.items()], "hash string, bytes binary")
    dead = {r.id for r in rows.where("type = 'delete'").collect()}
    pulled = {r.id for r in rows.where("event_id % 3 <> 0").collect()}
    nodes = {r.versionId: (r.parents, r.contentHash, r.fileId) for r in g.collect()}
    want = {}
    for e in entries.collect():
        own = {v: list(x) for v, x in nodes.items() if x[2] == e.id}
        head, tried = e.headVersionId, set()
        while True:
            w = Walk(own, [x[0] for x in own.values()], [x[1] for x in own.values()])
            named = {p for x in own.values() for p in x[0]}
            able = [v for v in sorted(own) if v not in named and v != head and v in pulled and v not in dead and v not in tried and v not in w.above([head]) and w.base(head, v)[0]]
            if not able:
                break
            leaf = able[0]
            sides = [text.get(own[v][1]) for v in (w.base(head, leaf)[0], head, leaf)]
            merged = None if None in sides else textmerge.three_way(*sides, canonical=True)
            if merged is None or merged["hasConflicts"]:
                tried.add(leaf)
                continue
            body = "\n".join(merged["merged"])
            node, content = reconcile.merge_node(body, [head, leaf])
            own[node] = [[head, leaf], content, e.id]
            text[content], head = body, node
        want[e.id] = head
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "versionId string")
    heads, made, _ = reconcile.fold_heads(entries.select(F.col("id").alias("fileId"), F.col("headVersionId").alias("head")), g, contents, ids(pulled), ids(dead))
    assert {r.fileId: r.head for r in heads.collect()} == want and made.count() > 0


def test_large_components_are_walked_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{i}", [f"n{p}" for p in range(max(0, i - 4), i) if rng.random() < 0.4] + (["stub"] if i == 3 else []), f"h{i % 25}" if i % 6 else "", f"f{i % 2}") for i in range(45)] + [("a", [], "ha", "g"), ("b", ["a"], "hb", "g")]
    g = versions(spark, rows)
    pairs = spark.createDataFrame([(f"{i}", f"n{rng.randrange(45)}", f"n{rng.randrange(45)}", [f"n{rng.randrange(45)}"] if i % 3 else None) for i in range(25)] + [("small", "a", "b", ["a"])], "pair string, a string, b string, opens array<string>")
    starts = spark.createDataFrame([("n44",), ("n30",), ("b",), ("unknown",)], "start string")
    has = spark.createDataFrame([(f"h{i}",) for i in range(0, 25, 2)], "hash string")

    def results():
        frames = [graph.pair_facts(pairs, g), graph.ancestors(starts, g), graph.above(starts.withColumnRenamed("start", "versionId"), g), graph.reachable_hashes(starts.where("start <> 'unknown'"), g, has), graph.reachable_hashes(starts.where("start <> 'unknown'"), g, None, 3)]
        return [sorted(map(str, f.select(*sorted(f.columns)).collect())) for f in frames]

    by_kernel = results()
    monkeypatch.setattr(graph, "MAX_COMPONENT", 10)
    assert results() == by_kernel and all(by_kernel)


def test_deep_chain():
    n = 300_000
    w = Walk([f"{i}" for i in range(n)] + ["x", "y"], [[f"{i - 1}"] if i else [] for i in range(n)] + [[f"{n - 1}"], [f"{n - 5}"]], [f"h{i}" for i in range(n + 2)])
    assert w.base("x", "y") == (f"{n - 5}", False) and w.is_ancestor("0", "x") and not w.is_ancestor("x", "0") and len(w.above(["x", "y"])) == n + 2
