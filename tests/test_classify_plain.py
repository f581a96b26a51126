"""Classification of random replicas, and of the fixture's, against the rules written out one after another."""

import hashlib
import random

from tidefold.operators import classify, textmerge
from tidefold.operators.graph import Walk
from tidefold.plans import queries
from tidefold.schemas import CONTENTS, ENTRIES, VERSIONS


class Plain:
    def __init__(self, local, remote, versions, local_store, remote_store):
        self.l, self.r = {e.id: e for e in local}, {e.id: e for e in remote}
        live = lambda side: {e.path: e for e in sorted(side.values(), key=lambda e: e.id) if not e.deleted}
        self.live_l, self.live_r = live(self.l), live(self.r)
        self.graph = {v.versionId: v for v in versions}
        self.walk = Walk([v.versionId for v in versions], [v.parents for v in versions], [v.contentHash for v in versions])
        self.hl, self.hr = local_store, remote_store

    def above(self, a, b):
        return a in self.walk.above([b])

    def facts(self, le, re):
        known = le.headVersionId is not None and re.headVersionId is not None
        fwd = known and self.above(le.headVersionId, re.headVersionId)
        back = known and self.above(re.headVersionId, le.headVersionId)
        base, many = None, False
        if known:
            common = self.walk.above([le.headVersionId]) & self.walk.above([re.headVersionId])
            best = common - self.walk.above([p for v in common for p in self.walk.parents.get(v, [])])
            base, many = (next(iter(best)), False) if len(best) == 1 else (None, bool(common))
        return known, fwd, back, base, many

    def held(self, h):
        return h in self.hl or h in self.hr

    def hash_at(self, v):
        return (self.graph[v].contentHash or None) if v in self.graph else None

    def rule(self, i):
        l, r = self.l.get(i), self.r.get(i)
        if l is None:
            if r.deleted:
                return "M1", "no_op"
            other = self.live_l.get(r.path)
            if other is not None and other.id != i:
                return self.collision(other, r, False)
            return ("M4", "write_local") if r.contentHash in self.hr else ("M3", "no_op")
        if r is None:
            if l.deleted:
                return "M5", "no_op"
            other = self.live_r.get(l.path)
            return self.collision(l, other, True) if other is not None and other.id != i else ("M7", "send_remote")
        if l.deleted and r.deleted:
            return "M8", "no_op"
        if l.deleted or r.deleted:
            return self.one_deleted(l, r)
        return self.same(l, r) if l.contentHash == r.contentHash else self.differ(l, r)

    def collision(self, l, r, mine):
        known, fwd, back, _, _ = self.facts(l, r)
        adopt = "write_local" if not mine and (self.held(r.contentHash) or l.contentHash in self.hl) else "no_op"
        wins = (r.hlcTimestamp, r.id) > (l.hlcTimestamp, l.id)
        if known and fwd:
            return "M20", adopt
        if known and back:
            return "M20", "no_op"
        if l.contentHash == r.contentHash:
            return "M20", adopt if wins else "no_op"
        if l.contentHash not in self.hl or r.contentHash not in self.hr:
            return "M20", "no_op"
        return "M20", "conflict" if wins != mine else "no_op"

    def same(self, l, r):
        known, fwd, back, _, _ = self.facts(l, r)
        if l.path != r.path:
            return "M9", "no_op" if l.hlcTimestamp >= r.hlcTimestamp else "move_local"
        if not known or l.headVersionId == r.headVersionId:
            return "M13", "no_op"
        if back:
            return "M10", "no_op"
        if self.hash_at(l.headVersionId) == l.contentHash and self.held(l.contentHash):
            return ("M11", "write_local") if fwd else ("M12", "write_merge")
        return "M13", "no_op"

    def one_deleted(self, l, r):
        known, fwd, _, base, many = self.facts(l, r)
        merges = r.headVersionId in self.graph and len(self.graph[r.headVersionId].parents) >= 2
        resolved = known and merges and fwd

        def still(x, other):
            synced = x.lastSyncedPath or other.lastSyncedPath
            h = self.hash_at(base) if base else None
            return h is not None and h == x.contentHash and not many and (synced is None or x.path == synced)

        if l.deleted:
            if resolved and self.held(r.contentHash):
                return "M14", "write_local"
            if still(r, l):
                return "M15", "delete_remote"
            return "M16", "delete_conflict" if self.held(r.contentHash) else "no_op"
        if resolved or still(l, r):
            return "M17", "delete_local"
        return "M17", "delete_conflict" if self.held(l.contentHash) else "no_op"

    def differ(self, l, r):
        known, fwd, back, base, many = self.facts(l, r)
        if len(l.conflictParents or []) >= 2:
            merges = r.headVersionId in self.graph and len(self.graph[r.headVersionId].parents) >= 2
            ok = known and merges and all(self.above(v, r.headVersionId) for v in l.conflictParents) and self.held(r.contentHash)
            return "M21", "write_local" if ok else "no_op"
        if known and fwd and self.hash_at(l.headVersionId) == l.contentHash:
            return "M22", "write_local" if self.held(r.contentHash) else "no_op"
        if back:
            return "M23", "no_op"
        mine, theirs = self.hl.get(l.contentHash), self.hr.get(r.contentHash)
        if mine is None or theirs is None:
            if l.hlcTimestamp >= r.hlcTimestamp:
                return "M24", "write_local" if mine is not None else "no_op"
            return "M24", "write_local" if theirs is not None else "no_op"
        base_hash = self.hash_at(base) if base else None
        if "\0" in mine or "\0" in theirs:
            new_l, new_r = l.contentHash != base_hash, r.contentHash != base_hash
            if base_hash and not many and new_l != new_r:
                return "M25", "write_local" if new_r else "no_op"
            return "M26", "binary_conflict"
        if many:
            return "M27", "conflict"
        old = (self.hl.get(base_hash) or self.hr.get(base_hash)) if base_hash else None
        if base and old is None:
            return "M28", "conflict"
        merged = textmerge.three_way(old or "", mine, theirs)
        action = "conflict" if merged["hasConflicts"] else "write_merge" if known else "write_local"
        return "M29" if known and base is None else {"conflict": "M32", "write_merge": "M30", "write_local": "M31"}[action], action


def compare(local, remote, versions, local_store, remote_store):
    told = {r.id: (r.rule, r.action) for r in classify.classify(local, remote, versions, local_store, remote_store).select("id", "rule", "action").collect()}
    store = lambda df: {r.hash: bytes(r.bytes).decode() for r in df.collect()}
    plain = Plain(local.collect(), remote.collect(), versions.collect(), store(local_store), store(remote_store))
    want = {i: plain.rule(i) for i in plain.l.keys() | plain.r.keys()}
    assert told == want
    return {rule for rule, _ in want.values()}


def test_random_replicas(spark):
    rng = random.Random(17)
    texts = ["a\nb\nc\nd", "A\nb\nc\nd", "a\nb\nc\nD", "a\nB\nc\nd", "x\0y", "x\0z", "gone", "", "a\nb\nc\nd\n"]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    nodes = []
    for g in range(30):  # small graphs, some with stubs and criss-crosses
        for i in range(9):
            parents = sorted({f"{g}.{p}" for p in range(i) if rng.random() < 0.3} | ({f"{g}.stub"} if i and rng.random() < 0.08 else set()))
            nodes.append((f"{g}.{i}", parents, rng.choice([*sha, ""]), f"file{g}"))
    known = {v: h for v, _, h, _ in nodes}

    def side(which):
        out = []
        for k in range(700):
            g, own = rng.randrange(30), f"{k}"
            if rng.random() < 0.15:
                continue
            head = f"{g}.{rng.randrange(9)}" if rng.random() < 0.85 else None
            h = known[head] if head and known[head] and rng.random() < 0.6 else rng.choice(sha)
            opens = [f"{g}.{rng.randrange(9)}" for _ in range(2)] if rng.random() < 0.1 else None
            path = f"p{k}" if rng.random() < 0.8 else f"p{rng.randrange(700)}"
            out.append((own, path, h, (rng.randrange(3), 0, rng.choice("ab")), rng.random() < 0.2, path if rng.random() < 0.3 else None, head, opens, None, None))
        return spark.createDataFrame(out, ENTRIES)

    def store(keep):
        return spark.createDataFrame([(h, bytearray(t.encode())) for h, t in zip(sha, texts, strict=True) if t != "gone" and rng.random() < keep], CONTENTS)

    # heads of one graph for both sides of a file, so that they have something in common
    seen = set()
    for round_ in range(2):
        rng = random.Random(round_)
        state = rng.getstate()
        local = side(0)
        rng.setstate(state)
        rng.random()
        remote = side(1)
        seen |= compare(local, remote, spark.createDataFrame(nodes, VERSIONS), store(0.9), store(0.9))
    paired = []
    for k in range(900):
        g = rng.randrange(30)
        one = lambda g=g, k=k: (f"{k}", f"p{k}" if rng.random() < 0.9 else f"q{k}", *((known[v] if known[v] and rng.random() < 0.7 else rng.choice(sha), (rng.randrange(3), 0, "a"), rng.random() < 0.2, f"p{k}" if rng.random() < 0.4 else None, v) if (v := f"{g}.{rng.randrange(9)}") and rng.random() < 0.9 else (rng.choice(sha), (rng.randrange(3), 0, "a"), rng.random() < 0.2, None, None)), [f"{g}.{rng.randrange(9)}", f"{g}.{rng.randrange(9)}"] if rng.random() < 0.15 else None, None, None)
        paired.append((one(), one()))
    local, remote = (spark.createDataFrame([p[n] for p in paired], ENTRIES) for n in range(2))
    seen |= compare(local, remote, spark.createDataFrame(nodes, VERSIONS), store(0.9), store(0.9))
    assert len(seen) >= 24, sorted(seen)


def test_replicas_of_the_fixture(spark, data):
    l, r, v, x = queries._replicas(spark, data)
    assert compare(l, r, v, x, x)
