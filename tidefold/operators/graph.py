"""The version graph: versions(versionId, parents, contentHash, fileId).

Versions are dealt to components of the graph (one file each, but for merges of files that collided),
and a component's walk is a Python kernel, O(versions + edges) for a question, cycle safe. Walks go from
the newest generation down and end where nothing new can come. Components of more than MAX_COMPONENT
versions are not given to one task: there, questions are answered by joins of the frontier, as closure()
does for any graph.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.scratch import materialize

#: Versions of a component that a task holds; larger ones are walked by joins.
MAX_COMPONENT = 2_000_000


# --- building -----------------------------------------------------------------------------------


def build(rows: DataFrame, position: str = "pos") -> DataFrame:
    """The graph of rows(versionId, parents, contentHash, fileId, position): parents united, first known hash and file, no self-parents."""
    first = lambda x: F.min_by(x, F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col(position)))
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("parents", F.array().cast("array<string>"))))))
    known = rows.groupBy("versionId").agg(united.alias("parents"), first("contentHash").alias("contentHash"), first("fileId").alias("fileId"))
    return known.select("versionId", F.filter("parents", lambda p: p != F.col("versionId")).alias("parents"), F.coalesce("contentHash", F.lit("")).alias("contentHash"), F.coalesce("fileId", F.lit("")).alias("fileId"))


def from_ops(ops: DataFrame) -> DataFrame:
    """Rows for build(): every operation but moves is a version."""
    return ops.where("type <> 'move'").select(F.col("id").alias("versionId"), "parents", "contentHash", "fileId", F.struct("hlcTimestamp", "id").alias("pos"))


def edges(versions: DataFrame) -> DataFrame:
    return versions.select("versionId", F.explode("parents").alias("parent"))


def new_edges(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges (null parent for a root) that would change the graph."""
    flat = lambda x: x.select("versionId", F.explode_outer("parents").alias("parent"))
    old = flat(versions).select(F.col("versionId").alias("v"), F.col("parent").alias("p"))
    rows = flat(incoming).where("parent is null or parent <> versionId").distinct()
    return rows.join(old, (F.col("versionId") == F.col("v")) & F.col("parent").eqNullSafe(F.col("p")), "left_anti")


def content_hash_of(ids: DataFrame, versions: DataFrame) -> DataFrame:
    """ids(versionId) with contentHash; null for stubs and unknown ids."""
    return ids.join(versions.select("versionId", F.nullif("contentHash", F.lit("")).alias("contentHash")), "versionId", "left")


def leaves(versions: DataFrame) -> DataFrame:
    """(fileId, leaves): versions with a file of their own that are nobody's parent, by file."""
    named = edges(versions).select(F.col("parent").alias("versionId")).distinct()
    return versions.where("fileId <> ''").join(named, "versionId", "left_anti").groupBy("fileId").agg(F.sort_array(F.collect_set("versionId")).alias("leaves"))


def is_merge_node(parents: Column) -> Column:
    return F.size(parents) >= 2


def open_conflicts(entries: DataFrame, by_path: bool = True) -> DataFrame:
    """Two-headed files with what is known of each head, in order of path."""
    from tidefold.functions.text import head_provenance

    some = entries.where("size(conflictParents) >= 2").select("id", "path", F.transform("conflictParents", lambda v: F.struct(v.alias("versionId"), head_provenance(v).alias("hlc"))).alias("heads"))
    return some.orderBy("path") if by_path else some


def roots(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """versionId of all that must stay: heads of all entries, open heads, pending ops and their parents."""
    many = F.concat(F.array("headVersionId"), F.coalesce("conflictParents", F.array().cast("array<string>")))
    a = entries.select(F.explode(many).alias("versionId"))
    b = pending.select(F.explode(F.concat(F.array("id"), F.coalesce("parents", F.array().cast("array<string>")))).alias("versionId"))
    return a.union(b).where("versionId is not null").distinct()


# --- walks over sets ----------------------------------------------------------------------------


class Walk:
    """Parents and hashes of one component."""

    def __init__(self, ids: Iterable[str], parents: Iterable[list[str] | None], hashes: Iterable[str | None]):
        self.parents = {v: p or [] for v, p in zip(ids, parents, strict=True)}
        self.hash = dict(zip(self.parents, hashes, strict=True))
        self._generation: dict[str, int] | None = None

    def above(self, starts: Iterable[str]) -> set[str]:
        """The versions reached from starts, these included, whether known or not."""
        seen, todo = set(), list(starts)
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += self.parents.get(v, [])
        return seen

    def generation(self) -> dict[str, int]:
        """How far each version is from a root, by the longest way; empty if there is a cycle. Unknown parents have 0."""
        if self._generation is None:
            children: dict[str, list[str]] = {}
            waits = {}
            for v, ps in self.parents.items():
                waits[v] = len(set(ps))
                for p in set(ps):
                    children.setdefault(p, []).append(v)
            at = {v: 0 for v in [*self.parents, *children] if not waits.get(v)}
            todo = list(at)
            while todo:
                v = todo.pop()
                for x in children.get(v, []):
                    waits[x] -= 1
                    if not waits[x]:
                        at[x] = 1 + max(at[p] for p in self.parents[x])
                        todo.append(x)
            self._generation = at if len(at) == len(self.parents.keys() | children.keys()) else {}
        return self._generation

    def add(self, v: str, parents: list[str], content: str) -> None:
        """A new version over known ones."""
        at = self.generation()
        self.parents[v], self.hash[v] = parents, content
        if at:
            at[v] = 1 + max(at.get(p, 0) for p in parents)

    def is_ancestor(self, a: str, d: str) -> bool:
        """Whether d is a or comes of it: nothing older than a is looked at."""
        at = self.generation()
        if not at:
            return a in self.above([d])
        low, seen, todo = at.get(a, 0), set(), [d]
        while todo:
            v = todo.pop()
            if v == a:
                return True
            if v not in seen and at.get(v, 0) > low:
                seen.add(v)
                todo += self.parents.get(v, [])
        return False

    def best(self, a: str, b: str, most: int | None = None) -> list[str]:
        """The common ancestors that no other common one descends from; no more than `most` of them."""
        at = self.generation()
        if not at:
            common = self.above([a]) & self.above([b])
            return sorted(common - self.above([p for v in common for p in self.parents.get(v, [])]))
        # newest first: when a version's turn comes, all that descend from it have had theirs
        mark, out = {a: 1}, []
        mark[b] = mark.get(b, 0) | 2
        todo = [(-at.get(v, 0), v) for v in mark]
        heapq.heapify(todo)
        fresh = len(todo)  # of those to come, versions that are not below a common one
        while todo and fresh:
            _, v = heapq.heappop(todo)
            m = mark[v]
            if m < 4:
                fresh -= 1
                if m == 3:
                    out.append(v)
                    if most is not None and len(out) >= most:
                        break
                    m = 7
            for p in self.parents.get(v, []):
                old = mark.get(p)
                new = (old or 0) | m
                if old is None:
                    heapq.heappush(todo, (-at.get(p, 0), p))
                    fresh += new < 4
                elif old < 4 <= new:
                    fresh -= 1
                mark[p] = new
        return sorted(out)

    def base(self, a: str, b: str) -> tuple[str | None, bool]:
        """(common ancestor that no other common one descends from, whether there are several)."""
        best = self.best(a, b, 2)
        if len(best) == 1:
            return best[0], False
        return None, bool(best) or bool(not self.generation() and self.above([a]) & self.above([b]))

    def reachable(self, v: str, has: set[str] | None, depth: int | None) -> dict[str, int]:
        """Hashes by generations from v, with the generation; a version whose bytes are gone ends its line, v does not."""
        out: dict[str, int] = {}
        seen, todo = {v}, deque([(v, 0)])
        while todo:
            x, n = todo.popleft()
            h = self.hash.get(x)
            if h:
                out.setdefault(h, n)
            if (x != v and h and has is not None and h not in has) or (depth is not None and n >= depth):
                continue
            for p in self.parents.get(x, []):
                if p not in seen:
                    seen.add(p)
                    todo.append((p, n + 1))
        return out


def _walk(t: pa.Table) -> Walk:
    return Walk(*(t.column(x).to_pylist() for x in ("versionId", "parents", "contentHash")))


def components(versions: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(versionId, component) of all versions and stubs. more(a, b): versions that must be together too.

    Versions begin with their file as label; labels that an edge joins are contracted, for which only
    edges between files, and those of stubs, count: few, and few rounds.
    """
    label = F.when(F.col("fileId") != "", F.concat(F.lit("f:"), "fileId")).otherwise(F.concat(F.lit("v:"), "versionId"))
    own = versions.select("versionId", label.alias("label"))
    links = edges(versions).select(F.col("versionId").alias("a"), F.col("parent").alias("b"))
    links = links if more is None else links.union(more.select("a", "b"))
    at = lambda x, to: own.select(F.col("versionId").alias(x), F.col("label").alias(to))
    named = links.join(at("a", "la"), "a", "left").join(at("b", "lb"), "b", "left")
    # most edges are within a file, and need nothing more
    odd = materialize(named.where("la is null or lb is null or la <> lb"))
    stub = lambda x: F.concat(F.lit("v:"), x)
    stubs = odd.where("la is null").select(F.col("a").alias("versionId"), stub("a").alias("label")).union(odd.where("lb is null").select("b", stub("b"))).distinct()
    every = own.union(stubs)
    joined = materialize(odd.select(F.coalesce("la", stub("a")).alias("x"), F.coalesce("lb", stub("b")).alias("y")).where("x <> y").distinct())
    if joined.limit(1).count() == 0:
        return every.withColumnRenamed("label", "component")
    low = joined.select("x").union(joined.select("y")).distinct().withColumn("low", F.col("x"))
    moved = 1
    while moved:
        both = joined.union(joined.select("y", "x"))
        near = both.join(low.select(F.col("x").alias("y"), F.col("low").alias("n")), "y").groupBy("x").agg(F.min("n").alias("n"))
        step = materialize(low.join(near, "x").select("x", F.least("low", "n").alias("low"), (F.col("n") < F.col("low")).alias("moved")))
        jump = step.join(step.select(F.col("x").alias("low"), F.col("low").alias("further")), "low").select("x", F.least("low", "further").alias("low"), "moved")
        low = materialize(jump)
        moved = low.where("moved").limit(1).count()
        low = low.select("x", "low")
    return materialize(every.join(low.withColumnRenamed("x", "label"), "label", "left").select("versionId", F.coalesce("low", "label").alias("component")))


def _by_component(versions: DataFrame, comps: DataFrame) -> DataFrame:
    return versions.join(comps, "versionId").select(F.col("component").alias("k"), "versionId", "parents", "contentHash")


_FACTS = "pair string, a string, b string, a_above_b boolean, b_above_a boolean, base string, ambiguous boolean, opens_above_b boolean"


def pair_facts(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """For pairs(pair, a, b, opens): is a an ancestor of b, b of a; their base; are all of opens ancestors of b.

    Versions that are paired are put in one component, so that every pair is answered by one task.
    """
    opens = F.coalesce("opens", F.array().cast("array<string>"))
    asked = materialize(pairs.where("a is not null and b is not null").select("pair", "a", "b", opens.alias("opens")))
    together = asked.select("a", "b").union(asked.select(F.explode("opens").alias("a"), "b"))
    comps = components(versions, together)
    grouped = asked.join(comps.select(F.col("versionId").alias("a"), "component"), "a").select("component", "pair", "a", "b", "opens")
    large = _large(comps)
    nodes = _by_component(versions, comps.join(grouped.select("component").distinct(), "component", "left_semi"))
    if large is not None:
        by_joins = _facts_by_joins(grouped.join(large, "component", "left_semi").drop("component"), versions)
        nodes, grouped = nodes.join(large.withColumnRenamed("component", "k"), "k", "left_anti"), grouped.join(large, "component", "left_anti")

    def run(nodes: pa.Table, some: pa.Table) -> pa.Table:
        w, out = _walk(nodes), []
        for x in some.to_pylist():
            base, many = w.base(x["a"], x["b"])
            out.append((x["pair"], x["a"], x["b"], w.is_ancestor(x["a"], x["b"]), w.is_ancestor(x["b"], x["a"]), base, many, all(w.is_ancestor(o, x["b"]) for o in x["opens"])))
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_())
        return pa.table({n.split()[0]: pa.array([o[i] for o in out], kinds[i]) for i, n in enumerate(_FACTS.split(", "))})

    out = nodes.groupBy("k").cogroup(grouped.groupBy("component")).applyInArrow(run, _FACTS)
    return out if large is None else out.unionByName(by_joins)


def _large(comps: DataFrame) -> DataFrame | None:
    """(component) of those with more than MAX_COMPONENT versions; None if there are none."""
    large = materialize(comps.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > MAX_COMPONENT).select("component"))
    return large if large.limit(1).count() else None


def _facts_by_joins(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """pair_facts() by joins, for components of any size."""
    pairs = materialize(pairs)
    starts = pairs.select(F.col("a").alias("start")).union(pairs.select("b")).distinct()
    above = ancestors_by_joins(starts, versions)
    of = lambda x, to: above.select(F.col("start").alias(x), F.col("ancestor").alias(to))
    common = materialize(pairs.select("pair", "a", "b").join(of("a", "v"), "a").join(of("b", "v"), ["b", "v"]).select("pair", "v"))
    # what a common ancestor's parents reach is common too; if it has a common child it is not the best
    child = common.join(edges(versions).select(F.col("versionId").alias("v"), F.col("parent").alias("p")), "v").where("p <> v").select("pair", F.col("p").alias("v"))
    best = common.join(child.distinct(), ["pair", "v"], "left_anti").groupBy("pair").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    some = common.groupBy("pair").agg(F.lit(True).alias("any"))
    told = pairs.join(best, "pair", "left").join(some, "pair", "left")
    is_above = lambda x, y, name: above.select(F.col("start").alias(y), F.col("ancestor").alias(x), F.lit(True).alias(name))
    told = told.join(is_above("a", "b", "a_above_b"), ["a", "b"], "left").join(is_above("b", "a", "b_above_a"), ["a", "b"], "left")
    opens = pairs.select("pair", "b", F.explode("opens").alias("o")).join(is_above("o", "b", "up"), ["o", "b"], "left").groupBy("pair").agg(F.bool_and(F.coalesce("up", F.lit(False))).alias("opens_above_b"))
    no = lambda x: F.coalesce(x, F.lit(False))
    return told.join(opens, "pair", "left").select("pair", "a", "b", no(F.col("a_above_b")).alias("a_above_b"), no(F.col("b_above_a")).alias("b_above_a"), F.when(F.col("n") == 1, F.col("v")).alias("base"), (no(F.col("any")) & ~no(F.col("n") == 1)).alias("ambiguous"), F.coalesce("opens_above_b", F.lit(True)).alias("opens_above_b"))


def ancestors_by_joins(starts: DataFrame, versions: DataFrame, hops: int = 8) -> DataFrame:
    """(start, ancestor) like ancestors(), by joins of the frontier: rounds of some hops, each written."""
    return _closure(starts.select("start", F.col("start").alias("ancestor")), "ancestor", versions, hops)


def reachable_hashes(starts: DataFrame, versions: DataFrame, has: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(start, hash, generation) of starts(start); has(hash): the bytes at hand. Walks end past a version whose bytes are gone."""
    comps = components(versions)
    held = versions if has is None else versions.join(has.select(F.col("hash").alias("contentHash")).distinct().withColumn("held", F.lit(True)), "contentHash", "left")
    nodes = held.join(comps, "versionId").select(F.col("component").alias("k"), "versionId", "parents", "contentHash", (F.coalesce("held", F.lit(False)) if has is not None else F.lit(True)).alias("held"))
    asked = starts.select("start").distinct().join(comps.withColumnRenamed("versionId", "start"), "start")
    large = _large(comps)
    if large is not None:
        by_joins = _reached_by_joins(asked.join(large, "component", "left_semi").select("start"), nodes.drop("k"), depth)
        nodes, asked = nodes.join(large.withColumnRenamed("component", "k"), "k", "left_anti"), asked.join(large, "component", "left_anti")

    def run(nodes: pa.Table, some: pa.Table) -> pa.Table:
        w = _walk(nodes)
        held = {h for h, k in zip(nodes.column("contentHash").to_pylist(), nodes.column("held").to_pylist(), strict=True) if k}
        rows = [(s, h, n) for s in some.column("start").to_pylist() for h, n in w.reachable(s, held, depth).items()]
        return pa.table({"start": pa.array([r[0] for r in rows], pa.string()), "hash": pa.array([r[1] for r in rows], pa.string()), "generation": pa.array([r[2] for r in rows], pa.int32())})

    out = nodes.groupBy("k").cogroup(asked.groupBy("component")).applyInArrow(run, "start string, hash string, generation int")
    return out if large is None else out.unionByName(by_joins)


def _reached_by_joins(starts: DataFrame, nodes: DataFrame, depth: int | None) -> DataFrame:
    """reachable_hashes() of nodes(versionId, parents, contentHash, held), a generation a round."""
    nodes = materialize(nodes)
    known = nodes.select("versionId", F.nullif("contentHash", F.lit("")).alias("hash"), "held")
    frontier = materialize(starts.select("start", F.col("start").alias("versionId")).join(known, "versionId", "left").select("start", "versionId", "hash", F.lit(True).alias("on")))
    seen, n = frontier.withColumn("generation", F.lit(0)), 0
    while (depth is None or n < depth) and frontier.where("on").limit(1).count():
        n += 1
        step = frontier.where("on").join(edges(nodes), "versionId").select("start", F.col("parent").alias("versionId")).distinct()
        step = step.join(seen.select("start", "versionId"), ["start", "versionId"], "left_anti").join(known, "versionId", "left")
        frontier = materialize(step.select("start", "versionId", "hash", (F.col("hash").isNull() | F.coalesce("held", F.lit(False))).alias("on")))
        seen = seen.unionByName(frontier.withColumn("generation", F.lit(n)))
    return seen.where("hash is not null").groupBy("start", "hash").agg(F.min("generation").alias("generation"))


def ancestors(starts: DataFrame, versions: DataFrame) -> DataFrame:
    """(start, ancestor); a start is its own ancestor, even an unknown one."""
    comps = components(versions)
    asked = starts.select("start").distinct().join(comps.withColumnRenamed("versionId", "start"), "start", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("v:"), "start")))
    nodes, large = _by_component(versions, comps), _large(comps)
    if large is not None:
        by_joins = ancestors_by_joins(asked.join(large, "component", "left_semi"), versions)
        nodes, asked = nodes.join(large.withColumnRenamed("component", "k"), "k", "left_anti"), asked.join(large, "component", "left_anti")

    def run(nodes: pa.Table, some: pa.Table) -> pa.Table:
        w, starts, found = _walk(nodes), [], []
        for s in some.column("start").to_pylist():
            up = w.above([s])
            starts += [s] * len(up)
            found += up
        return pa.table({"start": pa.array(starts, pa.string()), "ancestor": pa.array(found, pa.string())})

    out = nodes.groupBy("k").cogroup(asked.groupBy("component")).applyInArrow(run, "start string, ancestor string")
    return out if large is None else out.unionByName(by_joins)


def above(starts: DataFrame, versions: DataFrame) -> DataFrame:
    """(versionId) reached from any of starts(versionId), once each: one walk from all starts of a component."""
    comps = components(versions)
    asked = starts.select("versionId").where("versionId is not null").distinct().join(comps, "versionId", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("v:"), "versionId")))
    nodes, large = _by_component(versions, comps), _large(comps)
    if large is not None:
        by_joins = closure(asked.join(large, "component", "left_semi"), versions)
        nodes, asked = nodes.join(large.withColumnRenamed("component", "k"), "k", "left_anti"), asked.join(large, "component", "left_anti")

    def run(nodes: pa.Table, some: pa.Table) -> pa.Table:
        return pa.table({"versionId": pa.array(_walk(nodes).above(some.column("versionId").to_pylist()), pa.string())})

    out = nodes.groupBy("k").cogroup(asked.groupBy("component")).applyInArrow(run, "versionId string")
    return out if large is None else out.unionByName(by_joins)


def closure(starts: DataFrame, versions: DataFrame, hops: int = 8) -> DataFrame:
    """(versionId) reached from any of starts(versionId): joins of the frontier, for components of any size.

    A round goes some hops at once and is written; the number of rounds is the depth over hops.
    """
    return _closure(starts.select("versionId").where("versionId is not null").distinct(), "versionId", versions, hops)


def _closure(starts: DataFrame, at: str, versions: DataFrame, hops: int) -> DataFrame:
    """The rows of starts, and those with a parent in the column `at` instead, and so on."""
    keys = starts.columns
    parents = materialize(edges(versions).select(F.col("versionId").alias(at), "parent"))
    frontier = materialize(starts)
    rounds = [frontier]
    while True:
        seen = rounds[0]
        for x in rounds[1:]:
            seen = seen.union(x)
        reached, step = None, frontier
        for hop in range(hops):
            step = step.join(parents, at).withColumn(at, F.col("parent")).select(*keys).distinct()
            told = step.withColumn("last", F.lit(hop == hops - 1))
            reached = told if reached is None else reached.union(told)
        new = materialize(reached.groupBy(*keys).agg(F.max("last").alias("last")).join(seen, keys, "left_anti"))
        rounds.append(new.select(*keys))
        frontier = new.where("last").select(*keys)
        if frontier.limit(1).count() == 0:
            return seen.union(rounds[-1])


def prune(versions: DataFrame, keep: DataFrame) -> DataFrame:
    """versions that are roots(versionId) or ancestors of one."""
    return versions.join(above(keep, versions), "versionId", "left_semi")


def sweep(versions: DataFrame, keep: DataFrame) -> tuple[DataFrame, bool]:
    """(pruned versions, whether anything was done): declined for an empty graph, no roots, or none of them in the graph."""
    if versions.join(keep.select("versionId"), "versionId", "left_semi").limit(1).count() == 0:
        return versions, False
    return prune(versions, keep), True
