"""Near duplicates among vectors: spherical k-means cells, blocked cosine products within cells.

Vectors that are equal form a class and go on as one with a weight. Centres are fitted on a bounded
sample (SAMPLE vectors, chosen by a hash of the id); the number of cells follows the root of the
number of classes, up to MAX_CELLS. A vector lives in the cell of its nearest centre, and may have
partners in another cell unless it is farther from the plane between the two centres than a vector on the
other side of that plane can be at the threshold. This holds for every direction, so that no pair is missed.
Neighbouring cells, in an order that goes from a centre to the nearest one left, form a group of about
BLOCK vectors, and a vector is sent to a group once, whatever the number of its cells that it visits. Of
two vectors that live in different groups, the one whose group has the larger number visits the other's.
Within a group every home vector is compared with every visitor, in blocks of about BLOCK by BLOCK that
are tasks of their own, so that a cell with a third of all vectors is the work of many tasks. All
products are exact, in double precision, so that no link is below the threshold.

A block gives for each vector the weight of its links, and for links not all pairs but each vector's
least partner in the block, contracted; components come of these. Null or zero vectors, and those with
null or non-finite components, link with nothing. Vectors of different lengths do not link: each length has
centres and cells of its own (one cell, up to BLOCK classes). Repeated rows are vectors of their own.
Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common as c

SAMPLE, MAX_CELLS, ROUNDS, BLOCK, CHUNK = 20_000, 4096, 8, 4096, 512


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of unit vectors x."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def reach(threshold: float) -> float:
    """How far from a plane through zero a unit vector can be that has this cosine with one on the plane's other side.

    The sine of the angle between the two; the addend is for rounding.
    """
    return float(np.sqrt(1 - threshold**2)) + 1e-7 if 0 < threshold < 1 else (1e-7 if threshold >= 1 else 1.0 + 1e-7)


def chain(centres: np.ndarray) -> np.ndarray:
    """The centres from one to the nearest that is left, and so on."""
    left = np.ones(len(centres), bool)
    order = [0]
    left[0] = False
    for _ in range(len(centres) - 1):
        near = np.where(left, centres @ centres[order[-1]], -np.inf)
        order.append(int(near.argmax()))
        left[order[-1]] = False
    return centres[order]


def grouped(homes: list[int], block: int) -> np.ndarray:
    """The group of each cell: cells in a row that have up to `block` vectors together; a larger cell is a group of its own."""
    out, group, held = [], 0, 0
    for n in homes:
        if held and held + n > block:
            group, held = group + 1, 0
        out.append(group)
        held += n
    return np.array(out, np.int32)


def visited(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits) of unit vectors: the cell of each and, by cells, where a partner of it may live."""
    s = x @ centres.T
    home = s.argmax(1)
    square = (centres * centres).sum(1)
    apart = np.sqrt(np.maximum(square[home][:, None] + square - 2 * centres[home] @ centres.T, 0))
    return home, s[np.arange(len(x)), home][:, None] - s <= reach(threshold) * apart + 1e-7


def _vectors(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), np.float64).reshape(len(binary), -1)


def _unit(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, v, k1, k2): unit vectors as bytes, null where a vector links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("e")
            n = np.asarray(pc.fill_null(pc.list_value_length(e), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(pc.list_flatten(e), np.nan)).astype(np.float64)
            off = np.concatenate([[0], np.cumsum(n)])
            finite = np.isfinite(flat)
            ok = (c.segment_sum(finite.astype(np.int64), off) == n) & (n > 0)
            out: list[bytes | None] = []
            for i in range(len(n)):
                x = flat[off[i] : off[i + 1]]
                top = np.abs(x).max() if ok[i] else 0.0
                if top > 0:
                    x = x / top  # so that squares neither overflow nor vanish
                    out.append((x / np.sqrt(x @ x) + 0.0).tobytes())
                else:
                    out.append(None)
            v = pa.array(out, pa.binary())
            off8, data = c._buffers(v)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(n), v, c_signed(c.hash_bytes(off8, data)), c_signed(c.hash_bytes(off8, data, 1))], names=["vec_id", "dim", "v", "k1", "k2"])

    c_signed = lambda x: pa.array(c.signed(x))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, dim long, v binary, k1 long, k2 long")


def _assign(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """classes with home and visits, the sorted cells of a vector; a length without centres has cell 0 alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.asarray(whole.column("dim"))
            for d in np.unique(dims):
                own = whole.filter(pa.array(dims == d))
                for a in range(0, len(own), 2048):
                    b = own.slice(a, 2048)
                    if int(d) in centres:
                        home, visits = visited(_vectors(b.column("v")), centres[int(d)], threshold)
                    else:
                        home, visits = np.zeros(len(b), np.int64), np.ones((len(b), 1), bool)
                    off = np.concatenate([[0], np.cumsum(visits.sum(1))])
                    cells = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.nonzero(visits)[1], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("dim", "id", "m", "v")), pa.array(home, pa.int32()), cells], names=["dim", "id", "m", "v", "home", "visits"])

    return classes.select("dim", "id", "m", "v").mapInArrow(run, "dim long, id long, m long, v binary, home int, visits array<int>")


def _in_groups(assigned: DataFrame, groups: dict[int, np.ndarray]) -> DataFrame:
    """assigned with groups instead of cells; a vector visits its own group and those with smaller numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, visits = [], []
            for d, h, cells in zip(b.column("dim").to_pylist(), b.column("home").to_pylist(), b.column("visits").to_pylist(), strict=True):
                own = int(groups[d][h]) if d in groups else h
                home.append(own)
                visits.append([int(x) for x in np.unique(groups[d][cells]) if x <= own] if d in groups else cells)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("dim", "id", "m", "v")), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["dim", "id", "m", "v", "home", "visits"])

    return assigned.mapInArrow(run, assigned.schema)


def _centres(classes: DataFrame, dim: int, total: int) -> np.ndarray:
    own = classes.where(F.col("dim") == dim)
    some = own.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // SAMPLE)))) == 0).select("v").limit(2 * SAMPLE).toArrow()
    if not len(some):
        some = own.select("v").limit(1).toArrow()
    return chain(kmeans(_vectors(some.column("v").combine_chunks()), min(MAX_CELLS, max(1, int(np.sqrt(total) / 2)))))


def _compare(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        side = np.asarray(t.column("side")).astype(bool)
        h, v = t.filter(pa.array(side)), t.filter(pa.array(~side))
        ids = np.concatenate([np.asarray(h.column("id")), np.asarray(v.column("id"))])
        nh, nv = len(h), len(v)
        n, low = np.zeros(nh + nv, np.int64), ids.copy()
        if nh and nv:
            a, b = (_vectors(x.column("v").combine_chunks()) for x in (h, v))
            hid, vid = ids[:nh], ids[nh:]
            chunks = [slice(i, i + CHUNK) for i in range(0, nh, CHUNK)]
            hit = np.concatenate([(a[x] @ b.T >= threshold) & (hid[x, None] != vid) for x in chunks])
            mh, mv = np.asarray(h.column("m")), np.asarray(v.column("m"))
            n[:nh] = np.concatenate([hit[x] @ mv for x in chunks])
            home = np.asarray(v.column("home"))
            back = np.sum([mh[x] @ hit[x] for x in chunks], 0)
            n[nh:] = np.where(home != cell, back, 0)  # vectors of one group count each other from the home side
            big = np.iinfo(np.int64).max
            some_h, some_v = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            hit = hit[np.ix_(some_h, some_v)]
            chunks = [slice(i, i + CHUNK) for i in range(0, len(some_h), CHUNK)]
            while len(some_h):  # the least id that a vector reaches within the block
                lv, lh = low[nh:].copy(), low[:nh].copy()
                lv[some_v] = np.minimum(lv[some_v], np.min([np.where(hit[x], lh[some_h[x], None], big).min(0) for x in chunks], 0))
                lh[some_h] = np.minimum(lh[some_h], np.concatenate([np.where(hit[x], lv[some_v], big).min(1) for x in chunks]))
                if (lh == low[:nh]).all() and (lv == low[nh:]).all():
                    break
                low = np.concatenate([lh, lv])
        some = (n > 0) | (low != ids)
        return pa.table({"id": pa.array(ids[some]), "n": pa.array(n[some]), "low": pa.array(low[some])})

    return run


def embedding_dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    unit = c.materialize(_unit(df, vec_id, embedding))
    good = unit.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    if not good.limit(1).count():
        return unit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = c.materialize(good.groupBy("k1", "k2", "dim").agg(F.min(F.struct("vec_id", "v")).alias("f"), F.count("*").alias("m")).select("k1", "k2", "dim", F.col("f.vec_id").alias("id"), F.col("f.v").alias("v"), "m"))
    # lengths of more than BLOCK classes; two counts a cell, at most 2 * MAX_CELLS numbers for each of them
    large = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().where(F.col("count") > BLOCK).collect()}
    centres = {d: _centres(classes, d, n) for d, n in sorted(large.items())}
    assigned = c.materialize(_assign(classes, centres, threshold))
    live = {(r["dim"], r["home"]): r["n"] for r in assigned.where(F.col("dim").isin(list(large))).groupBy("dim", "home").agg(F.count("*").alias("n")).collect()}
    groups = {d: grouped([live.get((d, i), 0) for i in range(len(x))], BLOCK) for d, x in centres.items()}
    told = c.materialize(_in_groups(assigned, groups))
    split = told.where(F.col("dim").isin(list(large)))
    homes = {(r["dim"], r["home"]): r["n"] for r in split.groupBy("dim", "home").agg(F.count("*").alias("n")).collect()}
    visitors = {(r["dim"], r["cell"]): r["n"] for r in split.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    parts = {x: (-(-homes[x] // BLOCK), -(-visitors[x] // BLOCK)) for x in homes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                b = whole.slice(a, 512)
                ids = np.asarray(b.column("id"))
                salt = c.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)
                rows, key = [], []
                for k, (d, home, visits) in enumerate(zip(*(b.column(x).to_pylist() for x in ("dim", "home", "visits")), strict=True)):
                    s = int(salt[k])
                    for x in visits:
                        if d not in large or (d, x) in parts:
                            hp, vp = parts.get((d, x), (1, 1))
                            key += [(x, i, s % vp, False) for i in range(hp)]
                            rows += [k] * hp
                    hp, vp = parts.get((d, home), (1, 1))
                    key += [(home, s % hp, j, True) for j in range(vp)]
                    rows += [k] * vp
                at = pa.array(rows, pa.int64())
                cols = [pa.array([x[i] for x in key], pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x[3] for x in key], pa.bool_()), *(b.column(x).take(at) for x in ("dim", "id", "m", "v", "home"))], names=["cell", "i", "j", "side", "dim", "id", "m", "v", "home"])

    dealt = told.mapInArrow(deal, "cell int, i int, j int, side boolean, dim long, id long, m long, v binary, home int")
    met = c.materialize(dealt.groupBy("dim", "cell", "i", "j").applyInArrow(_compare(threshold), "id long, n long, low long"))
    links = met.groupBy("id").agg(F.sum("n").alias("n"))
    comps = c.components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    final = c.materialize(classes.join(links, "id", "left").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("k1", "k2", "dim", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    keyed = unit.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("k1")).alias("k1"), "k2", "dim")
    out = keyed.join(final, ["k1", "k2", "dim"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
