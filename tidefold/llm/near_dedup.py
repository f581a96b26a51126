"""Near duplicates by a fast similarity sketch, bands and exact checks.

A text's set holds its distinct shingles of SHINGLE lower-cased words (all its words as one where
there are fewer). Sets that are equal form a class and go on as one. The sketch has COORDINATES
places. In each of up to twice as many rounds every shingle of a set is hashed to one place (in the
later rounds all to the round's own place) with a value that rises from round to round, and a place
keeps its least value; a set is done after the round in which its last place is filled. So every
place is filled, and two sets agree in a place with a chance that is their similarity, with the
concentration of independent samples. ROWS coordinates form a band: two sets with similarity s share
none of the bands with chance (1 - s^ROWS)^(COORDINATES / ROWS), under 1e-8 at 0.85.

Sets that share a band are candidates, and only exact counts on full sets make a link. In a bucket
(the sets that share a band) all are first compared with its smallest member, which makes as many
pairs as members. Links so found are contracted to components. What is left are buckets with sets of
several components; their sets are compared in full, in blocks of bounded size, so that no link
between different components is missed, and no pairs of sets are ever written but links.

Shingles are 64 bits of the joined XXH3 digests of their words; classes are told apart by 128.

Null and empty texts, and texts without words, have the empty set and are linked with nothing.
Repeated rows are members of one class. Rows that share a doc_id but not a text are rows of their own:
each has the component of its own text. doc_id null: such rows are returned with their own set size,
linked with nothing and kept. Of clashing input columns the operator's own win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common as c

SHINGLE = 5
COORDINATES, ROWS = 160, 5
#: Sets that are compared with as many others at once.
BLOCK = 512
_ROUND = c.seeds(2 * COORDINATES, 6)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingles of each text, sorted."""
    w = c.split_words(c.texts_of(texts, lower=True))
    n = np.diff(w.off)
    at, doc, h = np.flatnonzero(w.windows(k)), w.doc(), w.hashes()
    hashes, owner = c.rolling(h, k)[at], doc[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = np.array([c.rolling(h[w.off[d] : w.off[d + 1]], int(n[d]))[0] for d in few], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), hashes


def sketch(off: np.ndarray, hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of each set; all ones for an empty one."""
    n, full = np.diff(off), np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(n), t), full)
    open_ = np.flatnonzero(n > 0)
    own, x = np.repeat(np.arange(len(n)), n), hashes
    for i in range(2 * t):
        if not len(open_):
            break
        with np.errstate(over="ignore"):
            h = c.mix(x ^ _ROUND[i])
        place = (h >> np.uint64(40)).astype(np.int64) % t if i < t else np.full(len(x), i - t)
        np.minimum.at(out.reshape(-1), own * t + place, (np.uint64(i) << np.uint64(52)) | (h & np.uint64((1 << 40) - 1)))
        left = (out[open_] == full).any(1)
        if not left.all():
            open_ = open_[left]
            still = np.zeros(len(n), bool)
            still[open_] = True
            own, x = own[still[own]], x[still[own]]
    return out


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    b = s.reshape(len(s), s.shape[1] // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(c.seeds(b.shape[1], 8), b.shape[:2]).copy()
        for j in range(rows):
            key = c.mix(key ^ b[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
    return key


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def make(texts):
        off, h = shingle_sets(texts)
        with np.errstate(over="ignore"):
            k1, k2 = c.segment_sum(c.mix(h ^ _ROUND[0]), off), c.segment_sum(c.mix(h ^ _ROUND[1]), off)
        key = bands(sketch(off, h))
        listed = pa.FixedSizeListArray.from_arrays(pa.array(c.signed(key).ravel()), key.shape[1]).cast(pa.list_(pa.int64()))
        return [np.diff(off).astype(np.int64), c.signed(k1), c.signed(k2), listed]

    fields = [c.field("n_shingles", "long"), c.field("_k1", "long"), c.field("_k2", "long"), c.field("_bands", "array<long>")]
    return c.add_columns(_rows(docs, doc_id, text), "_text", make, fields, ["doc_id", "digest"])


def digest_of(text: Column) -> Column:
    """What tells two texts under one doc_id apart."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(F.col(text)).alias("digest"), F.col(text).alias("_text"))


def _sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, set) of nodes(id, doc_id, digest): the sorted hashes of such a document as bytes."""
    def make(texts):
        off, h = shingle_sets(texts)
        return [c.blobs([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)])]

    some = _rows(docs, doc_id, text).join(nodes, ["doc_id", "digest"]).select("id", "_text").dropDuplicates(["id"])
    return c.add_columns(some, "_text", make, [c.field("set", "binary")], ["id"])


def _check_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, sa, sb) the pairs that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist(), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _rest(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of buckets(key, id, comp) of different components.

    Members are dealt to blocks of about BLOCK by a hash, and every two blocks of a bucket meet in a
    group of their own; a bucket whose members are all of one component doesn't come here.
    """
    size = c.materialize(buckets.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")))
    dealt = buckets.join(size, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "comp")
    schema = "a long, b long"

    def pairs(t: pa.Table) -> pa.Table:
        i, ids, comp, p, q = (t.column(x).to_numpy() for x in ("i", "id", "comp", "p", "q"))
        sets_ = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        order = np.lexsort((ids, np.array([len(x) for x in sets_])))
        lens = np.array([len(sets_[x]) for x in order])
        label = {int(x): int(x) for x in comp}

        def top(x: int) -> int:
            while label[x] != x:
                label[x] = x = label[label[x]]
            return x

        out = []
        for n, x in enumerate(order):
            far = np.searchsorted(lens, lens[n] * 100 // percent, side="right")
            for y in order[n + 1 : far]:
                if p[x] != q[x] and i[x] == i[y]:
                    continue
                s, r = top(int(comp[x])), top(int(comp[y]))
                if s != r and similar(sets_[x], sets_[y], percent):
                    label[max(s, r)] = min(s, r)
                    out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return met.join(sets, "id").groupBy("key", "p", "q").applyInArrow(pairs, schema).distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (that is its own), digest
    (of the text) and first: whether its doc_id and digest are the least of its group."""
    features = c.materialize(_features(docs, doc_id, text))
    key = ["n_shingles", "_k1", "_k2"]
    linked = features.where("n_shingles > 0 and doc_id is not null")
    # a class has a number of its own, as one doc_id may have several texts; it is fixed when the table is written
    least = linked.groupBy(*key).agg(F.min(F.struct("doc_id", "digest", "_bands")).alias("m")).select(*key, "m.*")
    classes = c.materialize(least.withColumn("id", F.monotonically_increasing_id()))
    buckets = classes.select("id", F.explode("_bands").alias("key"))
    centres = c.materialize(buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"))
    shared = c.materialize(buckets.join(centres, "key"))
    nodes = classes.select("id", "doc_id", "digest").join(shared.select("id").distinct(), "id")
    sets = c.materialize(_sets(docs, nodes, doc_id, text))
    stars = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    first = c.materialize(_check_pairs(stars.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a"), percent))
    comps = c.components(first)
    known = shared.select("key", "id").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    known = c.materialize(known)
    mixed = c.materialize(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    more = c.materialize(_rest(c.materialize(known.join(mixed, "key")), sets, percent))
    comps = c.components(first.union(more))
    grouped = classes.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select(*key, "doc_id", "digest", F.coalesce("component", "id").alias("component"))
    grouped = c.materialize(grouped)
    head = c.materialize(grouped.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("head")))
    final = c.materialize(grouped.select(*key, "component").join(head, "component").select(*key, "head"))
    own = F.struct("doc_id", "digest")
    out = features.drop("_bands").join(final, key, "left").withColumn("head", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", own)))
    yes = lambda x: F.coalesce(x, F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), yes(F.col("doc_id") == F.col("head.doc_id")).alias("kept"), "digest", yes(own == F.col("head")).alias("first"))
