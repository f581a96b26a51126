"""A quality classifier: random-indexing word vectors pooled by document, and a two-layer network.

Every word has a sparse random index vector, known from its hash alone. A word's context vector is
the sum of the index vectors of its neighbours, over all documents; words share BUCKETS rows by
their hash, so that the table of context vectors has a fixed size. A document is the mean of its
words' context vectors, of index vectors of the words' shapes (runs of capitals, letters, digits and
signs), and a few shares. A network with one hidden layer is fitted in numpy on labelled rows: all
of them, or about SAMPLE chosen by a hash where there are more. A fifth of these is left out of the
fit and sets the temperature of the probabilities.

Labels are read only from rows whose CRC-32 of the doc_id, modulo 4, is not 2; labels, language,
source and doc_id are no inputs of a score. Null and empty texts have zero vectors and are scored as
such. Rows with several labels count once, with the smallest. Without labels, or with one kind only,
every score is the share of ones among the labels, smoothed. Repeated rows are scored alike; input
columns with the names of results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common as c

BUCKETS, DIM, NONZERO, SHAPE_DIM = 8192, 64, 4, 48
#: About so many labelled rows are fitted on at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.7
_SLICE = 1 << 19


def _index(h: np.ndarray, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the NONZERO entries of each hash's index vector."""
    with np.errstate(over="ignore"):
        x = np.stack([c.mix(h ^ s) for s in c.seeds(NONZERO, seed)])
    return (x >> np.uint64(20)).astype(np.int64) % dim, np.where(x & np.uint64(1), 1.0, -1.0)


def _shape_hash(words: pa.Array) -> np.ndarray:
    """A hash of each word with runs of one kind of character taken as one."""
    kind = np.arange(256)
    kind[ord("a") : ord("z") + 1] = ord("x")
    kind[ord("A") : ord("Z") + 1] = ord("X")
    kind[ord("0") : ord("9") + 1] = ord("9")
    kind[0x80:] = ord("x")
    off, data = c._buffers(words)
    if not len(data):
        return np.zeros(len(words), np.uint64)
    k = kind[data].astype(np.uint8)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    new[off[:-1]] = True
    return c.hash_bytes(np.concatenate([[0], np.cumsum(new)])[off], k[new])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The BUCKETS context vectors, of unit length: sums over all documents, BUCKETS * DIM numbers in all."""
    def run(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in c.slices(batch, "_text"):
                w = c.split_words(c.texts_of(part.column("_text")))
                if len(w.codes) < 2:
                    continue
                h, doc = c.hash_strings(w.dictionary), w.doc()
                bucket = (h % np.uint64(BUCKETS)).astype(np.int64) * DIM
                pair = doc[1:] == doc[:-1]
                a, b = w.codes[:-1][pair], w.codes[1:][pair]
                for seed, one, other in ((41, a, b), (42, b, a)):  # what follows and what precedes have vectors of their own
                    place, sign = _index(h, DIM, seed)
                    for j in range(NONZERO):
                        total += np.bincount(bucket[one] + place[j][other], sign[j][other], BUCKETS * DIM)
        rows = total.reshape(BUCKETS, DIM).astype(np.int64)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(rows[some].ravel()), DIM).cast(pa.list_(pa.int64()))], names=["bucket", "v"])

    sums = docs.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, v array<long>")
    rows = sums.groupBy("bucket").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM))).collect()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in rows:
        v = np.array(r[1:], float)
        out[r[0]] = v / max(np.linalg.norm(v), 1e-9)
    return out


def document_vectors(texts: pa.Array, context: np.ndarray) -> np.ndarray:
    """A row of inputs for each text."""
    w = c.split_words(c.texts_of(texts))
    n = np.diff(w.off)
    out = np.zeros((len(n), DIM + SHAPE_DIM + 5), np.float32)
    if len(w.codes):
        h = c.hash_strings(w.dictionary)
        v = np.zeros((len(h), DIM + SHAPE_DIM), np.float32)
        v[:, :DIM] = context[(h % np.uint64(BUCKETS)).astype(np.int64)]
        place, sign = _index(_shape_hash(w.dictionary), SHAPE_DIM, 43)
        for j in range(NONZERO):
            np.add.at(v, (np.arange(len(h)), DIM + place[j]), sign[j].astype(np.float32))
        size = np.asarray(pc.utf8_length(w.dictionary)).astype(np.float64)
        has = np.flatnonzero(n > 0)
        at, m = w.off[:-1][has], n[has].astype(np.float64)
        for a in range(0, len(has), 256):  # some documents at once: a row of floats for each word
            b = min(a + 256, len(has))
            lo, hi = at[a], at[b - 1] + n[has[b - 1]]
            out[has[a:b], : DIM + SHAPE_DIM] = np.add.reduceat(v[w.codes[lo:hi]], at[a:b] - lo, axis=0) / m[a:b, None]
        doc = w.doc()
        distinct = np.bincount(np.unique(doc * len(h) + w.codes) // len(h), minlength=len(n))[has]
        again = np.bincount(doc[1:][(w.codes[1:] == w.codes[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))[has]
        k = DIM + SHAPE_DIM
        out[has, k] = np.log1p(m)
        out[has, k + 1] = distinct / np.sqrt(m)
        out[has, k + 2] = again / m
        out[has, k + 3] = c.segment_sum(size[w.codes], w.off)[has] / m
        out[has, k + 4] = np.linalg.norm(out[has, :DIM], axis=1)
    return out


@dataclass
class Network:
    """Inputs are standardised; the hidden layer is rectified; the output is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    fitted: bool = True  # False: a constant, as there were too few labels or only one kind

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def constant(y: np.ndarray, width: int) -> Network:
    p = (y.sum() + 1) / (len(y) + 2)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), fitted=False)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss, then the temperature that suits the rows left out."""
    x = x.astype(np.float64)
    if len(y) < 20 or y.min() == y.max():
        return constant(y, x.shape[1])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z, t = np.clip((x[own] - mean) / scale, -8, 8), y[own].astype(np.float64)
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(EPOCHS, 60_000 // len(t))):
        mixed = rng.permutation(len(t))
        for a in range(0, len(t), BATCH):
            i = mixed[a : a + BATCH]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[i]) / len(i)
            dh = np.outer(d, p[2]) * (h > 0)
            step += 1
            for k, g in enumerate((z[i].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, t = net.logit(x[held]), y[held].astype(np.float64)
    loss = lambda s: np.mean(np.logaddexp(0, logit / s) - t * logit / s)
    net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, context: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """The network of labels(doc_id, quality) and the texts of docs, without held-out rows."""
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    ids = docs.select(F.col(doc_id).cast("long").alias("_id")).distinct()
    known = c.materialize(known.groupBy("_id").agg(F.min("_y").alias("_y")).join(ids, "_id", "left_semi"))
    some = max(1, -(-known.count() // SAMPLE))
    # a hash leaves about SAMPLE rows at most, whatever the number of labels
    chosen = c.materialize(known.where(F.pmod(F.xxhash64("_id"), F.lit(some)) == 0))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])

    def make(texts):
        v = document_vectors(texts, context)
        return [c.blobs([x.tobytes() for x in v])]

    got = c.add_columns(rows, "_text", make, [c.field("_v", "binary")], ["_id", "_y"], _SLICE).toPandas().sort_values("_id")
    width = DIM + SHAPE_DIM + 5
    x = np.frombuffer(b"".join(got["_v"]), np.float32).reshape(-1, width)
    return fit(x, got["_y"].to_numpy(np.int64))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; all: None) with held_out, score and predicted."""
    return score(docs, learn(docs, labels, doc_id, text, label), doc_id, text, keep)


@dataclass
class Classifier:
    context: np.ndarray
    net: Network


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """Context vectors of all texts, and the network of the labelled ones."""
    context = context_vectors(docs, text)
    return Classifier(context, train(docs, labels, context, doc_id, text, label))


def score(docs: DataFrame, known: Classifier, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; all: None) with held_out, score and predicted."""
    context, net = known.context, known.net

    def make(texts):
        p = net.probability(document_vectors(texts, context))
        return [p, (p >= THRESHOLD).astype(np.int32)]

    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("held_out", "score", "predicted")]
    told = docs.select(*dict.fromkeys([*kept, text]), held_out(F.col(doc_id)).alias("held_out"))
    return c.add_columns(told, text, make, [c.field("score", "double"), c.field("predicted", "int")], [*kept, "held_out"], _SLICE)
