"""What the training-data operators share: words, hashes, scratch tables and components.

Words are maximal runs of anything but ASCII space, tab, newline, vertical tab, form feed and
carriage return. They are handled as one array of codes for a slice of some megabytes of text,
with a dictionary of the distinct words, so that Python work is done once for a distinct word.
"""

from __future__ import annotations

import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # tasks are the parallelism; takes effect where numpy isn't loaded yet
    os.environ.setdefault(_name, "1")

import ctypes
import gc
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.scratch import materialize

#: Bytes of text that are worked on at once.
SLICE_BYTES = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- tables -------------------------------------------------------------------------


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: what the number of blocks and buckets follows."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def forget(spark: SparkSession) -> None:
    """Let the driver find what it no longer needs, so that Spark deletes the shuffle files of ended jobs now and not by chance."""
    spark.range(1).count()  # the scheduler keeps hold of the last job until there is another
    gc.collect()
    if (jvm := getattr(spark.sparkContext, "_jvm", None)) is not None:
        jvm.System.gc()


# --- hashes ---------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _R + np.uint64(seed * 7919 + 1))


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array without nulls."""
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = a.buffers()
    if len(a) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def segment_sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x between offsets; empty segments give 0."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[off[1:]] - total[off[:-1]]


def digests(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """128 bits (XXH3) of each string, as two columns."""
    raw = data.tobytes()
    at = off.tolist()
    parts = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


def hash_bytes(off: np.ndarray, data: np.ndarray, seed: int = 0) -> np.ndarray:
    """The first (seed 0) or second (seed 1) 64 bits of each string's digest."""
    return np.ascontiguousarray(digests(off, data)[:, seed])


def hash_strings(a: pa.Array, seed: int = 0) -> np.ndarray:
    return hash_bytes(*_buffers(a), seed)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in this order."""
    return mix(a * _R + b)


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values; the last k - 1 places are left out.

    Runs of 1, 2, 4 ... values are joined pairwise, each time through the finalizer, so that it is no
    linear function of the values. Two hashes of one run are independent if those of its values are.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run, size, out, have, left = h, 1, None, 0, k
        while left:
            if left & 1:
                part = run[have : have + n]
                out = part if out is None else _joined(out, part)
                have += size
            left >>= 1
            if left:
                run, size = _joined(run[:-size], run[size:]), 2 * size
        return mix(out + np.uint64(k + 1000 * seed))


# --- memory ---------------------------------------------------------------------------------

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give free memory back to the system: workers live on after a task, and their neighbours need it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """The function of a group, with free memory given back after each."""
    def tidied(*args):
        try:
            return run(*args)
        finally:
            release()

    # Spark counts the arguments
    if len(inspect.signature(run).parameters) == 1:
        return lambda t: tidied(t)
    if len(inspect.signature(run).parameters) == 2:
        return lambda a, b: tidied(a, b)
    return lambda key, a, b: tidied(key, a, b)


# --- words ----------------------------------------------------------------------------------


@dataclass
class Words:
    """codes[off[d]:off[d+1]] are the words of document d, as places in the dictionary."""

    codes: np.ndarray
    off: np.ndarray
    dictionary: pa.Array
    _digests: np.ndarray | None = None

    def hashes(self, seed: int = 0) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(0, np.uint64)
        if self._digests is None:
            self._digests = digests(*_buffers(self.dictionary))
        return self._digests[:, seed][self.codes]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def windows(self, k: int) -> np.ndarray:
        """Which places start k words of one document (of the first len - k + 1 places)."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        end = np.repeat(self.off[1:], np.diff(self.off))
        return np.arange(n) + k <= end[:n]


def texts_of(a: pa.Array, lower: bool = False) -> pa.Array:
    """Strings without nulls (null: empty)."""
    a = pc.fill_null(a, "") if a.null_count else a
    return pc.ascii_lower(a) if lower else a


def split_words(a: pa.Array) -> Words:
    parts = pc.ascii_split_whitespace(a)
    off = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.values.slice(off[0], off[-1] - off[0]) if len(off) else parts.values
    off = off - off[0]
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return Words(np.asarray(coded.indices), off, coded.dictionary)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text; one longer text is a part of its own."""
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 64
    part = (np.cumsum(n) - n) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(n)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def add_columns(
    df: DataFrame,
    column: str,
    make: Callable[[pa.Array], list],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """df's `keep` columns (all: None) and the columns that `make` derives from a slice of texts.

    A column of df with the name of a new one gives way to it.
    """
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    read = list(dict.fromkeys([*kept, column]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in make(part.column(column))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *new])
                del made
            release()

    return df.select(*read).mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}[kind])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component: the smallest node it reaches.

    Stars are contracted to their smallest neighbour in turn, large and small, until nothing
    changes. Every step groups with a partial minimum and joins, so that a node with very many
    neighbours is split; rounds grow with the logarithm of the size, and each is written.
    """
    def size(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = size(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small)
        after = size(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
