"""Passages of WINDOW words that an earlier document has too are removed.

A window is WINDOW consecutive words of one document, unchanged. A word goes if a window over it
also starts in a document with a smaller doc_id; windows are judged on the input.

Anchors find the candidates. A set of residues modulo PERIOD is a difference cover: every difference
of two places is a difference of two residues. Only at places whose number in the document is in the
cover modulo PERIOD is a short window of WINDOW - PERIOD + 1 words hashed. Whatever the places i and j
of two equal windows, for some step below PERIOD both i + step and j + step are anchors, and the short
windows there lie within the two and are equal. So a window without an anchor that another document
has can be left out; the rest, a small share, are extended to whole windows and compared as such, by
128 bits, and the least doc_id of each is the verdict.

Documents are dealt to blocks by a hash, in one exchange of the texts that three steps read. A block
sends each distinct anchor once, as bytes, to the bucket of its upper bits, whatever the number of its
documents that have it, and a bucket answers with the anchors that are shared. The block then sends
each distinct window that may be repeated once, with the least doc_id here, and the answer lists those
that have a smaller one elsewhere. So a passage in a third of all documents costs one entry a block, no
task holds more than its block or bucket. The number of both follows spark.sql.shuffle.partitions, and the
bytes of the texts where these are more.

Texts that are wholly equal are collapsed before: only the one with the smallest doc_id takes part,
and of the others every word goes, if they have a whole window. Such a copy is known by its doc_id and
a digest of its text, as rows with one doc_id may differ. Null and empty texts have no words. Rows with
one doc_id are one document's for the rule "smaller doc_id", each with its own result. Rows whose
doc_id is null neither remove nor lose words. The operator's columns win over clashing ones.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm import common as c

WINDOW, PERIOD = 13, 7
#: Blocks, and buckets, for each of spark.sql.shuffle.partitions; there are more where they would hold more bytes of text.
#: A block sends a row to each bucket.
BLOCKS_EACH, BUCKETS_EACH = 4, 0.5
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in product(range(1, period), repeat=size - 1):
            cover = [0, *rest]
            if list(rest) == sorted(set(rest)) and len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return [0]


COVER = difference_cover(PERIOD)


def _anchors(w: c.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all documents."""
    size = WINDOW - PERIOD + 1
    place = np.arange(len(w.codes)) - np.repeat(w.off[:-1], np.diff(w.off))
    at = np.flatnonzero(w.windows(size) & np.isin(place % PERIOD, COVER)[: max(len(w.codes) - size + 1, 0)])
    return at, c.rolling(h, size)[at]


#: Bytes of a text's digest.
DIGEST = 16
_COLUMNS = "bucket int, block int, kind int, a binary, b binary, c binary"
_EMPTY = np.zeros(0, np.uint64)


def _parts(block: pa.Table, limit: int = 1 << 20):
    for batch in block.combine_chunks().to_batches():
        yield from c.slices(batch, "_text", limit)


def _read(t: pa.Table, kind: int, column: str, dtype: type) -> np.ndarray:
    rows = [x for x, k in zip(t.column(column).to_pylist(), t.column("kind").to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(rows), dtype)


def _copies(t: pa.Table) -> set[tuple[int, bytes]]:
    """(doc_id, digest) of the block's copies of an earlier whole text."""
    ids, digests = _read(t, _COPIES, "a", np.int64).tolist(), _read(t, _COPIES, "b", np.uint8).reshape(-1, DIGEST)
    return set(zip(ids, (x.tobytes() for x in digests), strict=True))


def _judged(part: pa.RecordBatch, copies: set[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id or 0, whether the row takes part, whether it is a copy of an earlier whole text): rows without id do not."""
    ids = part.column("_id")
    own, known = np.asarray(pc.fill_null(ids, 0)).astype(np.int64), np.asarray(ids.is_valid())
    copy = np.zeros(len(own), bool)
    if copies:
        copy[:] = [x in copies for x in zip(own.tolist(), part.column("_x").to_pylist(), strict=True)]
    copy &= known
    return own, known & ~copy, copy


def _rows(block: int | None, bucket: np.ndarray, kind: int, *columns: np.ndarray) -> pa.Table:
    """A row for each bucket (rising) with its part of the columns, as bytes."""
    full = np.unique(bucket)
    lo, hi = np.searchsorted(bucket, full), np.searchsorted(bucket, full, side="right")
    cols = [c.blobs([x[p:q].tobytes() for p, q in zip(lo, hi, strict=True)]) for x in columns]
    cols += [pa.nulls(len(full), pa.binary())] * (3 - len(cols))
    ints = [pa.array(full.astype(np.int32)), pa.array([block] * len(full), pa.int32()), pa.array([kind] * len(full), pa.int32())]
    return pa.table([*ints, *cols], names=["bucket", "block", "kind", "a", "b", "c"])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the upper bits: rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: What a row of bytes holds.
_COPIES, _ANCHORS, _WINDOWS = 0, 1, 2


def _send_anchors(buckets: int):
    def run(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        copies, hashes, owners = _copies(told), [_EMPTY], [np.zeros(0, np.int64)]
        for part in _parts(block):
            w = c.split_words(c.texts_of(part.column("_text")))
            own, on, _ = _judged(part, copies)
            at, h = _anchors(w, w.hashes())
            doc = w.doc()[at]
            h, own = h[on[doc]], own[doc[on[doc]]]
            hashes.append(h)
            owners.append(own)
        h, own = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h, own = h[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        many = (np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
        h = h[first]
        return _rows(key[0].as_py(), _bucket(h, buckets), _ANCHORS, h, many)

    return run


def _shared_anchors(t: pa.Table) -> pa.Table:
    """For each block the anchors of one bucket that it shares with another, or that two of its documents share."""
    parts = [np.frombuffer(x, np.uint64) for x in t.column("a").to_pylist()]
    h, own = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h, own, shared = h[order], own[order], np.frombuffer(b"".join(t.column("b").to_pylist()), np.uint8)[order].astype(bool)
    same = h[1:] == h[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    h, own = h[shared], own[shared]
    order = np.argsort(own, kind="stable")
    out = _rows(None, own[order], _ANCHORS, h[order])
    return out.set_column(1, "block", t.column("block").combine_chunks().take(out.column("bucket").combine_chunks()))


def _hits(w: c.Words, h: np.ndarray, on: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the whole windows that hold a shared anchor, of documents that take part."""
    at, a = _anchors(w, h)
    near = np.searchsorted(shared, a)
    doc = w.doc()
    at = at[(shared[np.minimum(near, len(shared) - 1)] == a) & on[doc[at]]] if len(shared) else at[:0]
    ok = w.windows(WINDOW)
    mark = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(mark, np.maximum(at - PERIOD + 1, w.off[doc[at]]), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero((np.cumsum(mark)[: len(ok)] > 0) & ok)


def _send_windows(buckets: int):
    def run(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        copies, shared, out = _copies(told), np.unique(_read(told, _ANCHORS, "a", np.uint64)), []
        for part in _parts(block) if len(shared) else ():
            w = c.split_words(c.texts_of(part.column("_text")))
            own, on, _ = _judged(part, copies)
            h = w.hashes()
            hit = _hits(w, h, on, shared)
            if len(hit):
                out.append((c.rolling(h, WINDOW)[hit], c.rolling(w.hashes(1), WINDOW, 1)[hit], own[w.doc()[hit]]))
        h1, h2, own = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (_EMPTY, _EMPTY, np.zeros(0, np.int64))
        order = np.lexsort((own, h2, h1))
        h1, h2, own = h1[order], h2[order], own[order]
        if len(h1):
            first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            h1, h2, own = h1[first], h2[first], own[first]
        return _rows(key[0].as_py(), _bucket(h1, buckets), _WINDOWS, h1, h2, own)

    return run


def _earlier_windows(t: pa.Table) -> pa.Table:
    """For each block those of its windows in one bucket that start in a document with a smaller doc_id than any of the block's."""
    n = [len(x) // 8 for x in t.column("a").to_pylist()]
    h1, h2, own = (np.frombuffer(b"".join(t.column(x).to_pylist()), kind) for x, kind in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
    block = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((own, h2, h1))
    h1, h2, own, block = h1[order], h2[order], own[order], block[order]
    first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)
    least = np.repeat(own[first], np.diff(np.append(first, len(h1))))
    late = own > least
    h1, h2, block = h1[late], h2[late], block[late]
    order = np.argsort(block, kind="stable")
    out = _rows(None, block[order], _WINDOWS, h1[order], h2[order])
    return out.set_column(1, "block", t.column("block").combine_chunks().take(out.column("bucket").combine_chunks()))


def _remove(kept: list[str], text: str):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        copies = _copies(told)
        late = np.stack([_read(told, _WINDOWS, "a", np.uint64), _read(told, _WINDOWS, "b", np.uint64)])
        late = late[:, np.argsort(late[0], kind="stable")]
        # windows of this block that one of its own documents has before another, and those that are told
        seen, kept_parts = [], []
        for part in _parts(block):
            w = c.split_words(c.texts_of(part.column("_text")))
            own, on, copy = _judged(part, copies)
            at = np.flatnonzero(w.windows(WINDOW))
            at = at[on[w.doc()[at]]]
            seen.append((c.rolling(w.hashes(), WINDOW)[at], c.rolling(w.hashes(1), WINDOW, 1)[at], own[w.doc()[at]]))
            kept_parts.append((part, w, copy, at))
        h1, h2, own = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (_EMPTY, _EMPTY, np.zeros(0, np.int64))
        seen.clear()
        gone = np.zeros(len(h1), bool)
        if len(h1):
            order = np.argsort(h1, kind="stable")
            near = h1[order]
            twin = np.zeros(len(h1), bool)
            twin[1:] = near[1:] == near[:-1]
            twin[:-1] |= twin[1:]
            some = order[twin]  # only windows whose first hash comes twice need a full sort
            some = some[np.lexsort((own[some], h2[some], h1[some]))]
            if len(some):
                a, b, o = h1[some], h2[some], own[some]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                gone[some] = o > np.repeat(o[first], np.diff(np.append(first, len(a))))
            if late.shape[1]:
                lo = np.searchsorted(late[0], h1)
                hit = np.flatnonzero(late[0][np.minimum(lo, late.shape[1] - 1)] == h1)
                for step in range(8):  # windows with one first hash and another second are next to none
                    k = lo[hit] + step
                    ok = k < late.shape[1]
                    hit, k = hit[ok], k[ok]
                    same = late[0][k] == h1[hit]
                    gone[hit[same & (late[1][k] == h2[hit])]] = True
                    hit = hit[same]
        done, out = 0, []
        for part, w, copy, at in kept_parts:
            n = np.diff(w.off)
            mark = np.zeros(len(w.codes) + 1, np.int64)
            start = at[gone[done : done + len(at)]]
            done += len(at)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + WINDOW, -1)
            off = np.cumsum(mark)[:-1] > 0
            off |= np.repeat(copy & (n >= WINDOW), n)
            words = w.dictionary.take(pa.array(w.codes[~off]))
            bounds = np.concatenate([[0], np.cumsum(~off)])[w.off]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")
            out.append(pa.RecordBatch.from_arrays([*(part.column("_text" if x == text else f"_c{i}") for i, x in enumerate(kept)), pa.array(n.astype(np.int64)), pa.array(c.segment_sum(off.astype(np.int64), w.off)), joined], names=[*kept, "n_words", "n_removed", "kept_text"]))
        return pa.Table.from_batches(out) if out else pa.table({})

    return run


def copies_of(docs: DataFrame) -> DataFrame:
    """(_id, _block, _x) of (_id, _x, _block): rows whose whole text an earlier row has."""
    ids = c.materialize(docs.where(F.col("_x").isNotNull()).select("_id", "_block", "_x"))
    first = c.materialize(ids.groupBy("_x").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last"))
    return c.materialize(ids.join(first, "_x").where("_id > _first").select("_id", "_block", "_x"))


def _pack_ids(batches):
    """The ids and digests of each block among the rows of a task, as bytes."""
    for b in batches:
        block, ids = np.asarray(b.column("_block")), np.asarray(b.column("_id"))
        digests = np.frombuffer(b"".join(b.column("_x").to_pylist()), np.uint8).reshape(-1, DIGEST)
        order = np.argsort(block, kind="stable")
        out = _rows(None, block[order].astype(np.int64), _COPIES, ids[order], digests[order])
        yield from out.set_column(1, "block", out.column("bucket")).to_batches()


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; all: None) with n_words, n_removed and kept_text, the kept words joined by a space."""
    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("n_words", "n_removed", "kept_text")]
    n, size = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), c.text_bytes(docs, text)
    block = F.pmod(F.xxhash64(doc_id, text), F.lit(max(n * BLOCKS_EACH, -(-size // BLOCK_BYTES)))).cast("int")
    n = max(1, int(n * BUCKETS_EACH), -(-size // BUCKET_BYTES))
    long = F.col(doc_id).isNotNull() & (F.length(text) > 2 * WINDOW - 2)  # a window has as many characters
    digest_ = F.when(long, F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, DIGEST))
    blocks = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), digest_.alias("_x"), block.alias("_block"), *(F.col(x).alias(f"_c{i}") for i, x in enumerate(kept) if x != text))
    copies = c.materialize(copies_of(blocks).mapInArrow(_pack_ids, _COLUMNS))
    by = blocks.groupBy("_block")
    told = lambda *more: _union(copies, *more).groupBy("block")
    shared = by.cogroup(told()).applyInArrow(c.tidy(_send_anchors(n)), _COLUMNS).groupBy("bucket").applyInArrow(c.tidy(_shared_anchors), _COLUMNS)
    late = by.cogroup(told(shared)).applyInArrow(c.tidy(_send_windows(n)), _COLUMNS).groupBy("bucket").applyInArrow(c.tidy(_earlier_windows), _COLUMNS)
    fields = [*docs.select(*kept).schema, c.field("n_words", "long"), c.field("n_removed", "long"), c.field("kept_text", "string")]
    return by.cogroup(told(late)).applyInArrow(c.tidy(_remove(kept, text)), T.StructType(fields))


def _union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for x in more:
        first = first.unionByName(x)
    return first


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """For tests: the same result from a dictionary of all windows."""
    words = {i: (t or "").encode().split() for i, t in rows}
    least: dict[tuple, int] = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        text = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(text).hexdigest())
    return out
