"""Language-model scores by a probabilistic suffix tree over words.

A text is its lower-cased words (A-Z only) and one end; what is before its first word is an end too.
Every training word is a symbol. A context is the symbols before a symbol, up to DEPTH of them and not
beyond the text. A context s is a state if, over the symbols w that came after it at least twice, its
own estimate (c - 1) / n diverges from that of the next shorter context s':

    sum of c ln(((c - 1) / n) / (c' / n')) + (n - sum of c) ln(1 - sum of (c - 1) / n)  >=  GAIN for each such w

where c and n are the counts of s w and s, and c', n' those of s' w and s' (for a shortest s: of w, and
of all tokens). One is taken off every count, so that what was seen once proves nothing (leaving one
out). A symbol's probability is smoothed along the states that are suffixes of what is before it,
shortest first: P = (c - 1) / n + (1 - sum of (c - 1) / n) P', beginning with the base's (c + 1) / (N +
V + 1), in which all unseen words are one class. Each distribution sums to one. There is no cap on
states and no share that a symbol or context must have: the tree grows with the corpus.

Counts are exact and of all training documents. Only sequences of words that come twice matter, and
those of n + 1 words only where both sequences of n come twice, so that the levels are counted one
after another. The documents are coded once, in slices of some megabytes; a slice sends each distinct
sequence once, as sorted hashes packed in bytes, to the bucket of its upper bits, and gets the total
counts back in the same order. Of each sequence one slice is the owner and adds its terms of the
divergence to the context's bucket, which answers whether the context is a state. The tree is a table
that is dealt by the hashes of its contexts; nothing of it comes to the driver, which has three sums.
A hot word, line or copied text is one entry a slice. Words and sequences are told apart by 64 bits
(XXH3 of words, joined).

Null and empty texts have the end alone. A table without training rows gives N = 0 and scores of 0 for
words, which are all unseen. Rows with null doc_id are training rows. Repeated rows count each time.
Other columns of the input do not go to the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common as c

DEPTH, GAIN, GRAIN = 3, 2.0, 2.0**-20
#: Bytes of text in a slice, and for which there is a bucket.
SLICE_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: The hash of an end.
END = c.seeds(1, 77)[0]
_CODED = "slice long, n int, n_codes int, n_words int, ids binary, known binary, train binary, codes binary, words binary"
_ROWS = "bucket int, slice long, kind int, n int, a binary, b binary"
#: A message about sequences of n words has kind n, one about contexts of d words kind STATES + d.
STATES = 100


# --- bytes ------------------------------------------------------------------------------------


_ZSTD = {level: pa.Codec("zstd", level) for level in (1, 3)}


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Numbers of 4 or 8 bytes as compressed planes of bytes, small where the numbers are."""
    wide = columns[0].itemsize
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), wide).T.tobytes() for x in columns)
    return len(raw).to_bytes(8, "little") + _ZSTD[level].compress(raw, asbytes=True)


def unpack(data: bytes, n: int, dtype: type = np.int64) -> list[np.ndarray]:
    """The columns of n numbers each."""
    size, wide = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not size:
        return []
    planes = np.frombuffer(_ZSTD[1].decompress(memoryview(data)[8:], size), np.uint8).reshape(-1, wide, n)
    return [np.ascontiguousarray(planes[i].T).reshape(-1).view(dtype) for i in range(len(planes))]


def _steps(h: np.ndarray) -> np.ndarray:
    """Rising hashes as differences."""
    return np.diff(h, prepend=np.uint64(0))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values rising, the place of each value among them, a place where each occurs)."""
    order = np.argsort(h)
    near = h[order]
    new = np.concatenate([[True], near[1:] != near[:-1]]) if len(h) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return near[new], back, order[new]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the upper bits: rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _messages(where: int, kind: int, buckets: int, h: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each bucket with its part of the rising hashes (a) and of what goes with them (b)."""
    at = _bucket(h, buckets)
    full = np.unique(at)
    cuts = list(zip(np.searchsorted(at, full), np.searchsorted(at, full, side="right"), strict=True))
    a, b = [pack(_steps(h[p:q])) for p, q in cuts], [pack(*(x[p:q] for x in columns)) for p, q in cuts]
    ints = [pa.array(full.astype(np.int32)), pa.array([where] * len(full), pa.int64()), pa.array([kind] * len(full), pa.int32())]
    ints.append(pa.array([q - p for p, q in cuts], pa.int32()))
    return pa.table([*ints, c.blobs(a), c.blobs(b)], names=["bucket", "slice", "kind", "n", "a", "b"])


# --- slices -----------------------------------------------------------------------------------


def code(docs: DataFrame, doc_id: str, text: str, modulus: int, remainder: int) -> DataFrame:
    """A row for each slice: doc_ids, which are known, which train, words by their places among the distinct hashes (0: an end)."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), (~held).alias("train"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small parts of a task's rows put together."""
        kept, size = [], 0
        for batch in batches:
            for part in c.slices(batch, "text", SLICE_BYTES):
                n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if kept and size + n > SLICE_BYTES:
                    yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                    kept, size = [], 0
                kept.append(part)
                size += n
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(whole(batches)):
            w = c.split_words(c.texts_of(part.column("text"), lower=True))
            own, _, place = _distinct(c.hash_strings(w.dictionary))
            rank = np.empty(len(w.dictionary), np.int64)
            rank[place] = np.arange(1, len(place) + 1)
            n = np.diff(w.off)
            codes = np.zeros(len(w.codes) + len(n), np.uint32)  # words of a text, then an end
            if len(w.codes):
                codes[np.arange(len(w.codes)) + w.doc()] = rank[w.codes]
            ids = part.column("id")
            known, train = np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(part.column("train")).astype(np.uint8)
            blobs = [pack(np.asarray(pc.fill_null(ids, 0)).astype(np.int64)), known.tobytes(), train.tobytes(), pack(codes, level=3), pack(_steps(own))]
            where = (part.column("part")[0].as_py() << 32) + k
            sizes = [pa.array([x], pa.int32()) for x in (len(n), len(codes), len(own))]
            yield pa.RecordBatch.from_arrays([pa.array([where], pa.int64()), *sizes, *(c.blobs([x]) for x in blobs)], names=[x.split()[0] for x in _CODED.split(", ")])
            del w, codes, own, blobs
        c.release()

    return rows.mapInArrow(run, _CODED)


@dataclass
class Level:
    """The sequences of n symbols that a slice knows of."""

    own: np.ndarray  # their hashes; rising, but for an end before the words
    which: np.ndarray  # at each place the number of the one that ends there, or -1
    total: np.ndarray  # their counts; 0 for one that comes once, but for words
    first: np.ndarray  # a place of each
    mine: np.ndarray  # whether this slice owns it
    goes_on: np.ndarray  # whether a symbol may follow

    def counts(self) -> np.ndarray:
        """The count at each place."""
        return np.append(self.total, 0)[self.which]


class Slice:
    """The texts of a slice as symbols: an end, the words and an end of each, and the counts that are known of them."""

    def __init__(self, row: dict, told: list[dict], ends: int):
        self.where, n = row["slice"], row["n"]
        self.ids, self.known = unpack(row["ids"], n)[0], np.frombuffer(row["known"], np.uint8).astype(bool)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        codes = unpack(row["codes"], row["n_codes"], np.uint32)[0].astype(np.int32)
        self.words = np.cumsum(unpack(row["words"], row["n_words"], np.uint64)[0], dtype=np.uint64) if row["n_words"] else np.zeros(0, np.uint64)
        after = np.flatnonzero(codes == 0)  # the last symbol of each text
        self.n_tokens = np.diff(np.concatenate([[-1], after]))
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.n_tokens + 1)
        first = (np.concatenate([[0], np.cumsum(self.n_tokens + 1)])[:-1]).astype(np.int32)
        self.place = np.arange(len(self.doc), dtype=np.int32) - first[self.doc]
        self.codes = np.zeros(len(self.doc), np.int32)
        self.codes[self.place > 0] = codes
        self.told: dict[int, list[dict]] = {}
        for x in sorted(told, key=lambda x: x["bucket"]):
            self.told.setdefault(x["kind"], []).append(x)
        self.ends = ends
        self.h = np.concatenate([[END], self.words])[self.codes]
        self.levels: dict[int, Level] = {}

    def answer(self, kind: int, n: int) -> list[np.ndarray]:
        """The columns that the buckets gave back for the n hashes that were sent."""
        parts = [unpack(x["a"], x["n"]) for x in self.told.get(kind, [])]
        out = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []
        if any(len(x) != n for x in out) or (n and not out):
            raise ValueError(f"{n} hashes sent, {[len(x) for x in out]} answers of kind {kind}")
        return out

    def candidates(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where n symbols end whose first and last n - 1 come twice: (places, distinct hashes, place among them, a place of each)."""
        before = self.level(n - 1).counts() >= 2
        at = np.flatnonzero((self.place >= n - 1) & before)
        at = at[before[at - 1]]
        own, back, first = _distinct(c.rolling(self.h, n)[at - n + 1] if len(at) else np.zeros(0, np.uint64))
        return at, own, back, at[first]

    def level(self, n: int) -> Level:
        """What is known of the sequences of n symbols."""
        if n not in self.levels:
            if n == 1:
                got = self.answer(1, len(self.words)) or [np.zeros(0, np.int64)]
                total = np.concatenate([[self.ends], got[0]])  # an end counts as often as there are training texts
                self.levels[1] = Level(np.concatenate([[END], self.words]), self.codes, total, np.zeros(0, np.int64), np.zeros(0, bool), np.ones(len(total), bool))
            else:
                at, own, back, first = self.candidates(n)
                got = self.answer(n, len(own)) or [np.zeros(0, np.int64)] * 2
                which = np.full(len(self.codes), -1, np.int32)
                which[at] = back
                self.levels[n] = Level(own, which, got[0], first, got[1].astype(bool), self.codes[first] != 0)
        return self.levels[n]

    def sequences(self, n: int, buckets: int) -> pa.Table:
        """What is to be counted: the distinct sequences of n symbols with how often they are in training texts here."""
        if n == 1:
            own = np.bincount(self.codes, self.train[self.doc], len(self.words) + 1)[1:].astype(np.int64)
            return _messages(self.where, n, buckets, self.words, own)
        at, own, back, _ = self.candidates(n)
        return _messages(self.where, n, buckets, own, np.bincount(back, self.train[self.doc[at]], len(own)).astype(np.int64))

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the sequences of d symbols that are contexts, by rising hash; for each sequence its place among these)."""
        level = self.level(d)
        some = np.flatnonzero((level.total >= 2) & level.goes_on)
        if d == 1:
            some = some[np.argsort(level.own[some])]
        slot = np.full(len(level.own) + 1, -1, np.int32)  # the last one for places without a sequence
        slot[some] = np.arange(len(some))
        return some, slot

    def divergences(self, d: int, total: int, buckets: int) -> pa.Table:
        """The contexts of d symbols, their counts, and the terms of the sequences that this slice owns."""
        some, slot = self.contexts(d)
        level, longer = self.level(d), self.level(d + 1)
        mine = longer.mine & (longer.total >= 2)
        first, count = longer.first[mine], longer.total[mine]
        k = slot[level.which[first - 1]]
        n = level.total[level.which[first - 1]]
        below = level.total[level.which[first]] / (self.level(d - 1).total[self.level(d - 1).which[first - 1]] if d > 1 else total)
        gain = count * np.log((count - 1) / n / below)
        sums = [np.bincount(k, x, len(some)).astype(np.int64) for x in (count - 1, count, np.ones(len(k)))]
        # whoever has a term also tells the context's count; terms are sent in units of GRAIN, so that their order does not matter
        n = np.where(sums[2] > 0, level.total[some], 0)
        return _messages(self.where, STATES + d, buckets, level.own[some], n, *sums, np.rint(np.bincount(k, gain, len(some)) / GRAIN).astype(np.int64))

    def scores(self, depth: int, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of the base and of the tree at each place, how many symbols the state there has)."""
        base = (self.level(1).counts() + 1) / (total + kinds + 1)
        p, used = base.copy(), np.zeros(len(base), np.int8)
        for d in range(1, depth + 1):
            some, _ = self.contexts(d)
            got = self.answer(STATES + d, len(some))
            if not got:
                break
            level, longer = self.level(d), self.level(d + 1)
            taken = np.zeros(len(level.own) + 1, np.int64)  # sum of (c - 1); 0 where the context is no state
            taken[some] = got[0]
            taken = np.concatenate([[0], taken[level.which[:-1]]])
            at = np.flatnonzero((taken > 0) & (self.place >= d))
            n = level.total[level.which[at - 1]]
            p[at] = np.maximum(longer.counts()[at] - 1, 0) / n + (1 - taken[at] / n) * p[at]
            used[at] = d
        return np.log10(base), np.log10(p), used


# --- buckets ----------------------------------------------------------------------------------


def _gather(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(slice of each entry as its number, hashes, columns) of rows."""
    n = [x["n"] for x in rows]
    h = np.concatenate([np.cumsum(unpack(x["a"], k, np.uint64)[0], dtype=np.uint64) for x, k in zip(rows, n, strict=True)])
    columns = [np.concatenate(y) for y in zip(*(unpack(x["b"], k) for x, k in zip(rows, n, strict=True)), strict=True)]
    return np.repeat(np.arange(len(rows)), n), h, columns


def _told(rows: list[dict], own: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """The columns given back to each row's slice."""
    cuts = np.searchsorted(own, np.arange(len(rows) + 1))
    out = [pack(*(x[p:q] for x in columns)) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
    ints = [pa.array([x[k] for x in rows], t) for k, t in (("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()))]
    return pa.table([*ints, c.blobs(out), pa.nulls(len(rows), pa.binary())], names=["bucket", "slice", "kind", "n", "a", "b"])


def _answer(t: pa.Table) -> pa.Table:
    """Total counts of sequences, and who owns them; of contexts the sum of their counts less one, if they are states."""
    out = []
    by: dict[int, list[dict]] = {}
    for x in t.to_pylist():
        by.setdefault(x["kind"], []).append(x)
    for kind, rows in sorted(by.items()):
        rows.sort(key=lambda x: x["slice"])
        own, h, columns = _gather(rows)
        distinct, back, _ = _distinct(h)
        if kind < STATES:
            total = np.bincount(back, columns[0], len(distinct)).astype(np.int64)
            if kind == 1:
                out.append(_told(rows, own, total[back]))
                known = total[total > 0]
                sums = pack(np.array([known.sum(), len(known)]))
                out.append(pa.table([[-1], [-1], [0], [2], [sums], [b""]], names=out[-1].column_names).cast(out[-1].schema))
                continue
            total[total < 2] = 0
            least = np.full(len(distinct), len(rows))
            np.minimum.at(least, back, own)
            out.append(_told(rows, own, total[back], (least[back] == own).astype(np.int64)))
            continue
        n = np.ones(len(distinct), np.int64)
        np.maximum.at(n, back, columns[0])
        less, some, kinds = (np.bincount(back, x, len(distinct)) for x in columns[1:4])
        gain = np.bincount(back, columns[4], len(distinct)) * GRAIN + (n - some) * np.log1p(-less / n)
        out.append(_told(rows, own, np.where((kinds > 0) & (gain >= GAIN * kinds), less, 0).astype(np.int64)[back]))
    return pa.concat_tables(out)


# --- the operator -----------------------------------------------------------------------------


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_context (tokens scored in a state) of each document.

    Documents whose CRC-32 of the doc_id as text has the remainder are held out, the others train.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(n, -(-c.text_bytes(docs, text) // BUCKET_BYTES))
    coded = c.materialize(code(docs, doc_id, text, modulus, remainder))
    answers: list[DataFrame] = []

    def ask(make, ends: int = 0) -> DataFrame:
        """The buckets' answers to what make(slice) sends, written."""
        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            got = told.to_pylist()
            return pa.concat_tables([make(Slice(x, got, ends)) for x in rows.to_pylist()] or [_messages(0, 0, 1, np.zeros(0, np.uint64))])

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.to_pylist():
                    yield from make(Slice(x, [], ends)).to_batches()
            c.release()

        if answers:
            sent = coded.groupBy("slice").cogroup(_union(answers).groupBy("slice")).applyInArrow(c.tidy(run), _ROWS)
        else:
            sent = coded.mapInArrow(alone, _ROWS)
        out = c.materialize(sent.groupBy("bucket").applyInArrow(c.tidy(_answer), _ROWS))
        c.forget(coded.sparkSession)
        return out

    words = ask(lambda s: s.sequences(1, buckets))
    answers.append(words.where("slice >= 0"))

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in b.column("train").to_pylist()], pa.int64())], names=["n"])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = [unpack(x, 2)[0] for x in b.column("a").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in two], pa.int64()) for i in range(2)], names=["n", "v"])

    ends = coded.select("train").mapInArrow(ends_of, "n long").agg(F.sum("n")).first()[0] or 0
    n_words, n_kinds = (x or 0 for x in words.where("slice < 0").select("a").mapInArrow(sums_of, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    total, kinds = n_words + ends, n_kinds + (ends > 0)
    for level in range(2, depth + 3):
        # sequences of `level` symbols, and the divergence of contexts whose sequences are counted
        jobs = [lambda s, k=level: s.sequences(k, buckets)] if level <= depth + 1 else []
        jobs += [lambda s, k=level - 2: s.divergences(k, total, buckets)] if level > 2 else []
        answers.append(ask(lambda s, jobs=tuple(jobs): pa.concat_tables([j(s) for j in jobs]), ends))
    base_end = float(np.log10((ends + 1) / (total + kinds + 1)))

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out, got = [], told.to_pylist()
        for x in rows.to_pylist():
            s = Slice(x, got, ends)
            base, p, used = s.scores(depth, total, kinds)
            inner = s.place > 0
            sums = [np.bincount(s.doc[inner], y[inner], len(s.ids)) for y in (s.level(1).counts() > 0, base, p, used > 0)]
            columns = [pa.array(s.ids, mask=~s.known), pa.array(~s.train), pa.array(s.n_tokens.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(s.ids), total, np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[3].astype(np.int64))]
            out.append(pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_context"]))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_context long"
    return coded.groupBy("slice").cogroup(_union(answers).groupBy("slice")).applyInArrow(c.tidy(run), schema)


def _union(answers: list[DataFrame]) -> DataFrame:
    """The answers of all levels so far."""
    out = answers[0]
    for x in answers[1:]:
        out = out.unionByName(x)
    return out
