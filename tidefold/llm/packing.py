"""Packing of token sequences as a cutting-stock problem, solved by column generation.

Texts become ids; a document longer than a sequence is cut into whole sequences and a rest. Rests
have a length class: lengths up to EXACT are classes of their own, longer ones are rounded up to a
multiple of 8 or 16. The histogram of classes (a few hundred counts, whatever the size of the corpus)
goes to the driver, where a linear program over patterns (how many rests of each class share a
sequence) is solved: a revised simplex holds one pattern a class, and a knapsack dynamic program over
the prices of classes finds the pattern that improves it most. Its patterns are used as often as the
rounded-down solution says; what demand is left, at most some items a class, is packed first-fit
decreasing into patterns of their own.

Documents are ranked within their class, and ranks are dealt to the slots of the patterns, which
fixes sequence and order. Ranks are counted by class and salt, so that a class with a third of all
documents, or one document repeated so often, is ranked by many tasks; each salted group holds about
GROUP rows.

Null and empty texts have one token, the end. Repeated rows are packed as rows of their own. An empty
table gives no rows. Other columns of the input do not go to the output.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold.llm import common as c

CAPACITY = 4096
END_ID = 2
EXACT = 256
#: Rows that are ranked in one group.
GROUP = 128
#: Parts of words whose ids a worker keeps: the first it meets, which has the frequent ones among them.
KEPT_PARTS = 800_000
#: The linear program ends when it is proven to be so near its optimum, or after so many patterns.
GAP, MAX_PATTERNS = 1e-4, 2000


# --- ids --------------------------------------------------------------------------------------


#: What a tokenizer must do before its merges, so that words can be cut into parts here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPECIAL = re.compile(r"<\|\w+\|>")

#: Kinds of bytes, lower-cased: letters (with all of U+00C0 to U+00FF), digits, others; NOT: the tokenizer has to see the whole word.
NOT, LETTER, DIGIT, OTHER = range(4)
_KINDS = np.full(256, NOT, np.uint8)
_KINDS[0x21:0x7F] = OTHER
_KINDS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]] = LETTER
_KINDS[ord("0") : ord("9") + 1] = DIGIT
_KINDS[ord("'")] = NOT


def parts_of(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts, off, plain): the parts of word i are those from off[i] to off[i + 1]; plain are those that are one token run each, in lower case.

    A word of ASCII and of U+00C0 to U+00FF is cut as the tokenizer does: runs of letters, single digits, runs of others. These
    characters are not changed by NFC, and lower case keeps their number of bytes. A word with any other character, an
    apostrophe (which has rules of its own) or what may be a special token is one part, as it is.
    """
    off, raw = c._buffers(words)
    before = np.concatenate([np.zeros(1, np.uint8), raw[:-1]])
    wide = before == 0xC3
    signs = wide & ((raw == 0x97) | (raw == 0xB7))  # multiplication and division
    upper = ((raw >= ord("A")) & (raw <= ord("Z"))) | (wide & (raw >= 0x80) & (raw <= 0x9E) & ~signs)
    low = raw + (upper * np.uint8(32))
    kind = _KINDS[low]
    odd = (kind == NOT) | signs | ((before == ord("<")) & (raw == ord("|")))
    whole = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) > 0
    first = np.zeros(len(raw) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    if whole.any():
        inside = np.repeat(whole, np.diff(off))
        low = np.where(inside, raw, low)
        first[:-1] &= ~inside
    first[off] = True
    begin = np.flatnonzero(first)
    at = np.searchsorted(begin, off)
    parts = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(low))
    return parts, at, np.repeat(~whole, np.diff(at))


class WordIds:
    """The ids of words by themselves; no token of these vocabularies goes over white space.

    Words are cut into parts that the tokenizer would cut them into, so that it sees a part once for all the words that have
    it, in upper and lower case, with and without punctuation. Many parts go to it as one text, since a text costs
    more than a part; the end of a part is told by the suffix of its last token. Other words go to it one by one, and so
    do all words if the tokenizer prepares its texts in another way. The ids of the first KEPT_PARTS
    different parts that a worker meets are kept, as arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.of_parts, self.ends = Tokenizer.from_file(path), None, None
        spec = json.loads(self.tokenizer.to_str())
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        known = spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        if known and end and not model.get("continuing_subword_prefix") and not spec["post_processor"] and all(SPECIAL.fullmatch(x["content"]) for x in spec["added_tokens"]):
            spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
            self.of_parts = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(max(model["vocab"].values()) + 1 + len(spec["added_tokens"]), bool)
            self.ends[[i for x, i in model["vocab"].items() if x.endswith(end)]] = True
        self.parts, self.start, self.n, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, ids = [], []
        for a in range(0, len(words), 4096):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(a, 4096).to_pylist(), add_special_tokens=False)]
            n.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(n[-1].sum())))
        return np.concatenate([np.zeros(0, np.int64), *n]), np.concatenate([np.zeros(0, np.uint32), *ids])

    def _together(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, ids = [], []
        for a in range(0, len(parts), 1024):
            some = parts.slice(a, 1024)
            got = np.array(self.of_parts.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) != len(some) or last[-1] != len(got) - 1:  # a vocabulary without some character or suffix
                many, got = self._one_by_one(some)
            else:
                many = np.diff(last, prepend=-1)
            n.append(many)
            ids.append(got)
        return np.concatenate([np.zeros(0, np.int64), *n]), np.concatenate([np.zeros(0, np.uint32), *ids])

    def _of_parts(self, parts: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number, pool): the ids of each different part are so many from its start in the pool."""
        at = pc.index_in(parts, value_set=self.parts)
        known = np.asarray(at.is_valid())
        where = np.asarray(at.fill_null(0)).astype(np.int64)
        # those that go together first
        new = np.concatenate([np.flatnonzero(~known & plain), np.flatnonzero(~known & ~plain)])
        n_plain = int((~known & plain).sum())
        names = parts.take(pa.array(new))
        (n_a, ids_a), (n_b, ids_b) = self._together(names.slice(0, n_plain)), self._one_by_one(names.slice(n_plain))
        n_new, ids_new = np.concatenate([n_a, n_b]), np.concatenate([ids_a, ids_b])
        start, n = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        start[known], n[known] = self.start[where[known]], self.n[where[known]]
        start_new = len(self.ids) + np.cumsum(n_new) - n_new
        start[new], n[new] = start_new, n_new
        pool = np.concatenate([self.ids, ids_new])
        more = min(len(new), KEPT_PARTS - len(self.parts))
        if more > 0:
            self.parts = pa.concat_arrays([self.parts, names.slice(0, more)])
            self.start, self.n = np.concatenate([self.start, start_new[:more]]), np.concatenate([self.n, n_new[:more]])
            self.ids = np.concatenate([self.ids, ids_new[: int(n_new[:more].sum())]])
        return start, n, pool

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number, pool): the ids of each different word are so many from its start in the pool."""
        words = words.cast(pa.string())
        if self.of_parts is None:
            return self._of_parts(words, np.zeros(len(words), bool))
        parts, off, plain = parts_of(words)
        coded = parts.dictionary_encode()
        code = np.asarray(coded.indices)
        alike = np.zeros(len(coded.dictionary), bool)
        alike[code] = plain  # no part is that of a word and also a whole word: the latter has a character that no part has
        start, n, pool = self._of_parts(coded.dictionary, alike)
        each = n[code]
        total = np.concatenate([[0], np.cumsum(each)])
        return total[off[:-1]], np.diff(total[off]), pool[np.arange(total[-1]) + np.repeat(start[code] - total[:-1], each)]


_word_ids = lru_cache(maxsize=1)(WordIds)


def ids_of_texts(texts: pa.Array, path: str, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of each text (null: empty), with the end id."""
    w = c.split_words(c.texts_of(texts))
    start, each, pool = _word_ids(path).of(w.dictionary)
    n = each[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    bounds = total[w.off]
    out = np.full(total[-1] + len(texts), end, "<u4")
    # where the ids of each word go: behind the ends of the texts before
    shift = np.repeat(np.arange(len(texts)), np.diff(w.off))
    place = np.arange(total[-1])
    from_ = place + np.repeat(start[w.codes] - total[:-1], n) if len(w.codes) else place
    out[place + np.repeat(shift, n)] = pool[from_]
    return bounds + np.arange(len(bounds)), out


def cut(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens."""
    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "_text"):
                off, ids = ids_of_texts(part.column("_text"), path)
                n = np.diff(off)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = off[:-1][doc] + start
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                del ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            c.release()

    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return some.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# --- the linear program -----------------------------------------------------------------------


def length_classes(capacity: int = CAPACITY) -> np.ndarray:
    """The length that each class stands for, rising; a rest has the first class that is not shorter."""
    fine = [*range(1, min(EXACT, capacity) + 1), *range(EXACT + 8, capacity // 4 + 1, 8), *range(max(EXACT, capacity // 4) + 16, capacity + 1, 16)]
    return np.array(sorted({x for x in fine if x <= capacity} | {capacity}))


#: Items of this length or less are priced one by one over all rooms, longer ones all at once over a stretch of rooms.
SHORT = 256


def best_pattern(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: an unbounded knapsack over lengths.

    value[room] is the most that fits. A short item of length s is tried for all rooms of one remainder
    modulo s in a row, as a running maximum; long items cannot follow each other within a stretch shorter
    than the shortest of them, so that such a stretch is one step.
    """
    useful = np.flatnonzero(price > 0)
    size, worth = lengths[useful], price[useful]
    value = np.zeros(capacity + 1)
    for k in np.flatnonzero(size <= SHORT):
        s, w = int(size[k]), worth[k]
        rows = -(-(capacity + 1) // s)
        table = np.full(rows * s, -np.inf)
        table[: capacity + 1] = value
        steps = np.arange(rows)[:, None] * w
        value = (np.maximum.accumulate(table.reshape(rows, s) - steps, 0) + steps).ravel()[: capacity + 1]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        s, w = size[long], worth[long][:, None]
        for a in range(int(s[0]), capacity + 1, int(s[0])):
            rooms = np.arange(a, min(a + int(s[0]), capacity + 1))
            before = rooms - s[:, None]
            got = np.where(before >= 0, value[np.maximum(before, 0)] + w, 0).max(0)
            value[rooms] = np.maximum(value[rooms], got)
            np.maximum.accumulate(value[a:], out=value[a:])
    out, room = np.zeros(len(lengths), np.int64), capacity
    while len(size):  # the items that make up the value, back from the end
        n = np.searchsorted(size, room, side="right")
        got = value[room - size[:n]] + worth[:n]
        k = int(got.argmax()) if n else 0
        if not n or got[k] < value[room] - 1e-9:
            smaller = np.searchsorted(value[: room + 1], value[room] - 1e-9)
            if smaller >= room or value[room] <= 1e-9:
                break
            room = int(smaller)
            continue
        out[useful[k]] += 1
        room -= int(size[k])
    return float((out * price).sum()), out


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A pattern for each class, and fractional uses that meet the demand.

    A pattern takes of what is left the longest items that still fit, and is used until a class is used
    up, and so on. Each pattern has an item of the class that it uses up and none of those used up before,
    so that the patterns are a (triangular) basis.
    """
    k, left = len(lengths), demand.astype(float)
    patterns, uses, alive = np.zeros((k, k), np.int64), np.zeros(k), np.ones(k, bool)
    while alive.any():
        new, room, on = np.zeros(k, np.int64), capacity, np.flatnonzero(alive)
        while True:
            n = np.searchsorted(lengths[on], room, side="right")
            if not n:
                break
            i = on[n - 1]
            new[i] = room // lengths[i]
            room -= int(new[i] * lengths[i])
            on = on[: n - 1]
        here = np.flatnonzero(new)
        share = left[here] / new[here]
        out = int(here[share.argmin()])
        uses[out], patterns[out], alive[out] = share.min(), new, False
        left = np.maximum(left - uses[out] * new, 0)
        left[out] = 0
    return patterns, uses


def inverse_of(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps, without a linear algebra library, whose threads may wait for each other under a JVM."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], 1)
    for i in range(n):
        k = i + int(np.abs(work[i:, i]).argmax())
        if k != i:
            work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i][:, None] * work[i]
    return work[:, n:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses) of a nearly optimal linear program; a pattern is a row of items a class."""
    patterns, x = first_basis(lengths, demand, capacity)
    inverse = inverse_of(patterns.T)  # columns of the basis are patterns
    for _ in range(MAX_PATTERNS):
        price = inverse.sum(0)
        value, new = best_pattern(lengths, price, capacity)
        bound = max((price * demand).sum() / value if value > 0 else 0, (lengths * demand).sum() / capacity)
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + GAP):
            break
        turn = (inverse * new).sum(1)
        ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * turn, 0)
        x[out] = step
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        patterns[out] = new
    return patterns, x


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole uses) that hold exactly the demand, or slots for a little more."""
    has = np.flatnonzero(demand > 0)
    if not len(has):
        return np.zeros((0, len(lengths)), np.int64), np.zeros(0, np.int64)
    some, uses = column_generation(lengths[has], demand[has].astype(float), capacity)
    patterns = np.zeros((len(some), len(lengths)), np.int64)
    patterns[:, has] = some
    uses = np.floor(uses + 1e-9).astype(np.int64)
    patterns, uses = patterns[uses > 0], uses[uses > 0]
    # a use may offer more slots than there are items; that many uses are given back
    for i in np.argsort((patterns * lengths).sum(1)):
        over = patterns.T @ uses - demand
        while uses[i] and (over[patterns[i] > 0] > 0).any():
            uses[i] -= 1
            over -= patterns[i]
    left = demand - patterns.T @ uses
    rest, room = [], []
    for k in range(len(lengths) - 1, -1, -1):
        for _ in range(int(left[k])):
            for b, free in enumerate(room):
                if free >= lengths[k]:
                    break
            else:
                b = len(room)
                room.append(capacity)
                rest.append(np.zeros(len(lengths), np.int64))
            rest[b][k] += 1
            room[b] -= lengths[k]
    if rest:
        patterns, uses = np.concatenate([patterns, np.array(rest)]), np.concatenate([uses, np.ones(len(rest), np.int64)])
    return patterns[uses > 0], uses[uses > 0]


def slots(patterns: np.ndarray, uses: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first rank, items a use, first sequence and place in the pattern, of each pattern that has it."""
    first = np.concatenate([[0], np.cumsum(uses)])[:-1]
    out = []
    for k in range(patterns.shape[1]):
        p = np.flatnonzero(patterns[:, k])
        each = patterns[p, k]
        begin = np.concatenate([[0], np.cumsum(each * uses[p])])[:-1].astype(np.int64)
        out.append((k, begin, each, first[p], patterns[p, k + 1 :].sum(1)))
    return out


# --- the operator -----------------------------------------------------------------------------


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    lengths = length_classes(capacity)
    pieces = c.materialize(cut(docs, path, doc_id, text, capacity).withColumn("_n", F.monotonically_increasing_id()))  # fixed when it is written
    steps = F.array(*(F.lit(int(x)) for x in (EXACT, capacity // 4)))
    rounded = F.when(F.col("length") <= steps[0], F.col("length")).when(F.col("length") <= steps[1], F.ceil(F.col("length") / 8) * 8).otherwise(F.ceil(F.col("length") / 16) * 16).cast("int")
    pieces = pieces.withColumn("_class", F.least(rounded, F.lit(capacity)))

    histogram = {r["_class"]: r["n"] for r in pieces.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # at most len(lengths) rows
    full = histogram.pop(capacity, 0)
    demand = np.array([histogram.get(int(x), 0) for x in lengths], np.int64)
    patterns, uses = plan(lengths, demand, capacity)
    table = {int(lengths[k]): rest for k, *rest in slots(patterns, uses)}
    table[capacity] = [np.zeros(1, np.int64), np.ones(1, np.int64), np.array([uses.sum()]), np.zeros(1, np.int64)]
    most = max([full, *demand.tolist(), 1])
    salts = -(-most // GROUP)

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(salts)))
    counts = salted.groupBy("_class", "_salt").agg(F.count("*").alias("n"))
    before = c.materialize(counts.withColumn("_before", F.sum("n").over(W.partitionBy("_class").orderBy("_salt")) - F.col("n")).drop("n"))
    order = W.partitionBy("_class", "_salt").orderBy("doc_id", "start", "_n")
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1).join(before.hint("merge"), ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row"))

    def run(batches):
        for b in batches:
            kind, rank = np.asarray(b.column("_class")), np.asarray(b.column("_rank"))
            seq, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                begin, each, first, place = table[int(k)]
                at = np.flatnonzero(kind == k)
                p = np.searchsorted(begin, rank[at], side="right") - 1
                use, item = np.divmod(rank[at] - begin[p], each[p])
                seq[at], slot[at] = first[p] + use, place[p] + item
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "_slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_rank").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long")
    up_to = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(up_to) - F.col("length")).drop("_slot")
