"""Encoding with a merge-type piece vocabulary, exactly, by backtracking.

A text is encoded left to right: of the vocabulary's pieces that match here (found by an
Aho-Corasick automaton) the longest is taken, if it may follow the piece before. Two pieces may be
neighbours if merging their joined text from its characters gives just these two again; a known
theorem says that a sequence of pieces all of whose neighbours are so is the one that merging
makes. A place from which no sequence was found is marked in a bitfield and never tried again, so
that work is bounded by the text's length times the pieces that match at a place.

No piece has a space mark after another character, and some characters are in no piece; a text is
cut there, and the encoding of a part is kept for when it comes again. Null text counts as empty
and has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm import common as c

SPACE = "▁"
#: Parts whose encoding a worker keeps: the first it meets, which has the frequent ones among them.
KEPT_PARTS = 600_000


class PieceModel:
    """Pieces with scores, as a sentencepiece file of type BPE has them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.id = {pieces[i]: i for i in plain}
        self.pieces = pieces
        self.byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes_of = [b"" if sp.is_control(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.prefix = bool(probe := sp.encode("a", out_type=str)) and probe[0].startswith(SPACE)
        self.chars = {p for p in self.id if len(p) == 1}
        if missing := {x for p in self.id for x in p} - self.chars:
            raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
        self.pair: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if self.merge(p) == [p]:  # others cannot come of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: The longest piece that a piece starts with, itself left out.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), None) for p in self.id if p in self.automaton}
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.line = "\n" not in self.chars
        self.parts = re.compile((f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.line else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if cut else r"(?s:.+)").findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a text by merging: the best-scored neighbours first, of equals the leftmost."""
        part: list[str | None] = list(text)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            offer(before[i], i)
        return [x for x in part if x is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        if (yes := self.pair.get((a, b))) is None:
            if len(self.pair) > KEPT_PARTS:
                self.pair.clear()
            yes = self.pair[a, b] = self.merge(a + b) == [a, b]
        return yes

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):  # of one start: ends rise, so the longest comes last
            longest[end + 1 - len(piece)] = piece
        if len(longest[0]) == n:
            return [longest[0]]
        shorter, known, compatible = self.shorter, self.pair.get, self.compatible
        failed: bytearray | None = None
        out, pos, piece = [], 0, longest[0]
        while pos < n:
            before = out[-1] if out else None
            while piece is not None:
                end = pos + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if before is None:
                        break
                    if (yes := known((before, piece))) is None:
                        yes = compatible(before, piece)
                    if yes:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                pos = end
                piece = longest[pos] if pos < n else None
            else:
                # Nothing fits here. The encoding of what lies before is one only, so that this holds for
                # whatever is tried later: mark the place and try a shorter piece before it.
                if not out:
                    return self.merge(text)
                failed = failed or bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                piece = shorter[piece]
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """The ids of a part of a text, with spaces as marks; characters in no piece become their bytes."""
        if self.chars.issuperset(part):
            return (self.id[part],) if part in self.automaton else tuple([self.id[p] for p in self.backtrack(part)])
        ids: list[int] = []
        run = ""
        for x in [*part, ""]:
            if x in self.chars:
                run += x
                continue
            if run and run in self.automaton:
                ids.append(self.id[run])
            elif run:
                ids += [self.id[p] for p in self.backtrack(run)]
            run = ""
            if x:
                ids += [self.byte[b] for b in x.encode()] if self.byte else [self.unknown]
        return tuple(ids)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.parts((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        out: list[int] = []
        for part in self.split(text):
            if (ids := self.known.get(part)) is None:
                ids = self.encode_part(part)
                if len(self.known) < KEPT_PARTS:
                    self.known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in ids])
        if self.prefix and ids and not self.is_byte[ids[0]] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `ids`, an array of each whole text's ids."""
    def make(texts):
        m = model(path)
        return [pa.array([m.encode(t) for t in c.texts_of(texts).to_pylist()], pa.list_(pa.int32()))]

    return c.add_columns(docs, text, make, [c.field("ids", "array<int>")], keep, 1 << 20)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of each array of ids (null: empty)."""
    def run(batches):
        m = model(path)
        for b in batches:
            out = pa.array([m.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            kept = [x for x in b.schema.names if x != "decoded"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), out], names=[*kept, "decoded"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema if f.name != "decoded"), c.field("decoded", "string")]))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, so that ids need not leave the worker."""
    def make(texts):
        m = model(path)
        decimal = [str(i) for i in range(len(m.pieces))]
        n, ids_sha, text_sha = [], [], []
        for t in c.texts_of(texts).to_pylist():
            ids = m.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return c.add_columns(docs, text, make, [c.field("n_tokens", "long"), c.field("ids_sha256", "string"), c.field("decoded_sha256", "string")], keep, 1 << 20)
