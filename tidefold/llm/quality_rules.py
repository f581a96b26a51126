"""Rules on single documents: counts of repeats and symbols, then divergence from a language's usual text.

The histogram of a document's characters by class, and of its common words, are compared with
those of each language by Jensen-Shannon distance (base 2, so 0 to 1). Two passes over the
documents: the first sums the histograms of each language, the second judges. The limit depends on
length: the squared distance that a sample of that size has by chance, and a margin.

Null text counts as empty: all counts 0, base_failed true. Documents too short for a histogram to
mean anything are not judged by it (MIN_CHARS, MIN_WORDS). Every language of MIN_REFERENCE documents
has a reference. A document whose language has none, or that has no language, is not judged by other
languages: only the base rules hold for it, as for all if there is no such column. Repeated rows are judged alike; input columns with the
names of results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common as c

#: Characters whose number is counted.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as by this at from are he or an were his not which but have had they you their",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird für",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other", "beyond")
#: Histograms of fewer characters or words are not judged.
MIN_CHARS, MIN_WORDS = 200, 40
#: Documents that a language needs to be a reference; those with this share of all documents or more go to every task, the others are joined.
MIN_REFERENCE, MIN_SHARE = 20, 0.001
#: Largest distances of a very long document that is kept, of characters and words; what the expected squared distance of a
#: sample of the document's size counts on top: words spread
#: around it, and characters come in words and are far from independent. Chosen on the labels of sf0.1.
MARGIN, SAMPLING = (0.16, 0.2), (20.0, 1.15)
MIN_DOC_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Bytes of text that are measured at once: a number for each byte.
SLICE_BYTES = 2 << 20


def _class_table() -> np.ndarray:
    """The class of each byte; -1 for the later bytes of a character."""
    t = np.full(256, CLASSES.index("other"), np.int64)
    t[0x80:0xC0] = -1
    t[0xC0:] = CLASSES.index("beyond")
    for name, chars in (("space", " \t\n\v\f\r"), ("stop", ".,;:'\"()-"), ("mark", "!?"), ("symbol", SYMBOLS + "@^_~+=/\\{}[]`")):
        t[[ord(x) for x in chars]] = CLASSES.index(name)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    return t


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), [ord(x) for x in SYMBOLS])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_START = ~np.isin(np.arange(256), np.arange(0x80, 0xC0))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, with its histograms `classes` and `words`."""
    a = c.texts_of(texts)
    off, data = c._buffers(a)
    w, n = c.split_words(a), len(a)
    out = {"n_words": np.diff(w.off), "word_chars": c.segment_sum((_START & ~_SPACE)[data].astype(np.int64), off), "n_symbols": c.segment_sum(_SYMBOL[data].astype(np.int64), off)}

    lines = pc.split_pattern(a, "\n")
    line_off = np.asarray(lines.offsets).astype(np.int64)
    coded = lines.values.slice(line_off[0], line_off[-1] - line_off[0]).dictionary_encode()
    worded = np.asarray(pc.match_substring_regex(coded.dictionary, "[^\\x20\\x09-\\x0D]")).astype(bool)
    code, doc = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(n), np.diff(line_off))
    code, doc = code[worded[code]], doc[worded[code]]
    once = np.unique(doc * (len(coded.dictionary) + 1) + code) // (len(coded.dictionary) + 1)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(once, minlength=n)

    doc = w.doc()
    starts = np.flatnonzero(w.windows(WINDOW))
    with np.errstate(over="ignore"):
        key = c.rolling(w.hashes(), WINDOW)[starts] * np.uint64(0x9E3779B97F4A7C15) + c.mix(doc[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = starts[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(starts) else starts
    cover = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = c.segment_sum((np.cumsum(cover)[:-1] > 0).astype(np.int64), w.off)

    kind, k = _CLASS[data], len(CLASSES)
    at = np.repeat(np.arange(n), np.diff(off))[kind >= 0] * k + kind[kind >= 0]
    out["classes"] = np.bincount(at, minlength=n * k).reshape(n, k)
    place = pc.index_in(pc.utf8_lower(pc.utf8_trim(w.dictionary, ".,;:!?\"'()")), pa.array(VOCABULARY))
    place = np.asarray(pc.fill_null(place, len(VOCABULARY))).astype(np.int64)
    v = len(VOCABULARY) + 1
    out["words"] = np.bincount(doc * v + place[w.codes], minlength=n * v).reshape(n, v)
    out["base_failed"] = (out["n_words"] < MIN_DOC_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q, or from its own row of them; 0 where a row of p is empty."""
    total = p.sum(1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
        out = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, 0)


@dataclass
class References:
    """Summed histograms: of the large languages here (name: classes, words), of all others as rows (_lang, _ref)."""

    large: dict[str, tuple[np.ndarray, np.ndarray]]
    small: DataFrame | None


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """(classes, words) summed over the documents of each language that pass the base rules.

    The at most 1 / MIN_SHARE languages that have this share of the documents come to the driver; the others stay a table.
    """
    k, v = len(CLASSES), len(VOCABULARY) + 1

    def make(texts):
        m = measure(texts)
        both = np.concatenate([m["classes"], m["words"]], 1)
        both[m["base_failed"]] = 0
        return [(~m["base_failed"]).astype(np.int64), _lists(both)]

    fields = [c.field("_n", "long"), c.field("_h", "array<long>")]
    if lang not in docs.columns:
        return References({}, None)
    sums = c.add_columns(docs.select(F.col(lang).cast("string").alias("_lang"), text), text, make, fields, ["_lang"], SLICE_BYTES)
    by = sums.where("_n > 0 and _lang is not null").groupBy("_lang").agg(F.sum("_n").alias("_n"), *(F.sum(F.col("_h")[i]).alias(f"h{i}") for i in range(k + v)))
    total = c.materialize(by)
    floor = max(MIN_REFERENCE, MIN_SHARE * (total.agg(F.sum("_n")).first()[0] or 0))
    rows = total.where(F.col("_n") >= floor).orderBy("_lang").collect()
    small = total.where((F.col("_n") >= MIN_REFERENCE) & (F.col("_n") < floor))
    small = c.materialize(small.select("_lang", F.array(*(f"h{i}" for i in range(k + v))).alias("_ref"))) if small.limit(1).count() else None
    return References({r[0]: (np.array(r[2 : 2 + k], float), np.array(r[2 + k :], float)) for r in rows}, small)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


_SIZES = np.unique(np.geomspace(20, 1e6, 80).astype(np.int64)).astype(float)


def sampled(q: np.ndarray) -> np.ndarray:
    """The expected squared distance from q of _SIZES draws from it, with Poisson counts; near 1 / 8 n ln 2 a bin where counts are large."""
    p = q[q > 0] / max(q.sum(), 1)
    x = np.arange(100.0)
    log_factorial = np.concatenate([[0], np.cumsum(np.log(x[1:]))])
    out = []
    for n in _SIZES:
        mean = p * n
        some = mean[mean <= 40]
        weight = np.exp(x * np.log(some)[:, None] - some[:, None] - log_factorial)
        a, b = np.broadcast_to(x, weight.shape), np.broadcast_to(some[:, None], weight.shape)
        m = (a + b) / 2
        gain = np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / m), 0) + b * np.log2(b / m)
        out.append((weight * gain).sum() / (2 * n) + ((1 - p[mean > 40]) / (8 * n * np.log(2))).sum())
    return np.array(out)


def _strange(kind: int, n: np.ndarray, far: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Whether histograms of n characters (kind 0) or words (1) are farther from a reference than samples of their size and the margin."""
    noise = np.interp(np.log(np.maximum(n, 1)), np.log(_SIZES), expected)
    return (n >= (MIN_CHARS, MIN_WORDS)[kind]) & (far**2 > MARGIN[kind] ** 2 + SAMPLING[kind] * noise)


def _judge_by_own(t: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(rows with a reference of their own language in _ref, their distances from it, whether each is strange)."""
    k = len(CLASSES)
    at = np.flatnonzero(np.asarray(pc.is_valid(t.column("_ref"))))
    h, ref = (np.asarray(pc.list_flatten(t.column(x).take(pa.array(at)))).reshape(len(at), k + len(VOCABULARY) + 1).astype(float) for x in ("_h", "_ref"))
    far, strange = [], []
    for i, part in enumerate((slice(k), slice(k, None))):
        far.append(js_distance(h[:, part], ref[:, part]))
        n, odd = h[:, part].sum(1), np.zeros(len(at), bool)
        _, first, group = np.unique(ref, axis=0, return_index=True, return_inverse=True)
        for g, f in enumerate(first):
            rows = group.ravel() == g
            odd[rows] = _strange(i, n[rows], far[-1][rows], sampled(ref[f, part]))
        strange.append(odd)
    return at, far, strange


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, refs: References | None = None) -> DataFrame:
    """docs (its columns `keep`; all: None) with the counts, distances, base_failed and kept."""
    refs = references(docs, text, lang) if refs is None else refs
    large, small = list(refs.large.values()), refs.small
    joined = small is not None
    expected = [[sampled(r[i]) for r in large] for i in range(2)]

    def make(texts):
        m = measure(texts)
        far, strange = [], []
        for i, kind in enumerate(("classes", "words")):
            each = [js_distance(m[kind], r[i]) for r in large]
            n = m[kind].sum(1)
            far.append(np.min(each, 0) if large else np.zeros(len(n)))
            strange.append(np.all([_strange(i, n, x, e) for x, e in zip(each, expected[i], strict=True)], 0) if large else np.ones(len(n), bool))
        more = [_lists(np.concatenate([m["classes"], m["words"]], 1))] if joined else []
        return [*(m[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *far, m["base_failed"], *strange, *more]

    fields = [*(c.field(x, "long") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), c.field("char_distance", "double"), c.field("word_distance", "double"), c.field("base_failed", "boolean")]
    made = [f.name for f in fields]
    kept = [x for x in (docs.columns if keep is None else keep) if x not in (*made, "kept")]
    inner = [*fields, c.field("_odd_chars", "boolean"), c.field("_odd_words", "boolean"), *([c.field("_h", "array<long>")] if joined else [])]
    known = F.coalesce(F.col("_lang").isin(list(refs.large)), F.lit(False))
    own = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    out = c.add_columns(docs.select(*dict.fromkeys([*kept, text]), own.alias("_lang")), text, make, inner, [*kept, "_lang"], SLICE_BYTES)
    if small is None:
        out = out.withColumn("_judged", known)
    else:
        # only histograms of small languages meet a row; the others are dealt by their counts, so that they are no hot key
        key = F.when(known | F.col("_lang").isNull(), F.concat(F.lit("\0"), F.xxhash64("_h").cast("string"))).otherwise(F.col("_lang"))
        out = out.withColumn("_key", key).join(small.withColumnRenamed("_lang", "_key"), "_key", "left").withColumn("_judged", known | F.col("_ref").isNotNull())
        order = [*kept, *made, "_odd_chars", "_odd_words", "_judged"]
        schema = out.select(*order).schema

        def own(batches):
            for b in batches:
                at, far, strange = _judge_by_own(b)
                cols = {x: b.column(x) for x in order}
                for name, new, smaller in (("char_distance", far[0], True), ("word_distance", far[1], True), ("_odd_chars", strange[0], False), ("_odd_words", strange[1], False)):
                    x = np.array(cols[name])
                    x[at] = (np.minimum(x[at], new) if large else new) if smaller else x[at] & new
                    cols[name] = pa.array(x)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=order)

        out = out.select(*order, "_h", "_ref").mapInArrow(own, schema)
    odd = F.col("_judged") & (F.col("_odd_chars") | F.col("_odd_words"))
    return out.select(*kept, *made, (~(F.col("base_failed") | odd)).alias("kept"))
