"""The columns that decide, of the quality rules and the classifier, against plain versions without arrays."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidefold.llm import common, quality_classifier, quality_rules

SCHEMA = "doc_id bigint, text string, lang string"


def make_docs(spark):
    rng = random.Random(11)
    words = {k: v.split() for k, v in quality_rules.COMMON_WORDS.items()}
    other = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "fr", "de", "xx", None])
        common_ = words.get(lang or "en", words["es"])
        n = rng.choice([5, 30, 80, 200, 400])
        text = [rng.choice(common_) if rng.random() < 0.45 else rng.choice(other) for _ in range(n)]
        kind = i % 13
        if kind == 0:
            text = ["".join(rng.choice("#$%0123@!") for _ in range(5)) for _ in text]
        elif kind == 1:
            text = [w.upper() for w in text]
        elif kind == 2:
            text = text[:9] * (n // 9 + 1)
        rows.append((i, " ".join(text).replace(" a", "\n", 1), lang))
    return [*rows, (900, None, "en"), (901, "", "en"), (902, "Ünïcode … ‘words’ 日本 " * 30, "en")], words


def characters(text):
    out = Counter()
    for x in text or "":
        if "a" <= x <= "z":
            k = "lower"
        elif "A" <= x <= "Z":
            k = "upper"
        elif "0" <= x <= "9":
            k = "digit"
        elif x in " \t\n\v\f\r":
            k = "space"
        elif x in ".,;:'\"()-":
            k = "stop"
        elif x in "!?":
            k = "mark"
        elif x in quality_rules.SYMBOLS + "@^_~+=/\\{}[]`":
            k = "symbol"
        else:
            k = "other" if ord(x) < 0x80 else "beyond"
        out[k] += 1
    return out


def common_words(text):
    out = Counter()
    for w in (text or "").encode().split():
        w = w.decode().strip(".,;:!?\"'()").lower()
        out[w if w in quality_rules.VOCABULARY else None] += 1
    return out


def distance(p, q):
    """Jensen-Shannon distance of two counters, base 2."""
    a, b = sum(p.values()), sum(q.values())
    if not a:
        return 0.0
    total = 0.0
    for k in set(p) | set(q):
        x, y = p[k] / a, q[k] / max(b, 1)
        m = (x + y) / 2
        total += sum(z * math.log2(z / m) for z in (x, y) if z > 0) / 2
    return math.sqrt(min(max(total, 0), 1))


def test_rules_against_a_plain_version(spark):
    rows, _ = make_docs(spark)
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    chars, words = {i: characters(t) for i, t, _ in rows}, {i: common_words(t) for i, t, _ in rows}
    refs = {}
    for i, _, lang in rows:
        if lang is not None and not got[i].base_failed:
            n, a, b = refs.setdefault(lang, [0, Counter(), Counter()])
            refs[lang][0] = n + 1
            a.update(chars[i])
            b.update(words[i])
    refs = {k: v for k, v in refs.items() if v[0] >= quality_rules.MIN_REFERENCE}
    assert {"en", "fr"} <= set(refs)
    kept = 0
    for i, _, lang in rows:
        odd, far = [], []
        for kind, own, low in ((1, chars[i], quality_rules.MIN_CHARS), (2, words[i], quality_rules.MIN_WORDS)):
            n, strange, near = sum(own.values()), [], []
            for ref in refs.values():
                q = ref[kind]
                d = distance(own, q)
                noise = np.interp(math.log(max(n, 1)), np.log(quality_rules._SIZES), quality_rules.sampled(np.array(list(q.values()), float)))
                near.append(d)
                strange.append(n >= low and d * d > quality_rules.MARGIN[kind - 1] ** 2 + quality_rules.SAMPLING[kind - 1] * noise)
            odd.append(all(strange))
            far.append(min(near))
        r = got[i]
        assert (r.char_distance, r.word_distance) == pytest.approx(tuple(far), abs=1e-9)
        assert r.kept == (not r.base_failed and not (lang in refs and any(odd))), i
        kept += r.kept
    assert 50 < kept < len(rows) - 30


def test_expected_distance_of_samples():
    """`sampled` against draws."""
    rng = np.random.default_rng(3)
    q = np.array([500.0, 300, 120, 60, 15, 5])
    for n in (100, 1000):
        drawn = [quality_rules.js_distance(rng.multinomial(n, q / q.sum())[None].astype(float), q)[0] ** 2 for _ in range(1500)]
        told = np.interp(np.log(n), np.log(quality_rules._SIZES), quality_rules.sampled(q))
        assert told == pytest.approx(np.mean(drawn), rel=0.35)


def test_scores_against_a_plain_version(spark):
    rows, _ = make_docs(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 13 > 2)) for i, _, _ in rows if i < 260], "doc_id bigint, quality int")
    known = quality_classifier.learn(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score(docs, known).collect()}
    assert known.net.fitted
    q, hashes = quality_classifier, {}

    def hash_of(w):
        if w not in hashes:
            hashes[w] = common.hash_strings(pa.array([w.decode()]))
        return hashes[w]

    def index(w, dim, seed):
        place, sign = q._index(hash_of(w), dim, seed)
        v = np.zeros(dim)
        for p, s in zip(place[:, 0], sign[:, 0], strict=True):
            v[p] += s
        return v

    sums = {}
    for _, t, _ in rows:
        w = (t or "").encode().split()
        for a, b in zip(w[:-1], w[1:], strict=True):
            for own, other, seed in ((a, b, 41), (b, a, 42)):
                k = int(hash_of(own)[0] % np.uint64(q.BUCKETS))
                sums[k] = sums.get(k, 0) + index(other, q.DIM, seed)
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sums.items()}
    for i, t, _ in random.Random(2).sample(rows, 60):
        w = (t or "").encode().split()
        vector = np.mean([unit.get(int(hash_of(x)[0] % np.uint64(q.BUCKETS)), np.zeros(q.DIM)) for x in w], 0) if w else np.zeros(q.DIM)
        made = q.document_vectors(pa.array([t]), known.context)[0]
        assert made[: q.DIM] == pytest.approx(vector, abs=1e-4)
        net = known.net
        z = np.clip((made.astype(float) - net.mean) / net.scale, -8, 8)
        hidden = [max(0.0, sum(z[j] * net.w1[j, k] for j in range(len(z))) + net.b1[k]) for k in range(net.w1.shape[1])]
        logit = (sum(h * x for h, x in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))), abs=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_too_few_labels_reject_nothing_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"some words of document {i}") for i in range(30)], "doc_id bigint, text string")
    assert corpus_pipeline.classifier(spark, docs, str(tmp_path)).count() == 30
