"""Each operator against a brute-force version, and on the cases that tables have: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.llm import common, embedding_dedup, license_scan, near_dedup, packing, pieces, quality_classifier, quality_rules, substring_dedup, suffix_tree_lm, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, kept boolean, score string, n_words string, _text string"


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words(text)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "to", "in", "is", "Ünder", "naïve", "日本"] + ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary[:9] if rng.random() < 0.4 else vocabulary) for _ in range(n)]
    shared, rows = make(60), []
    for i in range(120):
        w = make(rng.randint(1, 160))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = shared[: rng.randint(10, 60)]
        rows.append(" ".join(w).replace(" the ", "\nthe ", 2))
    near = rows[10].split(" ")
    rows += [rows[3]] * 9 + [" ".join(near[:-2] + ["changed"] * 2)] * 2
    rows += [" ".join((base := make(200))), " ".join(base[:100] + ["x"] + base[101:]), " ".join(["y", *base]), " ".join(base[:60] + make(60))]
    rows += [None, "", " \t\n", "word", "Two words", "a b c d e", "A B C D E", "same same same " * 40, "LOUD!! " * 60, "x" * 30_000, " ".join(make(6000)), "\x1c\x85 odd spaces", "▁ mark <s> <|endoftext|>"]
    return [(i, t, rng.choice(["en", "fr", None])) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, g, False, "s", "n", "own") for i, t, g in corpus]
    return spark.createDataFrame(rows + rows[:3] + [(None, "no id here at all " * 9, "en", True, "s", "n", "own")], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared ---------------------------------------------------------------------------------------


def test_words_are_ascii_split(corpus):
    texts = [t or "" for _, t, _ in corpus]
    w = common.split_words(pa.array(texts))
    dictionary = w.dictionary.to_pylist()
    assert [[dictionary[c].encode() for c in w.codes[a:b]] for a, b in zip(w.off[:-1], w.off[1:], strict=True)] == [words(t) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(w.codes.tolist()))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, i) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7)]
    top = {x: x for e in edges for x in e}

    def find(x):
        return x if top[x] == x else find(top[x])

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {x for x in top if x not in got}
    assert alone <= {7} and got == {x: find(x) for x in top if x in got}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 ----------------------------------------------------------------------------------------------


def test_column_generation_is_near_the_bound():
    lengths, rng = np.array([3, 5, 7, 11, 20, 33, 64]), np.random.default_rng(1)
    for _ in range(20):
        demand = rng.integers(0, 400, len(lengths))
        patterns, uses = packing.plan(lengths, demand, 64)
        assert (patterns.T @ uses == demand).all() and ((patterns * lengths).sum(1) <= 64).all()
        room = []  # first-fit decreasing
        for k in range(len(lengths) - 1, -1, -1):
            for _ in range(demand[k]):
                at = next((i for i, free in enumerate(room) if free >= lengths[k]), None)
                if at is None:
                    room.append(64)
                    at = len(room) - 1
                room[at] -= lengths[k]
        assert uses.sum() <= len(room) * 1.01 + 5
    assert packing.plan(lengths, np.zeros(7, int), 64)[1].sum() == 0


def test_best_pattern_against_brute_force():
    from itertools import product

    lengths, price = np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0])
    best = max(a * 2.0 + b * 3.1 + d * 5.0 for a, b, d in product(range(8), range(6), range(4)) if 3 * a + 4 * b + 7 * d <= 22)
    value, pattern = packing.best_pattern(lengths, price, 22)
    assert value == pytest.approx(best) == pytest.approx(pattern @ price) and pattern @ lengths <= 22


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(docs, WORD_BPE, capacity=512).toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all() and s.length.sum() <= 512
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 512):
            want[r.doc_id, a, min(512, len(ids) - a), zlib.crc32(ids[a : a + 512].tobytes()), len(ids)] += 1
    key = lambda r: (None if math.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(key, got.itertuples())) == want
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_parts_of_words_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(WORD_BPE), random.Random(5)
    pools = ["abcXYZ", "0123", "'\u2019", "<|>", "\u00e9\u00c9\u00df\u00ff\u00d7\u00f7\u00c0\u00d6\u00d8\u00de\u00f0", "\u00aa\u00b5\u00b2\u00bd\u00bf\xa0\x85\xad", "\x1c\x00\x01\x7f\x80", "\u0130\u0131\u017f\u212a\u01c5\ufb01", "\u0301\u0327\u0308", "\u6f22\u304b\u0645\u0939\u093f", "\U0001f600", "\u3000\u200b\u2028", "\u2167\u0663", "\u03a3\u03c2", "!?.,-_&*#$%", "stredvm"]
    some = ["it's", "IT'S", "'s", "we'll", "<|endoftext|>", "a<|ENDOFTEXT|>b", "<|startoftext|>", "<", "|", "<|", "T\u0308", "E\u0301", "1/2", "\u00e91\u00e9", "A1b2C3..!!", "\u00d7a", "a\u00f7b"]
    texts = ["", *(r.choice([" ", "  ", "\n"]).join(r.choice(some) if r.random() < 0.3 else "".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(9))) for _ in range(3000))]
    off, ids = packing.ids_of_texts(pa.array(texts), WORD_BPE)
    assert packing.WordIds(WORD_BPE).of_parts is not None
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*tokenizer.encode(x, add_special_tokens=False).ids, packing.END_ID], repr(x)


def test_a_part_goes_to_the_tokenizer_once_and_with_others():
    class Counted:
        def __init__(self, inner):
            self.inner, self.texts, self.bytes = inner, 0, 0

        def encode_batch_fast(self, texts, **options):
            self.texts, self.bytes = self.texts + len(texts), self.bytes + sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **options)

    ids, plain = packing.WordIds(WORD_BPE), [a + b + "e" for a in "bcdfghjk" for b in "lmnrstvw"]
    counted = [Counted(ids.tokenizer), Counted(getattr(ids, "of_parts", None))]
    ids.tokenizer, ids.of_parts = counted
    forms = [f(x) for x in plain for f in (str, str.upper, str.title, "{},".format, "({})".format)]
    start, n, pool = ids.of(pa.array(forms))
    whole = counted[0].inner
    assert [pool[a : a + k].tolist() for a, k in zip(start.tolist(), n.tolist(), strict=True)] == [whole.encode(x, add_special_tokens=False).ids for x in forms]
    assert sum(x.texts for x in counted) == 1 and sum(x.bytes for x in counted) < 5 * len(plain)
    ids.of(pa.array(forms))
    assert sum(x.texts for x in counted) == 1


def test_other_tokenizers_get_whole_words(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(WORD_BPE).to_str())
    spec["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "case.json")
    Tokenizer.from_str(json.dumps(spec)).save(path)
    ids, texts = packing.WordIds(path), ["The Cat, the cat.", "MIT it's"]
    assert ids.of_parts is None
    off, got = packing.ids_of_texts(pa.array(texts), path)
    for i, x in enumerate(texts):
        assert got[off[i] : off[i + 1]].tolist() == [*Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, packing.END_ID]


# --- 2 ----------------------------------------------------------------------------------------------


def plain_words(text):
    return [x for x in (w.strip(license_scan.TRIM.encode()) for w in lowered(text)) if x]


def brute_finds(text):
    """Names of templates of which some stretch has enough shingles."""
    h, out = plain_words(text), set()
    for name, t in license_scan.TEMPLATES.items():
        own = plain_words(t)
        k = min(license_scan.SHINGLE, len(own))
        want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        at = [i for i in range(len(h) - k + 1) if tuple(h[i : i + k]) in want]
        for n, a in enumerate(at):
            if len({tuple(h[i : i + k]) for i in at[n:] if i < a + 1.3 * len(want) + k}) >= license_scan.CONTAINMENT * len(want):
                out.add(name)
                break
    return out


def test_license_scan(spark, nothing):
    rng, rows = random.Random(5), []
    for i, (_, t) in enumerate(sorted(license_scan.TEMPLATES.items()) * 2):
        w = t.split()
        if i % 2 and len(w) > 25:
            w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join([*(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))), *w, *(["tail"] * rng.randrange(9))]))
    rows += [None, "", "Released under the", "RELEASED, under the MIT license!", "Released under the MIT License. " * 3]
    got = license_scan.license_scan(spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)], "doc_id int, text string, finds int")).collect()
    for r in got:
        assert {f.template for f in r.finds if f.whole} == brute_finds(rows[r.doc_id]), rows[r.doc_id]
        assert set(r.licenses) == {f.template for f in r.finds} and r.n_finds == len(r.finds)
    assert {r.doc_id: r.n_finds for r in got}[len(rows) - 1] == 3
    assert license_scan.license_scan(nothing).count() == 0


def changed_copies(rng, words, how):
    """A license's words, changed as licenses are."""
    filler = [f"w{i}" for i in range(500)]
    if how == "edited":
        out = []
        for w in words:
            r = rng.random()
            out += [] if r < 0.005 else [rng.choice(filler)] if r < 0.01 else [w, rng.choice(filler)] if r < 0.015 else [w]
        return " ".join(out)
    if how == "reflowed":
        sign, lines, line = rng.choice(["// ", "# ", " * ", ""]), [], ""
        for w in words:
            if len(line) + len(w) > rng.choice([60, 80]):
                lines.append(sign + line)
                line = ""
            line += f" {w}"
        return "\n".join([*lines, sign + line])
    n = max(60, len(words) // 2)
    return " ".join(words[:n] if how == "cut off" else words[-n:])


@pytest.mark.parametrize("how", ["edited", "reflowed", "cut off", "end only"])
def test_license_recall(how):
    rng, given = random.Random(9), tuple(sorted(license_scan.TEMPLATES.items()))
    long = [(k, t.split()) for k, t in given if len(t.split()) >= 60]
    rows = [(k, " ".join([*(f"a{rng.randrange(99)}" for _ in range(rng.randrange(80))), "\n", changed_copies(rng, w, how), "\n", *(f"b{rng.randrange(99)}" for _ in range(rng.randrange(80)))])) for k, w in long for _ in range(3)]
    found = license_scan.scan(pa.array([t for _, t in rows]), given)
    hits = [any(x[1] == k for x in f) for (k, _), f in zip(rows, found, strict=True)]
    assert len(rows) > 40 and sum(hits) >= 0.9 * len(hits)


def test_no_license_in_plain_texts(corpus):
    assert not any(license_scan.scan(pa.array([t for _, t, _ in corpus]), tuple(sorted(license_scan.TEMPLATES.items()))))


def test_bands_meet_as_often_as_stated():
    rng = np.random.default_rng(4)
    size, met, share = license_scan.WIDE, 0, 0.6
    for _ in range(150):
        both = int(round(2 * size * share / (1 + share)))
        x = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64)
        a, b = x[:size], np.concatenate([x[:both], x[size:]])
        met += any((p == q).all() for p, q in zip(license_scan.signatures(a, size, 1), license_scan.signatures(rng.permutation(b), size, 1), strict=True))
    assert met >= 148


# --- 3 ----------------------------------------------------------------------------------------------


def brute_tree(texts, depth):
    """(states: context -> (n, counts), root counts, N, V) of training texts as lists of words."""
    grams, total = Counter(), Counter()
    for t in texts:
        x = (None, *t, None)
        total.update(x[1:])
        for n in range(1, depth + 2):
            grams.update(x[i : i + n] for i in range(len(x) - n + 1) if n > 1 or i)
    n_all, after = sum(total.values()), {}
    for g, k in grams.items():
        if len(g) > 1:
            after.setdefault(g[:-1], Counter())[g[-1]] = k
    states = {}
    for s, nexts in after.items():
        n, twice = sum(nexts.values()), {w: k for w, k in nexts.items() if k >= 2}
        if twice:
            below = lambda w, s=s: after[s[1:]][w] / sum(after[s[1:]].values()) if len(s) > 1 else total[w] / n_all
            less = sum(k - 1 for k in twice.values())
            gain = sum(k * math.log((k - 1) / n / below(w)) for w, k in twice.items()) + (n - sum(twice.values())) * math.log(1 - less / n)
            if gain >= suffix_tree_lm.GAIN * len(twice):
                states[s] = (n, twice, less)
    return states, total, n_all, len(total)


def brute_probability(tree, context, w, depth):
    states, total, n_all, v = tree
    p = (total[w] + 1) / (n_all + v + 1)
    used = 0
    for d in range(1, min(depth, len(context)) + 1):
        if (s := states.get(context[-d:])) is not None:
            n, twice, less = s
            p, used = (twice.get(w, 1) - 1) / n + (1 - less / n) * p, d
    return p, used


@pytest.mark.parametrize("depth", [1, 3])
def test_language_model(docs, nothing, corpus, depth):
    got = suffix_tree_lm.score(docs, depth=depth).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tree = brute_tree([lowered(t) for i, t in rows if not held(i)], depth)
    states, count, n, v = tree
    tokens = {i: [*lowered(t), None] for i, t in rows}
    assert len(got) == len(rows) and len(states) > 100 and (depth == 1 or max(map(len, states)) == 3)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        each = [brute_probability(tree, (None, *t[:i]), w, depth) for i, w in enumerate(t)]
        assert r.score == pytest.approx(sum(math.log10(p) for p, _ in each), rel=1e-9)
        assert r.n_context == sum(d > 0 for _, d in each)
    assert suffix_tree_lm.score(nothing).count() == 0
    only_held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    assert {r.train_tokens for r in suffix_tree_lm.score(only_held).collect()} == {0}


def test_tree_is_a_distribution(corpus):
    tree = brute_tree([lowered(t) for _, t, _ in corpus], 3)
    contexts = random.Random(3).sample(sorted(tree[0], key=str), 60)
    for s in contexts:
        assert sum(brute_probability(tree, s, w, 3)[0] for w in [*tree[1], "a word not seen"]) == pytest.approx(1)


def test_slices_and_buckets_do_not_matter(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "SLICE_BYTES", 2000)
    few = {(r.doc_id, r.score) for r in suffix_tree_lm.score(docs).collect()}
    monkeypatch.undo()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        many = {r.doc_id: r.score for r in suffix_tree_lm.score(docs.coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(many[i] == pytest.approx(x, rel=1e-9) for i, x in few)


def test_packed_numbers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        a, b = rng.integers(-(2**62), 2**62, n), rng.random(n)
        x, y = suffix_tree_lm.unpack(suffix_tree_lm.pack(a, b.view(np.int64)), n) or (a, b.view(np.int64))
        assert (x == a).all() and (y.view(float) == b).all()


# --- 4 ----------------------------------------------------------------------------------------------


def test_classifier(spark, nothing):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        good = i % 4 != 0
        w = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "junk"))
        labels.append((i, int(good), 0))
    rows += [(900, None, "x"), (901, "", "x"), (902, "z" * 5000, "x"), (0, rows[0][1], "x"), (None, "no id", "x")]
    labels += [(5, 1, 0), (None, 0, 0), (6, None, 0)]
    d, la = spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(d, la).collect()
    assert len(got) == len(rows)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got if r.doc_id is not None]
    assert held == [r.held_out for r in got if r.doc_id is not None]
    # labels of held-out rows change nothing
    turned = la.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda rows: sorted((str(r.doc_id), r.text or "", round(r.score, 9)) for r in rows)
    assert key(quality_classifier.classify(d, turned).collect()) == key(got)
    assert {round(r.score, 6) for r in quality_classifier.classify(d.limit(3), la.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(nothing, la).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------


def test_cover_has_every_difference():
    for p in range(1, 14):
        cover = substring_dedup.difference_cover(p)
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_substring_dedup(docs, nothing, corpus):
    got = substring_dedup.substring_dedup(docs)
    assert {"kept", "score", "_text"} <= set(got.columns)
    want = substring_dedup.brute_force([(i, t) for i, t, _ in corpus])
    rows = substring_dedup.digest(got).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r
    assert sum(x[1] for x in want.values()) > 200
    assert substring_dedup.substring_dedup(nothing).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------


def brute_sets(text, k=5):
    w = lowered(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(sets, percent):
    top = {i: i for i in sets}

    def find(x):
        return x if top[x] == x else find(top[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(spark, docs, nothing, corpus, percent):
    sets = {i: brute_sets(t) for i, t, _ in corpus}
    want = brute_components(sets, percent)
    got = near_dedup.near_dedup(docs, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want) - 5
    assert near_dedup.near_dedup(nothing).count() == 0


def test_links_that_no_centre_has(spark):
    """A chain of texts that are each like the next, and members of a bucket that are like others than its smallest."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    chain = [" ".join(base[i * 2 : i * 2 + 90]) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(random.Random(1).sample(chain, len(chain)))]
    want = brute_components({i: brute_sets(t) for i, t in rows}, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_sketch_agreement_is_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.9):
        hits = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 200, dtype=np.uint64)
            common_ = int(200 * share)
            a, b = x, np.concatenate([x[:common_], rng.integers(0, 2**63, 200 - common_, dtype=np.uint64)])
            s = near_dedup.sketch(np.array([0, 200, 400]), np.concatenate([a, b]))
            assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
            hits.append((s[0] == s[1]).mean())
        assert np.mean(hits) == pytest.approx(common_ / (400 - common_), abs=0.03)
    assert (near_dedup.sketch(np.array([0, 1]), np.array([5], np.uint64)) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


# --- 7 ----------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16))
    near = x[:30] + rng.normal(size=(30, 16)) * 0.12
    rows = [(int(i), [float(f) for f in v], 1) for i, v in enumerate(np.concatenate([x, near, x[:4], x[5:6] * 3]).astype(np.float32))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    v = np.array([r[1] for r in rows[:n]], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.9
    top = np.arange(n)
    for _ in range(n):
        top = np.minimum(top, np.where(hit, top[None], n).min(1))
    links = hit.sum(1) - 1
    found = sum(got[i].n_links for i in range(n))
    assert found >= 0.9 * links.sum() and all(got[i].n_links <= links[i] for i in range(n))
    assert found == links.sum() and [got[i].component_id for i in range(n)] == top.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 7))
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    lost = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert [r.kept for r in embedding_dedup.embedding_dedup(lost).collect()] == [True, True]


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(60, 8)) * 0.05, rng.normal(size=(40, 8))])
    rows = [(int(i), [float(f) for f in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: int(n) - 1 for i, n in enumerate((v @ v.T >= 0.9).sum(1))}


def test_pairs_meet_in_every_direction(spark):
    """Vectors of rank 16 in 768 dimensions, with partners at 0.90 to 0.93."""
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(768, 16)))[0].T
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(rng.normal(size=(700, 16))), rng.normal(size=(700, 16))
    cos = rng.uniform(0.9, 0.93, (700, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * unit(y - (x * y).sum(1, keepdims=True) * x)]) @ basis
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(v)], "vec_id bigint, embedding array<double>")).collect()}
    w = unit(v)
    want = (w @ w.T >= 0.9).sum(1) - 1
    assert want.sum() >= 1390 and got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("block", [2048, 16])
def test_every_length_is_compared(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    sets = [np.concatenate([x := rng.normal(size=(n, d)), x + rng.normal(size=(n, d)) * 0.05, x[:3]]) for n, d in ((40, 8), (30, 12), (2, 5))]
    rows = [(1000 * k + i, z.tolist()) for k, v in enumerate(sets) for i, z in enumerate(v)]
    want = {}
    for k, v in enumerate(sets):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        want |= {1000 * k + i: int(n) - 1 for i, n in enumerate((v @ v.T >= 0.9).sum(1))}
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == want and all(want[1000 * k] > 0 for k in range(3))


# --- 8 ----------------------------------------------------------------------------------------------


def test_url_filter_with_columns_of_its_own_names(spark):
    captures = spark.createDataFrame([("http://a.example.org/x", "2024-01-05", "mine", 7, "c")], "url string, day string, _host string, _day int, c0 string").withColumn("day", F.col("day").cast("date"))
    entries = spark.createDataFrame([("spam", "example.org", "2024-01-01", "add")], "list_name string, domain string, day string, action string").withColumn("day", F.col("day").cast("date"))
    r = url_filter.url_filter(captures, entries).first()
    assert (r["_host"], r["_day"], r.c0, r.host, r.n_lists, r.kept) == ("mine", 7, "c", "a.example.org", 1, False)


def test_url_filter(spark):
    entries = [("spam", "bad.example", 10, "add"), ("spam", "bad.example", 20, "remove"), ("spam", "bad.example", 30, "add"), ("adult", "EXAMPLE.org", 5, "add"), ("spam", "x.example.org", 5, "add"), ("spam", "tie.example", 7, "add"), ("spam", "tie.example", 7, "remove"), ("spam", "twice.example", 3, "add"), ("spam", "twice.example", 4, "add"), ("spam", None, 1, "add"), ("spam", "other.example", 1, "odd")]
    urls = ["http://bad.example/x", "https://www.bad.example:80/", "http://notbad.example", "http://u@x.example.org./a?b", "https://Example.ORG", "http://tie.example", "http://twice.example", "no url", "", None, "http://10.0.0.1/", "http://localhost/"]
    days = [4, 9, 10, 19, 20, 29, 30, None]
    caps = [(f"{u}|{d}", u, d, "own") for u in urls for d in days]
    date = lambda df: df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    e = date(spark.createDataFrame(entries, "list_name string, domain string, day int, action string"))
    got = {r.k: r for r in url_filter.url_filter(date(spark.createDataFrame(caps, "k string, url string, day int, kept string")), e).collect()}
    assert len(got) == len(caps)
    spans = {("spam", "bad.example"): [(10, 20), (30, 99)], ("adult", "example.org"): [(5, 99)], ("spam", "x.example.org"): [(5, 99)], ("spam", "twice.example"): [(3, 99)]}
    hosts = {urls[0]: "bad.example", urls[1]: "www.bad.example", urls[2]: "notbad.example", urls[3]: "x.example.org", urls[4]: "example.org", urls[5]: "tie.example", urls[6]: "twice.example", urls[10]: "10.0.0.1", urls[11]: "localhost"}
    for k, u, d, _ in caps:
        host = hosts.get(u)
        on = sorted(n for (n, dom), s in spans.items() if host and d is not None and (host == dom or host.endswith("." + dom)) and any(a <= d < b for a, b in s))
        assert (got[k].host, got[k].n_lists, got[k].first_list, got[k].kept) == (host, len(on), on[0] if on else None, not on), k
    none = date(spark.createDataFrame(caps[:0], "k string, url string, day int, kept string"))
    assert url_filter.url_filter(none, e).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys(docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for r in pieces.round_trip(docs, PIECE_BPE).collect():
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    coded = pieces.encode(docs, PIECE_BPE, keep=["doc_id", "text"])
    assert all(r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids) for r in pieces.decode(coded, PIECE_BPE).collect())
    assert pieces.round_trip(nothing, PIECE_BPE).count() == 0


def test_pieces_on_odd_texts():
    import sentencepiece

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), pieces.model(PIECE_BPE), random.Random(9)
    parts = ["a", " ", "  ", "\n", "\t", "é", "▁", "<s>", "<0x0A>", "<unk>", "日本", "👍", "́", "\0", "the", "ing", "https", "//", "...", "0", "﻿", "\r", "abab"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert m.encode(t) == sp.encode(t) and m.decode(m.encode(t)) == sp.decode(sp.encode(t)), repr(t)
    for t in ("ab" * 20_000, "".join(rng.choice("abcdeth") for _ in range(20_000))):
        assert m.encode(t) == sp.encode(t)
    for _ in range(300):
        w = "".join(rng.choice("abcdething") for _ in range(rng.randint(1, 12)))
        assert m.backtrack(w) == m.merge(w)


# --- 10 ---------------------------------------------------------------------------------------------


def brute_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    cover = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in quality_rules.SYMBOLS), dup, len(cover)


def test_quality_rules(docs, nothing, corpus):
    texts = {i: t for i, t, _ in corpus}
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            n = brute_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_rules_without_a_language_column(docs):
    got = quality_rules.quality_rules(docs.drop("lang")).collect()
    assert all(r.kept == (not r.base_failed) for r in got) and any(r.kept for r in got)


def test_js_distance():
    p = np.array([[1.0, 0], [0, 1], [1, 1], [0, 0]])
    assert quality_rules.js_distance(p, np.array([1.0, 0])) == pytest.approx([0, 1, 0.5579230452841438, 0])


def test_strange_text_is_rejected(spark):
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    rows = [(i, make(rng.randint(30, 200)), "en") for i in range(60)] + [(100, " ".join(f"{w}***" for w in make(150).split()), "en"), (101, make(150).upper().replace(" ", "!! "), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]


def _prose(rng, common, n):
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.mark.parametrize("share", [0.001, 0.5])
def test_small_languages_have_their_own_reference(spark, monkeypatch, share):
    """share 0.5: the second language is too small for the driver and is joined; the third has too few documents, the fourth no name."""
    monkeypatch.setattr(quality_rules, "MIN_SHARE", share)
    rng = random.Random(11)
    languages = [("en", ["the", "of", "and", "to", "in"], 90), ("xx", ["de", "la", "que", "el", "los"], 30), ("yy", ["der", "die", "und", "das"], 6), (None, ["der", "die", "und", "das"], 3)]
    rows = [(100 * k + i, _prose(rng, w, 250), name, "own") for k, (name, w, n) in enumerate(languages) for i in range(n)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in _prose(rng, ["los"], 200).split()), name, "own") for i, name in enumerate(["en", "xx"])]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows + junk, "doc_id int, text string, lang string, kept string")).collect()}
    assert len(got) == len(rows) + 2
    assert [i for i, *_ in rows if not got[i].kept] == []
    assert not got[1000].kept and not got[1001].kept
    assert max(got[i].word_distance for i in range(100, 130)) < 0.3


def test_limits_follow_length():
    """A long text at 0.3 is strange, a short one is not; samples of the reference are not."""
    rng = np.random.default_rng(12)
    ref = np.concatenate([rng.integers(1, 400, 110), [6000]]).astype(float)
    e = quality_rules.sampled(ref)
    for n in (40, 100, 1000, 5000):
        x = rng.multinomial(n, ref / ref.sum(), size=200).astype(float)
        far = quality_rules.js_distance(x, ref)
        assert (far**2).mean() == pytest.approx(np.interp(np.log(n), np.log(quality_rules._SIZES), e), rel=0.1)
        assert not quality_rules._strange(1, np.full(200, n), far, e).any()
    assert quality_rules._strange(1, np.array([40, 5000]), np.array([0.3, 0.3]), e).tolist() == [False, True]
