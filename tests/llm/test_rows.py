"""Rows that share a doc_id but not a text, and words made to collide under a linear hash."""

import random
import zlib

import corpus_pipeline

from tidefold.llm import common, near_dedup, substring_dedup, suffix_tree_lm

SCHEMA = "doc_id bigint, text string"


def shingles(text, k=5):
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in (text or "").encode().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, percent):
    """For each row the place of the first row (by doc_id and place) that it reaches."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(rows))]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def made(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def repeated_ids():
    rows = []
    for i in range(40):
        base = made(i, 60)
        rows += [(5, " ".join(base)), (i % 7 + 1, " ".join([*base[:-1], "end"])), (5, " ".join(made(100 + i, 30)))]
    return [*rows, (1, " ".join(made(0, 60))), (5, rows[0][1]), (5, rows[0][1].upper()), (5, None), (5, ""), (None, rows[0][1]), (None, rows[0][1])]


def test_near_dedup_of_repeated_ids(spark):
    rows = repeated_ids()
    where = groups(rows, 85)
    least = {}
    for (i, _), g in zip(rows, where, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((i is None, i or 0, len(shingles(t)), least[g] if i is not None else -1) for (i, t), g in zip(rows, where, strict=True))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_stage_drops_only_rows_with_a_kept_one(spark):
    rows = repeated_ids()
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    where = groups(rows, 80)
    of = {}
    for row, g in zip(rows, where, strict=True):
        of.setdefault(row, g)
    loose = [r for r in rows if r[0] is None or not shingles(r[1])]
    one = [r for r in kept if r not in loose]
    assert sorted(map(str, (r for r in kept if r in loose))) == sorted(map(str, loose))
    every = {g for row, g in zip(rows, where, strict=True) if row not in loose}
    assert sorted(of[r] for r in one) == sorted(every)  # one of each group, and none lost
    small = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, "text a"), (1, "unrelated words b"), (2, "c")], SCHEMA), "")
    assert small.count() == 3


def test_substring_dedup_of_repeated_ids(spark):
    first = " ".join(made(1, 40))
    rows = [(1, first), (5, first)] + [(5, " ".join(made(200 + i, 25))) for i in range(40)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_removed == (r.n_words if (r.doc_id, r.text) == (5, first) else 0) for r in got) and len(got) == 42


def test_words_that_a_linear_hash_confuses(spark):
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    frame = "one two three four five six {} seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, frame.format(x)), (2, frame.format(y))], SCHEMA)
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()] == [0, 0]
    assert [r.component_id for r in near_dedup.near_dedup(docs).orderBy("doc_id").collect()] == [1, 2]
    held = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 7 != 2)
    out = suffix_tree_lm.score(spark.createDataFrame([(train, frame.format(x)), (held, frame.format(y))], SCHEMA))
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in out.collect()} == {train: (14, 14), held: (14, 13)}


def test_rolling_hash_of_words_in_patterns():
    import numpy as np

    codes = np.array([[bin(i + s).count("1") & 1 for i in range(16)] for s in (0, 32, 64, 1 << 10)])
    h = common.seeds(2, 9)[np.concatenate(codes)]
    for k in range(1, 17):
        keys = common.rolling(h, k)
        runs = [tuple(np.concatenate(codes)[i : i + k]) for i in range(len(keys))]
        assert len(set(keys.tolist())) == len(set(runs)) and len({*zip(runs, keys.tolist(), strict=True)}) == len(set(runs))


def test_blocks_by_the_bytes_of_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 900)
    shared = made(7, 30)
    rows = [(i, " ".join([*made(300 + i, i % 20), *shared[i % 11 :], *made(400 + i, 5)])) for i in range(120)]
    want = substring_dedup.brute_force(rows)
    got = substring_dedup.digest(substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_one_document_repeated_is_packed_by_many_tasks(spark):
    import public_tokenizers

    from tidefold.llm import packing

    rows = [(1, "the same text again and again")] * 3000 + [(i, " ".join(made(i, i % 50))) for i in range(2, 300)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == len(rows)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x[:-1], x[1:], strict=True)) and x[-1][0] + x[-1][1] <= packing.CAPACITY
    assert sum(r.length for r in out) > 0.95 * packing.CAPACITY * len(seqs)
