"""Substring and SimHash deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pgspark.llm import simhash, substrings
from tests.llm.helpers import clashing, docs, empty, prose, sorted_rows, words


def brute_repeats(texts, ids, window):
    least = {}
    for t, i in zip(texts, ids):
        ws = words(t)
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for t, i in zip(texts, ids):
        ws = words(t)
        drop = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if i is not None and least[tuple(ws[k : k + window])] < i:
                drop[k : k + window] = [True] * window
        kept = " ".join(w for w, d in zip(ws, drop) if not d)
        out.append((i, len(ws), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    base = [prose(300, s) for s in range(6)]
    texts = []
    for k in range(60):
        ws = list(r.choice(base))
        a = r.randrange(0, 250)
        own = prose(r.randrange(0, 120), 100 + k)
        cut = ws[a : a + r.choice([10, 30, 49, 50, 51, 75, 120])]
        texts.append(" ".join(own[: len(own) // 2]) + "\n" + " ".join(cut) + "\t" + " ".join(own[len(own) // 2 :]))
    return texts + [None, "", "a " * 500, "a " * 499, texts[0], " ".join(prose(5000, 1))]


def test_repeats_against_brute_force(spark):
    texts = corpus()
    ids = random.Random(1).sample(range(1000), len(texts))
    got = substrings.digest(substrings.find_repeats(docs(spark, texts, ids)))
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts, ids, 50)


@pytest.mark.parametrize("window", [3, 8])
def test_short_windows(spark, window):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(30))) for _ in range(25)]
    ids = list(range(len(texts)))
    got = substrings.digest(substrings.find_repeats(docs(spark, texts, ids), window=window))
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts, ids, window)


def test_repeats_odd_tables(spark):
    assert substrings.find_repeats(empty(spark)).count() == 0
    t = " ".join(prose(80, 3))
    df = docs(spark, [t, t, t, t], ids=[5, 5, None, 9])
    plain = sorted_rows(substrings.digest(substrings.find_repeats(df)), "doc_id", "n_removed")
    assert plain == [(5, 0), (5, 0), (9, 80), (None, 0)]
    assert sorted_rows(substrings.digest(substrings.find_repeats(clashing(df))), "doc_id", "n_removed") == plain


def test_a_window_of_many_documents_is_settled_in_chunks(spark, monkeypatch):
    """A passage that half of all documents hold: right at any size of chunks, and buckets get an entry for each chunk, not document."""
    passage = " ".join(prose(80, 3))
    texts = [f"{' '.join(prose(9, 100 + k))} {passage if k % 2 else ''} {' '.join(prose(7, 500 + k))}" for k in range(200)]
    ids = random.Random(8).sample(range(5000), len(texts))
    want = brute_repeats(texts, ids, 50)
    for words_held in (300, 1 << 19):
        monkeypatch.setattr(substrings, "CHUNK_WORDS", words_held)
        got = substrings.digest(substrings.find_repeats(docs(spark, texts, ids).repartition(3)))
        assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    h, d = np.array([5, 5, 5, 9, 5], np.uint64), np.array([4, 2, 4, 1, 3])
    order, runs, run = substrings._grouped(h, d)
    assert d[order].tolist() == [2, 3, 4, 4, 1] and runs.tolist() == [0, 4] and run.tolist() == [0, 0, 0, 0, 1]


def test_long_text_with_repeats_of_itself(spark):
    ws = prose(60_000, 5, 30)
    texts = [" ".join(ws), " ".join(prose(100, 6) + ws[30_000:31_000])]
    got = substrings.digest(substrings.find_repeats(docs(spark, texts)))
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts, [0, 1], 50)


def brute_fingerprint(text, size=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(text)
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, distance=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= distance):
            x, y = root(i), root(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, k in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, k), k)
    return [least[root(i)] for i in range(len(ids))]


def near_copies():
    r = random.Random(9)
    texts = []
    for s in range(12):
        ws = prose(r.choice([3, 40, 200, 800]), s)
        for _ in range(r.randrange(1, 9)):
            mine = list(ws)
            for _ in range(r.randrange(0, 4)):
                mine[r.randrange(len(mine))] = f"x{r.randrange(99)}"
            texts.append(" ".join(mine))
    return texts + [None, "", "ÀÉ Abc", "Two words", "two WORDS", "one"]


def test_near_duplicates_against_brute_force(spark):
    texts = near_copies()
    ids = random.Random(4).sample(range(1000), len(texts))
    got = simhash.digest(simhash.near_duplicates(docs(spark, texts, ids)))
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), brute_components(fps, ids)), key=str)
    assert sorted_rows(got, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("cell_rows,distance,blocks", [(2, 4, 7), (8, 4, 7), (4096, 4, 7), (4096, 6, 9), (16, 2, 4)])
def test_links_within_dealt_cells(spark, cell_rows, distance, blocks):
    """Chains of fingerprints a few bits apart, in cells of any size."""
    r = random.Random(7)
    fps = set()
    for _ in range(5):
        f = r.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for b in r.sample(range(64), r.choice([1, 4, 5])):
                f ^= 1 << b
    fps = sorted(fps)
    v = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {x.node: x.root for x in simhash.components(simhash.links(v, distance, blocks, cell_rows)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, range(len(fps)), distance)


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(5)
    a, b = (r.integers(0, 1 << 63, 2000, np.uint64) for _ in "ab")
    b[:1000] = a[:1000] ^ (np.uint64(1) << r.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 1000).astype(np.uint64))
    counts = lambda x: np.array([[bin(int(v) >> 2 * s & 3).count("1") for s in range(32)] for v in x])
    manhattan = np.abs(counts(a) - counts(b)).sum(1)
    assert (np.bitwise_count(simhash.unary_counts(a) ^ simhash.unary_counts(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_blocks_follow_the_number_of_fingerprints(spark):
    """Candidates by chance stay few for each fingerprint up to tens of millions of them; the formula holds on random ones."""
    assert [simhash.blocks_for(n) for n in (0, 1000, 500_000)] == [7, 7, 7]
    assert all(simhash.chance_candidates(n, 4, simhash.blocks_for(n)) <= simhash.CANDIDATES for n in (10**5, 10**6, 10**7, 5 * 10**7))
    assert simhash.chance_candidates(10**8, 4, simhash.blocks_for(10**8)) < simhash.chance_candidates(10**6, 4, 7) * 100 / 15
    n = 20_000
    v = spark.createDataFrame([(int(x), i) for i, x in enumerate(np.random.default_rng(2).integers(-(1 << 63), 1 << 63, n))], "fp long, rep long")
    sizes = [r[0] for r in simhash.cells(v, 4, 7).groupBy("cell").count().where("count > 1").select("count").collect()]
    assert sum(k * (k - 1) for k in sizes) / n == pytest.approx(simhash.chance_candidates(n, 4, 7), rel=0.25)


def test_long_texts(spark):
    ws = prose(150_000, 4)
    got = simhash.digest(simhash.near_duplicates(docs(spark, [" ".join(ws), " ".join(ws[:-1]), " ".join(prose(10, 1))])))
    assert [r[1] for r in sorted_rows(got, "doc_id", "component_id")] == [0, 0, 2]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(501, 560)] + [(900, 901), (901, 900), (7, 7)]
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[k] == 500 for k in range(501, 560)) and got[901] == 900


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    t = " ".join(prose(60, 3))
    df = docs(spark, [t, t, t, "other words here today"], ids=[5, 5, None, 9])
    plain = sorted_rows(simhash.near_duplicates(df), "doc_id", "component_id")
    assert plain == [(5, 5), (5, 5), (9, 9), (None, 5)]
    assert sorted_rows(simhash.near_duplicates(clashing(df)), "doc_id", "component_id") == plain
    assert sorted_rows(simhash.keep_one(df), "doc_id") == [(5,), (9,), (None,)]
