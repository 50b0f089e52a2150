"""The near-duplicate stage of the pipeline against all pairs by exact Jaccard similarity."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from pgspark.llm import similar
from tests.llm.helpers import docs, prose, sorted_rows, words

DIR = "/root/testdata/sf0.01"
NEAR = dict(corpus_pipeline.STAGES)["near_duplicates"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    ws = words(lower(text))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_kept(texts, ids):
    sets, root = [shingle_set(t) for t in texts], list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda k: ids[k])

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(order, 2):
        x, y = sets[a], sets[b]
        near = min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (x == y or len(x & y) / len(x | y) >= 0.8)
        if near and find(a) != find(b):
            low, high = sorted((find(a), find(b)), key=lambda k: ids[k])
            root[high] = low
    return {ids[k] for k in order if find(k) == k}


def test_edited_copies(spark):
    """Copies whose similarity is a little over 0.8 go, a little under it stay; their fingerprints are more than four bits apart."""
    texts = []
    for s in range(40):
        base = prose(200, s, 4000)
        texts.append(" ".join(base))
        for edits in (2, 3, 4, 5, 6, 9):
            ws = list(base)
            for k in random.Random(100 * s + edits).sample(range(len(ws)), edits):
                ws[k] = f"new{k}"
            texts.append(" ".join(ws))
    texts += [None, "", " \n", "One Two", "one two", "one two three"]
    ids = random.Random(3).sample(range(10_000), len(texts))
    got = {r.doc_id for r in NEAR(spark, docs(spark, texts, ids), DIR).collect()}
    assert got == brute_kept(texts, ids)


def test_large_group_of_copies(spark, monkeypatch):
    """Dealing of common cells and vertices, and a base with copies that are near it but not near each other."""
    for name, value in (("HOT", 8), ("SLICE_ROWS", 16), ("SLICE_SHINGLES", 4000)):
        monkeypatch.setattr(similar, name, value)
    base, texts = prose(300, 7, 5000), []
    for k in range(150):
        ws = list(base)
        for i in random.Random(k).sample(range(len(ws)), k % 8):
            ws[i] = f"x{k}_{i}"
        texts.append(" ".join(ws))
    ids = random.Random(4).sample(range(10_000), len(texts))
    got = {r.doc_id for r in NEAR(spark, docs(spark, texts, ids), DIR).collect()}
    assert got == brute_kept(texts, ids)


def counted(monkeypatch):
    """The rows of the tables that the stage writes, by name."""
    written, rows = similar.materialise, {}

    def count(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(similar, "materialise", count)
    return rows


def edited(base, seed, edits):
    ws = list(base)
    for i in random.Random(seed).sample(range(len(ws)), edits):
        ws[i] = f"x{seed}_{i}"
    return " ".join(ws)


def test_near_copies_meet_once(spark, monkeypatch):
    """Copies of one text that are mostly not near each other share many cells, but are compared as one group."""
    rows, seen = counted(monkeypatch), []
    for size in (150, 300):
        base = prose(120, 11, 5000)
        texts = [edited(base, k, 1 + k % 4) for k in range(size)]
        ids = random.Random(5).sample(range(10_000), size)
        got = {r.doc_id for r in NEAR(spark, docs(spark, texts, ids), DIR).collect()}
        assert got == brute_kept(texts, ids) and 1 < len(got) < size
        seen.append(dict(rows))
        assert rows["similar-groups"] > 20 * size  # a row for each cell in which a set has neighbours, 90 at most
        assert rows["similar-members"] <= 2 * size
    assert seen[1]["similar-groups"] < 3 * seen[0]["similar-groups"]


def test_chain_is_compared_by_group(spark, monkeypatch):
    """Texts of which each is near its neighbours only are a part of many pairs, so they are compared within their groups."""
    rows, words_now, texts = counted(monkeypatch), prose(150, 12, 5000), []
    for k in range(240):
        words_now = list(words_now)
        for i in random.Random(k).sample(range(150), 3 + k % 3):
            words_now[i] = f"y{k}_{i}"
        texts.append(" ".join(words_now))
    ids = random.Random(6).sample(range(10_000), len(texts))
    got = {r.doc_id for r in NEAR(spark, docs(spark, texts, ids), DIR).collect()}
    assert got == brute_kept(texts, ids) and 1 < len(got) < len(texts)
    assert rows["similar-by-group"] > 0


def test_members_of_parts(spark):
    """Each pair of different roots that a group holds is in a group of the result, the smallest member of a part included."""
    r = random.Random(8)
    groups = [sorted(r.sample(range(a, a + n), min(n, r.randint(2, 6)))) for a, n, many in ((0, 12, 40), (100, 60, 40), (200, 2, 1)) for _ in range(many)]
    found = spark.createDataFrame([(k, v, g[0]) for k, g in enumerate(groups, 1000) for v in g], "key long, vertex long, centre long")
    edges = spark.createDataFrame([(g[0], v) for g in groups for v in g[1:]], "u long, v long")
    parts = similar.parts_of(edges).collect()
    assert {p.vertex for p in parts} == {v for g in groups for v in g}
    of_part = spark.createDataFrame([(p.part, p.vertex, 50, p.vertex // 2) for p in parts], "part long, vertex long, n long, root long")
    got = {}
    for m in similar.unlinked(found, of_part).collect():
        assert m.root == m.vertex // 2 and m.n == 50
        got.setdefault(m.key, set()).add(m.vertex)
    for g in groups:
        for a, b in combinations(g, 2):
            assert a // 2 == b // 2 or any({a, b} <= x for x in got.values())
    assert sum(len(x) for x in got.values()) < sum(len(g) for g in groups)


def test_given_documents(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = sorted_rows(table, "doc_id", "text")
    left = NEAR(spark, table, DIR)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == brute_kept([t for _, t in rows], [i for i, _ in rows])


def test_share_of_bands():
    """Sets at 0.8 meet in a cell."""
    r = np.random.default_rng(1)
    for _ in range(300):
        both, a, b = (r.integers(0, 1 << 63, n, np.uint64) for n in (400, 50, 50))
        x, y = (similar.band_keys(np.concatenate([both, z])) for z in (a, b))
        assert (x == y).any()


def brute_prints(text, count):
    """Fingerprints of 128 bits by counting, from the hashes of the shingles."""
    hashes = [int(h) for h in similar.shingles(text)]
    out = []
    for w in range(2 * count):
        ones = [0] * 64
        for h in hashes:
            x = (h + (w + 1) * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            for k in range(64):
                ones[k] += x >> k & 1
        out.append(sum(1 << k for k in range(64) if 2 * ones[k] > len(hashes)))
    return [out[k] | out[k + 1] << 64 for k in range(0, 2 * count, 2)]


def brute_groups(vertices, prints, grid):
    """Members of a cell (equal counts in a run of segments) that steps of at most the distance connect."""
    found = set()
    for f in range(max(len(p) for p in prints)):
        for r in range(64 // grid.dims):
            cells = {}
            for v, p in zip(vertices, prints):
                if f < len(p):
                    cells.setdefault(tuple((p[f] >> 2 * s & 3).bit_count() for s in range(r * grid.dims, (r + 1) * grid.dims)), []).append((v, p[f]))
            for members in cells.values():
                while members:
                    part, todo = [], [members.pop()]
                    while todo:
                        one = todo.pop()
                        part.append(one[0])
                        near = [m for m in members if (m[1] ^ one[1]).bit_count() <= grid.distance]
                        members = [m for m in members if m not in near]
                        todo += near
                    if len(part) > 1:
                        found.add(frozenset(part))
    return found


def test_candidates_come_from_fingerprints(spark, monkeypatch):
    """Groups are those of the fingerprints' cells, Manhattan bound and Hamming distance, counted plainly; small sets have more of them."""
    texts = []
    for s in range(12):
        base = prose((9, 40, 120)[s % 3], s, 4000)
        for edits in range(6):
            ws = list(base)
            for k in random.Random(10 * s + edits).sample(range(len(ws)), edits):
                ws[k] = f"new{k}"
            texts.append(" ".join(ws))
    grid = similar.grid_for(len(texts))._replace(fingerprints=3)
    own = similar.signatures(docs(spark, texts), grid=grid).orderBy("doc_id").collect()
    prints = [brute_prints(t, 6 if r.n <= similar.SMALL else 3) for t, r in zip(texts, own)]
    assert [bytes(r.fps) for r in own] == [b"".join(x.to_bytes(16, "little") for x in p) for p in prints]
    want = brute_groups([r.vertex for r in own], prints, grid)
    assert {len(g) for g in want} > {2, 3}
    table = spark.createDataFrame([(r.vertex, r.n, r.fps) for r in own], "vertex long, n long, fps binary")

    def got():
        found = {}
        for r in similar.groups(table, grid).collect():
            found.setdefault(r.key, set()).add(r.vertex)
        return {frozenset(g) for g in found.values()}

    assert got() == want
    monkeypatch.setattr(similar, "CELL_ROWS", 2)  # dealt in slices: no pair of neighbours is lost
    dealt = got()
    near = {frozenset(p) for g in want for p in combinations(sorted(g), 2)}
    words = {r.vertex: p for r, p in zip(own, prints)}
    close = {p for p in near if any((a ^ b).bit_count() <= grid.distance for a, b in zip(*(words[v] for v in p)))}
    for p in close:
        alone = brute_groups(sorted(p), [words[v] for v in sorted(p)], grid)
        assert not alone or any(p <= g for g in dealt)
    assert all(any(g <= w for w in want) for g in dealt)


def test_share_of_groups():
    """Sets at 0.8 share a cell in which their fingerprints are near, whatever their sizes and the number of documents; others do not."""
    r = np.random.default_rng(2)
    for n in (0, 20_000_000):
        grid = similar.grid_for(n)
        for both, one, other, least in ((4, 1, 0, 1), (8, 1, 1, 1), (20, 2, 3, 1), (23, 2, 3, 1), (80, 10, 10, 1), (400, 50, 50, 1), (400, 100, 0, 1), (50, 400, 400, 0)):
            for _ in range(40):
                c, a, b = (r.integers(0, 1 << 63, k, np.uint64) for k in (both, one, other))
                count = grid.fingerprints * (1 + (both + max(one, other) <= similar.SMALL))
                x, y = (similar.fingerprints(np.concatenate([c, z]), count) for z in (a, b))
                same = np.equal(*similar.cell_keys(np.stack([x, y]), grid.dims)).reshape(count, -1)
                near = np.bitwise_count(x ^ y).sum(1) <= grid.distance
                assert (same & near[:, None]).any() == bool(least)


def test_grid_follows_the_number_of_documents():
    """Chance brings bounded numbers to a cell; the share of the cells that two sets at the similarity need grows slower than that."""
    grids = [similar.grid_for(n) for n in (10**5, 10**6, 10**7, 10**8)]
    assert grids[0] == grids[1] == similar.grid_for(0)
    assert all(n * (3 / 8) ** g.dims <= similar.MATES for n, g in zip((10**5, 10**6, 10**7, 10**8), grids))
    cells = [g.fingerprints * (similar.SEGMENTS // g.dims) for g in grids]
    assert cells[0] < 100 and cells[3] < 100 * 10**0.8
    assert similar.grid_for(0, 1.0).fingerprints == 1
