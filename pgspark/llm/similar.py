"""Near-duplicates by the Jaccard similarity of word shingles: SimHash candidates, each verified exactly.

The side of the SimHash operator that links by similarity instead of by distance.
A text is the set of its shingles of ``shingle`` words, lower-cased in ASCII. Texts
with equal sets are one vertex from the start. Two sets at a similarity of 0.8
differ in some 15 % of a fingerprint's bits, where no grid over one fingerprint of
64 bits prunes. So a set gets several fingerprints of 128 bits, each with its
embedding: the bit counts of its 64 two-bit segments. Runs of ``dims`` segments are
the dimensions of grids of unit width, and a set lies in one cell of each. Members
of a cell pass the Manhattan bound over all 64 counts and then the exact Hamming
distance; those that this connects are a group of candidates. There are as many
fingerprints as it takes for two sets at ``similarity`` to share no group with a
probability of at most ``MISS``, and ``dims`` follow the number of documents.

Candidates are verified in two rounds. The first verifies each member of a group
against the group's smallest, so that groups with much in common give the same
pairs. The second compares all members that are still in different components, so
the components are those of all candidates; it compares in place, over slices of
bounded size, and no pair becomes a row. Near copies meet in many cells: sets that
groups connect are compared once, as one group, where that is no more work than
comparing within each of their groups. Verification compares the sets; nothing is
estimated.

Defined results: null and empty texts are equal to each other only; rows with null
id cannot be told apart and stay; of repeated ids one row stays; extra columns are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgspark.llm.common import ASCII_LOWER, SEED, components, discard, materialise, unary_counts

SHINGLE, SIMILARITY = 5, 0.8
#: Two-bit segments of a fingerprint, and the chance that two sets at the similarity share no group.
SEGMENTS, MISS = 64, 1e-6
#: Sets of up to so many hashes get twice the fingerprints, as bits that hang on one hash differ more often.
SMALL = 24
#: The least dimensions of a grid, the members that chance may bring to a cell before it gets more, and the rows above which a cell is dealt.
LEAST_DIMS, MATES, CELL_ROWS = 6, 8192, 1 << 15
#: Degrees above this are dealt by a broadcast list of the vertices concerned; there are at most rows / HOT of them.
HOT = 1024
#: Members, and shingles, of a slice of a cell.
SLICE_ROWS, SLICE_SHINGLES = 512, 1 << 19
_STEP, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Grid(NamedTuple):
    """Segments that a cell fixes, fingerprints of a set, and the Hamming distance up to which two of them make candidates."""

    dims: int
    fingerprints: int
    distance: int


def grid_for(n: int, similarity: float = SIMILARITY) -> Grid:
    """The grid for ``n`` documents.

    Two sets at ``similarity`` differ in a bit with the chance ``p`` of the angle
    between them; three standard deviations above its mean are the distance.
    A segment's counts agree by chance with 3/8.
    """
    p = max(acos(min(1.0, 2 * similarity / (1 + similarity))) / pi, 0.01)
    dims = LEAST_DIMS
    while dims < SEGMENTS and n * (3 / 8) ** dims > MATES:
        dims += 1
    meet = ((1 - p) ** 2 + p * p / 2) ** dims
    return Grid(dims, ceil(log(MISS) / log1p(-meet) / (SEGMENTS // dims)), int(2 * SEGMENTS * p + 3 * sqrt(2 * SEGMENTS * p * (1 - p))))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[-n:])), np.uint64, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def fingerprints(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` SimHash fingerprints of a set, two words each: majority of the bits of its hashes, mixed anew for each word."""
    salts = np.arange(1, 2 * count + 1, dtype=np.uint64) * _STEP
    ones = np.zeros(128 * count, np.int64)
    for a in range(0, len(hashes), 255):  # so many ones fit a byte
        mixed = _mixed(hashes[a : a + 255, None] + salts)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64).reshape(count, 2)


def cell_keys(found: np.ndarray, dims: int) -> np.ndarray:
    """The keys of the cells of sets: a column for each fingerprint of ``found`` (sets, fingerprints, 2) and run of ``dims`` segments."""
    runs = [((1 << 2 * dims) - 1) << 2 * dims * r for r in range(SEGMENTS // dims)]
    masks = np.array([[m & (1 << 64) - 1, m >> 64] for m in runs], np.uint64)
    fixed = unary_counts(found)[:, :, None, :] & masks
    place = np.arange(1, found.shape[1] * len(runs) + 1, dtype=np.uint64) * _STEP
    keys = (_mixed(fixed[..., 0]) + fixed[..., 1]).reshape(len(found), -1) + place
    return _mixed(keys).view(np.int64)


def band_keys(hashes: np.ndarray, grid: Grid = grid_for(0)) -> np.ndarray:
    """The keys of the cells of one set, by its fingerprints."""
    return cell_keys(fingerprints(hashes, grid.fingerprints)[None], grid.dims)[0]


def signatures(docs: DataFrame, shingle: int = SHINGLE, grid: Grid = grid_for(0)) -> DataFrame:
    """(doc_id, text_key, vertex, n, fps) of every row: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b["text"]]
            vertex = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = pa.array([fingerprints(s, grid.fingerprints * (1 + (len(s) <= SMALL))).tobytes() for s in sets], pa.binary())
            yield pa.record_batch([b["doc_id"], b["text_key"], pa.array(vertex), pa.array([len(s) for s in sets], pa.int64()), fps], names=["doc_id", "text_key", "vertex", "n", "fps"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return read.mapInArrow(run, "doc_id long, text_key long, vertex long, n long, fps binary")


def near_labels(words: np.ndarray, distance: int) -> np.ndarray:
    """A number for each fingerprint of (members, 2); equal for those that steps of at most ``distance`` bits connect."""
    n = len(words)
    label = np.arange(n)
    x, y = np.ascontiguousarray(unary_counts(words).T)
    step = max(16, (1 << 16) // n)
    for a in range(0, n, step):
        b = min(n, a + step)
        bound = np.bitwise_count(x[a:b, None] ^ x[None, a:]) + np.bitwise_count(y[a:b, None] ^ y[None, a:])  # the Manhattan distance
        i, j = np.divmod(np.flatnonzero(bound <= distance), n - a)
        i, j = i + a, j + a
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= distance
        i, j = i[near], j[near]
        edges = np.flatnonzero(np.diff(i, prepend=-1))
        for one, others in zip(i[edges], np.split(j, edges[1:])):
            if (label[others] != label[one]).any():
                joined = np.unique(np.append(label[others], label[one]))
                label[np.isin(label, joined)] = joined[0]
    return label


def groups(classes: DataFrame, grid: Grid) -> DataFrame:
    """(key, vertex, centre): groups of two or more of (vertex, n, fps) that share a cell and that the Hamming distance connects there.

    The centre is the smallest member. Groups with the same members are one. A cell beyond ``CELL_ROWS`` is dealt as
    pairs of slices, each with groups of its own. Empty sets have no cells.
    """
    held = classes.where("n > 0").select("vertex", "fps")
    runs, dims, distance = SEGMENTS // grid.dims, grid.dims, grid.distance

    def read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Vertices and fingerprints, by the number of fingerprints."""
        vertex, fps = b["vertex"].to_numpy(zero_copy_only=False), b["fps"].to_pylist()
        sizes = np.array([len(x) for x in fps])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield vertex[rows], np.frombuffer(b"".join(fps[k] for k in rows), np.uint64).reshape(len(rows), -1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, found in read(b):
                yield pa.record_batch([pa.array(x) for x in np.unique(cell_keys(found, dims), return_counts=True)], names=["key", "m"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)):
            for vertex, found in read(b):
                keys = cell_keys(found, dims)
                words = [np.repeat(found[..., w], runs, axis=1).ravel().view(np.int64) for w in (0, 1)]
                yield pa.record_batch([pa.array(x) for x in (keys.ravel(), np.repeat(vertex, keys.shape[1]), *words)], names=["key", "vertex", "x", "y"])

    hot = held.mapInArrow(count, "key long, m long").groupBy("key").agg(F.sum("m").alias("m")).where(F.col("m") > CELL_ROWS)
    hot = materialise(hot.select("key", F.ceil(F.col("m") / (CELL_ROWS / 2)).cast("int").alias("k")), "similar-hot")
    sized = held.mapInArrow(deal, "key long, vertex long, x long, y long").join(F.broadcast(hot), "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("vertex"), F.col("k").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.xxhash64("key", F.least(F.col("own"), t), F.greatest(F.col("own"), t)))
    rows = sized.withColumn("own", own).select(F.explode(pairs).alias("place"), "vertex", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped(rows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
            keys, members, centres = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                label = near_labels(np.ascontiguousarray(rows[2:, a:b].T).view(np.uint64), distance)
                if (label == np.arange(b - a)).all():
                    continue
                order = np.argsort(label, kind="stable")
                for part in np.split(rows[1, a:b][order], np.flatnonzero(np.diff(label[order])) + 1):
                    if len(part) > 1:
                        part = np.sort(part)
                        keys.append(np.full(len(part), xxhash.xxh64_intdigest(part.tobytes(), SEED), np.uint64).view(np.int64))
                        members.append(part)
                        centres.append(np.full(len(part), part[0]))
            return pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, members, centres)], names=["key", "vertex", "centre"])

        rest = np.zeros((4, 0), np.int64)
        for b in batches:
            rows = np.concatenate([rest, np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("place", "vertex", "x", "y")])], axis=1)
            edges = np.flatnonzero(np.diff(rows[0], prepend=rows[0, :1] + 1)) if rows.shape[1] else np.zeros(1, int)
            rest = rows[:, edges[-1] :]
            yield grouped(rows, edges)
        if rest.shape[1]:
            yield grouped(rest, np.array([0, rest.shape[1]]))

    found = materialise(rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "key long, vertex long, centre long").distinct(), "similar-groups")
    discard(hot)
    return found


def texts_of(vertices: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(vertex, text) of some vertices."""
    keys = classes.join(vertices.distinct(), "vertex", "left_semi").select("vertex", "text_key")
    found = docs.select(F.xxhash64("text").alias("text_key"), "text").join(keys.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
    return keys.join(found, "text_key").select("vertex", "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) of the pairs whose sets reach ``similarity``."""
    texts = materialise(texts_of(pairs.select(F.explode(F.array("u", "v")).alias("vertex")), classes, docs), "similar-texts")

    held = [texts]

    def beside(df: DataFrame, side: str) -> DataFrame:
        """``df`` with the text of one side; the text of a vertex in many pairs is dealt in copies."""
        often = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > HOT).select(F.col(side).alias("often"), F.ceil(F.col("d") / HOT).cast("int").alias("k"))
        often = materialise(often, "similar-often")
        held.append(often)
        dealt = df.join(F.broadcast(often), df[side] == F.col("often"), "left")
        dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("u", "v"), F.coalesce("k", F.lit(1)).cast("long")).cast("int")).drop("often", "k")
        copies = texts.join(F.broadcast(often), texts["vertex"] == F.col("often"), "left")
        copies = copies.select(F.col("vertex").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("copy"))
        return dealt.join(copies, [side, "copy"]).drop("copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for b in batches:
            near = []
            for u, v, tu, tv in zip(b["u"].to_pylist(), b["v"].to_pylist(), b["text_u"], b["text_v"]):
                if u != last:
                    last, one = u, shingles(tu.as_py(), shingle)
                other = shingles(tv.as_py(), shingle)
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both / (len(one) + len(other) - both) >= similarity:
                    near.append((u, v))
            yield pa.record_batch([pa.array([p[i] for p in near], pa.int64()) for i in (0, 1)], names=["u", "v"])

    full = beside(beside(pairs, "v"), "u").select("u", "v", "text_u", "text_v")
    found = materialise(full.mapInArrow(run, "u long, v long"), "similar-links")
    discard(*held)
    return found


def parts_of(edges: DataFrame) -> DataFrame:
    """(vertex, part) of all that (u, v), centre and member, connect; the smallest of a part included.

    A member has a centre for each of its cells at most. They meet at the smallest of
    them, which near copies share, so few different links are left to contract.
    """
    centres = edges.groupBy("v").agg(F.sort_array(F.collect_set("u")).alias("c"))
    linked = centres.select(F.get("c", F.lit(0)).alias("u"), F.explode(F.concat(F.array("v"), F.slice("c", 2, F.size("c")))).alias("v")).distinct()
    parts = components(linked, "similar-connected").select(F.col("node").alias("vertex"), F.col("root").alias("part"))
    return parts.union(parts.select(F.col("part").alias("vertex"), "part").distinct())


def unlinked(found: DataFrame, of_part: DataFrame) -> DataFrame:
    """(key, vertex, n, root): the groups within which members of different roots are still to be compared.

    ``of_part`` has (part, vertex, n, root), where the groups of ``found`` connect a
    part. A part is one group if it has no more pairs, and after dealing no more
    rows, than its groups have together; all pairs of these are among its own.
    """
    groups_of = found.groupBy("key", "centre").agg(F.count(F.lit(1)).alias("m")).join(of_part.select(F.col("vertex").alias("centre"), "part"), "centre")
    apart = groups_of.groupBy("part").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    whole = (F.col("m") * F.col("m") <= F.col("pairs")) & (F.col("m") * F.ceil(F.col("m") / SLICE_ROWS) <= F.col("rows"))
    mixed = of_part.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    chosen = materialise(mixed.join(apart, "part").select("part", whole.alias("whole")), "similar-chosen")
    placed = materialise(of_part.join(chosen, "part"), "similar-placed")
    by_group = materialise(found.join(placed.where("NOT whole"), "vertex").select("key", "vertex", "n", "root"), "similar-by-group")
    open_ = by_group.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    by_part = placed.where("whole").select(F.col("part").alias("key"), "vertex", "n", "root")
    members = materialise(by_part.unionByName(by_group.join(open_, "key", "left_semi")), "similar-members")
    discard(chosen, placed, by_group)
    return members


def _cell_links(sets: list[np.ndarray], vertices: list[int], roots: list[int], slices: list[int] | None, similarity: float) -> list[tuple[int, int]]:
    """Links that join what reaches ``similarity`` in one cell, between components only.

    A member of the cell's largest component is compared from the other side.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    part = np.unique(np.array(roots), return_inverse=True)[1]
    of_slice = np.array(slices) if slices is not None else None
    out = []
    for i in range(len(sets)):
        if part[i] == np.bincount(part).argmax():
            continue
        mark = np.zeros(len(known), bool)
        mark[place[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(mark[place], starts, dtype=np.int64)
        near = (both / (sizes[i] + sizes - both) >= similarity) & (part != part[i])
        if of_slice is not None:
            near &= of_slice != of_slice[i]
        for j in np.flatnonzero(near).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((vertices[i], vertices[j]))
    return out


def cell_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links within the cells of (key, vertex, n, root), between different roots.

    A cell beyond the size of a slice is dealt as pairs of slices, each its own group.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / SLICE_ROWS), F.ceil(F.col("total") / SLICE_SHINGLES)).cast("int")
    dealt = materialise(sizes.select("key", parts.alias("k")).where("k > 1"), "similar-dealt")
    sized = members.join(dealt, "key", "left").select("key", "vertex", "root", F.coalesce("k", F.lit(1)).alias("k"))
    own = F.pmod(F.xxhash64("vertex"), F.col("k").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.struct(F.least(F.col("own"), t).alias("a"), F.greatest(F.col("own"), t).alias("b")))
    rows = sized.withColumn("own", own).select("key", "vertex", "root", "own", F.explode(pairs).alias("pair"))
    full = rows.join(sets, "vertex").select(F.xxhash64("key", "pair.a", "pair.b").alias("place"), "key", "pair.a", "pair.b", "own", "vertex", "root", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            near = []
            if len(held) > 1:
                own, vertices, roots, hashes = zip(*held)
                near = _cell_links([np.frombuffer(h, np.uint64) for h in hashes], vertices, roots, own if now[1] != now[2] else None, similarity)
            return pa.record_batch([pa.array([p[i] for p in near], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            for key, x, y, *row in zip(*(b[c].to_pylist() for c in ("key", "a", "b", "own", "vertex", "root", "hashes"))):
                if (key, x, y) != now:
                    yield found()
                    now, held = (key, x, y), []
                held.append(row)
        yield found()

    links = materialise(full.repartition("place").sortWithinPartitions("place", "key", "a", "b").mapInArrow(run, "u long, v long").distinct(), "similar-cell-links")
    discard(dealt)
    return links


def hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """(vertex, hashes): the sets of (vertex, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["vertex"], pa.array([shingles(t.as_py(), shingle).tobytes() for t in b["text"]], pa.binary())], names=["vertex", "hashes"])

    return texts.mapInArrow(run, "vertex long, hashes binary")


def links(classes: DataFrame, docs: DataFrame, grid: Grid, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): links with the components of all candidate pairs that reach ``similarity``."""
    found = groups(classes, grid)
    edges = materialise(found.where("vertex <> centre").select(F.col("centre").alias("u"), F.col("vertex").alias("v")).distinct(), "similar-edges")
    first = verified(edges, classes, docs, shingle, similarity)
    roots = components(first, "similar-first").withColumnRenamed("node", "vertex")
    of_part = parts_of(edges).join(classes.select("vertex", "n"), "vertex").join(roots, "vertex", "left").select("part", "vertex", "n", F.coalesce("root", "vertex").alias("root"))
    of_part = materialise(of_part, "similar-parts")
    members = unlinked(found, of_part)
    sets = materialise(hashed(texts_of(members.select("vertex"), classes, docs), shingle), "similar-sets")
    rest = cell_links(members, sets, similarity)
    discard(found, edges, of_part, members, sets)
    return first.unionByName(rest)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: the smallest id of each component stays, once."""
    grid = grid_for(docs.count(), similarity)
    own = signatures(docs.select("doc_id", "text"), shingle, grid)
    classes = own.groupBy("vertex").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("fps").alias("fps"))
    classes = materialise(classes, "similar-classes").where("rep IS NOT NULL")
    roots = components(links(classes, docs, grid, shingle, similarity), "similar-components").withColumnRenamed("node", "vertex")
    keep = classes.join(roots, "vertex", "left").groupBy(F.coalesce("root", "vertex")).agg(F.min("rep").alias("_keep")).select("_keep").distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
