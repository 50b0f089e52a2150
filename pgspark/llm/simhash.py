"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such vectors is a lower bound of the Hamming distance,
so fingerprints within ``distance`` bits lie within ``distance`` in the
embedding. The segments are dealt to ``blocks`` blocks; as a distance of at most
``distance`` touches at most that many blocks, two linked fingerprints agree in
all counts of ``blocks - distance`` blocks. Every choice of so many blocks gives
one cell per fingerprint of a grid of unit width in the chosen dimensions; points
that agree in those need no neighbouring cells, of which a grid in all 32 would
have thousands. Within a cell candidates pass the Manhattan bound over all 32
counts and are then verified by the exact Hamming distance. More blocks make more
and emptier cells, so their number follows the number of fingerprints.

Equal fingerprints are one vertex from the start. A cell yields links that
connect its members as the exact links do (a spanning forest), never all pairs;
a cell above ``cell_rows`` is dealt as pairs of slices, each its own group.
Components come from star contraction, with each round written to the shared
folder.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with null id get the component of their fingerprint's smallest id
(null if there is none); repeated rows get the same result each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.llm import similar
from pgspark.llm.common import ASCII_LOWER, SEED, components, materialise, unary_counts

SHINGLE, DISTANCE, CELL_ROWS = 4, 4, 4096
#: Blocks to choose from, and the candidates that chance may bring a fingerprint before more blocks are taken.
LEAST_BLOCKS, MOST_BLOCKS, CANDIDATES = 3, 8, 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text: majority of the bits of its shingles' hashes."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= shingle:
        slices = [joined]
    else:
        slices = [joined[a : b - 1] for a, b in zip([0, *ends], ends[shingle - 1 :])]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(slices)
    for a in range(0, n, 1 << 16):
        part = slices[a : a + (1 << 16)]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of the fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The embedding: the bit counts of the 32 two-bit segments, two bits each in one long."""
    low = F.lit(0x5555555555555555).cast("long")
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # the sum of two bits, without carries between segments


def _edges(blocks: int) -> list[int]:
    """Where the blocks of the 32 segments begin and end."""
    return [round(32 * i / blocks) for i in range(blocks + 1)]


def chance_candidates(n: int, distance: int, blocks: int) -> float:
    """How many of ``n`` unrelated fingerprints meet one in its cells: a segment's counts agree with a chance of 3/8."""
    sizes = [b - a for a, b in zip(_edges(blocks), _edges(blocks)[1:])]
    return n * sum((3 / 8) ** sum(chosen) for chosen in combinations(sizes, blocks - distance))


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The least number of blocks that keeps chance candidates of ``n`` fingerprints below ``CANDIDATES`` each."""
    tried = range(distance + LEAST_BLOCKS, distance + MOST_BLOCKS + 1)
    return next((b for b in tried if chance_candidates(n, distance, b) <= CANDIDATES), tried[-1])


def cells(vertices: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(cell, fp, rep): a row for each vertex and choice of ``blocks - distance`` blocks."""
    edges = _edges(blocks)
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - distance)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(chosen)])
    counted = vertices.select("fp", "rep", segment_counts(F.col("fp")).alias("counts"))
    return counted.select("fp", "rep", F.explode(keys).alias("c")).select(F.struct("c.choice", "c.key").alias("cell"), "fp", "rep")


def _forest(fps: np.ndarray, reps: np.ndarray, slices: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the exact links within the group connect.

    ``slices`` marks two sides of a dealt cell: a pair of slices compares across.
    """
    n = len(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = np.ascontiguousarray(fps).view(np.uint64)
    counts = unary_counts(bits)
    links = []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        b = min(n, a + step)
        i, j = np.nonzero(np.bitwise_count(counts[a:b, None] ^ counts[None, a:]) <= distance)  # the Manhattan bound
        i, j = i + a, j + a
        near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= distance)
        if slices is not None:
            near &= slices[i] != slices[j]
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                links.append((int(reps[x]), int(reps[y])))
    return links


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def links(vertices: DataFrame, distance: int = DISTANCE, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): links between representatives with the components of the exact links."""
    blocks = blocks or blocks_for(vertices.count(), distance)
    dealt = materialise(cells(vertices, distance, blocks), "simhash-cells")
    half = cell_rows // 2
    hot = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / half).cast("int").alias("k"))
    sized = dealt.join(hot, "cell", "left")
    # A row of a dealt cell is in slice s of k and goes to all pairs of slices with s; within a slice the pair (s, s).
    own = F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1)).cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), lambda t: F.struct(F.least(F.col("own"), t).alias("a"), F.greatest(F.col("own"), t).alias("b")))
    rows = sized.withColumn("own", own).select("cell", "fp", "rep", "own", F.explode(pairs).alias("pair"))
    grouped = rows.select(F.xxhash64("cell.choice", "cell.key", "pair.a", "pair.b").alias("place"), "cell.choice", "cell.key", "pair.a", "pair.b", "own", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray, last: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
            """Links of the whole groups in ``rows``, and the rows of the last group unless it is whole too."""
            edges = np.concatenate([[0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1, [rows.shape[1]]])
            if not last:
                edges, rest = edges[:-1], rows[:, edges[-2] :]
            else:
                rest = rows[:, :0]
            out = []
            for k in np.flatnonzero(np.diff(edges) > 1):
                g = rows[:, edges[k] : edges[k + 1]]
                out += _forest(g[4], g[5], g[6] if g[2, 0] != g[3, 0] else None, distance)
            return out, rest

        rest = np.zeros((7, 0), np.int64)
        for b in batches:
            rows = np.stack([b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "key", "a", "b", "fp", "rep", "own")])
            out, rest = linked(np.concatenate([rest, rows], axis=1), last=False) if b.num_rows else ([], rest)
            yield _pairs(out)
        if rest.shape[1]:
            yield _pairs(linked(rest, last=True)[0])

    placed = grouped.repartition("place").sortWithinPartitions("place", "choice", "key", "a", "b", "fp")
    return placed.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    own = materialise(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-fp")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    vertices = classes.where("rep IS NOT NULL")
    roots = components(links(vertices, distance, blocks, cell_rows), "simhash-components")
    of_class = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float | None = None, **options: int) -> DataFrame:
    """``docs`` without near-duplicates: the smallest id of each component stays, once.

    With ``similarity``, texts link by the Jaccard similarity of their shingle
    sets instead of by ``distance``: at 0.8 fingerprints are some ten bits apart,
    where no grid over 64 bits prunes, so ``similar`` takes candidates from grids
    over several fingerprints of 128 bits and verifies them by their sets.
    Rows with null id cannot be told apart and stay.
    """
    if similarity is not None:
        return similar.keep_one(docs, similarity=similarity, **options)
    found = near_duplicates(docs, **options)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's rows."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))
