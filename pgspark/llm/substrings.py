"""Exact substring deduplication with fixed-block anchors.

Words are hashed to 64 bits and windows to polynomial sums of them. Every
document is cut into non-overlapping reference blocks of ``block`` words; the
rolling windows of the same length in every document probe that index. As
``window >= 2 * block - 1``, each repeated window holds a whole reference block
of its earlier copy, so every repeat has an anchor. Around the anchors all
windows of ``window`` words, of both the earlier and the later document, are
compared whole, by 64 hash bits and the bucket's bits of a second hash: two
different windows pass for equal with a chance of 2^-(64 + bits), bits being 11 at
least. Runs of equal windows are the hits extended to maximal repeats.

Anchors, probes and windows travel packed, many to a row, to hash buckets whose
number follows the size of the input. What documents of one chunk share is
settled in the chunk: only its smallest document asks the bucket, the others are
answered at once. So a window that a third of all documents share adds one entry
for each chunk of ``CHUNK_WORDS`` words to its bucket, however many documents
hold it; no pairs are made.

Defined results: a null text has no words; a row with null id neither loses
words nor counts as an earlier document; rows of equal id do not compare with
each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, BLOCK = 50, 25
CHUNK_WORDS = 1 << 19  # words that a task holds hashed at a time
CHARS_PER_BUCKET, LEAST_BUCKETS = 1 << 24, 1 << 10
#: Odd multipliers of the two polynomials, and of the final mixing.
MULTIPLIERS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
MIX = np.uint64(0xFF51AFD7ED558CCD)
PACKED = "bucket int, first long, hashes binary, gaps binary, block_hashes binary, block_docs binary"


class _WordHash(dict):
    """64-bit hash of a word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class _Rolling:
    """Hashes of all windows of one length over an array of word hashes."""

    def __init__(self, multiplier: int):
        self.m, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.p = self.q = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, size: int) -> np.ndarray:
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        if len(self.p) < n:
            k = max(n, 2 * len(self.p))
            self.p, self.q = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(k, x, np.uint64))]) for x in (self.m, self.inverse))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.p[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.q[: n - size + 1]
        h ^= h >> np.uint64(29)
        h *= MIX
        return h ^ (h >> np.uint64(32))


class _Chunk:
    """Some whole documents: their words, word hashes and the document of each word."""

    def __init__(self, ids: list, words: list[list[bytes]], more: list, hashed: _WordHash):
        self.ids, self.words, self.codes = ids, words, more
        lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.hashes = np.fromiter((hashed[w] for ws in words for w in ws), np.uint64, int(self.starts[-1]))
        self.of = np.repeat(np.arange(len(words)), lengths)

    def positions(self, size: int) -> np.ndarray:
        """Where a window of this size lies within one document that has an id."""
        n = len(self.of) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        named = np.array([x is not None for x in self.ids], bool)
        first = self.of[:n]
        return np.flatnonzero((first == self.of[size - 1 :]) & named[first])

    def doc_ids(self, at: np.ndarray) -> np.ndarray:
        return np.array([x or 0 for x in self.ids], np.int64)[self.of[at]]


def _chunks(batches: Iterator[pa.RecordBatch], codes: bool = False, marked_only: bool = False) -> Iterator[_Chunk]:
    """Chunks of (doc_id, text) rows, with each document's codes; ``marked_only`` passes over documents without codes."""
    hashed = _WordHash()
    ids, words, more, n = [], [], [], 0
    for batch in batches:
        values, offsets = (batch["codes"].values.to_numpy().view(np.uint64), batch["codes"].offsets.to_numpy()) if codes else (None, None)
        for i, (doc, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"])):
            own = values[offsets[i] : offsets[i + 1]] if codes else ()
            if marked_only and not len(own):
                continue
            ws = (text.as_py() or "").encode().split()  # bytes split at exactly the six ASCII characters
            ids.append(doc)
            words.append(ws)
            more.append(own)
            n += len(ws)
            if n >= CHUNK_WORDS:
                yield _Chunk(ids, words, more, hashed)
                ids, words, more, n = [], [], [], 0
    if ids:
        yield _Chunk(ids, words, more, hashed)


def _packed(buckets: np.ndarray, hashes: np.ndarray, docs: np.ndarray, n_buckets: int, blocks: tuple | None = None) -> pa.RecordBatch:
    """One row for each bucket: its hashes, and their documents as gaps from the first."""
    by_doc = np.argsort(docs, kind="stable")
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32
    order = by_doc[np.argsort(buckets[by_doc].astype(kind), kind="stable")]
    buckets, hashes, docs = buckets[order], hashes[order], docs[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    edges = np.concatenate([[0], cuts, [len(buckets)]]) if len(buckets) else np.zeros(1, np.int64)
    rows: dict[int, list] = {}
    for a, b in zip(edges[:-1], edges[1:]):
        gaps = np.diff(docs[a:b])
        top = int(gaps.max(initial=0))
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
        rows[int(buckets[a])] = [int(docs[a]), hashes[a:b].tobytes(), gaps.astype(width).tobytes(), None, None]
    if blocks is not None:
        bucket, h, d = blocks
        order = np.argsort(bucket, kind="stable")
        bucket, h, d = bucket[order], h[order], d[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        edges = np.concatenate([[0], cuts, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            rows.setdefault(int(bucket[a]), [0, b"", b"", None, None])[3:] = [h[a:b].tobytes(), d[a:b].tobytes()]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ["bucket", "first", "hashes", "gaps", "block_hashes", "block_docs"]
    columns = [list(rows)] + [[r[i] for r in rows.values()] for i in range(5)]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _local(docs: np.ndarray, codes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Answers found in a chunk, as a row of a bucket of their own beyond the others."""
    bucket = n_buckets + int.from_bytes(os.urandom(3), "little") if len(docs) else None
    row = [bucket, 0, b"", b"", codes.astype(np.uint64).tobytes(), docs.astype(np.int64).tobytes()]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ["bucket", "first", "hashes", "gaps", "block_hashes", "block_docs"]
    return pa.record_batch([pa.array([x] if len(docs) else [], k) for x, k in zip(row, kinds)], names=names)


def _grouped(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions sorted by hash, then document; start of each hash's run; number of the run of each)."""
    order = np.argsort(docs, kind="stable")
    order = order[np.argsort(h[order], kind="stable")]
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _docs_of(first: int, gaps: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    out[0] = first
    if n > 1:
        out[1:] = np.frombuffer(gaps, f"u{len(gaps) // (n - 1)}").astype(np.int64)
    return np.cumsum(out)


def _buckets(batches: Iterator[pa.RecordBatch], kind: type, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket by bucket of a sorted partition: hashes, documents, block hashes, block documents.

    From ``n_buckets`` on the last two are answers found in a chunk: codes and documents.
    """
    now, held = None, []

    def gathered() -> tuple:
        hashes = [np.frombuffer(r[2], kind) for r in held]
        docs = [_docs_of(r[1], r[3], len(h)) for r, h in zip(held, hashes)]
        return now, np.concatenate(hashes), np.concatenate(docs), np.concatenate([np.frombuffer(r[4] or b"", kind if now < n_buckets else np.uint64) for r in held]), np.concatenate([np.frombuffer(r[5] or b"", np.int64) for r in held])

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("bucket", "first", "hashes", "gaps", "block_hashes", "block_docs"))):
            if row[0] != now and held:
                yield gathered()
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield gathered()


def _answers(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for docs, codes in found:
        if len(docs):
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(codes.view(np.int64), pa.int64())], names=["doc_id", "code"])


def _code(buckets: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (buckets.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def _shuffled(packed: DataFrame) -> DataFrame:
    """Rows of a bucket together and in order; many buckets share a partition."""
    return packed.repartition("bucket").sortWithinPartitions("bucket", "first")


def anchors(docs: DataFrame, bits: int, block: int) -> DataFrame:
    """(doc_id, code): for every document the windows that hit another's reference block, or its blocks that were hit.

    The document with the smaller id is the reference. Codes hold the bucket
    and 32 bits of the hash, 32 + ``bits`` in all; the exact comparison follows.
    A window that several documents of a chunk hold is an anchor for all of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(MULTIPLIERS[0])
        for chunk in _chunks(batches):
            at = chunk.positions(block)
            h, d = rolling(chunk.hashes, block)[at], chunk.doc_ids(at)
            is_block = (at - chunk.starts[chunk.of[at]]) % block == 0
            h = _code(h >> np.uint64(64 - bits), h & np.uint64(0xFFFFFFFF))
            order, runs, run = _grouped(h, d)
            ends = np.append(runs[1:], len(order))[: len(runs)] - 1
            many = d[order[runs]] != d[order[ends]] if len(runs) else np.zeros(0, bool)
            yield _local(d[order[many[run]]], h[order[many[run]]], 1 << bits)
            # The largest document stands for all that probe, the smallest with a block for all references.
            probe, held = order[ends], order[is_block[order]]
            held = held[np.append(True, h[held[1:]] != h[held[:-1]])[: len(held)]]
            bucket, low = (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield _packed(bucket[probe], low[probe], d[probe], 1 << bits, (bucket[held], low[held], d[held]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for bucket, probes, probe_docs, blocks, block_docs in _buckets(batches, np.uint32, 1 << bits):
                if bucket >= 1 << bits:
                    yield block_docs, blocks
                    continue
                if not len(blocks):
                    continue
                known, inverse = np.unique(blocks, return_inverse=True)
                least = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, block_docs)
                slot = np.minimum(np.searchsorted(known, probes), len(known) - 1)
                hit = known[slot] == probes
                slot, later, low = slot[hit], probe_docs[hit], probes[hit]
                most = np.full(len(known), np.iinfo(np.int64).min)
                np.maximum.at(most, slot, later)
                query = least[slot] < later
                reference = most[inverse] > block_docs
                both_d = np.concatenate([later[query], block_docs[reference]])
                both_c = np.concatenate([low[query], blocks[reference]])
                code = _code(np.full(len(both_c), bucket), both_c)
                pairs = np.unique(np.stack([both_d.view(np.uint64), code]), axis=1) if len(code) else np.zeros((2, 0), np.uint64)
                yield pairs[0].view(np.int64), pairs[1]

        yield from _answers(found())

    return _shuffled(docs.mapInArrow(send, PACKED)).mapInArrow(meet, "doc_id long, code long")


def _covered(marks: np.ndarray, size: int) -> np.ndarray:
    """Which of ``len(marks)`` words a marked window start covers."""
    n = len(marks)
    ends = np.zeros(n + size + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + size, -1)
    return np.cumsum(ends[:n]) > 0


def repeats(marked: DataFrame, bits: int, window: int, block: int) -> DataFrame:
    """(doc_id, code): first hashes of the windows that also start in a document with a smaller id.

    Only windows that hold an anchor travel; the others cannot be repeats.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block, first, second = _Rolling(MULTIPLIERS[0]), _Rolling(MULTIPLIERS[0]), _Rolling(MULTIPLIERS[1])
        for chunk in _chunks(batches, codes=True, marked_only=True):
            h = by_block(chunk.hashes, block)
            code = _code(h >> np.uint64(64 - bits), h & np.uint64(0xFFFFFFFF))
            near = np.zeros(len(chunk.of) + 1, bool)
            for i in range(len(chunk.ids)):
                if len(chunk.codes[i]):
                    a, b = chunk.starts[i], max(chunk.starts[i], chunk.starts[i + 1] - block + 1)
                    hit = np.isin(code[a:b], chunk.codes[i])
                    # A window starting at q holds the anchor at p for p - (window - block) <= q <= p.
                    near[a:b] = _covered(hit[::-1], window - block + 1)[::-1]
            at = chunk.positions(window)
            at = at[near[at]]
            if not len(at):
                continue
            bucket, h, d = (second(chunk.hashes, window)[at] >> np.uint64(64 - bits)).astype(np.int64), first(chunk.hashes, window)[at], chunk.doc_ids(at)
            order, runs, run = _grouped(h, d)
            least = order[runs]
            later = order[d[order] > d[least][run]]
            yield _local(d[later], h[later], 1 << bits)
            yield _packed(bucket[least], h[least], d[least], 1 << bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for bucket, hashes, docs, codes, code_docs in _buckets(batches, np.uint64, 1 << bits):
                if bucket >= 1 << bits:
                    yield code_docs, codes
                    continue
                known, inverse = np.unique(hashes, return_inverse=True)
                least = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, docs)
                later = least[inverse] < docs
                yield docs[later], hashes[later]

        yield from _answers(found())

    return _shuffled(marked.mapInArrow(send, PACKED)).mapInArrow(meet, "doc_id long, code long")


def _with_codes(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """The same left join for both rounds, so that Spark shuffles the texts once and reuses them."""
    gathered = codes.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    return docs.join(gathered, "doc_id", "left").select("doc_id", "text", "codes")


def find_repeats(docs: DataFrame, window: int = WINDOW, block: int | None = None) -> DataFrame:
    """(doc_id, n_words, spans, kept): word spans of the maximal repeats to drop, and the text that is left.

    ``spans`` are [start, end) word positions of windows that also start in a
    document with a smaller id, united; windows are judged on the input.
    """
    block = block or (window + 1) // 2
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS, chars // CHARS_PER_BUCKET).bit_length()
    marked = _with_codes(docs, anchors(docs, bits, block))
    judged = _with_codes(docs, repeats(marked, bits, window, block))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _Rolling(MULTIPLIERS[0])
        for chunk in _chunks(batches, codes=True):
            h = first(chunk.hashes, window)
            spans, kept = [], []
            for i, words in enumerate(chunk.words):
                drop = np.zeros(len(words), bool)
                if len(chunk.codes[i]) and len(words) >= window:
                    a = chunk.starts[i]
                    marks = np.zeros(len(words), bool)
                    marks[: len(words) - window + 1] = np.isin(h[a : a + len(words) - window + 1], chunk.codes[i])
                    drop = _covered(marks, window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                spans.append(edge.tolist())
                kept.append(b" ".join([w for w, d in zip(words, drop) if not d] if len(edge) else words).decode())
            yield pa.record_batch([pa.array(chunk.ids, pa.int64()), pa.array([len(w) for w in chunk.words], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return judged.mapInArrow(finish, "doc_id long, n_words long, spans array<int>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's rows; ``spans`` alternates starts and ends."""
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return found.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Windows as text: fine at the size of the oracle's tables.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
dup AS (SELECT DISTINCT win.doc_id, i FROM win JOIN least USING (s) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM dup, range(0, 50) r(k)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
