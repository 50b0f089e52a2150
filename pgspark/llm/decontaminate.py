"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are lower-cased with white space squeezed to single spaces.
An item of m characters may differ from a passage by k = floor(rate * m) edits.
Cut into k + 1 pieces, at least one piece stands unchanged in every passage
within k edits, so all pieces of a block of items are looked up in one pass over
each text (Aho-Corasick). A hit is verified with Myers' bit-parallel distance,
first over the two, four, ... pieces around it: by the same pigeonhole some exact
piece lies in a pair of pieces with at most one edit, in a four with at most
three, and so on up to the whole item, so chance hits end after a few characters.

The benchmark is a stated query set: it is taken in blocks of at most
``block_chars`` characters (or one longer item), each one pass over all documents, so what a task
holds is bounded at any size of the benchmark.

An item shorter than ``exact_below`` characters gets no error budget and has to
stand as whole words: with edits, chance would match it.

The items of all blocks pass through the driver, which is what a stated query set
means here: the benchmark is bounded by the driver, the documents by nothing.

Defined results: null and empty texts and items match nothing; repeated documents
or items each give their rows; a null item id is reported as null; extra columns
are ignored (``hits``) or stay (``clean``); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

RATE, EXACT_BELOW, BLOCK_CHARS = 0.10, 40, 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors`` + 1 pieces of almost equal length."""
    n = errors + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """A text to look for, ready for Myers' algorithm."""

    def __init__(self, text: str):
        self.m = len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << len(text)) - 1, 1 << (len(text) - 1)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the least edit distance of the pattern to any substring, and where that ends first."""
        up, down, score, full, top, get = self.full, 0, self.m, self.full, self.top, self.masks.get
        best, end = self.m, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | ~(horizontal | up) & full
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            if score < best:
                best, end = score, j
            plus = plus << 1 & full  # a match may begin anywhere in the text
            minus = minus << 1 & full
            up = minus | ~(vertical | plus) & full
            down = plus & vertical
        return best, end


class Item:
    """One benchmark item, its pieces, and patterns of runs of its pieces, made when first needed."""

    def __init__(self, item_id: object, text: str, errors: int, whole_words: bool = False):
        self.item_id, self.text, self.errors, self.whole_words = item_id, text, errors, whole_words
        self.pieces = pieces(text, errors)
        self.edges = [at for at, _ in self.pieces] + [len(text)]
        self.patterns: dict[tuple[int, int], Pattern] = {}

    def pattern(self, low: int, high: int) -> Pattern:
        if (low, high) not in self.patterns:
            self.patterns[low, high] = Pattern(self.text[self.edges[low] : self.edges[high]])
        return self.patterns[low, high]

    def runs(self, piece: int) -> list[tuple[int, int]]:
        """Runs of pieces around one, by halving: from the smallest to the largest below the whole."""
        low, high, out = 0, len(self.pieces), []
        while high - low > 2:
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
            if high - low > 1:
                out.append((low, high))
        return out[::-1]

    def may_match(self, text: str, piece: int, start: int) -> bool:
        """Whether every run around the hit is within its budget; ``start``: where the item would begin."""
        if self.whole_words:
            end = start + len(self.text)
            return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())
        for low, high in self.runs(piece):
            errors = high - low - 1
            a, b = max(0, start + self.edges[low] - errors), max(0, start + self.edges[high] + errors)
            if self.pattern(low, high).best(text[a:b])[0] > errors:
                return False
        return True


class Matcher:
    """All pieces of one block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float, exact_below: int = EXACT_BELOW):
        self.items = [Item(i, text, 0 if len(text) < exact_below else int(rate * len(text)), len(text) < exact_below) for i, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, item in enumerate(self.items):
            for i, (_, piece) in enumerate(item.pieces):
                places.setdefault(piece, []).append((p, i))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item within its error budget of a passage of the text."""
        text = normal(text)
        if not self.items or not text:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for p, i in where:
                item = self.items[p]
                start = end + 1 - size - item.edges[i]
                a, b = max(0, start - item.errors), min(len(text), start + len(item.text) + item.errors)
                spans = near.setdefault(p, [])
                if spans and spans[-1][0] <= a and b <= spans[-1][1]:
                    continue  # verified with the span
                if not item.may_match(text, i, start):
                    continue
                if spans and a <= spans[-1][1] and spans[-1][0] <= b:
                    spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        out = []
        for p, spans in near.items():
            item = self.items[p]
            best, where = item.errors + 1, 0
            for a, b in spans:
                distance, end = item.pattern(0, len(item.pieces)).best(text[a:b])
                if distance < best:
                    best, where = distance, a + end
            if best <= item.errors:
                out.append((item.item_id, best, where))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """Normalised items, in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): items found in documents; ``end`` is in the normalised text."""
    item = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, end int"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, exact_below)
            for b in batches:
                rows = [(i, *h) for i, t in enumerate(b["text"]) for h in matcher.find(t.as_py())]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([b["doc_id"].take(at), *[pa.array([r[k] for r in rows], t) for k, t in ((1, item), (2, pa.int32()), (3, pa.int32()))]], names=["doc_id", "item_id", "distance", "end"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay and no row moves."""
    for block in item_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, exact_below)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t.as_py()) for t in b["text"]], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
