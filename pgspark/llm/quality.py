"""Quality rules and distribution divergence.

Per language, one pass over all documents sums two histograms: of character
classes, and of the language's common words against all others. Every document
is then compared with the references of its language by Jensen-Shannon distance
(base 2, from 0 to 1). A document is rejected if either distance or their sum
exceeds its limit; texts below the minimum lengths are not judged by a histogram, as theirs
is mostly noise. The plain rules (too few words, repeated 3-word windows) reject
first.

References use only documents that pass the plain rules, have at most one symbol
in a hundred word characters and fewer than one upper-case letter in five, so
that rejected kinds of text do not shape what they are compared with. They are a few hundred
numbers at any size; nothing else goes through the driver, and no row moves.

Defined results: a null or empty text has no words and fails; a null or unknown
language is judged by the sum of all references; repeated rows get equal
results; extra columns stay (``keep_good``) or are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common words of the languages that have a reference of their own.
COMMON = {
    "en": "the of and to a in is that for it was on be with as by at this are or from an not he his which but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
#: The symbols of the plain rules.
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Limits of the two distances and of their sum, and the lengths from which they are used.
CLASS_LIMIT, WORD_LIMIT, SUM_LIMIT, MIN_CHARS, MIN_COMMON_WORDS = 0.30, 0.45, 0.455, 200, 50


def _class_table() -> np.ndarray:
    """Class of each code point below 0x250; beyond, letters count as lower case by ``_classes``."""
    table = np.full(0x250, CLASSES.index("other"), np.int8)
    for c in range(0x250):
        x = chr(c)
        name = "lower" if x.islower() else "upper" if x.isupper() else "digit" if x.isdigit() else "space" if x.isspace() else "stop" if x in ".,;:!?'\"()-¿¡" else "symbol" if 32 < c < 127 else None
        if name:
            table[c] = CLASSES.index(name)
    return table


_TABLE = _class_table()
_LINE = re.compile(r"[^\x20\x09-\x0D]")


def class_histogram(text: str) -> np.ndarray:
    """Counts of the character classes of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = points < len(_TABLE)
    counts = np.bincount(_TABLE[points[near]], minlength=len(CLASSES))
    far = points[~near]
    letters = sum(chr(c).isalpha() for c in far.tolist())
    counts[CLASSES.index("lower")] += letters
    counts[CLASSES.index("other")] += len(far) - letters
    return counts


def plain_counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words) of one text."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII characters
    n = len(words)
    white = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if _LINE.search(x)]
    repeats = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(windows[2][windows[1]] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[twice + k] = True
        repeats = int(covered.sum())
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeats, words


def fails_plain(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def word_histogram(words: list[bytes], common: list[str]) -> np.ndarray:
    """Counts of the common words, and of all others together."""
    counts = Counter(words)
    got = [0] * len(common)
    for i, w in enumerate(common):
        got[i] = counts[w.encode()] + counts[w.capitalize().encode()]
    return np.array([*got, len(words) - sum(got)])


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance (root of the base-2 divergence) of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


class References:
    """Histograms of each language, and of all together for texts of no known language."""

    def __init__(self, sums: dict[str, tuple[list[int], list[int]]]):
        self.classes = {k: np.array(v[0]) for k, v in sums.items()}
        self.words = {k: np.array(v[1]) for k, v in sums.items() if k in COMMON}
        self.all = sum(self.classes.values()) if sums else np.zeros(len(CLASSES))

    def distances(self, lang: str | None, text: str, words: list[bytes]) -> tuple[float, float]:
        """Distances of the two histograms; 0 where the text is too short or its language has no reference."""
        of_classes = jensen_shannon(class_histogram(text), self.classes.get(lang, self.all)) if len(text) >= MIN_CHARS else 0.0
        common = self.words.get(lang) if len(words) >= MIN_COMMON_WORDS else None
        return of_classes, jensen_shannon(word_histogram(words, COMMON[lang]), common) if common is not None else 0.0


def references(docs: DataFrame) -> References:
    """Sums of the histograms of all documents that pass the plain rules: one row for each language and task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                n, chars, symbols, _, repeats, words = plain_counts(text := text.as_py() or "")
                classes = class_histogram(text)
                if fails_plain(n, repeats) or 100 * symbols > chars or 5 * classes[1] > classes[0] + classes[1]:
                    continue
                lang = lang if lang in COMMON else "other"
                own = sums.setdefault(lang, [np.zeros(len(CLASSES), np.int64), np.zeros(len(COMMON.get(lang, [])) + 1, np.int64)])
                own[0] += classes
                own[1] += word_histogram(words, COMMON.get(lang, []))
        flat = [(lang, kind, at, int(n)) for lang, own in sums.items() for kind, h in enumerate(own) for at, n in enumerate(h)]
        yield pa.record_batch([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "kind", "at", "n"])

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, kind int, at int, n long")
    totals = parts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    rows = totals.groupBy("lang", "kind").agg(F.collect_list(F.struct("at", "n")).alias("h")).collect()  # at most 10 rows
    sums: dict[str, list] = {}
    for r in rows:
        sums.setdefault(r["lang"], [[], []])[r["kind"]] = [x["n"] for x in sorted(r["h"], key=lambda x: x["at"])]
    return References({k: (v[0], v[1]) for k, v in sums.items()})


RESULT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "class_distance": "double", "word_distance": "double"}


def judge(text: str | None, lang: str | None, reference: References) -> tuple:
    """The values of RESULT for one document."""
    n, chars, symbols, dup, repeats, words = plain_counts(text := text or "")
    failed = fails_plain(n, repeats)
    of_classes, of_words = reference.distances(lang if lang in COMMON else "other", text, words)
    kept = not failed and of_classes <= CLASS_LIMIT and of_words <= WORD_LIMIT and of_classes + of_words <= SUM_LIMIT
    return n, chars, symbols, dup, repeats, failed, kept, of_classes, of_words


def assess(docs: DataFrame, reference: References | None = None) -> DataFrame:
    """(doc_id, the columns of RESULT) of every row; no shuffle."""
    reference = reference or references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), lang, reference) for t, lang in zip(b["text"], b["lang"].to_pylist())]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            columns = [pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(RESULT.values())]
            yield pa.record_batch([b["doc_id"], *columns], names=["doc_id", *RESULT])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {t}" for k, t in RESULT.items()))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a rule or a distance rejects; all columns stay."""
    reference = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), lang, reference)[6] for t, lang in zip(b["text"], b["lang"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
