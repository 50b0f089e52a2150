"""BPE encoding and decoding by speculation and verification.

For every new word of a batch, greedy longest-match proposes tokens. A proposal
is the BPE result exactly if each token encodes to itself and every adjacent pair
is compatible, i.e. the pair's joined text encodes to the pair. Pairs are tested
with array look-ups over all words of the batch at once; a pair not seen before
is decided once by merging its joined text. Only words with a failing pair
undergo exact merging of the whole word.

The vocabulary file is a parameter; its normalisation (NFC, white space to one
space, lower case by character), word split and byte alphabet are those of the
file's format. A task holds one batch and bounded caches.

Defined results: a null or empty text has no tokens and decodes to an empty text;
repeated rows each get their result; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, and the split pattern of the file's format.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The format's character classes follow Unicode 16, those of ``unicodedata`` 15.1. Letters and numbers that are newer.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Lower case that is newer, as code points and the step to their lower case.
NEW_LOWER = {"1C89 A7CC A7CE A7D2 A7D4 A7DA": 1, "A7CB": -42343, "A7DC": -42561, "10D50-10D65": 32, "16EA0-16EB8": 27}
#: The format's NFC follows Unicode 9; characters since then neither move nor join.
NO_MARKS = "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
CACHE = 400_000  # words, and chunks, remembered by a task, beside those of the texts in hand
NEVER = 1 << 62  # the rank of a pair that no merge joins
ROWS, BYTES = 500, 1 << 23  # of the texts in hand
END = "\n"  # the end of a word, outside the byte alphabet
LONG = 64  # symbols from which merging keeps its pairs in a heap


def code_points(ranges: str) -> list[int]:
    """The code points of blank-separated hexadecimal ranges."""
    ends = ([int(x, 16) for x in r.split("-")] for r in ranges.split())
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


_LOWER = {c: c + step for ranges, step in NEW_LOWER.items() for c in code_points(ranges)}
_NEW_UPPER = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_APART = re.compile("([" + "".join(map(chr, code_points(NO_MARKS))) + "])")
_CHUNK, _CONTROL = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]")  # str.split also splits at these four


@functools.cache
def split_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """Contractions, runs of letters, single numbers, and runs of all else but white space.

    For texts of code points up to ``top``; a pattern up to U+FFFF matches faster.
    """
    newer = dict.fromkeys(code_points(NEW_LETTERS), "L") | dict.fromkeys(code_points(NEW_NUMBERS), "N")
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(top + 1):
        found = ranges.get(newer.get(c) or unicodedata.category(chr(c))[0])
        if found is not None:
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LN")
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+|\n")  # a line end stands for itself


def normal(text: str) -> str:
    """The normal form of chunks on lines: NFC, then lower case character by character."""
    if text.isascii():
        return text.lower()
    text = "".join(unicodedata.normalize("NFC", part) for part in _APART.split(text))
    text = text.replace("\u03a3", "\u03c3")  # lower() looks at a sigma's neighbours, the format does not
    return _NEW_UPPER.sub(lambda m: chr(_LOWER[ord(m[0])]), text.lower())


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {self.ids[a] << 20 | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self.pair_codes = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[c] for c in self.pair_codes.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.spaced = {i: " " + t for i, t in self.tokens.items()}
        alphabet = byte_alphabet()
        #: Ids of the 256 bytes, and of each as the last of a word; -1 where the vocabulary lacks it.
        self.byte_ids, self.last_ids = (np.array([self.ids.get(c + end, -1) for c in alphabet], np.int64) for end in ("", self.suffix))
        #: From the bytes of words, one on a line, to the alphabet; a line end is the end of a word, as the suffix is.
        self.to_alphabet = dict(enumerate(alphabet)) | {10: END}
        self.longest = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.longest.add_word(token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token, i)
        self.longest.make_automaton()
        # The ids of the bytes of each token, one token after the other.
        byte_of, spread = {c: b for b, c in enumerate(alphabet)}, [[] for _ in range(max(self.tokens) + 1)]
        for token, i in self.ids.items():
            last = bool(self.suffix) and token.endswith(self.suffix)
            own = [byte_of.get(c, 0) for c in (token[: -len(self.suffix)] if last else token)]
            spread[i] = self.byte_ids[own[:-1]].tolist() + [int((self.last_ids if last else self.byte_ids)[own[-1]])] if own else []
        self.n_bytes = np.array([len(x) for x in spread], np.int64)
        self.ends_word = np.array([bool(self.suffix) and self.tokens.get(i, "").endswith(self.suffix) for i in range(len(spread))], bool)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.array([x for own in spread for x in own], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids."""
        codes = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], NEVER)

    def bytes_of(self, tokens: np.ndarray) -> np.ndarray:
        """The ids of the bytes of tokens, one token after the other."""
        n = self.n_bytes[tokens]
        return self.all_bytes[np.repeat(self.first_byte[tokens] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Encoder:
    """Encodes words of one task; remembers a bounded number of them and of pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, tuple[bytes, str]] = {}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.split, self.split_near = split_pattern(), split_pattern(0xFFFF)
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.merged_words = self.speculated_words = 0

    # -- words ---------------------------------------------------------------

    def merge(self, ids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of ``n`` words: in each the pair of least rank is joined, the leftmost of equals, until none is left.

        ``ids`` are of the words' bytes, ``of`` their words in order. All words take
        a step at once; a word without a pair to join leaves. Long words are
        merged singly. Returns ids and words in the same form.
        """
        known = ids >= 0
        ids, of = ids[known], of[known]
        sizes = np.bincount(of, minlength=n)
        long = sizes[of] > LONG
        done = [(np.full(len(x), w), x) for w in np.flatnonzero(sizes > LONG).tolist() for x in [self._merge_long(ids[of == w].tolist())]]
        ids, of = ids[~long], of[~long]
        same = np.append(of[1:] == of[:-1], False)[: len(of)]
        ranks = np.full(len(ids), NEVER)
        ranks[:-1] = np.where(same[:-1], self.v.rank(ids[:-1], ids[1:]), NEVER)
        while len(ids):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(ids))))
            ended = best == NEVER
            if ended.any():
                done.append((of[ended], ids[ended]))
                ids, of, ranks, best = ids[~ended], of[~ended], ranks[~ended], best[~ended]
            at = np.flatnonzero(ranks == best)
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])[: len(at)]]
            ids[at] = self.v.merged[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one position before each is gone
            ids, of, ranks = ids[keep], of[keep], ranks[keep]
            for i in (at, at - 1):
                i = i[i >= 0]
                after = np.minimum(i + 1, len(ids) - 1)
                ranks[i] = np.where((after > i) & (of[after] == of[i]), self.v.rank(ids[i], ids[after]), NEVER)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, ids = (np.concatenate([x[i] for x in done]).astype(np.int64) for i in (0, 1))
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one word, over linked positions and a heap of (rank, position); entries that no longer hold are passed over."""
        rank, merged, n = self.v.ranks.get, self.v.merged, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j], NEVER) != r:
                continue
            ids[i], ids[j], k = int(merged[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 20 | ids[k], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | ids[i], NEVER)) != NEVER:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _kept(self, known: dict[int, bool], codes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a row of tokens gives the row; ``codes`` are the rows' keys in ``known``."""
        out = np.array([known.get(c, -1) for c in codes.tolist()], np.int8)
        new = np.flatnonzero(out < 0)
        if len(new):
            wide = tokens.shape[1]
            rows = tokens[new]
            sizes = self.v.n_bytes[rows].sum(1)
            ids, of = self.merge(self.v.bytes_of(rows.ravel()), np.repeat(np.arange(len(new)), sizes), len(new))
            exact = np.flatnonzero(np.bincount(of, minlength=len(new)) == wide)
            first = np.searchsorted(of, exact)
            same = np.ones(len(exact), bool)
            for k in range(wide):
                same &= ids[first + k] == rows[exact, k]
            out[new] = 0
            out[new[exact[same]]] = 1
            if len(known) > 4 * CACHE:
                known.clear()
            known.update(zip(codes[new].tolist(), (out[new] > 0).tolist()))
        return out > 0

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered: propose, verify all pairs together, merge what fails."""
        if not words:
            return
        raw = ("\n".join(words) + "\n").encode()
        # Greedy longest match over all words in one pass; no token goes past the end of a word.
        proposed = list(self.v.longest.iter_long(raw.decode("latin-1").translate(self.v.to_alphabet)))
        ends, flat = (np.array([x[i] for x in proposed], np.int64) for i in (0, 1))
        bytes_ = np.frombuffer(raw, np.uint8)
        stops = np.flatnonzero(bytes_ == 10)
        starts = np.append(0, stops[:-1] + 1)
        of = np.searchsorted(stops, ends)
        good = np.bincount(of, self.v.n_bytes[flat] + self.v.ends_word[flat], len(words)) == stops - starts + 1  # no byte without a token
        tokens, where = np.unique(flat, return_inverse=True)
        good[of[~self._kept(self.alone, tokens, tokens[:, None])[where]]] = False
        inside = of[1:] == of[:-1]
        codes, where = np.unique((flat[:-1] << 20 | flat[1:])[inside], return_inverse=True)
        good[of[1:][inside][~self._kept(self.pairs, codes, np.stack([codes >> 20, codes & 0xFFFFF], 1))[where]]] = False
        # The ids of all bytes of the words that fail.
        own = self.v.byte_ids[bytes_]
        own[stops - 1] = self.v.last_ids[bytes_[stops - 1]]
        failed = np.repeat(~good, stops - starts + 1) & (bytes_ != 10)
        ids, places = self.merge(own[failed], np.repeat(np.arange(len(words)), stops - starts + 1)[failed], len(words))
        flat, of = np.append(flat[good[of]], ids), np.append(of[good[of]], places)
        flat = flat[np.argsort(of, kind="stable")]
        edges = np.append(0, np.cumsum(np.bincount(of, minlength=len(words)))).tolist()
        data, spaced = flat.astype("<u4").tobytes(), list(map(self.v.spaced.__getitem__, flat.tolist()))
        self.words.update((w, (data[4 * a : 4 * b], "".join(spaced[a:b]))) for w, a, b in zip(words, edges, edges[1:]))
        self.speculated_words += int(good.sum())
        self.merged_words += int((~good).sum())

    # -- texts ---------------------------------------------------------------

    def _parts(self, text: str) -> list[str]:
        """The white-space-separated chunks of a text, and its special strings, in order."""
        if self.special is None or not self.special.search(text):
            return self._chunks(text)
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._chunks(text[at : m.start()])
            out.append("\n" + m[0])  # no chunk holds a line end
            at = m.end()
        return out + self._chunks(text[at:])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return _CHUNK.findall(text) if _CONTROL.search(text) else text.split()

    def _remember(self, chunks: list[str]) -> None:
        """Tokens of new chunks; all new words in them are verified together."""
        plain: list[list[str]] = [[], []]
        for c in chunks:
            if c[0] == "\n":
                token = self.v.special[c[1:]]
                self.ids_of[c], self.text_of[c] = token.to_bytes(4, "little"), self.v.spaced[token]
            else:
                plain[max(c) > "\uffff"].append(c)
        for own, pattern in zip(plain, (self.split_near, self.split)):
            # One chunk on a line: line ends keep words apart like any white space.
            low = normal("\n".join(own)) + "\n" * bool(own)
            flat = (pattern if max(low, default="") <= "\uffff" else self.split).findall(low)  # NFC can leave the plane
            self.learn(list(set(flat).difference(self.words, "\n")))
            found = list(map(self.words.get, flat))
            start = 0
            for c in own:
                stop = found.index(None, start)
                if stop == start + 1:
                    self.ids_of[c], self.text_of[c] = found[start]
                else:
                    self.ids_of[c] = b"".join([x[0] for x in found[start:stop]])
                    self.text_of[c] = "".join([x[1] for x in found[start:stop]])
                start = stop + 1

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids as little-endian 32-bit integers and the decoded text of each text.

        White space separates words in every normal form, so what a chunk between
        it encodes to is remembered as a whole; all new chunks are taken together.
        """
        if len(self.ids_of) > CACHE:
            self.ids_of.clear(), self.text_of.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        parts = [self._parts(t) for t in texts]
        self._remember(list({c for p in parts for c in p}.difference(self.ids_of)))
        for p in parts:
            yield b"".join(map(self.ids_of.__getitem__, p)), "".join(map(self.text_of.__getitem__, p))[1:]


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of little-endian 32-bit ids: without a decoder in the file, tokens joined by spaces."""
    return " ".join(vocabulary.tokens[i] for i in np.frombuffer(ids, "<u4").tolist())


@functools.cache
def encoder(vocabulary_path: str) -> Encoder:
    """The encoder of a Python worker: later tasks in it go on with what it remembers."""
    return Encoder(Vocabulary(vocabulary_path))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary_path: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, str]]]]:
    """Rows, some hundreds at a time or fewer if they are long, with their tokens."""
    held = encoder(vocabulary_path)
    for b in batches:
        sizes, start = pc.fill_null(pc.binary_length(b["text"]), 0).to_pylist(), 0
        while start < b.num_rows:
            end, size = start, 0
            while end < b.num_rows and end - start < ROWS and (end == start or size + sizes[end] <= BYTES):
                size += sizes[end]
                end += 1
            part = b.slice(start, end - start)
            yield part, list(held.encode([t or "" for t in part["text"].to_pylist()]))
            start = end


def encode_documents(docs: DataFrame, vocabulary_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of every row; ``ids`` as an array of ints. Rows stay where they are: no shuffle.

    ``vocabulary_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, done in _encoded(batches, vocabulary_path):
            ids = np.frombuffer(b"".join(x[0] for x in done), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) // 4 for x in done])]).astype(np.int32)
            arrays = [part[key], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([x[1] for x in done], pa.string())]
            yield pa.record_batch(arrays, names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded and hashed in one pass, so that tokens go nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, done in _encoded(batches, vocabulary_path):
            sha = hashlib.sha256
            columns = [pa.array([len(x[0]) // 4 for x in done], pa.int64()), pa.array([sha(x[0]).hexdigest() for x in done], pa.string()), pa.array([sha(x[1].encode()).hexdigest() for x in done], pa.string())]
            yield pa.record_batch([part["doc_id"], *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
