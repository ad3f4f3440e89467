"""Exact token counts under a public byte-level BPE tokenizer, without making identifiers.

Text is cut into pre-tokens by array operations that follow the tokenizer's pattern, whole batches at a time. Each
distinct pre-token of a batch is counted once: an Aho-Corasick automaton of the vocabulary gives all tokens that end at
each byte, and of them the one that is compatible with the token before it belongs to the encoding. Whether two tokens
are compatible (no merge of lower rank would have crossed their border) is decided by undoing their merges. One pass,
linear in the length for tokens of bounded length; its result is that of the merges themselves.

The vocabulary is a file of ranks in base64, one token a line. The driver reads it and sends it to the tasks (under
1 MB), so executors need no file. Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The session's setting that names another one.
SETTING = "spark.chunkquarry.vocabulary"
FLUSH_CHARS = 2_000_000
CACHE = 1 << 19


def read_ranks(path: str, spark: SparkSession | None = None) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file; a path with a scheme is read through Spark, another one on the driver."""
    if spark is not None and "://" in path:
        whole = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])  # a vocabulary is a few MB
    else:
        with open(path, "rb") as f:
            whole = f.read()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in whole.splitlines() if line.strip())}


class Counter:
    """Counts the tokens of single pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.size = {r: len(t) for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            self.halves[rank] = (rank, rank)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._undo(token, rank)):
                self.halves[rank] = halves
                self.pairs[halves] = rank
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}

    def _undo(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what merges of lower rank leave of its bytes."""
        for cut in range(1, len(token)):  # most tokens have but one cut into known halves of lower rank
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and (a, b) not in self.pairs and self._fits(a, b, rank):
                return a, b
        return None

    def _fits(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether no merge crosses the border of two tokens (of a rank under ``limit``, where given)."""
        top = limit if limit is not None else 1 << 40
        while True:
            merged = self.pairs.get((left, right))
            if merged is not None and merged < top:
                return False
            if left > right:
                top, left = left, self.halves[left][1]
                if left == top:
                    top, right = right + 1, self.halves[right][0]
                    if right + 1 == top:
                        return True
            else:
                top, right = right + 1, self.halves[right][0]
                if right + 1 == top:
                    top, left = left, self.halves[left][1]
                    if left == top:
                        return True

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        if (n := self.known.get(word)) is not None:
            return n
        raw = word.encode("utf-8", "surrogatepass")
        if raw in self.ranks:
            n = 1
        else:
            last, counts = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
            for end, rank in self.automaton.iter(raw.decode("latin-1")):
                end += 1
                if last[end] >= 0:
                    continue
                start = end - self.size[rank]
                if start and last[start] < 0:
                    continue
                if start:
                    pair = (last[start], rank)
                    fits = self.compatible.get(pair)
                    if fits is None:
                        if len(self.compatible) > CACHE:
                            self.compatible.clear()
                        fits = self.compatible[pair] = self._fits(*pair)
                    if not fits:
                        continue
                last[end], counts[end] = rank, counts[start] + 1
            n = counts[-1]
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[word] = n
        return n


_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def _class_of(code: int) -> int:
    c = chr(code)
    if c.isspace() and not 0x1C <= code <= 0x1F:
        return _SPACE
    major = unicodedata.category(c)[0]
    return _LETTER if major == "L" else _NUMBER if major == "N" else _OTHER


_CLASSES = np.array([_class_of(c) for c in range(0x3000)], dtype=np.uint8)


def _classes(codes: np.ndarray) -> np.ndarray:
    out = _CLASSES[np.minimum(codes, len(_CLASSES) - 1)]
    far = np.flatnonzero(codes >= len(_CLASSES))
    if len(far):
        values, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class_of(int(v)) for v in values], dtype=np.uint8)[at]
    return out


def pretoken_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end; ``starts``: of the non-empty texts.

    Follows 's|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|whitespace+(?!non-whitespace)|whitespace+.
    """
    n = len(codes)
    kind = _classes(codes)
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    first[n] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    begin = change.copy()
    at = np.flatnonzero(change[:n])
    # a run that isn't blank takes a plain space before it
    solid = at[(kind[at] != _SPACE) & ~first[at]]
    spaced = solid[codes[solid - 1] == 32]
    begin[spaced] = False
    begin[spaced - 1] = True
    # of a longer blank run before such a run its last character stands alone
    blank_before = solid[kind[solid - 1] == _SPACE]
    begin[blank_before - 1] = True
    # contractions: an apostrophe that begins a pre-token, then certain letters
    quote = np.flatnonzero((codes == 39) & begin[:n])
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
        stop = np.flatnonzero(first)
        room = stop[np.searchsorted(stop, quote, side="right")] - quote
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [115, 116, 109, 100]) & (room >= 2)
        two = ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)) & (room >= 3) & ~one
        for found, width in ((quote[one], 2), (quote[two], 3)):
            begin[found + 1] = False
            follows = found[(found + width < n)] + width
            same = kind[follows] == _LETTER
            begin[follows[same]] = True
    return np.flatnonzero(begin[:n])


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)
_COUNTERS: dict[str, Counter] = {}  # of a worker, by vocabulary


def _hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pre-token."""
    from .spans import _powers

    global _POWERS
    width = np.diff(np.concatenate([starts, [len(codes)]]))
    longest = int(width.max(initial=1))
    if len(_POWERS) < longest:
        _POWERS = _powers(_BASE, longest)
    with np.errstate(over="ignore"):
        offset = np.arange(len(codes)) - np.repeat(starts, width)
        value = (codes.astype(np.uint64) + np.uint64(0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        return np.add.reduceat(value * _POWERS[offset], starts)


def count_batch(texts: pa.Array, counter: Counter) -> np.ndarray:
    """Tokens of each text."""
    joined = "".join(t or "" for t in texts.to_pylist())
    length = pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not joined:
        return np.zeros(len(texts), dtype=np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(length)
    begins = ends - length
    starts = pretoken_starts(codes, begins[length > 0])
    _, where, back = np.unique(_hashes(codes, starts), return_index=True, return_inverse=True)
    stops = np.concatenate([starts[1:], [len(codes)]])
    sizes = np.array([counter.count(joined[a:b]) for a, b in zip(starts[where].tolist(), stops[where].tolist())], dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes[back])])
    return total[np.searchsorted(starts, ends)] - total[np.searchsorted(starts, begins)]


def _counting(ranks_handle, key: str, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(ranks_handle.value)
        counter = _COUNTERS[key]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            size = np.cumsum(pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(batch):
                done = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, done + FLUSH_CHARS, side="right")))
                part = batch.slice(begin, end - begin)
                counts = pa.array(count_batch(texts.slice(begin, end - begin), counter), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in passed), counts], names=[*passed, "n_tokens"])
                begin = end

    return run


def token_counts(items: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The items (text string and any other columns) with n_tokens in place of text.

    The vocabulary is the one given, else the one of the setting ``spark.chunkquarry.vocabulary``, else ``VOCABULARY``.
    """
    spark = items.sparkSession
    passed = [f for f in items.schema.fields if f.name not in ("text", "n_tokens")]
    ranks = read_ranks(vocabulary or spark.conf.get(SETTING, VOCABULARY), spark)
    handle = spark.sparkContext.broadcast(ranks)
    key = hashlib.blake2b(repr(sorted(ranks.items())).encode()).hexdigest()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed)
    return items.select("text", *[f.name for f in passed]).mapInArrow(_counting(handle, key, [f.name for f in passed]), f"{schema}, n_tokens long" if schema else "n_tokens long")


#: Spellings of a language in the tables. Fixed values.
_SPELLINGS = {"py": "python", "python3": "python", "c++": "c", "c/c++": "c", "cpp": "c", "golang": "go", "rs": "rust", "eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es"}


def plain_language(c: Column) -> Column:
    lower = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _SPELLINGS.items() for x in kv])[lower], F.nullif(lower, F.lit("")))


def cube(counts: DataFrame, by: list[str]) -> DataFrame:
    """Items and tokens of every slice and sub-total; level counts the columns that are summed over (null in the row)."""
    known = counts.select(*[F.coalesce(c, F.lit("(none)")).alias(c) for c in by], "n_tokens")
    return known.cube(*by).agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"), F.grouping_id().alias("level"))
