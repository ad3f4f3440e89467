"""Broken prompt and response pairs.

Each side of a pair gets at most one defect, tested in this order: empty, copy, refusal, other_language, truncated.

* other_language compares the posteriors of question and answer under a naive Bayes model of character trigrams.
* truncated: open fences, brackets, quotes of code and bare list marks are counted; of every other answer without a mark
  at its end a logistic regression over end-of-text n-gram odds (how often the last characters stood at a sentence's end
  and inside one) and the shape of the ending decides.
* refusal: a logistic regression over words and word pairs judges each sentence; phrase patterns and a list of example
  sentences only label what it is fitted on.

All models are fitted on every document with a known language and every answer. One pass over the texts counts trigrams
and n-grams (by 64-bit hashes) and packs endings and sentences as numbers; the regressions then visit these blocks where
they lie, once a step, and only sums of the size of a model come to the driver. Complete texts give both sides of the
truncation model: as they are without their last mark, and cut at a place inside a sentence; an ending's odds leave its own
place out of the counts. Null answers are no answers. A null or blank question leaves the language and the copy test out.
A pair that comes twice has one result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from . import linear

LANGUAGES = {"en": "en", "eng": "en", "de": "de", "ger": "de", "deu": "de", "es": "es", "spa": "es", "fr": "fr", "fra": "fr", "fre": "fr"}
ORDERS = (12, 9, 6, 4, 2)
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_NAMES = re.compile(r"`[^`\n]*`|\b(?=[^\W_]*+_)\w*[a-z0-9]_\w+\b|\b[a-z]++(?:[A-Z][a-z0-9]*+)+\b")
_QUOTED = re.compile(r'"[^"\n]{12,}"|“[^”\n]{12,}”|«[^»\n]{12,}»|„[^“”\n]{12,}[“”]|^>.*$', re.M)


def prose(text: str) -> str:
    """The text without code blocks, and with § for each name."""
    return _NAMES.sub("§", _FENCED.sub(" ", text))


def trigrams(text: str) -> list[str]:
    letters = re.sub(r"[^\w']+|[\d_]+", " ", prose(text).replace("§", " ").lower()).strip()
    s = f" {letters} "
    return [s[i : i + 3] for i in range(len(s) - 2)] if letters else []


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _classes(c: np.ndarray, *patterns: str) -> np.ndarray:
    """For each character the number of the first pattern that it matches, or of patterns."""
    seen = np.flatnonzero(np.bincount(c))
    known = np.zeros(int(seen[-1]) + 1, dtype=np.int8)
    for x in seen.tolist():
        known[x] = next((i for i, p in enumerate(patterns) if re.fullmatch(p, chr(x))), len(patterns))
    return known[c]


def trigram_counts(plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts (without names) as numbers of 63 bits, and how often each stands there."""
    c = _characters("".join(f" {t} \0" for t in (t.replace("\0", " ") for t in plain)).replace("§", " ").lower())
    if not len(c):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _classes(c, r"\0", r"[\d_]", r"[\w']")  # 2: letters, 3: neither
    ends = np.flatnonzero(kind == 0)
    at = np.flatnonzero(kind == 2)
    first, last = np.searchsorted(at, np.concatenate([[0], ends[:-1]])), np.searchsorted(at, ends) - 1
    some = first <= last
    first, last = at[first[some]], at[last[some]]
    inside = np.zeros(len(c) + 1, dtype=np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    keep = (kind == 2) | (np.cumsum(inside[:-1]) > 0) & (kind != np.concatenate([[0], kind[:-1]]))
    keep[first - 1] = keep[last + 1] = keep[ends] = True
    c = np.where((kind == 1) | (kind == 3), 32, c)[keep]
    whole = (c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)
    return np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole], return_counts=True)


_MARKED = re.compile(r"^\s*(?:[-*]|0\.|0:0|\w+:)\s+")
SHORT = 120
#: What a character is multiplied by, from an n-gram's last character back; the sum stands for the n-gram.
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(SHORT + 2)], dtype=np.uint64).view(np.int64)


def keys_of(text: str, sizes: tuple[int, ...]) -> list[int]:
    """64 bits for the last characters of a text, by number of characters."""
    c = _characters(text[-len(_FACTORS) :])[::-1]
    sums = np.cumsum(c * _FACTORS[: len(c)])
    return [int(sums[min(n, len(c)) - 1]) for n in sizes]


def end_counts(plain: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Keys of the n-grams before word ends, how often each stands inside a sentence and at its end, and how many word ends are which.

    Names are §, digits 0. Where another line follows a line's end is a sentence's; where the text ends without a mark nothing
    is known. An n-gram that would reach over the line's begin (^) stands once for all longer ones.
    """
    lines = []
    for text in plain:
        own = re.sub(r"\d+", "0", text.replace("\0", " ")).rstrip().split("\n")
        for line in own:
            m = _MARKED.match(line)
            lines += ["\n^", (line[m.end() :] if m else line).strip().lower()]
        lines.append("\0")
    c = _characters("".join(lines) + "\n")
    kind = _classes(c, "\0", "\n", r"[.?!]", r"[,;:]", r"\s", r"[\w§)]")
    at = np.flatnonzero((kind[:-1] == 5) & (kind[1:] > 0) & (kind[1:] < 5))
    begins = np.flatnonzero((c[1:] == 94) & (kind[:-1] == 1)) + 1
    after = kind[at + 1]
    ended = (after == 1) | (after == 2) & np.isin(kind[np.minimum(at + 2, len(c) - 1)], (0, 1, 4))
    length = at - begins[np.searchsorted(begins, at, "right") - 1] + 1
    keys, labels, sums, done = [], [], np.zeros(len(at), dtype=np.int64), 0
    for n in sorted(ORDERS):
        more = length > done
        for k in range(done, n):
            reach = length > k
            sums[reach] += c[at[reach] - k] * _FACTORS[k]
        keys.append(sums[more])
        labels.append(ended[more])
        done = n
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.bincount(place, weights=np.concatenate(labels), minlength=len(keys)).astype(np.int64)
    return keys, np.column_stack([np.bincount(place, minlength=len(keys)) - ends, ends]), (int((~ended).sum()), int(ended.sum()))


DIMS = 1 << 15


@dataclass
class Ends:
    """How often n-grams stood inside a sentence and at its end, by their sorted keys."""

    keys: np.ndarray
    counts: np.ndarray

    def at(self, keys: np.ndarray) -> np.ndarray:
        """A pair of counts a key, 0 where it was not seen."""
        if not len(self.keys):
            return np.zeros((*keys.shape, 2), dtype=np.int64)
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[places] == keys)[..., None], self.counts[places], 0)

    def get(self, gram: str, default: tuple[int, int] = (0, 0)) -> tuple[int, int]:
        key = keys_of(gram, (len(gram),))[0]
        i = int(np.searchsorted(self.keys, key))
        return tuple(self.counts[i].tolist()) if i < len(self.keys) and self.keys[i] == key else default


@dataclass
class Models:
    grams: dict[str, dict[str, float]] = field(default_factory=dict)
    rare: float = 0.0
    ends: Ends | dict[str, tuple[int, int]] = field(default_factory=dict)
    base: float = 0.0
    cut_weights: np.ndarray | None = None
    said_weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _scores(self, seen: list[str]) -> dict[str, float]:
        """Log-likelihood of trigrams in each language: one lookup a trigram gives its row of a matrix."""
        known = self.__dict__.get("_matrix")
        if known is None:
            rows = {t: i + 1 for i, t in enumerate({t: None for g in self.grams.values() for t in g})}
            matrix = np.array([[self.rare] * len(self.grams), *([g.get(t, self.rare) for g in self.grams.values()] for t in rows)])
            known = self.__dict__["_matrix"] = (rows, matrix)
        rows, matrix = known
        return dict(zip(self.grams, matrix[[rows.get(t, 0) for t in seen]].sum(axis=0).tolist()))

    def language(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and the log of its odds against the second."""
        seen = trigrams(text)
        if not seen or len(self.grams) < 2:
            return None, 0.0
        score = self._scores(seen)
        best, second = sorted(score.values(), reverse=True)[:2]
        return max(score, key=lambda k: (score[k], k)), best - second

    def log_odds(self, seen: list[str], language: str) -> float:
        """How much more likely a text of these trigrams is in its best language than in another."""
        score = self._scores(seen) if seen else {}
        return max(score.values()) - score[language] if language in score else 0.0

    def cut_odds(self, tail: str) -> list[float]:
        """By order of n-gram the log-odds that a sentence with this tail is cut off, against that it ends here (0 where unseen),
        and whether it was seen."""
        odds, seen = [], []
        for n in ORDERS:
            cut, end = self.ends.get(tail[-n:], (0, 0)) if len(tail) >= n or tail[:1] == "^" else (0, 0)
            odds.append(math.log((cut + 0.3) / (end + 0.3)) - self.base if cut + end else 0.0)
            seen.append(float(cut + end > 0))
        return odds + seen

    def recurs(self, whole: str | None) -> float:
        """How often a short answer was given as a whole: the logarithm of the number of others."""
        return math.log1p(self.ends.get("=" + whole, (0, 0))[1]) if whole else 0.0

    def cut_off(self, text: str) -> bool:
        """Whether a text without a mark at its end breaks off there."""
        return self.cut_weights is not None and bool(np.dot(_cut_features(ending(text), self), self.cut_weights) > 0)

    def says(self, what: str, sentence: str) -> bool:
        """Whether a sentence is a refusal or a courtesy."""
        w = self.said_weights.get(what)
        return w is not None and bool(w[linear.hashed(_said(sentence), DIMS)].sum() > 0)


def flattened(sentence: str) -> str:
    """A line's or sentence's form in the n-gram model."""
    return "^" + re.sub(r"\d+", "0", prose(sentence)).strip().lower()


def short_whole(text: str) -> str | None:
    """The flattened form of a text of one line and one sentence, without its mark."""
    text = text.strip()
    return flattened(text.rstrip(".!?"))[:SHORT] if len(text) <= SHORT and "\n" not in text and not _second(text) else None


def ending(text: str) -> tuple[str, str | None, list[float]]:
    """The flattened last sentence, as far as n-grams reach, the whole text if it is short, and the shape of its end."""
    text = text.rstrip()
    outside = _FENCED.sub(" ", text)
    lines = text.split("\n")
    listed = bool(_LIST.match(lines[-1]))
    item = _LIST.sub("", lines[-1])
    tail = re.split(r"(?<=[.!?])\s+", item)[-1]
    others = [x.rstrip() for x in lines[:-1] if _LIST.match(x)] if listed else []
    marked = any(x[-1:] in (".", "!", "?") for x in others)
    alone = not _second(outside)
    length = math.log1p(len(tail.split()))
    last = text[-1:]
    shape = [length, float(alone), length * alone, float(listed), float(listed and marked), float(listed and bool(others) and not marked), float(listed and bool(re.fullmatch(r"[`\w.§/:()\-]+", item))), float(last in ",;:-–—=+/&"), float(last.isalnum())]
    return flattened(tail)[-ORDERS[0] - 1 :], short_whole(text), shape


def _cut_features(end: tuple[str, str | None, list[float]], models: Models) -> list[float]:
    return [1.0, *models.cut_odds(end[0]), models.recurs(end[1]), *end[2]]


def _form(sentence: str) -> str:
    """A sentence in small letters, names as § and digits as 0."""
    return re.sub(r"\d+", "0", prose(sentence.replace("’", "'"))).lower()


def _features(form: str) -> list[str]:
    """Words and neighbouring words."""
    words = re.findall(r"[\w']+|§", form)
    return words + [f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"])]


def _said(sentence: str) -> list[str]:
    """Words and neighbouring words of a sentence, names as one."""
    return _features(_form(sentence))


def _complete(text: str) -> str | None:
    """A text that ends as a text should, without its last mark; else None."""
    text = text.rstrip()
    ok = re.search(r"[\w§`)][.!?]$", text) and text.count("`") % 2 == 0 and text.count("```") % 2 == 0 and not _GIVEN_UP.search(text)
    return text[:-1] if ok else None


def cuts(text: str, n: int = 2) -> list[str]:
    """A text broken off at ``n`` places inside sentences (chosen by its hash): after a word, and within one."""
    out, seed = [], zlib.crc32(text.encode())
    inside = [m.start() for m in re.finditer(r"(?<=[\w`)]) (?=[\w`(])", _FENCED.sub(lambda m: "." * len(m[0]), text))]
    ticks = [m.start() for m in re.finditer("`", text)]
    words = [i for i in inside if bisect_left(ticks, i) % 2 == 0] if ticks else inside
    for k in range(n if len(words) > 2 else 0):
        seed = (seed * 1_103_515_245 + 12_345) % (1 << 31)
        at = words[seed % len(words)]
        rest = re.match(r"[^\W\d_]{4,}", text[at + 1 :])
        out.append(text[: at + 1 + len(rest[0]) // 2] if k % 2 and rest else text[:at])
    return out


_BARE = re.compile(r"[\w)`](?![^\n])")
_COUNTED = "what string, data binary"
_SUMS = "what string, key long, n long"
#: An ending: complete (y = 0) or cut (1), whether its place (and it as a whole) is among those counted, keys and shape.
_ENDING = np.dtype([("y", "u1"), ("own", "u1"), ("own_whole", "u1"), ("keys", "<i8", len(ORDERS) + 1), ("shape", "<f4", 9)])
#: Distinct entries that a task holds before it passes them on; bytes of blocks up to which the driver visits them itself.
ENTRIES, HERE = 300_000, 1 << 20
#: Fits of the regression over endings.
ROUNDS = 4
#: A sentence that is neither refusal nor courtesy weighs a quarter. The examples weigh what 8 each are to 10,000 (they lead only where data are few).
PLAIN, EXAMPLE, OF = 0.25, 8.0, 10_000.0


def _endings(text: str) -> Iterator[tuple[float, int, int, str]]:
    """y, own, own_whole and the text up to an ending."""
    whole = _complete(text)
    if whole is not None:
        yield 0, 1, 1, whole
        for c in cuts(whole):
            yield 1, int(whole[len(c) : len(c) + 1] == " "), 0, c
    if _BARE.match(text.rstrip()[-1:]):  # most texts end where they should
        yield 0, 0, 1, text
    fences = [m.start() for m in re.finditer("```", text)]
    bare = [i for i in (m.end() for m in re.finditer(r"[\w)`](?=\n)", text)) if bisect_right(fences, i - 3) % 2 == 0]
    if bare:  # a line that another one follows is whole
        yield 0, 1, 0, text[: bare[zlib.crc32(text.encode()) % len(bare)]]


def _tail_keys(tail: str, whole: str | None) -> list[int]:
    keys = [k if len(tail) >= n or tail[:1] == "^" else 0 for k, n in zip(keys_of(tail, ORDERS), ORDERS)] if tail else [0] * len(ORDERS)
    return [*keys, keys_of("=" + whole, (len(whole) + 1,))[0] if whole else 0]


def said_block(sentences_: dict[tuple[int, bytes], float]) -> bytes:
    """Labels, weights and places of (label, places) as one string of bytes."""
    labels = np.array([k for k, _ in sentences_], dtype="u1")
    sizes = np.array([len(b) // 2 for _, b in sentences_], dtype="<u2")
    head = np.array([len(labels)], dtype="<u4").tobytes()
    return head + labels.tobytes() + np.array([*sentences_.values()], dtype="<f8").tobytes() + sizes.tobytes() + b"".join(b for _, b in sentences_)


def _said_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, weights, where each row begins and the places of all."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    labels, weight = np.frombuffer(raw, "u1", n, 4), np.frombuffer(raw, "<f8", n, 4 + n)
    sizes = np.frombuffer(raw, "<u2", n, 4 + 9 * n).astype(np.int64)
    return labels, weight, np.cumsum(sizes) - sizes, np.frombuffer(raw, "<u2", -1, 4 + 11 * n).astype(np.int64)


class _Counts:
    """What a task counts and packs."""

    def __init__(self) -> None:
        self.plain: list[tuple[str, str | None]] = []
        self.chars = 0
        self.sums: Counter = Counter()
        self.endings: Counter = Counter()
        self.said: Counter = Counter()
        self.places: dict[str, bytes] = {}
        self.words: dict[str, tuple[int, bytes]] = {}

    def _hashed(self, form: str) -> bytes:
        """linear.hashed of a sentence's features; words are hashed once, pairs from their first word's sum on."""
        sums, tails = [], []
        for w in re.findall(r"[\w']+|§", form):
            if (known := self.words.get(w)) is None:
                known = self.words[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")), (" " + w).encode("utf-8", "surrogatepass")
            sums.append(known[0])
            tails.append(known[1])
        pairs = map(zlib.crc32, [*tails, b" $"], [zlib.crc32(b"^"), *sums])
        return array("H", [0, *sorted({1 + x % (DIMS - 1) for x in itertools.chain(sums, pairs)})]).tobytes()

    def add(self, text: str, language: str | None) -> None:
        plain = prose(text)
        self.plain.append((plain, language))
        self.chars += len(plain)
        if whole := short_whole(text):
            self.sums["end", keys_of("=" + whole, (len(whole) + 1,))[0]] += 1
        for y, own, own_whole, t in _endings(text):
            tail, whole, shape = ending(t)
            self.endings[y, own, own_whole, tail, whole, tuple(shape)] += 1
        for s in sentences(text):
            straight = s.replace("’", "'")
            label = 1 if _REFUSALS.search(straight) else 2 if _COURTESY.search(straight) else 0
            form = _form(straight)
            if (at := self.places.get(form)) is None:
                at = self.places[form] = self._hashed(form)
            self.said[label, at] += 1
        if self.chars > 2_000_000:
            self.count_plain()

    def full(self) -> bool:
        return max(map(len, (self.sums, self.endings, self.said))) > ENTRIES

    def count_plain(self) -> None:
        if self.plain:
            for language in {k for _, k in self.plain} - {None}:
                codes, n = trigram_counts([t for t, k in self.plain if k == language])
                self.sums.update(dict(zip(((f"gram {language}", c) for c in codes.tolist()), n.tolist())))
            keys, counts, base = end_counts([t for t, _ in self.plain])
            for i, label in enumerate(("cut", "end")):
                some = counts[:, i] > 0
                self.sums.update(dict(zip(((label, k) for k in keys[some].tolist()), counts[some, i].tolist())))
                self.sums[f"base {label}", 0] += base[i]
        self.plain, self.chars = [], 0

    def rows(self) -> pd.DataFrame:
        self.count_plain()
        by: dict[str, tuple[array, array]] = {}
        for (what, key), n in self.sums.items():
            keys, counts = by.setdefault(what, (array("q"), array("q")))
            keys.append(key)
            counts.append(n)
        out = [(what, zlib.compress(keys.tobytes() + counts.tobytes(), 1)) for what, (keys, counts) in by.items()]
        packed = np.array([(y, own, own_whole, _tail_keys(tail, whole), shape) for y, own, own_whole, tail, whole, shape in self.endings], dtype=_ENDING)
        if len(packed):
            out.append(("endings", zlib.compress(np.array([len(packed)], "<u4").tobytes() + packed.tobytes() + np.array([*self.endings.values()], "<f8").tobytes(), 1)))
        if self.said:
            out.append(("said", said_block(self.said)))
        self.__init__()
        return pd.DataFrame(out, columns=["what", "data"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _Counts()
    for batch in batches:
        for text, language in zip(batch.text, batch.language):
            counts.add(text, language)
            if counts.full():
                yield counts.rows()
    yield counts.rows()


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for what, data in zip(batch.what, batch.data):
            keys, counts = np.frombuffer(zlib.decompress(data), dtype="<i8").reshape(2, -1)
            yield pd.DataFrame({"what": what, "key": keys, "n": counts})


def _ending_rows(block: bytes, m: Models, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, y and weight of endings; counted without their own place.

    Of a text that ends without a mark nothing says that it is whole: it counts as much as it looked whole to the weights ``before``.
    """
    raw = zlib.decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    e, weight = np.frombuffer(raw, _ENDING, n, 4), np.frombuffer(raw, "<f8", n, 4 + n * _ENDING.itemsize)
    seen = m.ends.at(e["keys"]).astype(float)
    y = e["y"].astype(int)
    rows = np.arange(n)
    seen[rows[:, None], np.arange(len(ORDERS)), y[:, None]] -= e["own"][:, None]
    seen[:, -1, 1] -= e["own_whole"]
    seen[seen < 2] = 0
    cut, end = seen[:, :-1, 0], seen[:, :-1, 1]
    odds = np.where(cut + end > 0, np.log((cut + 0.3) / (end + 0.3)) - m.base, 0.0)
    x = np.column_stack([np.ones(n), odds, cut + end > 0, np.log1p(seen[:, -1, 1]), e["shape"]])
    if before is not None:
        weight = weight * np.where((y == 0) & (e["own"] == 0), 1 - linear.sigmoid(x @ before), 1.0)
    return x, y.astype(float), weight


def summed(blocks: DataFrame, also: tuple[bytes, ...] = ()) -> Callable[[Callable[[bytes], np.ndarray]], np.ndarray]:
    """What sums a function over all blocks; few are fetched once, others visited where they lie."""
    size = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    if size <= HERE:
        here = [*(bytes(r.data) for r in blocks.select("data").collect()), *also]
        return lambda f: sum(map(f, here))
    spread = blocks.select("data").coalesce(max(1, 2 * blocks.sparkSession.sparkContext.defaultParallelism))

    def total(f: Callable[[bytes], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [f(bytes(x)) for batch in batches for x in batch.data]
            yield pd.DataFrame({"data": [np.asarray(sum(parts), dtype="<f8").tobytes()] if parts else []})

        return sum(np.frombuffer(bytes(r.data), "<f8") for r in spread.mapInPandas(run, "data binary").collect()) + sum(map(f, also))

    return total


def _fit_cut(blocks: DataFrame, m: Models) -> np.ndarray | None:
    """The regression over endings, by Newton steps; again where it has been seen which unmarked endings look cut."""
    total = summed(blocks)
    known = blocks.sparkSession.sparkContext.broadcast(Models(ends=m.ends, base=m.base))  # once for all steps

    def sides(block: bytes) -> np.ndarray:
        _, y, weight = _ending_rows(block, known.value, None)
        return np.array([weight[y == 0].sum(), weight[y == 1].sum()])

    def part(w: np.ndarray, before: np.ndarray | None) -> Callable[[bytes], np.ndarray]:
        return lambda block: linear.newton_part(*_ending_rows(block, known.value, before), w)

    if np.min(total(sides)) <= 0:
        return None
    w = None
    for _ in range(ROUNDS):
        w = linear.newton(lambda v, before=w: total(part(v, before)), 2 + 2 * len(ORDERS) + 9, w)
    return w


def _fit_said(blocks: DataFrame) -> dict[str, np.ndarray]:
    """The regressions over sentences: of refusals (label 1) and of courtesies (2)."""
    labels = lambda block: np.bincount(_said_rows(block)[0], _said_rows(block)[1], minlength=3)
    examples = {(int(y), np.array(linear.hashed(_said(s), DIMS), dtype="<u2").tobytes()): EXAMPLE for y, lines in _EXAMPLES.items() for s in lines}
    scale = np.array([PLAIN, 1.0, 1.0])
    total = summed(blocks)
    corpus = total(labels) if blocks.head(1) else np.zeros(3)
    heavier = max(1.0, float((corpus * scale).sum()) / OF)
    shown = {k: v * heavier / scale[k[0]] for k, v in examples.items()}
    total = summed(blocks, (said_block(shown),))
    weight = scale * total(labels)
    known = {"refusal": 1, "courtesy": 2}
    most = {k: min(1.0, 0.25 / max(weight[k] / weight.sum(), 1e-12)) for k in known.values()}  # no more than a quarter of all
    each = np.array([[scale[x] * (most[k] if x == k else 1.0) for x in range(3)] for k in known.values()])
    each /= (each * total(labels)).sum(axis=1, keepdims=True)

    def part(w: np.ndarray) -> Callable[[bytes], np.ndarray]:
        def of(block: bytes) -> np.ndarray:
            label, n, starts, at = _said_rows(block)
            return np.concatenate([linear.loss_part(starts, at, (label == k).astype(float), n * each[i][label], w[i]) for i, k in enumerate(known.values())])

        return of

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        both = total(part(w.reshape(2, DIMS))).reshape(2, DIMS + 1)
        return float(both[:, 0].sum()), both[:, 1:].ravel()

    return dict(zip(known, linear.lbfgs(value, 2 * DIMS).reshape(2, DIMS)))


def fit(documents: DataFrame, pairs: DataFrame | None = None) -> Models:
    """The models from all documents (doc_id, text, lang) of a known language and all pairs (task_id, response_full, response_bridge)."""
    lang = F.lower(F.trim("lang"))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    texts = documents.select("text", known[lang].alias("language")).where("language is not null and length(text) > 40")
    if pairs is not None:
        answers = pairs.where("task_id is not null").select(F.explode(F.array("response_full", "response_bridge")).alias("text")).where("length(text) > 0")
        texts = texts.unionByName(answers.withColumn("language", F.lit(None).cast("string")))
    counted = checkpointed(texts.mapInPandas(_count, _COUNTED))  # visited once a step
    sums = counted.where("what not in ('endings', 'said')").mapInPandas(_unpacked, _SUMS).groupBy("what", "key").agg(F.sum("n").alias("n")).where("n >= 2").toArrow().to_pandas()
    m = Models()
    for what, rows in sums[sums.what.str.startswith("gram ")].groupby("what"):
        decoded = ["".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in rows.key.tolist()]
        m.grams[what[5:]] = dict(zip(decoded, rows.n.tolist()))
    m.rare = math.log(0.5 / (max((sum(g.values()) for g in m.grams.values()), default=0) + 5000))  # what no language has tells none
    for k, g in m.grams.items():
        total = sum(g.values()) + 5000
        m.grams[k] = {t: math.log((n + 0.5) / total) for t, n in g.items()}
    ends = sums[sums.what.isin(["cut", "end"])]
    keys, place = np.unique(ends.key.to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(keys), 2), dtype=np.int64)
    counts[place, (ends.what == "end").to_numpy(int)] = ends.n.to_numpy(np.int64)
    m.ends = Ends(keys, counts)
    totals = dict(zip(sums.what, sums.n))
    m.base = math.log((totals.get("base cut", 0) + 1) / (totals.get("base end", 0) + 1))
    endings = counted.where("what = 'endings'")
    if endings.head(1):
        m.cut_weights = _fit_cut(endings, m)
    m.said_weights = _fit_said(counted.where("what = 'said'"))
    return m


#: Words that stand for no output. Fixed values.
_NOTHING = frozenset(
    ["null", "none", "nil", "na", "n a", "nan", "empty", "no output", "no response", "no answer", "no content", "no result", "no results", "undefined", "blank", "nothing", "void", "leer", "keine ausgabe", "keine antwort", "nichts", "vide", "aucune réponse", "aucune sortie", "rien", "vacío", "sin respuesta", "sin salida", "nada", "no reply", "missing", "not available", "output empty", "empty response", "empty string"]
)
#: Words around a repeated question that add nothing to it. Fixed values.
_LEAD = frozenset("question answer the is q a you asked asks ask was to here your repeat frage die lautet antwort ihre deine war pregunta la es respuesta tu su réponse est votre voici restated rephrased prompt user assistant response and: as follows".split())


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def is_empty(text: str) -> bool:
    words = _words(re.sub(r"```\w*", " ", text))
    return not words or " ".join(words) in _NOTHING


def is_copy(question: str | None, text: str) -> bool:
    """The question's words, once or more, after a lead-in of a few words without names and with nothing said after them."""
    q, a = _words(question or ""), _words(text)
    if len(q) < 2 or len(a) < len(q):
        return False
    before, after, i, copies = [], [], 0, 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            before, after, copies, i = before + after, [], copies + 1, i + len(q)
        else:
            after.append(a[i])
            i += 1
    return copies > 0 and len(before) <= 8 and not any(re.search(r"[\d_]", w) for w in before) and len(after) <= 4 and all(w in _LEAD for w in after)


#: Sentences that the models know besides those of the sample: no refusals (0), refusals (1), courtesies (2).
_EXAMPLES = {
    0.0: ["I cannot find a second caller, so it is safe to remove it.", "I can't see why this would be called twice.", "There is not enough context in the cache itself, which is why it reads the index.", "No information is lost here, the index is rebuilt.", "It cannot be removed, since the queue reads it.", "The client cannot help it: the lock is taken first.", "Sorry for the long list, the short version is that it owns the cursor.", "Access to the files is checked before the request is answered.", "Unfortunately the test fails once the cache is stale.", "No", "Yes", "No, it is not", "Nein, das ist nicht so.", "Der Puffer kann nicht gelöscht werden, solange er gelesen wird.", "Je n'ai pas trouvé d'autre appel, donc on peut retirer la fonction.", "No se puede borrar porque la cola todavía lo lee.", "If you need the cursor, read it first.", "Thanks to the cache it is read once.", "Please check whether the pattern is still valid.", "Bitte prüft, ob das Muster noch gültig ist."],
    1.0: ["I'm sorry, but I can't help with that.", "I cannot answer this question.", "I am unable to assist with this request.", "I won't be able to comment on §.", "I don't have enough information about § to say anything.", "I do not have access to your files, so no answer is possible.", "As an AI I cannot give advice on this.", "Insufficient information to answer.", "No context provided.", "Not enough context was given to answer.", "The request falls outside of what I may discuss.", "That is not something I can assist with.", "I have to decline this one.", "My guidelines do not allow me to answer.", "I lack the context needed to tell.", "Tut mir leid, dabei kann ich nicht helfen.", "Ich habe keinen Zugriff auf die Dateien und muss die Antwort ablehnen.", "Dazu liegen mir keine Informationen vor.", "Ich kann diese Frage nicht beantworten.", "Désolé, je ne peux pas répondre à cette demande.", "Je n'ai pas assez d'informations pour donner une réponse.", "Je n'ai pas accès aux fichiers et je dois refuser de répondre.", "Lo siento, no puedo ayudar con eso.", "No tengo acceso a los archivos, así que debo declinar la respuesta.", "No dispongo de información suficiente para responder."],
    2.0: ["Is there anything else you would like to know?", "Thank you for understanding.", "Please provide the missing files and try once more.", "Please ask the maintainers instead.", "If you share more of the code, feel free to ask again.", "Let me know if you have more details.", "Sorry.", "I apologise.", "Danke für Ihr Verständnis.", "Bitte senden Sie die fehlenden Dateien.", "Gibt es sonst noch etwas?", "Merci de votre compréhension.", "Veuillez fournir les fichiers manquants.", "Gracias por su comprensión.", "Por favor, envíe los archivos que faltan."],
}
_OPEN = r"^(?:\W*(?:well|hi|hello|unfortunately|regrettably|sorry|apologies|i apologi[sz]e|i am sorry|i'm sorry|my apologies|no|leider|es tut mir leid|tut mir leid|désolée?|je suis désolée?|malheureusement|lo siento|lamentablemente|desafortunadamente|perdón|entschuldigung)\b[\s,.;:!-]*(?:but|and|aber|mais|pero|que)?\s*)*"
_CANT = r"(?:can(?:no|')?t|can not|am unable to|'m unable to|am not able to|'m not able to|won't be able to|will not be able to|won't|will not|must decline to|have to decline to|am not allowed to|may not|would rather not|must refuse to)"
_REFUSALS = re.compile(
    _OPEN + r"(?:"
    rf"(?:i|we)\s?{_CANT}\s+(?:really |currently |safely )?(?:help|assist|answer|comment|determine|provide|say|tell|discuss|do (?:that|this)|comply|respond|give|offer|speak|fulfil\w*|complete|process|share|evaluate|judge)\b|"
    r"(?:i|we) (?:do not|don't) (?:have|possess) (?:enough|sufficient|any|the necessary|the required|the|access)\b.{0,30}(?:information|context|access|details|data|files|to (?:your|the))|"
    r"(?:i|we) (?:lack|am missing|are missing) (?:the )?(?:information|context|access|details|files)|(?:i|we) have no (?:access|information|context|knowledge)\b|"
    r"insufficient (?:information|context|data)\s*[:.,]|not enough (?:information|context|data)\s*(?:[:.,]|$|was |is |were |has been |to answer|provided|available|given)|no (?:context|information|code|files?|input) (?:was |were |has been |is )?(?:provided|given|available|supplied|attached)\b|"
    r"as an? (?:ai|assistant|language model|automated)\b|(?:that|this|it) is not something i (?:can|may|am)|(?:this|that) one i (?:have to|must) decline|i (?:must|have to|need to) (?:decline|refuse|pass)\b|"
    r"(?:this|that|the|your) (?:request|question|topic|query) (?:falls|is|lies|goes) (?:outside|beyond)|my (?:guidelines|instructions|policy|rules)\b|i (?:decline|refuse)\b|"
    r"(?:dabei |damit |darauf |hier |das )?(?:kann|darf|möchte|werde|muss) ich\b.*\b(?:nicht|ablehnen|keine)|ich (?:kann|darf|möchte|werde)\b.*\b(?:nicht (?:helfen|beantworten|sagen|weiterhelfen|antworten)|keine auskunft)|ich (?:habe|verfüge)\b.*\b(?:keinen zugriff|keine (?:informationen|angaben)|nicht genug|nicht genügend|nicht über)|ich muss\b.*\bablehnen|(?:dazu|hierzu|mir) (?:liegen|fehlen|reichen)\b.*(?:keine|nicht|informationen|angaben)|als (?:assistent|ki)\b|"
    r"je n(?:e |')(?:ai|dispose|possède|peux|suis|saurais|puis)\b.*\bpas\b.*(?:informations?|accès|contexte|répondre|aider|mesure|demande|dire|données|éléments)|je (?:dois|préfère) (?:décliner|refuser)|en tant qu'(?:assistant|ia)|il m'est impossible de (?:répondre|vous aider)|"
    r"no (?:tengo|dispongo de|cuento con)\b.*(?:acceso|información|contexto|datos|suficiente)|no (?:puedo|podré|me es posible) (?:ayudar|responder|contestar|dar|comentar|determinar|proporcionar)|debo (?:declinar|rechazar)|como asistente\b"
    r")",
    re.I | re.S,
)
_COURTESY = re.compile(
    r"^\W*(?:is there anything else|thank(?:s| you)|please (?:provide|ask|try|share|contact|consult|check with|send|rephrase|let me|attach)|feel free|if you (?:share|provide|can|could|send|give|have|need|would)|let me know|sorry|i'm sorry|i am sorry|apologies|i hope|perhaps (?:you|someone)|try (?:again|once)|maybe you|"
    r"gracias|por favor|si (?:me )?(?:compartes|proporcionas|envías|facilitas)|lo siento|¿hay algo más|merci|veuillez|si vous (?:partagez|fournissez|pouvez)|désolée?|y a-t-il autre chose|danke|vielen dank|bitte|wenn (?:sie|du) |gibt es sonst|tut mir leid|entschuldigung|leider\W*$|unfortunately\W*$)",
    re.I,
)


def _sentences(text: str) -> Iterator[str]:
    return (s for line in text.split("\n") for s in re.split(r"(?<=[.!?])\s+", line.strip()) if re.search(r"\w", s))


def sentences(text: str) -> list[str]:
    return list(_sentences(text))


def _second(text: str) -> bool:
    """Whether a text has more than one sentence."""
    return next(itertools.islice(_sentences(text), 1, None), None) is not None


def is_refusal(text: str, models: Models) -> bool:
    """At least one sentence declines or claims to lack what is needed, and no other says anything."""
    said = sentences(text)
    if len(said) > 8:
        return False
    any_refused = last = False
    for i, s in enumerate(said):
        if models.says("refusal", s):
            any_refused = last = True
        elif i and last and len(s.split()) <= 2 or models.says("courtesy", s):
            last = False
        else:
            return False
    return any_refused


_GIVEN_UP = re.compile(r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|[\[(<](?:[^\])>\n]{0,20}\b)?(?:cut|truncated|continued|abgeschnitten|gekürzt|tronqué|coupé|cortado|truncado)\b[^\])>\n]{0,20}[\])>])\s*$", re.I)
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])(?:\s+|$)")


def is_truncated(text: str, models: Models) -> bool:
    text = text.rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    if _GIVEN_UP.search(text):
        return True
    last = text.split("\n")[-1]
    if _LIST.fullmatch(last):
        return True
    outside = _FENCED.sub(" ", text)
    item = _LIST.sub("", last)
    tail = re.split(r"(?<=[.!?])\s+", item)[-1]
    if last.count("`") % 2 or outside.count("`") % 2:
        return True
    if tail.count("(") > tail.count(")") or tail.count("[") > tail.count("]"):
        return True
    if re.search(r"\b0\.$", tail) and len(tail.split()) > 4:  # inside a decimal number
        return True
    if re.search(r"[.!?]['\"”»)\]*_`]*$", text) or text[-1] in "|>}":
        return False
    if re.search(r"[,;:(\[{\-–—=+/&]$", text):
        return True
    return models.cut_off(text)


def is_other_language(question: str | None, text: str, models: Models) -> bool:
    asked, sure = models.language(question or "")
    if asked is None or sure < 3:
        return False
    plain = _QUOTED.sub(" ", text)
    seen = trigrams(plain)
    return len(seen) >= 12 and models.log_odds(seen, asked) > max(8.0, 0.5 * len(seen))


def defect(question: str | None, text: str | None, models: Models) -> str | None:
    if text is None:
        return None
    if is_empty(text):
        return "empty"
    if is_copy(question, text):
        return "copy"
    if is_refusal(text, models):
        return "refusal"
    if is_other_language(question, text, models):
        return "other_language"
    return "truncated" if is_truncated(text, models) else None


def defects(pairs: DataFrame, models: Models) -> DataFrame:
    """task_id, side, defect of each defective side of (task_id, question, response_full, response_bridge)."""
    sides = pairs.where("task_id is not null").select(
        "task_id", "question", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"response_{s}").alias("text")) for s in ("full", "bridge")])).alias("s")
    ).select("task_id", "question", "s.side", "s.text").where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect(q, t, models) for q, t in zip(b.question, b.text)]
            yield pd.DataFrame({"task_id": b.task_id, "side": b.side, "defect": found}).dropna()

    return sides.mapInPandas(run, "task_id string, side string, defect string").dropDuplicates(["task_id", "side"])
