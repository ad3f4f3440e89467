"""Splitting oversized items at natural boundaries.

A text larger than the limit is cut along a hierarchy of separators: section (a blank line followed by a line that
is not indented), paragraph (a blank line), line, sentence, word and, where the unit is the character, character. Parts
that fit are packed greedily into pieces; a part that does not fit is cut by the next finer separator. Each piece but the
first begins with an overlap: the longest run of whole parts from the end of the piece before that has at most ``overlap``
units, or that many units where even the last part is longer. A piece is a stretch of the text and never has more units
than the limit. The pieces cover the text: where a piece begins after the end of the last one, only blanks lie between.

In unit ``word`` sizes count words, and a word, however long, is never cut; in unit ``char`` they count characters with the
blanks between words. Null, empty and blank texts, and texts within the limit, give no pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\S+")
#: Every character that parts words.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: From coarse to fine: where a part may begin.
SEPARATORS = (
    ("section", re.compile(r"\n[^\S\n]*\n(?=\S)")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?;])\s+|(?<=[,)}])\s+")),
    ("word", re.compile(r"\s+")),
)


def _parts(text: str, begin: int, end: int, starts, limit: int, level: int, before: int, out: list[tuple[int, int, int]]) -> None:
    """Append (first unit, end unit, separator before it) of the parts of units begin..end, none over the limit.

    ``starts``: where units begin; separators are numbered from 1, 0 stands for the beginning of the text.
    """
    if end - begin <= limit:
        out.append((begin, end, before))
        return
    if level == len(SEPARATORS):
        out.extend((i, i + 1, before if i == begin else level + 1) for i in range(begin, end))
        return
    low, high = starts[begin], starts[end] if end < len(starts) else len(text)
    cuts, last = [begin], begin
    for m in SEPARATORS[level][1].finditer(text, low, high):
        i = bisect_left(starts, m.end(), last, end)
        if last < i < end:
            cuts.append(i)
            last = i
    cuts.append(end)
    for a, b in zip(cuts, cuts[1:]):
        _parts(text, a, b, starts, limit, level + 1, before if a == begin else level + 1, out)


_BOUNDARIES = ("start", *(name for name, _ in SEPARATORS), "char")


def pieces(text: str, limit: int, overlap: int, unit: str = "word") -> list[tuple[int, int, int, str]]:
    """(start, end, units, boundary) of the pieces of a text over the limit; boundary: the separator before the piece."""
    if unit == "word":
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        starts, ends = [a for a, _ in words], [b for _, b in words]
    else:
        starts, ends = range(len(text)), range(1, len(text) + 1)
    if len(starts) <= limit:
        return []
    parts: list[tuple[int, int, int]] = []
    _parts(text, 0, len(starts), starts, limit, 0, 0, parts)
    begins = [p[0] for p in parts]
    out, first, i = [], 0, 0
    while i < len(parts):
        j = bisect_right(begins, first + limit, i) - 1  # the last part that may begin in this piece
        while j >= i and parts[j][1] > first + limit:
            j -= 1
        if j < i:  # the overlap leaves no room for the next part: begin with that part
            first = begins[i]
            continue
        stop = parts[j][1]
        at = bisect_left(begins, first)
        inner = len(SEPARATORS) + (unit == "char")  # an overlap that begins inside a part
        before = parts[at][2] if at < len(begins) and begins[at] == first else inner
        out.append((starts[first], ends[stop - 1], stop - first, _BOUNDARIES[before]))
        i = j + 1
        if i < len(parts):
            room = min(overlap, limit - (parts[i][1] - parts[i][0]))
            back = max(stop - room, first + 1)
            k = bisect_left(begins, back)
            first = begins[k] if k <= j else max(back, stop - room)
    return out


def _split(limit: int, overlap: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("rec", "piece_no", "start", "end", "size", "boundary", "widest_line", "piece")}
            for rec, text in zip(batch.column("rec").to_pylist(), batch.column("text").to_pylist()):
                found = pieces(text, limit, overlap, unit)
                widest = max((len(WORD.findall(x)) for x in text.split("\n")), default=0) if found else 0
                for i, (a, b, n, boundary) in enumerate(found):
                    for c, v in zip(cols, (rec, i, a, b, n, boundary, widest, text[a:b])):
                        cols[c].append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("rec", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("boundary", pa.string()), ("widest_line", pa.int32()), ("piece", pa.string())])


def split_oversized(items: DataFrame, limit: int, overlap: int, unit: str = "word") -> DataFrame:
    """The pieces of every item (rec bigint, text string) over the limit.

    rec, piece_no, start and end (characters from 0), size in units, boundary (the kind of separator the piece begins
    at), widest_line (the most words of a line of the item), piece. An item that comes twice is split once.
    Needs 0 <= overlap < limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be less than the limit")
    least = 2 * limit + 1 if unit == "word" else limit + 1  # fewer characters can't hold more than limit words
    large = items.select("rec", "text").where(F.col("rec").isNotNull() & (F.length("text") >= least))
    if unit == "word":  # more than limit words have at least limit blanks between them
        large = large.where(F.length("text") - F.length(F.translate("text", BLANKS, "")) >= limit)
    return large.dropDuplicates(["rec"]).mapInArrow(_split(limit, overlap, unit), "rec long, piece_no int, start int, end int, size int, boundary string, widest_line int, piece string")
