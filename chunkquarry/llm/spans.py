"""Long exact spans shared between records.

Two records share a span when one run of ``min_len`` or more code points stands verbatim in both. Comparing all
windows of that length would hash every position, so the search has two rounds:

1. *Anchors.* Shorter windows are hashed only where their position modulo a period lies in a perfect difference
   set. Whatever the two positions of a common run are, some offset below the period puts both on the set, so a
   run of ``min_len`` always has an anchor of ``min_len - period + 1`` characters in common. For a period of 133
   that is a hash at 9 % of the positions. A batch of records sends each hash once to a hash bucket and hears which of
   them other batches hold too.
2. *Extension.* Only windows of the full length that contain a shared anchor are compared, at every position of such
   a region. Neighbouring windows with the same minimizer (the least hash of the anchors' length within them) go to that
   minimizer's bucket as one compressed stretch of text. There windows are equal if two independent 64-bit hashes of
   their text agree; equal windows of different groups are the shared spans, whatever the number of records that hold them.

A batch first settles what it can see itself: of a window that several of its groups hold it sends one copy, marked as
such, and a task sends such a copy once for all its batches. So a header that stands in a third of all records costs a
bucket one row a task instead of one a record, and no pairs of records are ever formed. Batches are named by the ids of
their records and travel with their texts, so a task that runs again makes the same ones as long as the records come from
a scan.

Rows without id or text are no records. Texts shorter than ``min_len`` come out with nothing covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import buckets_for

FLUSH_CHARS = 4_000_000
FLUSH_ROWS = 60_000
#: How many hashes a task remembers as sent, and how many windows a bucket compares at once: bounds of memory, not of results.
REMEMBERED = 1 << 21
AT_ONCE = 1 << 22
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB))


def difference_set(order: int) -> tuple[int, np.ndarray]:
    """A period and a perfect difference set for it (Singer): lines of the projective plane of a prime order.

    Every residue modulo the period is the difference of exactly one pair of its members.
    """
    period = order * order + order + 1
    for c0, c1, c2 in product(range(1, order), range(order), range(order)):
        power, zeros = (1, 0, 0), []
        for i in range(period):  # powers of x modulo x^3 = c2 x^2 + c1 x + c0
            if power[2] == 0:
                zeros.append(i)
            a, b, top = power
            power = (top * c0 % order, (a + top * c1) % order, (b + top * c2) % order)
        if len(zeros) == order + 1 and len({(i - j) % period for i in zeros for j in zeros}) == period:
            return period, np.array(zeros)
    raise ValueError(f"no difference set of order {order}: it has to be a prime")


def _powers(base: int, n: int) -> np.ndarray:
    out, known, step = np.ones(max(n, 1), dtype=np.uint64), 1, base
    while known < n:
        take = min(known, n - known)
        with np.errstate(over="ignore"):
            out[known : known + take] = out[:take] * np.uint64(step)
        step, known = step * step % (1 << 64), known * 2
    return out


class Windows:
    """Hashes of any window of the texts of one batch, from prefix sums of polynomials modulo 2**64.

    There are two independent hashes (``which`` 0 and 1).
    """

    _tables: list = [(np.ones(1, dtype=np.uint64),) * 2] * 2

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(raw) != chars.sum():
            raw = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        self.raw = raw
        self.length = chars
        self.start = np.concatenate([[0], np.cumsum(chars)[:-1]]).astype(np.int64)
        self._prefix: list = [None, None]

    def hash(self, at: np.ndarray | slice, width: int, which: int = 0) -> np.ndarray:
        n = len(self.raw)
        with np.errstate(over="ignore"):
            if len(Windows._tables[which][0]) < n:
                Windows._tables[which] = (_powers(_BASES[which], n), _powers(pow(_BASES[which], -1, 1 << 64), n))
            up, down = Windows._tables[which]
            if self._prefix[which] is None:
                value = self.raw.astype(np.uint64) + np.uint64(1)
                value *= _MIX[which]
                value ^= value >> np.uint64(32)
                value *= up[:n]
                self._prefix[which] = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(value, out=self._prefix[which][1:])
            prefix = self._prefix[which]
            if isinstance(at, slice):
                h = (prefix[width:][at] - prefix[: len(prefix) - width][at]) * down[: len(prefix) - width][at]
            else:
                h = (prefix[at + width] - prefix[at]) * down[at]
            h ^= h >> np.uint64(32)
            h *= _MIX[which]
            h ^= h >> np.uint64(29)
            return h

    def anchors(self, period: int, cover: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and position in the batch of every window of ``width`` at a cover position of its text."""
        per = self.length // period + 1
        row = np.repeat(np.arange(len(per)), per)
        block = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * period
        at = (block[:, None] + cover[None, :]).ravel()
        row = np.repeat(row, len(cover))
        fits = at + width <= self.length[row]
        row, at = row[fits], at[fits]
        return row, self.start[row] + at

    def minimizers(self, width: int, span: int) -> np.ndarray:
        """For every position the least hash of the ``span`` windows of ``width`` that begin there and after."""
        least, reach = self.hash(slice(None), width), 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        return least

    def slices(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Stretches of the batch as UTF-8: the bytes of each, and all of them."""
        chars = self.raw[ranges(begin, size)]
        if chars.dtype == np.uint8:
            return size.astype(np.uint32), chars.tobytes()
        wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(size)])]
        return np.diff(ends).astype(np.uint32), chars.tobytes().decode("utf-32-le").encode()


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch of ``size`` members, one after the other."""
    if not len(size):
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - first, size)


def _planes(values: np.ndarray) -> bytes:
    """32-bit values, most significant bytes first: sorted values compress well this way."""
    return np.ascontiguousarray(values.astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.uint32)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, with the end as last item."""
    if not len(ordered):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])


def _batch_id(recs: np.ndarray) -> int:
    """The same whenever and wherever the same records make up a batch."""
    return int.from_bytes(hashlib.blake2b(recs.astype(np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Slices of a bounded number of rows and characters; one longer text is a slice of its own."""
    held, rows, size = [], 0, 0
    for batch in batches:
        weight = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        while begin < len(batch):
            total = np.cumsum(weight[begin:])
            take = max(int(np.searchsorted(total, FLUSH_CHARS - size, side="right")), 0 if held else 1)
            take = min(take, FLUSH_ROWS - rows)
            if take:
                held.append(batch.slice(begin, take))
                rows, size, begin = rows + take, size + int(total[take - 1]), begin + take
            if begin < len(batch):
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


_BLOB = "bucket int, batch long, kind string, data binary"
_STRETCH = "bucket int, rec long, a int, b int, data binary"


def _rows(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in parts], dtype=np.int64).tobytes() + b"".join(parts))


def _unpack(data: bytes, *types) -> list:
    whole = memoryview(zstandard.ZstdDecompressor().decompress(data))
    sizes = np.frombuffer(whole, dtype=np.int64, count=len(types))
    ends = 8 * len(types) + np.cumsum(sizes)
    parts = [whole[e - n : e] for e, n in zip(ends, sizes)]
    return [bytes(x) if t is bytes else np.frombuffer(x, dtype=t) for x, t in zip(parts, types)]


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    """Stretches of UTF-8 as an array of strings."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of a hash; with the lower one it tells as many bits apart as there are windows to tell, at any size."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Sent:
    """Hashes a task has sent already."""

    task, seen = None, np.zeros(0, dtype=np.uint64)

    @classmethod
    def fresh(cls, hashes: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes are new; they are remembered."""
        context = TaskContext.get()
        task = context.taskAttemptId() if context else None
        if task is None or task != cls.task:
            cls.task, cls.seen = task, np.zeros(0, dtype=np.uint64)
        new = ~np.isin(hashes, cls.seen)
        if len(cls.seen) < REMEMBERED:
            cls.seen = np.union1d(cls.seen, hashes[new])
        return new


def _groups(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each run holds more than one id."""
    return np.minimum.reduceat(ids, runs[:-1]) != np.maximum.reduceat(ids, runs[:-1])


def _anchor_blobs(period: int, cover: np.ndarray, width: int, buckets: int):
    """Round 1: the distinct anchor hashes of each batch by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _flushes(batches):
            windows, batch = Windows(part.column("text").combine_chunks()), _batch_id(part.column("rec").to_numpy())
            row, at = windows.anchors(period, cover, width)
            if not len(at):
                continue
            h = windows.hash(at, width)
            order = np.argsort(h, kind="stable")
            ends = _runs(h[order])
            several = _groups(part.column("grp").to_numpy()[row[order]], ends)
            h = h[order][ends[:-1]]
            send = ~several
            send[several] = Sent.fresh(h[several])
            h = h[send]
            bucket = _buckets(h, buckets)
            order = np.lexsort((h.astype(np.uint32), bucket))
            cut = _runs(bucket[order])
            yield _rows(_BLOB, [(int(bucket[order[a]]), batch, "anchors", _planes(h[order[a:b]].astype(np.uint32))) for a, b in zip(cut[:-1], cut[1:])])

    return run


def _anchor_replies(table: pa.Table) -> pa.Table:
    """Anchors of one bucket: a hash that two batches sent is shared; each batch hears which of its hashes are."""
    names = table.column("batch").to_numpy()
    lists = [_from_planes(x.as_py()) for x in table.column("data")]
    known, batch = np.unique(names, return_inverse=True)
    batch = np.repeat(batch, [len(x) for x in lists])
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    h, batch = h[order], batch[order]
    ends = _runs(h)
    shared = np.repeat(_groups(batch, ends), np.diff(ends))
    h, batch = h[shared], batch[shared]
    order = np.lexsort((h, batch))
    h, batch = h[order], batch[order]
    ends = _runs(batch)
    bucket = table.column("bucket")[0].as_py()
    rows = [(bucket, int(known[batch[a]]), "shared", _planes(h[a:b])) for a, b in zip(ends[:-1], ends[1:])] if len(h) else []
    return pa.Table.from_batches([_rows(_BLOB, rows)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches themselves, compressed, under the names that round 1 gave them."""
    for part in _flushes(batches):
        recs, text = part.column("rec").to_numpy().astype(np.int64), part.column("text").combine_chunks().cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = _pack(recs, part.column("grp").to_numpy().astype(np.int64), np.diff(ends).astype(np.uint32), bytes(memoryview(text.buffers()[2] or b"")[ends[0] : ends[-1]]))
        yield _rows(_BLOB, [(0, _batch_id(recs), "text", data)])


def _stretches(period: int, cover: np.ndarray, width: int, min_len: int, anchor_buckets: int, buckets: int):
    """Round 2: the regions of one batch around shared anchors, as stretches of windows by bucket; and what the batch can settle itself."""

    def one(data: bytes, bucket: np.ndarray, short: np.ndarray) -> Iterator[pa.RecordBatch]:
        recs, grps, sizes, text = _unpack(data, np.int64, np.int64, np.uint32, bytes)
        windows = Windows(_strings(sizes, text))
        row, at = windows.anchors(period, cover, width)
        h = windows.hash(at, width)
        order = np.argsort(h, kind="stable")
        ends = _runs(h[order])
        hit = np.zeros(len(h), dtype=bool)
        if len(h):
            hit[order] = np.repeat(_groups(grps[row[order]], ends), np.diff(ends))
        key = lambda b, x: (b.astype(np.uint64) << np.uint64(32)) | x.astype(np.uint64)
        hit |= np.isin(key(_buckets(h, anchor_buckets), h.astype(np.uint32)), key(bucket, short))
        row, at = row[hit], at[hit]
        end = windows.start[row] + windows.length[row] - min_len
        low, high = np.maximum(at - (min_len - width), windows.start[row]), np.minimum(at, end)
        edge = np.zeros(len(windows.raw) + 2, dtype=np.int32)
        ok = high >= low
        np.add.at(edge, low[ok], 1)
        np.add.at(edge, high[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(edge) > 0)
        if not len(at):
            return
        row = np.searchsorted(windows.start, at, side="right") - 1
        order, ends = equal_windows(windows, at, min_len)
        several = _groups(grps[row[order]], ends)
        own = np.zeros(len(at), dtype=bool)
        own[order] = np.repeat(several, np.diff(ends))
        first = order[ends[:-1]][several]  # one window stands for those that several groups hold
        send = ~own
        send[first] = Sent.fresh(windows.hash(at[first], min_len))
        local = merged(row[own], at[own] - windows.start[row[own]], min_len)
        if len(local[0]):
            yield _rows(_STRETCH, [(None, int(recs[r]), int(a), int(b), None) for r, a, b in zip(*local)])
        at, row, own = at[send], row[send], own[send]
        if not len(at):
            return
        least = windows.minimizers(width, min_len - width + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(row) != 0) | (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        bucket = _buckets(least[begin], buckets)
        order = np.argsort(bucket, kind="stable")
        cut, rows = _runs(bucket[order]), []
        for a, b in zip(cut[:-1], cut[1:]):
            i = order[a:b]
            of, n, where = begin[i], count[i], at[begin[i]]
            sizes, text = windows.slices(where, n + min_len - 1)
            r = row[of]
            rows.append((int(bucket[i[0]]), None, None, None, _pack(recs[r], grps[r], own[of], (where - windows.start[r]).astype(np.uint32), n.astype(np.uint32), sizes, text)))
        yield _rows(_STRETCH, rows)

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        replies = [(table.column("bucket")[i].as_py(), _from_planes(data[i].as_py())) for i, k in enumerate(kinds) if k == "shared"]
        bucket = np.repeat(np.array([b for b, _ in replies], dtype=np.int64), [len(x) for _, x in replies])
        short = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in replies)])
        if "text" not in kinds:  # links would be lost
            raise RuntimeError("records came in another order when they were read again: shared_spans needs records of a scan or a written table")
        out = [x for i, k in enumerate(kinds) if k == "text" for x in one(data[i].as_py(), bucket, short)]
        return pa.Table.from_batches(out or [_rows(_STRETCH, [])])

    return run


def equal_windows(windows: Windows, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows in which equal ones are neighbours, and where each run of them begins (the end as last item)."""
    h, second = windows.hash(at, width), windows.hash(at, width, 1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, h))
        same = (h[order][1:] == h[order][:-1]) & (second[order][1:] == second[order][:-1])
    return order, np.concatenate([[0], np.flatnonzero(~same) + 1, [len(at)]])


def merged(row: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, begin and end of the stretches that windows (in the order of row and position) cover; touching ones are one."""
    if not len(at):
        return row, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(at) > width)
    begin = np.flatnonzero(new)
    return row[begin], at[begin], at[np.append(begin[1:], len(at)) - 1] + width


def _window_replies(min_len: int):
    """The stretches of one bucket: rec, a, b of what of each record stands in another group too."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), np.int64, np.int64, np.bool_, np.uint32, np.uint32, np.uint32, bytes) for x in table.column("data")]
        rec, grp, own, begin, count, sizes = (np.concatenate([p[k] for p in parts]) for k in range(6))
        windows = Windows(_strings(sizes, b"".join(p[6] for p in parts)))
        count = count.astype(np.int64)
        at, of = ranges(windows.start, count), np.repeat(np.arange(len(count)), count)
        turn = windows.hash(at, min_len) >> np.uint64(40)  # equal windows are compared in the same turn
        turns = -(-len(at) // AT_ONCE)
        shared = np.zeros(len(at), dtype=bool)
        for t in range(turns):
            i = np.flatnonzero(turn % np.uint64(turns) == t) if turns > 1 else np.arange(len(at))
            if not len(i):
                continue
            order, ends = equal_windows(windows, at[i], min_len)
            s = of[i[order]]
            found = _groups(grp[s], ends) | np.logical_or.reduceat(own[s], ends[:-1])
            shared[i[order]] = np.repeat(found, np.diff(ends)) & ~own[s]
        of, at = of[shared], (at - np.repeat(windows.start, count))[shared]
        s, a, b = merged(of, at, min_len)
        return pa.table({"rec": rec[s], "a": (a + begin[s]).astype(np.int32), "b": (b + begin[s]).astype(np.int32)})

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in the order of rec and a, as one row of merged ones for each record."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]) if held is not None else part
        rec = part.column("rec").to_numpy()
        if not len(rec):
            continue
        whole = int(np.searchsorted(rec, rec[-1]))  # the last record may go on in the next batch
        held = part.slice(whole)
        if whole:
            yield _merged_records(part.slice(0, whole))
    if held is not None and len(held):
        yield _merged_records(held)


def _merged_records(part: pa.Table) -> pa.RecordBatch:
    rec, a, b = (part.column(c).to_numpy().astype(np.int64) for c in ("rec", "a", "b"))
    number = np.cumsum(np.concatenate([[0], (rec[1:] != rec[:-1]).astype(np.int64)]))
    far = np.int64(b.max()) + 1
    reach = np.maximum.accumulate(b + number * far) - number * far  # how far the stretches of the record so far go
    new = np.ones(len(a), dtype=bool)
    new[1:] = (np.diff(number) != 0) | (a[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(a)) - 1
    of = number[begin]
    ends = np.searchsorted(of, np.arange(number[-1] + 2))
    starts, lengths = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (a[begin], reach[last] - a[begin]))
    return pa.RecordBatch.from_arrays([pa.array(rec[np.searchsorted(number, np.arange(number[-1] + 1))], pa.int64()), starts, lengths], names=["rec", "starts", "lengths"])


def shared_spans(records: DataFrame, min_len: int = 200, order: int = 11) -> DataFrame:
    """One row for each record that shares a span of ``min_len`` or more with a record of another group.

    ``records``: rec bigint, grp bigint, text string; other columns are ignored. Records of one group do not count
    as others for each other; a repeated row is in its own group and so finds nothing in itself. Result: rec,
    starts and lengths of the covered stretches (overlapping or touching ones merged). Records are read twice, and have to come
    in the same order each time, as those of a scan or a written table do; otherwise the job fails. ``order`` is the prime order
    of the difference cover; its period has to be shorter than ``min_len``.
    """
    period, cover = difference_set(order)
    width = min_len - period + 1
    if width < 1:
        raise ValueError(f"a period of {period} is too long for spans of {min_len}")
    usable = records.select("rec", "grp", "text").where(F.col("rec").isNotNull() & F.col("grp").isNotNull() & (F.length("text") >= min_len))
    anchors = buckets_for(usable)
    replies = usable.mapInArrow(_anchor_blobs(period, cover, width, anchors), _BLOB).groupBy("bucket").applyInArrow(_anchor_replies, _BLOB)
    texts = usable.mapInArrow(_texts, _BLOB)
    stretches = replies.unionByName(texts).groupBy("batch").applyInArrow(_stretches(period, cover, width, min_len, anchors, 2 * anchors), _STRETCH)
    # what a batch settled itself passes by in groups of its record, beside the buckets
    key = F.coalesce(F.col("bucket").cast("long"), -1 - F.pmod(F.xxhash64("rec"), F.lit(anchors)))
    found = stretches.groupBy(key.alias("key")).applyInArrow(_settled(min_len), "rec long, a int, b int")
    return found.repartition("rec").sortWithinPartitions("rec", "a", "b").mapInArrow(_spans, "rec long, starts array<long>, lengths array<long>")


def _settled(min_len: int):
    compare = _window_replies(min_len)

    def run(table: pa.Table) -> pa.Table:
        return table.select(["rec", "a", "b"]) if table.column("bucket")[0].as_py() is None else compare(table)

    return run


def span_records(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Chunks (grouped by file) and patterns (each its own group) as records; an odd rec is a pattern."""
    file = F.coalesce(F.xxhash64(F.lit("file"), "file_path"), F.xxhash64(F.lit("chunk"), "chunk_no"))
    return chunks.select(
        (F.col("chunk_no") * 2).alias("rec"), F.when(F.col("file_path").isNotNull(), file).otherwise(F.xxhash64(F.lit("chunk"), "chunk_no")).alias("grp"), F.col("source").alias("text")
    ).unionByName(
        patterns.select((F.col("pattern_no") * 2 + 1).alias("rec"), F.xxhash64(F.lit("pattern"), "pattern_no").alias("grp"), F.col("original").alias("text"))
    )


def rec_columns() -> list:
    """rec_kind and rec_no of a rec of span_records."""
    return [F.when(F.col("rec") % 2 == 0, "chunk").otherwise("pattern").alias("rec_kind"), F.expr("rec div 2").alias("rec_no")]
