import random
from collections import defaultdict

import numpy as np
import pytest

from chunkquarry.llm import spans


def brute(records, min_len):
    """rec -> covered characters, from the sets of all windows."""
    holders = defaultdict(set)
    for _, grp, text in records:
        for i in range(len(text) - min_len + 1):
            holders[text[i : i + min_len]].add(grp)
    out = {}
    for rec, _, text in records:
        covered = set()
        for i in range(len(text) - min_len + 1):
            if len(holders[text[i : i + min_len]]) > 1:
                covered.update(range(i, i + min_len))
        if covered:
            out[rec] = len(covered)
    return out


def run(spark, records, min_len, order, monkeypatch=None):
    df = spark.createDataFrame([(r, g, t, "x") for r, g, t in records], "rec long, grp long, text string, starts string").repartition(5)
    found = spans.shared_spans(df, min_len, order).collect()
    assert len({r.rec for r in found}) == len(found)
    for r in found:
        assert all(x >= min_len for x in r.lengths) and r.starts == sorted(r.starts)
    return {r.rec: sum(r.lengths) for r in found}


@pytest.mark.parametrize("order", [2, 3, 5, 7, 11])
def test_difference_set(order):
    period, cover = spans.difference_set(order)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_against_all_windows(spark):
    rng = random.Random(3)
    letters = "abcdé \nß漢"
    blocks = ["".join(rng.choice(letters) for _ in range(n)) for n in (19, 20, 21, 30, 45, 80)]
    records = []
    for i in range(150):
        text = "".join(rng.choice([rng.choice(blocks), "".join(rng.choice(letters) for _ in range(rng.randrange(25)))]) for _ in range(rng.randrange(6)))
        records.append((i, i // 2, text))
    records += [(1000, 500, blocks[1]), (1001, 501, blocks[1]), (1002, 501, "x" * 200), (1003, 501, "x" * 200), (1004, 502, "")]
    assert run(spark, records, 20, 3) == brute(records, 20)


def test_run_of_one_letter_hot_block_and_repeated_rows(spark):
    hot = "".join(random.Random(5).choice("abcdef") for _ in range(60))
    records = [(i, i, f"{i:05d}" + hot + f"{i * 7:06d}") for i in range(300)] + [(400, 400, "z" * 90), (401, 401, "y" + "z" * 50)]
    assert run(spark, records + records[:20], 40, 5) == brute(records, 40)


def test_null_and_empty(spark):
    rows = [(1, 1, None), (None, 2, "a" * 30), (3, 3, ""), (4, 4, "a" * 30), (5, None, "a" * 30)]
    df = spark.createDataFrame(rows, "rec long, grp long, text string")
    assert spans.shared_spans(df, 20, 3).collect() == []
    assert spans.shared_spans(df.limit(0), 20, 3).collect() == []


def test_small_flushes_give_the_same(spark, monkeypatch):
    texts = ["".join(random.Random(i % 7).choice("abc") for _ in range(50)) for i in range(40)]
    windows = spans.Windows(__import__("pyarrow").array(texts))
    row, at = windows.anchors(13, np.array([0, 1, 3, 9]), 8)
    assert {texts[r][a - windows.start[r] : a - windows.start[r] + 8] for r, a in zip(row, at)} == {t[i : i + 8] for t in texts for i in range(43) if i % 13 in (0, 1, 3, 9)}
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([(1, 1, "a")], "rec long, grp long, text string"), 100, 11)


def test_batches_and_turns_of_any_size_give_the_same(spark, monkeypatch):
    """Small batches, buckets compared in several turns, and a first hash that tells little: the second one decides."""
    rng = random.Random(9)
    block = ["".join(rng.choice("abé漢 ") for _ in range(n)) for n in (25, 40, 70)]
    records = [(i, i // 3, "".join(rng.choice([*block, "".join(rng.choice("abcd") for _ in range(15))]) for _ in range(4))) for i in range(120)]
    want = brute(records, 20)
    period, cover = spans.difference_set(3)
    width = 20 - period + 1
    monkeypatch.setattr(spans, "FLUSH_CHARS", 300)
    monkeypatch.setattr(spans, "AT_ONCE", 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"rec": [r for r, _, _ in records], "grp": [g for _, g, _ in records], "text": [t for _, _, t in records]})

    def grouped(batches, key):
        out = defaultdict(list)
        for b in batches:
            for r in b.to_pylist():
                out[r[key]].append(r)
        return {k: pa.Table.from_pylist(v, b.schema) for k, v in out.items()}

    for weak in (False, True):
        if weak:
            plain = spans.Windows.hash
            monkeypatch.setattr(spans.Windows, "hash", lambda self, at, w, which=0: plain(self, at, w, which) & np.uint64(0xFFFFFFFFFFFFFFFF if which else 0x3F000000FF))
            monkeypatch.setattr(spans.Sent, "fresh", classmethod(lambda cls, h: np.ones(len(h), dtype=bool)))
        replies = [spans._anchor_replies(t) for t in grouped(spans._anchor_blobs(period, cover, width, 7)(iter([batch])), "bucket").values()]
        both = [b for t in replies for b in t.to_batches()] + list(spans._texts(iter([batch])))
        stretches = [spans._stretches(period, cover, width, 20, 7, 5)(t) for t in grouped(both, "batch").values()]
        rows = []
        for key, t in grouped([b for t in stretches for b in t.to_batches()], "bucket").items():
            rows += spans._settled(20)(t).to_pylist()
        covered = defaultdict(set)
        for r in rows:
            covered[r["rec"]].update(range(r["a"], r["b"]))
        assert {k: len(v) for k, v in covered.items()} == want


def test_replies_without_their_batch_fail(spark):
    import pyarrow as pa

    orphan = pa.table({"bucket": pa.array([1], pa.int32()), "batch": pa.array([5], pa.int64()), "kind": ["shared"], "data": pa.array([spans._planes(np.array([7], dtype=np.uint32))], pa.binary())})
    with pytest.raises(RuntimeError):
        spans._stretches(13, np.array([0, 1, 3, 9]), 8, 20, 7, 5)(orphan)
