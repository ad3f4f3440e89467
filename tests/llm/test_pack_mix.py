import random
from collections import Counter, defaultdict

import pytest

from chunkquarry.llm import mix, pack, queries


def containers_of(lines, counts):
    out = defaultdict(list)
    by = defaultdict(list)
    for size, rank, first, copies in lines:
        by[size].append((rank, first, copies))
    for size, n in counts.items():
        ordered = sorted(by[size])
        for r in range(n):
            rank, first, copies = max(x for x in ordered if x[0] <= r)
            out[first + (r - rank) // copies].append(size)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 512])
    counts = Counter(min(capacity, max(1, int(rng.paretovariate(1) * rng.choice([1, 3, 10])))) for _ in range(rng.randrange(1, 3000)))
    lines, bins = pack.plan(counts, capacity)
    got = containers_of(lines, counts)
    assert len(got) == bins and set(got) == set(range(bins))
    assert max(map(sum, got.values())) <= capacity
    assert Counter(s for x in got.values() for s in x) == counts
    load = sum(s * n for s, n in counts.items())
    large = sum(n for s, n in counts.items() if 2 * s > capacity)
    assert bins <= max(-(-load // capacity) * 1.25 + 1, large * 1.25 + 1)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 40, 50, 64, 100, 101, 250])) for i in range(900)] + [(i, 60) for i in range(2000, 2600)] + [(None, 5), (5000, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, size long, piece int, container int").repartition(3)
    out = pack.pack(df, 100).collect()
    total, parts = Counter(), defaultdict(list)
    for r in out:
        total[r.container] += r["size"]
        parts[r.id].append((r.piece, r.start, r["size"]))
    assert max(total.values()) <= 100
    for i, n in rows:
        if i is None or n is None:
            continue
        p = sorted(parts[i])
        assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // 100)) and [x[1] for x in p] == [100 * k for k in range(len(p))]
    assert len(total) <= sum(n for i, n in rows if i is not None and n) / 100 * 1.2 + 600 * 0.35
    assert pack.pack(df.limit(0), 100).collect() == []


def test_schedule_deviates_less_than_one_block():
    for counts in ({"a": 1}, {"a": 500, "b": 300, "c": 150, "d": 50}, {"a": 997, "b": 1, "c": 2}, {str(i): 100 for i in range(10)}):
        slots, period = mix.schedule(counts), sum(counts.values())
        order = sorted((t, s) for s, ts in slots.items() for t in ts)
        assert [t for t, _ in order] == list(range(period))
        done = Counter()
        for t, s in order:
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * n / period) < 1 for x, n in counts.items())


def test_weights_and_quotas():
    assert mix.whole_weights({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    w = mix.whole_weights({"a": 0.9996, "b": 0.0002, "c": 0.0002}, 1000)
    assert sum(w.values()) == 1000 and min(w.values()) >= 1
    q = mix.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, "available")
    assert q == {"b": 20.0, "a": 90.0}
    assert mix.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, "feasible") == {"a": 20.0, "b": 20.0}


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(["a"] * 3000 + ["b"] * 800 + ["c"] * 90 + ["d"] * 50)]
    docs += [(90001, None, 5), (None, "a", 5), (90002, "a", None), (90003, "b", 0)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, n_tokens long, slot int").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("zz", 0.5, 4)], "source string, target_share double, max_repeats int")
    rows = sorted(mix.mixture(df, targets, block=200).collect(), key=lambda r: (r.slot, r.seq))
    assert {r.source for r in rows} == {"a", "b", "c"}
    uses = Counter((r.source, r.doc_id) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "a") == 1 and max(uses.values()) <= 4
    assert {d for s, d in uses if s == "c"} == {i for i, s, _ in docs if s == "c"}
    tokens, total = Counter(), 0
    for r in rows:
        tokens[r.source] += r.n_tokens
        total += r.n_tokens
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(tokens[s] - w * total) < 2 * 200 + 120
    report = {r.source: r for r in mix.shares(mix.mixture(df, targets, block=200), targets).collect()}
    assert abs(report["a"].actual_share - 0.5) < 0.02 and report["zz"].tokens == 0 and report["c"].most_uses <= 4
    assert mix.mixture(df.limit(0), targets).collect() == []


def test_registered_mixture_keeps_the_target_shares(spark, tmp_path):
    docs = [(i, "a" if i < 400 else "b", "en", "x", "some words of text " * (1 + i % 3)) for i in range(440)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, domain string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    targets.write.parquet(f"{tmp_path}/mix_targets.parquet")
    exact, available = ({r.source: r for r in mix.shares(queries.QUERIES[q](spark, str(tmp_path)), targets).collect()} for q in ("p9_mixture", "p9_available"))
    assert all(abs(r.actual_share - 0.5) < 0.02 and r.most_uses <= r.max_repeats for r in exact.values())
    assert available["b"].actual_share < 0.25 and available["b"].most_uses == 2
