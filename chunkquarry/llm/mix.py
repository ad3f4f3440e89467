"""Mixing sources to target weights.

Each source is a stream of its documents in an order fixed by a hash, read up to ``max_repeats`` times, cut into blocks
of ``block`` tokens (a document belongs to the block it begins in and is never cut). Block k of a source with weight w
is released at k/w and due at (k+1)/w (Pfair windows); one block is scheduled at a time, of the released ones that with
the earliest deadline. As the weights add up to one every deadline is met, so at any point of the mixture each source is
less than one block (and the rest of one document) away from its share. Weights are multiples of 1/``slots``, so the
schedule repeats and only one period of it is ever computed; the place of block k follows from k modulo the period.

The total is by default the largest at which every source can give its share ("feasible"); with ``total="available"``
it is the size of all sources together, or it is a number of tokens. Sources that cannot give their share within
max_repeats then give all they may, the others share the rest by weight, and the actual shares say so.

Positions within a source come from bucketed prefix sums, so that no source, however large, is one sorted group.
Documents without id, source or tokens and sources without a target or with a weight of 0 or less take no part.
Targets are scaled to add up to 1; of targets that repeat a source the first by share counts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import buckets_for


def schedule(counts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of one period: counts[s] blocks of each source, earliest deadline first among the released."""
    period = sum(counts.values())
    release = {s: [k * period // n for k in range(n)] for s, n in counts.items() if n}
    due = {s: [-(-(k + 1) * period // n) for k in range(n)] for s, n in counts.items() if n}
    waiting = [(r[0], due[s][0], s, 0) for s, r in release.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in release}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, d, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, k))
        d, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if k + 1 < counts[s]:
            heapq.heappush(waiting, (release[s][k + 1], due[s][k + 1], s, k + 1))
    return out


def whole_weights(share: dict[str, float], slots: int) -> dict[str, int]:
    """Shares as whole numbers of slots that add up to ``slots``, by largest remainder, each at least 1."""
    exact = {s: x * slots for s, x in share.items()}
    out = {s: max(1, int(x + 1e-9)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) >= slots:
            break
        out[s] += 1
    while sum(out.values()) > slots:
        s = max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], s))
        out[s] -= 1
    return out


def quotas(sizes: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: str | int) -> dict[str, float]:
    """Tokens that each source gives."""
    most = {s: sizes[s] * repeats[s] for s in share}
    if total == "feasible":
        whole = min(most[s] / share[s] for s in share)
        return {s: share[s] * whole for s in share}
    rest, free, out = float(sum(sizes.values()) if total == "available" else total), dict(share), {}
    while free:
        weight = sum(free.values())
        short = [s for s in free if most[s] < rest * free[s] / weight - 1e-9]
        if not short:
            return out | {s: rest * w / weight for s, w in free.items()}
        for s in short:
            out[s] = float(most[s])
            del free[s]
        rest -= sum(out[s] for s in short)
    return out


def mixture(documents: DataFrame, targets: DataFrame, block: int = 2048, slots: int = 10_000, total: str | int = "feasible", seed: int = 17) -> DataFrame:
    """slot, seq, source, pass, doc_id, n_tokens of every use of a document; the mixture is in the order of slot, seq.

    ``documents``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats (a handful of rows).
    """
    docs = documents.where("doc_id is not null and source is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    rows = docs.join(wanted, "source").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.first("t").alias("t")).collect()  # one row a source
    spark = documents.sparkSession
    empty = "slot long, seq long, source string, pass int, doc_id long, n_tokens long"
    if not rows:
        return spark.createDataFrame([], empty)
    weight = sum(r.t.target_share for r in rows)
    share = {r.source: r.t.target_share / weight for r in rows}
    sizes = {r.source: r["size"] for r in rows}
    quota = quotas(sizes, share, {r.source: r.t.max_repeats for r in rows}, total)
    given = sum(quota.values())
    counts = whole_weights({s: q / given for s, q in quota.items()}, max(slots, len(quota)))
    period = sum(counts.values())
    offsets = [(s, k, slot) for s, places in schedule(counts).items() for k, slot in enumerate(places)]
    places = spark.createDataFrame(offsets, "source string, k long, offset long")
    facts = spark.createDataFrame([(s, sizes[s], float(quota[s]), counts[s]) for s in quota], "source string, size long, quota double, per_period long")

    buckets = buckets_for(documents)
    keyed = docs.join(F.broadcast(facts), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    keyed = keyed.withColumn("bucket", F.expr(f"int(shiftrightunsigned(h, 33) * {buckets} div {1 << 31})"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    inner = W.partitionBy("source", "bucket").orderBy(F.expr("shiftrightunsigned(h, 1)"), "h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inner_start", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(starts, ["source", "bucket"])
    placed = placed.withColumn("begin", F.col("bucket_start") + F.col("inner_start"))
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("size")) - 1, F.lit(0)).cast("int"))
    used = placed.withColumn("pass", F.explode(passes)).withColumn("seq", F.col("pass") * F.col("size") + F.col("begin")).where("seq + n_tokens / 2 < quota")
    used = used.withColumn("block", F.expr(f"seq div {block}")).withColumn("k", F.expr("block % per_period"))
    slot = F.expr(f"(block div per_period) * {period}") + F.col("offset")
    return used.join(F.broadcast(places), ["source", "k"]).select(slot.alias("slot"), "seq", "source", "pass", "doc_id", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target and actual share, tokens, uses, documents and the most uses of one."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    per = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    whole = per.agg(F.sum("tokens")).scalar()
    filled = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["tokens", "uses", "documents", "most_uses"])
    return filled.withColumn("actual_share", F.col("tokens") / whole)
