"""Parameter grids as columns, and leaderboards over their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.tables import language_of, numbered
from .corpus import distinct_chunks

#: Settings that are compared: threshold, penalty of a complex line.
GRID = {"threshold": (0.60, 0.65, 0.70, 0.75, 0.80, 0.85), "penalty": (0.04, 0.06, 0.08)}


def grid(values: dict[str, tuple[float, ...]] = GRID):
    """All settings as an array of structs, to be exploded."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(values, row)]) for row in product(*values.values())])


def skeleton_grid(chunks: DataFrame, values: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """Per setting: Python functions whose body would be dropped, their tokens and the share of all tokens.

    The features of a chunk don't depend on the setting, so chunks are first counted by features; the settings meet that
    small table, not the chunks.
    """
    functions = chunks.where(F.lower("chunk_type").isin("function", "method") & F.col("source").isNotNull() & (language_of(F.col("file_path")) == "python"))
    f = text.line_features(text.strip(F.col("source")), lexicon.PY_COMPLEX, lexicon.PY_SIMPLE)
    rows = distinct_chunks(functions, f.alias("f"), text.count_tokens(F.col("source")).alias("tokens")).select("f.n", "f.k", (F.col("f.s") >= 0.5 * F.col("f.n")).alias("plain"), "tokens")
    by_feature = rows.groupBy("n", "k", "plain").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    tried = by_feature.withColumn("g", F.explode(grid(values))).select("*", "g.*")
    features = F.struct("n", "k", F.when(F.col("plain"), F.col("n")).otherwise(F.lit(0)).alias("s"))
    beyond = F.greatest(F.lit(0.0), 0.70 - (F.col("n") - 35) * 0.02)
    pi = text.predictability(features, beyond, 0.35, penalty=F.col("penalty"))
    hit = F.round(pi, 9) >= F.col("threshold")
    sums = tried.groupBy(*values).agg(F.sum(F.when(hit, F.col("chunks")).otherwise(0)).alias("dropped"), F.sum(F.when(hit, F.col("tokens")).otherwise(0)).alias("tokens_dropped"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("share", F.col("tokens_dropped") / F.col("tokens"))


def best_setting(results: DataFrame, target: float = 0.5) -> DataFrame:
    """The setting whose share comes closest to a target; ties go to the smaller setting."""
    key = F.struct(F.abs(F.col("share") - target).alias("off"), "threshold", "penalty", "share")
    return results.agg(F.min(key).alias("m")).select("m.threshold", "m.penalty", "m.share")


def speed_adjusted(runs: DataFrame, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """runs (run, score, elapsed) with adjusted: the score times median elapsed over own, the ratio clamped; 1 without elapsed."""
    timed = numbered(runs.where("elapsed > 0").select(F.lit(0).alias("all"), "elapsed", "run"), "all", F.col("elapsed").asc(), F.col("run").asc())
    n = timed.count()
    median = timed.where(F.col("place").isin((n + 1) // 2, (n + 2) // 2)).agg(F.avg("elapsed")).first()[0]
    median = F.lit(median)
    ratio = F.when(F.col("elapsed") > 0, F.greatest(F.lit(low), F.least(F.lit(high), median / F.col("elapsed")))).otherwise(1.0)
    return runs.select("run", "score", "elapsed", (F.col("score") * ratio).alias("adjusted"))


def leaderboard(adjusted: DataFrame, n: int = 20) -> DataFrame:
    """The n best runs."""
    return adjusted.orderBy(F.desc("adjusted"), "run").limit(n)


def label(env, most: int = 3, prefix: str = ""):
    """The first settings of a map, in the order of their names, as 'A.B=1 | C=2'."""
    short = lambda k: F.replace(F.replace(k, F.lit(prefix), F.lit("")) if prefix else k, F.lit("_"), F.lit("."))
    return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(env)), 1, most), lambda e: F.concat(short(e["key"]), F.lit("="), e["value"])), " | ")


def log_metrics(logs: DataFrame) -> DataFrame:
    """run and the metrics that the lines of its log (run, text) tell; null where no line does.

    original_tokens, after_skeleton and skeleton_saved come from the first line that has them, the others from the last.
    """
    lines = logs.select("run", F.posexplode(text.lines(F.col("text"))).alias("at", "line"))
    line = F.col("line")
    whole = F.replace(F.regexp_extract(line, r"([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long")
    percent = F.regexp_extract(line, r"([0-9.]+)%", 1).try_cast("double") / 100
    numbers = F.filter(F.transform(text.matches(line, r"[0-9]+\.[0-9]+"), lambda x: x.cast("double")), lambda x: (x >= 0) & (x <= 1))
    first, last = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(-1))
    told = {
        "original_tokens": (line.contains("Original tokens:"), whole, True), "after_skeleton": (line.contains("After skeleton:"), whole, True),
        "skeleton_saved": (line.contains("After skeleton:") & line.contains("%"), percent, True), "consistency": (line.contains("Mean RQS-L1") | line.contains("Mean CCC"), first, False),
        "true_value": (line.contains("True Value") & (F.lower(line).contains("x") | line.contains("×")), last, False), "c_saved": (line.contains("TOTAL TER"), percent, False),
    }
    aggs = [(F.min_by if earliest else F.max_by)(F.when(hit, value), F.when(hit, F.col("at"))).alias(k) for k, (hit, value, earliest) in told.items()]
    return lines.groupBy("run").agg(*aggs)


MODES = {"tv": ("tv", "product"), "tv_time": ("tv_time", "tv"), "ter": ("ter", "tv"), "ccc": ("ccc", "tv")}


def leaderboards(runs: DataFrame, n: int = 20, baseline: dict[str, float] = lexicon.BASELINE) -> DataFrame:
    """mode, place, run, score, delta: the n best of runs (run, tv, tv_time, ter, ccc) in each mode and what they are above the baseline.

    Ties go by the mode's second column, then by run. Each mode is a limited sort of its own; its n rows alone are numbered.
    """
    boards = []
    rows = runs.withColumn("product", F.col("ter") * F.col("ccc"))
    for mode, (by, then) in MODES.items():
        best = rows.orderBy(F.desc_nulls_last(by), F.desc_nulls_last(then), "run").limit(n)
        place = F.row_number().over(W.orderBy(F.desc_nulls_last(by), F.desc_nulls_last(then), "run"))
        boards.append(best.select(F.lit(mode).alias("mode"), place.alias("place"), "run", F.col(by).alias("score"), (F.col(by) - baseline[mode]).alias("delta")))
    return reduce(DataFrame.unionByName, boards)


def coordinate_descent(score: Callable[[dict[str, float]], dict[tuple, float]], spaces: dict[str, tuple[float, ...]] = GRID, rounds: int = 2, gain: float = 0.002) -> tuple[dict[str, float], float]:
    """The best setting found by changing one parameter at a time, from the middle of each range, and its score.

    ``score(ranges)`` gives the score of each setting (a tuple in the order of ``spaces``) of some ranges; it is called once
    for each parameter and round. A change has to gain more than ``gain``; a round without one ends the search.
    """
    best, value = {k: v[len(v) // 2] for k, v in spaces.items()}, float("-inf")
    for _ in range(rounds):
        better = False
        for k, values in spaces.items():
            found = score({x: values if x == k else (best[x],) for x in spaces})
            top = max(sorted(found), key=lambda s: found[s])
            if found[top] > value + gain:
                best, value, better = dict(zip(spaces, top)), found[top], True
        if not better:
            break
    return best, value
