"""Scores of paired responses: term cosine, code overlap, longest common subsequence, composite, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon, text


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each task_id once."""
    return pairs.where("task_id is not null").dropDuplicates(["task_id"])


def cosine(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, cosine of the term frequencies of two texts; 0 where either has no terms, null where either is null."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), text.terms(F.col(c)).alias("t")) for s, c in ((0, a), (1, b))])).alias("x"))
    counts = each.select(key, "x.side", F.explode("x.t").alias("term")).groupBy(key, "term").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    sums = counts.groupBy(key).agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    scored = sums.select(key, F.when((F.col("nn") > 0) & (F.col("mm") > 0), F.col("dot") / (F.sqrt("nn") * F.sqrt("mm"))).otherwise(0.0).alias("cosine"))
    return rows.select(key).join(scored, key, "left").fillna(0.0, ["cosine"])


def tfidf_cosine(pairs: DataFrame, key: str, a: str, b: str, floor: float = 0.01) -> DataFrame:
    """key, cosine weighted by the rarity of terms within text a: ln(distinct terms / (1 + frequency)), 1 for terms it lacks."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), text.terms(F.col(c)).alias("t")) for s, c in ((0, a), (1, b))])).alias("x"))
    counts = each.select(key, "x.side", F.explode("x.t").alias("term")).groupBy(key, "term").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    distinct = counts.groupBy(key).agg(F.count_if(F.col("n") > 0).alias("u"))
    weight = F.when(F.col("n") > 0, F.greatest(F.log(F.col("u") / (1 + F.col("n"))), F.lit(floor))).otherwise(1.0)
    w = counts.join(distinct, key).withColumn("w", weight).withColumn("x", F.col("n") * F.col("w")).withColumn("y", F.col("m") * F.col("w"))
    sums = w.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    scored = sums.select(key, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("dot") / (F.sqrt("xx") * F.sqrt("yy"))).otherwise(0.0).alias("cosine"))
    return rows.select(key).join(scored, key, "left").fillna(0.0, ["cosine"])


def fenced_identifiers(c: str):
    """Distinct identifiers of the fenced code blocks of a text."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```(?:python)?\n(.*?)```"), F.lit(1))
    return F.array_distinct(text.matches(F.array_join(blocks, "\n"), r"[a-zA-Z_]\w*"))


def code_overlap(a: str, b: str):
    """Shared identifiers of fenced code over all; 1 where text a has no code."""
    x, y = fenced_identifiers(a), fenced_identifiers(b)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def code_block(c: str):
    """The first fenced block, else the first function definition up to a blank line, else null."""
    fenced = F.regexp_extract(c, r"(?s)```(?:python)?\n(.*?)```", 1)
    defined = F.regexp_extract(c, r"(?s)(def \w+.*?)(?:\n\n|\z)", 1)
    return F.coalesce(F.nullif(text.strip(fenced), F.lit("")), F.nullif(text.strip(defined), F.lit("")))


def composite(semantic, overlap, functional, judge):
    """Weighted mean of the scores that were run: -1 or null means not run."""
    runs = [(semantic, 0.25, F.lit(True)), (overlap, 0.15, F.lit(True)), (functional, 0.40, functional >= 0), (judge, 0.20, judge >= 0)]
    value = sum((F.when(ok, s * w).otherwise(0.0) for s, w, ok in runs), F.lit(0.0))
    weight = sum((F.when(ok, w).otherwise(0.0) for _, w, ok in runs), F.lit(0.0))
    return value / weight


def scores(pairs: DataFrame) -> DataFrame:
    """task_id, semantic, overlap, composite, saved (percent of tokens) of the pairs with both responses."""
    rows = distinct_pairs(pairs).where("response_full is not null and response_bridge is not null")
    saved = F.when(F.col("full_tokens") > 0, 100.0 * (F.col("full_tokens") - F.col("bridge_tokens")) / F.col("full_tokens"))
    kept = rows.select("task_id", code_overlap("response_full", "response_bridge").alias("overlap"), "functional", "judge", saved.alias("saved"))
    both = kept.join(cosine(rows, "task_id", "response_full", "response_bridge"), "task_id")
    return both.select("task_id", F.col("cosine").alias("semantic"), "overlap", composite(F.col("cosine"), F.col("overlap"), F.col("functional"), F.col("judge")).alias("composite"), "saved")


def lcs_f1(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence, two rows of the table at a time."""
    if not a or not b:
        return 0.0
    vocabulary: dict[str, int] = {}
    x, y = (np.array([vocabulary.setdefault(t, len(vocabulary)) for t in s]) for s in (a, b))
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for t in x:
        grown = np.maximum(row[1:], np.where(y == t, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(grown)
    n = int(row[-1])
    return 2 * n / (len(a) + len(b)) if n else 0.0


@F.pandas_udf(T.DoubleType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_f1(list(x), list(y)) for x, y in zip(a, b)], dtype=float)


def rouge_l(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, rouge_l of two texts over their terms in order."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.select(key, _lcs(text.terms(F.col(a)), text.terms(F.col(b))).alias("rouge_l"))


def verdict(score):
    """The band of a composite score."""
    out = F.lit("FAILURE")
    for name, least in reversed(lexicon.VERDICTS):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def combined_verdict(saved, consistency):
    """The band of tokens saved, in percent, together with consistency."""
    high, good, ok = saved >= lexicon.SAVED_HIGH, saved >= lexicon.SAVED_GOOD, consistency >= lexicon.CONSISTENT
    ladder = F.when(high & (consistency >= lexicon.VERY_CONSISTENT), "EXCELLENT").when(high & ok, "PASSED").when(good & ok, "GOOD").when(high, "CONSISTENCY RISK").when(~good & ok, "LOW COMPRESSION").otherwise("BELOW TARGETS")
    return F.when(saved.isNotNull() & consistency.isNotNull(), ladder)


def confidence(pairs: DataFrame, answer: str) -> DataFrame:
    """task_id, confidence: the term cosine of question and answer."""
    return cosine(distinct_pairs(pairs), "task_id", "question", answer).select("task_id", F.round("cosine", 4).alias("confidence"))


def gated_mean(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Mean composite score of the pairs with enough words on both sides, how many these are, and how many were dropped."""
    rows = distinct_pairs(pairs).where("response_full is not null and response_bridge is not null")
    long = rows.select("task_id", ((text.count_words(F.col("response_full")) >= least) & (text.count_words(F.col("response_bridge")) >= least)).alias("long"))
    both = long.join(scores(pairs).select("task_id", "composite"), "task_id")
    return both.agg(F.count_if("long").alias("kept"), F.count_if(~F.col("long")).alias("dropped"), F.round(F.avg(F.when(F.col("long"), F.col("composite"))), 4).alias("mean_score"))


def routed_score(texts: DataFrame, key: str, original: str, compressed: str, interface: str | None = None) -> DataFrame:
    """key, score of a text against its compressed form: term cosine, or where ``interface`` names the column of its interface
    the longest common subsequence of that and the compressed form."""
    if interface is None:
        return cosine(texts, key, original, compressed).withColumnRenamed("cosine", "score")
    return rouge_l(texts, key, interface, compressed).withColumnRenamed("rouge_l", "score")
