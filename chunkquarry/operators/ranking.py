"""Ranking of records against questions: keywords, function fields, vectors, and fusion of rankings.

A question set is a table (qid, question). Every ranking returns qid, the record's key, score and place, for the k best
records of each question; ties go to the smaller key. Only records with at least one matching token are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text


def best(scored: DataFrame, k: int, key: str = "rec") -> DataFrame:
    """The k best of each question (a window limit that partitions apply before the shuffle)."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term: the distinct tokens of each question."""
    return questions.select("qid", F.explode(F.array_distinct(text.identifiers(F.col("question")))).alias("term"))


def _tokens(c: Column) -> Column:
    return F.coalesce(text.identifiers(c), F.array().cast("array<string>"))


def _asked(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """The exploded tokens (term, ...) that any question asks for, met with the questions; others go before anything is counted."""
    return parts.join(question_terms(questions), "term")


def keyword_scores(questions: DataFrame, records: DataFrame) -> DataFrame:
    """qid, rec, score: occurrences of the question's tokens over the logarithm of the record's length."""
    listed = records.select("rec", _tokens(F.col("text")).alias("t"))
    hits = _asked(listed.select("rec", F.size("t").alias("size"), F.explode("t").alias("term")), questions)
    return hits.groupBy("qid", "rec", "size").agg(F.count("*").alias("hits")).select("qid", "rec", (F.col("hits") / F.log(F.col("size") + 2)).alias("score"))


def field_scores(questions: DataFrame, records: DataFrame, weights: dict[str, float] = lexicon.FIELD_WEIGHTS) -> DataFrame:
    """qid, rec, score over the fields of function records (rec, text, name, signature, callees array, summary, line_count).

    Field tokens are counted once; the body counts occurrences, less for very long functions. One pass over the records
    gives every token with what it adds to the score of a question that asks for it.
    """
    fields = {"name": F.col("name"), "signature": F.col("signature"), "callees": F.array_join(F.coalesce("callees", F.array().cast("array<string>")), " "), "summary": F.col("summary")}
    listed = records.select("rec", F.lower("name").alias("symbol"), "line_count", _tokens(F.col("text")).alias("body"), *(F.array_distinct(_tokens(c)).alias(f"f_{k}") for k, c in fields.items()))
    part = lambda t, w: F.struct(t.alias("term"), w.cast("double").alias("part"))
    of = lambda c, w: F.transform(c, lambda t: part(t, w))
    length = F.log(F.size("body") + 2) * F.when(F.col("line_count") > lexicon.LARGE_FUNCTION_LINES, F.log("line_count")).otherwise(1.0)
    parts = [of(f"f_{k}", weights[k] / F.sqrt(F.size(f"f_{k}"))) for k in fields] + [of("body", weights["body"] / length), F.filter(F.array(part(F.col("symbol"), F.lit(lexicon.SYMBOL_BOOST))), lambda x: x["term"].isNotNull())]
    each = listed.select("rec", F.explode(F.concat(*parts)).alias("x")).select("rec", "x.term", "x.part")
    return _asked(each, questions).groupBy("qid", "rec").agg(F.round(F.sum("part"), 9).alias("score"))


def restricted(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    """The scores of records that a question allows (qid, rec), of all records for questions whose allowed set meets none."""
    kept = scored.join(allowed.select("qid", "rec").distinct(), ["qid", "rec"], "left_semi")
    return kept.unionByName(scored.join(kept.select("qid").distinct(), "qid", "left_anti"))


def retrieve(questions: DataFrame, records: DataFrame, k: int, fields: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best k by the richest data there is: function fields, else keywords fused with vectors of (questions, records), else keywords."""
    if fields is not None:
        return best(field_scores(questions, fields), k)
    words = keyword_scores(questions, records)
    return fuse([best(words, 2 * k), dense_top(*vectors, 2 * k)], k) if vectors is not None else best(words, k)


def fuse(rankings: list[DataFrame], k: int, constant: int = lexicon.RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, rec, place)."""
    whole = None
    for r in rankings:
        part = r.select("qid", "rec", (1.0 / (constant + F.col("place"))).alias("score"))
        whole = part if whole is None else whole.unionByName(part)
    return best(whole.groupBy("qid", "rec").agg(F.round(F.sum("score"), 12).alias("score")), k)


def expand(scored: DataFrame, records: DataFrame, k: int, most: int = 2, callees: int = 3, callers: int = 2) -> DataFrame:
    """qid, rec, score, place, added: the k best of each question and up to ``most`` further scored records, the best of those
    whose name the k best call or are called by; these have no place.

    ``scored``: qid, rec, score; ``records``: rec, name, callees, callers. Names are compared in lower case.
    """
    none = F.array().cast("array<string>")
    near = F.concat(F.slice(F.coalesce("callees", none), 1, callees), F.slice(F.coalesce("callers", none), 1, callers))
    named = records.select("rec", F.lower("name").alias("name"), F.transform(near, lambda x: F.lower(x)).alias("near"))
    kept = best(scored, k)
    wanted = kept.join(named, "rec").select("qid", F.explode("near").alias("name")).distinct()
    rest = scored.join(named.select("rec", "name"), "rec").join(wanted, ["qid", "name"], "left_semi").join(kept, ["qid", "rec"], "left_anti")
    further = best(rest.select("qid", "rec", "score"), most).withColumn("place", F.lit(None).cast("int"))
    return kept.withColumn("added", F.lit(False)).unionByName(further.withColumn("added", F.lit(True)))


def contexts(top: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, context: the texts (rec, text) of a ranking's records in order, with a rule between them."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return top.join(texts, "rec").groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n---\n").alias("context"))


def _nearest(qids: np.ndarray, q: np.ndarray, recs: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k records with the largest cosine for each question of one block, ties by the smaller record."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    order = np.argsort(recs, kind="stable")
    recs, score = recs[order], unit(q) @ unit(v[order]).T
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"qid": np.repeat(qids, top.shape[1]), "rec": recs[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def dense_top(questions: DataFrame, records: DataFrame, k: int, block: int = 4096, record_block: int = 32_768) -> DataFrame:
    """The k records (rec, vector) with the largest cosine for each question (qid, vector).

    Up to ``block`` questions are broadcast. More are cut into blocks, as are the records, and each pair of blocks meets in
    a group of its own that keeps its k best of each question; nothing passes through the driver. Null vectors take no part;
    a zero vector has cosine 0.
    """
    asked, held = questions.where("vector is not null").select("qid", "vector"), records.where("vector is not null").select("rec", "vector")
    few = asked.limit(block + 1).toPandas()
    schema = "qid long, rec long, score double"
    if few.empty:
        return questions.sparkSession.createDataFrame([], schema + ", place int")
    if len(few) <= block:
        few = few.sort_values("qid")
        handle = questions.sparkSession.sparkContext.broadcast((few.qid.to_numpy(), _matrix(few.vector)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield _nearest(*handle.value, b.rec.to_numpy(), _matrix(b.vector), k)

        return best(held.mapInPandas(run, schema), k)
    n_q, n_r = -(-asked.count() // block), max(1, -(-held.count() // record_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("rb", every(n_r))
    right = held.withColumn("rb", F.pmod(F.xxhash64("rec"), F.lit(n_r)).cast("int")).withColumn("qb", every(n_q))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "rec": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _nearest(q.qid.to_numpy(), _matrix(q.vector), r.rec.to_numpy(), _matrix(r.vector), k)

    return best(left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema), k)
