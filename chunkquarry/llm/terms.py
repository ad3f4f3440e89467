"""Frequency of every distinct value and term.

Vertical layout: a term's records are a bitmap of record numbers, kept as the 64-bit words that have a bit set (a
term of one record costs one word). Words of different partitions merge by OR, occurrence counters by addition, and
the document frequency is the number of set bits. Both steps aggregate before they shuffle, so a term that stands
in a third of all records costs each partition one row a word, not one row a record.

A record is a distinct id with a non-null text; of rows with the same id the one with the least text counts. Terms
are the ASCII identifiers of the lower-cased text. Types are trimmed, lower-cased and null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = "[a-z_][a-z0-9_]*"


def plain_type(c: Column) -> Column:
    """A pattern type without blanks around it, in lower case, '-' and blanks inside as '_'; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def records(patterns: DataFrame) -> DataFrame:
    """rec, kind, text, recorded: each distinct pattern_no with a text, once."""
    rows = patterns.where("pattern_no is not null and original is not null")
    first = rows.groupBy("pattern_no").agg(F.min(F.struct("original", plain_type(F.col("pattern_type")).alias("kind"), "frequency")).alias("r"))
    return first.select(F.col("pattern_no").alias("rec"), F.coalesce("r.kind", F.lit("unknown")).alias("kind"), F.col("r.original").alias("text"), F.col("r.frequency").alias("recorded"))


def _bitmap(postings: DataFrame, keys: list[str], claims: bool = False) -> DataFrame:
    """keys, occurrences, records: from one row per posting (rec, n); with ``claims`` the least and most of recorded too."""
    least = [F.min("recorded_least").alias("recorded_least"), F.max("recorded_most").alias("recorded_most")] if claims else []
    words = postings.groupBy(*keys, F.shiftright("rec", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(rec & 63))")).alias("bits"), F.sum("n").alias("n"), *([F.min("recorded").alias("recorded_least"), F.max("recorded").alias("recorded_most")] if claims else [])
    )
    return words.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.sum(F.bit_count("bits")).alias("records"), *least)


def with_all(freq: DataFrame, *key: str) -> DataFrame:
    """Frequencies by kind, and of all kinds together as kind 'all'. A record has one kind, so the union's cardinality is the sum."""
    others = [c for c in ("recorded_least", "recorded_most") if c in freq.columns]
    both = freq.withColumn("kind", F.explode(F.array("kind", F.lit("all"))))
    aggs = [F.min(others[0]).alias(others[0]), F.max(others[1]).alias(others[1])] if others else []
    return both.groupBy("kind", *key).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), *aggs)


def term_postings(recs: DataFrame) -> DataFrame:
    """kind, rec, term, n: every term of a record with its occurrences in it."""
    each = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    return recs.select("kind", "rec", F.explode(each).alias("term"), F.lit(1).cast("long").alias("n"))


def term_frequencies(recs: DataFrame, per_kind: bool = False) -> DataFrame:
    """term, occurrences, records over all records, or for each kind of record too."""
    return _bitmap(term_postings(recs), ["kind", "term"] if per_kind else ["term"])


def value_frequencies(recs: DataFrame) -> DataFrame:
    """Of every distinct text and kind: in how many records it stands, and the frequencies those records claim."""
    once = recs.select("kind", F.col("text").alias("value"), "rec", F.lit(1).cast("long").alias("n"), "recorded")
    return _bitmap(once, ["kind", "value"], claims=True)


def marked(freq: DataFrame, recs: DataFrame, common_share: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    """``freq`` with mark: rare (one record), common (more than the share of all records), else null."""
    if keys:
        total = recs.groupBy(*keys).agg(F.count("*").alias("n_records"))
        both = freq.join(total, list(keys))
    else:
        both = freq.withColumn("n_records", recs.agg(F.count("*")).scalar())
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > common_share * F.col("n_records"), "common")
    return both.withColumn("mark", mark)
