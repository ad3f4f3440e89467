"""Foreground and background of a corpus: predictability of chunks and distance to changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import language_of
from .corpus import distinct_chunks


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """file_path, line: the changed new lines of unified diffs (file_path, diff); a hunk of no lines gives none."""
    head = F.explode(F.regexp_extract_all("diff", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1)))
    hunks = diffs.select("file_path", head.alias("h"))
    first = F.split("h", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    sized = hunks.select("file_path", first.alias("a"), count.alias("n")).where("n > 0")
    return sized.select("file_path", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("line")).distinct()


def nearest_changed(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks (file_path, start_line, ...) with distance to the nearest changed line (file_path, line) of their file, null if none.

    Both sides meet in one window per file, ordered by line: the last changed line at or before and the first at or after.
    """
    both = chunks.withColumn("line", F.col("start_line")).withColumn("changed", F.lit(None).cast("int")).unionByName(
        changed.select("file_path", "line", F.col("line").alias("changed")).where("file_path is not null and line is not null"), allowMissingColumns=True
    ).withColumn("side", F.col("changed").isNull().cast("int"))
    up = W.partitionBy("file_path").orderBy("line", "side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("file_path").orderBy(F.desc("line"), "side").rowsBetween(W.unboundedPreceding, 0)
    near = F.least(F.col("line") - F.last("changed", True).over(up), F.last("changed", True).over(down) - F.col("line"))
    return both.withColumn("distance", near).where("side = 1").drop("line", "changed", "side")


def predicted(chunks: DataFrame) -> DataFrame:
    """Adds pi, the predictability of source in its language; null source has none."""
    c = F.coalesce(language_of(F.col("file_path")), F.lit("python")) == "c"
    return chunks.withColumn("pi", F.when(c, text.c_predictability(F.col("source"))).otherwise(text.python_predictability(F.col("source"))))


def classify(chunks: DataFrame, changed: DataFrame, decay: float = 0.1, hot: float = 0.10, complex_below: float = 0.70) -> DataFrame:
    """chunk_no, file_path, pi, hzs, zone: foreground if near a change or hard to predict; without changes hzs is 0."""
    rows = distinct_chunks(predicted(chunks.where("source is not null")), "file_path", "start_line", "pi")
    scored = nearest_changed(rows, changed)
    hzs = F.coalesce(F.exp(-decay * F.col("distance")), F.lit(0.0))
    front = (hzs > hot) | (F.col("pi") < complex_below)
    return scored.select("chunk_no", "file_path", "pi", hzs.alias("hzs"), F.when(front, "FOREGROUND").otherwise("BACKGROUND").alias("zone"))


def zone_rollup(classified: DataFrame, target: float = 0.20) -> DataFrame:
    """Foreground and background chunks of each repository, the share in front and how close it is to the target."""
    counts = classified.groupBy(F.substring_index("file_path", "/", 1).alias("repo")).agg(F.count_if(F.col("zone") == "FOREGROUND").alias("foreground"), F.count_if(F.col("zone") == "BACKGROUND").alias("background"))
    ratio = F.col("foreground") / (F.col("foreground") + F.col("background"))
    return counts.select("repo", "foreground", "background", ratio.alias("ratio"), (1 - F.abs(ratio - target)).alias("confidence"))
