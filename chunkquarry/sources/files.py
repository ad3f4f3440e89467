"""Files as tables and tables as files: repositories, JSON lines, partitioned logs, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import language_of


def scan_repository(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("py", "c", "h", "cc", "cpp", "go", "rs")) -> DataFrame:
    """path, language, content of all files below a folder; hidden folders and caches are left out, bad bytes replaced."""
    cased = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(cased)}}}").load(root)  # other files are not opened
    inside = F.regexp_replace("path", r"^\w+:/*", "/")
    named = raw.select(inside.alias("path"), F.col("content")).where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$") & ~F.col("path").rlike(r"/(\.[^/]+|__pycache__)/"))
    return named.select("path", language_of(F.col("path")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON are skipped."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: later lines of a file overwrite earlier ones."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that hold one JSON array or object each; files that are no JSON give none."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def with_setting(log: DataFrame, part: str) -> DataFrame:
    """Runs whose settings (env, a map) have a name that holds ``part``, in any case."""
    return log.where(F.exists(F.map_keys("env"), lambda k: F.lower(k).contains(part.lower())))


def append_log(rows: DataFrame, path: str, date: Column) -> None:
    """Append rows to a log in one folder per day."""
    rows.withColumn("date", F.date_format(date, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType, date: str | None = None) -> DataFrame:
    """A log's rows, of one day only where given (its other folders are not read)."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.StringType())])).json(path)
    return rows.where(F.col("date") == date) if date else rows


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key by ``order`` of both tables; of equal ones the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_new")))
    return both.withColumn("_place", place).where("_place = 1").drop("_new", "_place")


def sample_files(files: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n files by the hash of path and seed: the same on every run. Files are taken by path first, so no content is sorted."""
    paths = files.where("path is not null").select("path").distinct()
    return paths.orderBy(F.sha2(F.concat("path", F.lit(f"|{seed}")), 256), "path").limit(n)
