"""Parquet tables of one data directory, and helpers every job shares."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
#: "true" spreads small tables over the cores: for benches on one machine, whose tables are one file each.
SPREAD = "spark.chunkquarry.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, read as it lies.

    Only where ``spark.chunkquarry.spread`` is "true", a table of fewer splits than cores is spread over these.
    """
    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spark.conf.get(SPREAD, "false") != "true":
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 1 <= rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> None:
    """Set the folder that checkpoint() writes to: the one the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a folder below the warehouse directory serves on one machine; on a cluster that is an error, since
    no folder of a single machine outlives its executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get(SHARED_DIR, None)
    if named is None and not sc.master.split("[")[0] == "local":
        raise ValueError(f"{SHARED_DIR} has to name a folder that all executors share")
    sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name in the file system its path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(at) and files.getFileStatus(at).isDirectory()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buckets_for(df: DataFrame, per_partition: int = 4, least: int = 48) -> int:
    """A number of hash buckets that follows the size of the input, counted in its scan partitions."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, spread, per_partition * df.rdd.getNumPartitions())


def lookup(rows: DataFrame, known: DataFrame, key: str, spread: list[str], salts: int = 16) -> DataFrame:
    """``rows`` with the other columns of ``known`` (each key once), null where there is none.

    A key that a third of all rows hold stays in no single task: rows are salted by the columns ``spread`` and ``known`` is
    repeated for each salt. Rows without a key are spread the same way and meet nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted = salted.withColumn("_key", F.when(F.col(key).isNotNull(), F.col(key).cast("string"))).withColumn("_none", F.when(F.col(key).isNull(), F.xxhash64(*spread)).otherwise(0))
    others = [c for c in known.columns if c != key]
    repeated = known.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.lit(0).cast("bigint").alias("_none"), *others).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, ["_key", "_salt", "_none"], "left").drop("_key", "_salt", "_none")


def numbered(df: DataFrame, group: str, *order: Column, name: str = "place") -> DataFrame:
    """The place of each row in its group, from 1, in an order without ties; no group is sorted in one task.

    Rows are range-partitioned in that order; a place is the place within the partition and the rows before it.
    """
    parts = checkpointed(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = parts.withColumn("_place", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)))
    joined = within.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(name, (F.col("_before") + F.col("_place")).cast("int")).drop("_part", "_place", "_group", "_of", "_before")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """python, c, go or rust by extension, else null."""
    ext = extension(path)
    return (
        F.when(ext == "py", "python")
        .when(ext.isin("c", "h", "cc", "cpp"), "c")
        .when(ext == "go", "go")
        .when(ext == "rs", "rust")
    )


def repo_of(path: Column) -> Column:
    """The first directory of a path."""
    return F.substring_index(path, "/", 1)
