"""Message channels and keyed state as Structured Streaming.

A channel is a folder of files; what was read is kept in a checkpoint, so a batch that is repeated after a failure
gives the same result. ``drain`` reads all that is there and stops.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import exists, is_folder, shared_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    shared_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def channel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory as a stream of its files."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """The result of a streaming query over all there is, read back from where it was written.

    In mode "update" every batch's rows are kept with its number, batch_no: the newest row of a key stands (see ``current``).
    """
    at = work_dir(spark, name)
    out = os.path.join(at, "out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(at, "progress")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    elif mode == "update":
        writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(os.path.join(out, f"batch_no={i}"))).start().awaitTermination()
        kept = T.StructType([*stream.schema.fields, T.StructField("batch_no", T.IntegerType())])
        return spark.read.schema(kept).parquet(out) if exists(spark, out) else spark.createDataFrame([], kept)
    else:  # the last complete result stands; a repeated batch overwrites its own
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)


def current(updates: DataFrame, *key: str) -> DataFrame:
    """The newest row of each key of what a stream in update mode wrote."""
    rest = [c for c in updates.columns if c not in (*key, "batch_no")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_no").alias("_r")).select(*key, "_r.*")


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "7 days") -> DataFrame:
    """Events and their value per type and window; rows later than ``late`` are dropped by the watermark."""
    timed = events.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    """Events of each user's sessions, which end after a gap."""
    timed = events.where("ts is not null and user_id is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


_STATE = "user_id long, n long, first_id long, last_id long, last_type string"


def user_state(events: DataFrame) -> DataFrame:
    """Per user how many events came, the first and last id and the last type: state kept between batches.

    A row comes out whenever a user's state changes; the newest has the largest n.
    """

    def update(key, batches, state):
        n, first, last, kind = state.get if state.exists else (0, None, None, None)
        for b in batches:
            if b.empty:
                continue
            n += len(b)
            low, top = int(b.event_id.min()), b.loc[b.event_id.idxmax()]
            first = low if first is None else min(first, low)
            if last is None or int(top.event_id) > last:
                last, kind = int(top.event_id), top.event_type
        state.update((n, first, last, kind))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first_id": [first], "last_id": [last], "last_type": [kind]})

    rows = events.where("user_id is not null and event_id is not null").select("user_id", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(update, _STATE, "n long, first long, last long, kind string", "append", "NoTimeout")


def newest(states: DataFrame) -> DataFrame:
    """The last state of each user."""
    return states.groupBy("user_id").agg(F.max_by(F.struct("n", "first_id", "last_id", "last_type"), "n").alias("s")).select("user_id", "s.*")


def cursors(messages: DataFrame, channel: str, until) -> DataFrame:
    """channel, cursor: how many messages of each channel a consumer that has read them ``until`` (a condition) is past."""
    return messages.where(until).groupBy(F.col(channel).alias("channel")).agg(F.count("*").alias("cursor"))


def queue_stats(messages: DataFrame, channel: str, channels: DataFrame, read: DataFrame) -> DataFrame:
    """channel, total, unread of every listed channel (channel), those without messages or cursor too."""
    total = messages.groupBy(F.col(channel).alias("channel")).agg(F.count("*").alias("total"))
    joined = channels.select("channel").distinct().join(total, "channel", "left").join(read, "channel", "left").fillna(0, ["total", "cursor"])
    return joined.select("channel", "total", F.greatest(F.lit(0), F.col("total") - F.col("cursor")).alias("unread"))


def peek(messages: DataFrame, channel: str, order: str, n: int = 5) -> DataFrame:
    """The last n messages of each channel, which stay unread."""
    place = F.row_number().over(W.partitionBy(channel).orderBy(F.desc(order)))
    return messages.withColumn("back", place).where(F.col("back") <= n)


def step(messages: DataFrame, ok, error) -> tuple[DataFrame, DataFrame]:
    """(messages that a step takes, messages it fails on with what was wrong as error): none is lost, none stops the others."""
    good = F.coalesce(ok, F.lit(False))
    return messages.where(good), messages.where(~good).withColumn("error", error)


def taxonomy(spark: SparkSession, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    """category, tag."""
    return spark.createDataFrame([(c, t) for c, ts in tags.items() for t in ts], "category string, tag string")


def unknown_tags(tags, known: dict[str, tuple[str, ...]]):
    """The tags of an array that no category holds; an empty taxonomy knows them all."""
    valid = [t for ts in known.values() for t in ts]
    return F.array_except(tags, F.array(*map(F.lit, valid))) if valid else F.array().cast("array<string>")
