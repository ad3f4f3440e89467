import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkquarry.sources import files, tables
from chunkquarry.streaming import channels


def test_scan_repository(spark, tmp_path):
    for name, data in {"a/x.PY": b"x = 1\n", "a/.git/y.py": b"y", "a/__pycache__/z.py": b"z", "a/b/w.rs": b"fn f() {}\xff", "a/n.txt": b"t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path.split("/a/")[1]: r for r in files.scan_repository(spark, str(tmp_path / "a")).collect()}
    assert set(got) == {"x.PY", "b/w.rs"} and got["x.PY"].language == "python" and got["b/w.rs"].content.startswith("fn f() {}")


def test_json_lines_and_log(spark, tmp_path):
    lines = ['{"hash": "a", "compressed": "1"}', "{broken", '{"hash": "b"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("hash", T.StringType()), T.StructField("compressed", T.StringType())])
    assert {(r.hash, r.compressed) for r in files.read_json_lines(spark, str(tmp_path / "c.jsonl"), schema).collect()} == {("a", "1"), ("b", None)}
    rows = spark.createDataFrame([("e1", "2024-01-01 10:00:00"), ("e2", "2024-01-02 10:00:00")], "id string, at string")
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_log(rows, log, F.to_timestamp("at"))
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.StringType())])
    assert files.read_log(spark, log, kept).count() == 4 and [r.id for r in files.read_log(spark, log, kept, "2024-01-02").collect()] == ["e2", "e2"]
    assert sorted(os.listdir(log))[-2:] == ["date=2024-01-01", "date=2024-01-02"]


def test_upsert_and_sample(spark):
    old = spark.createDataFrame([("s1", 1, "a"), ("s2", 5, "b")], "session string, at int, v string")
    new = spark.createDataFrame([("s1", 2, "c"), ("s2", 5, "d"), ("s3", None, "e")], "session string, at int, v string")
    assert {(r.session, r.v) for r in files.upsert(old, new, ["session"], "at").collect()} == {("s1", "c"), ("s2", "d"), ("s3", "e")}
    f = spark.createDataFrame([(f"p{i}",) for i in range(50)], "path string")
    assert files.sample_files(f.repartition(7), 5).collect() == files.sample_files(f, 5).collect()


def test_paths(spark):
    df = spark.createDataFrame([("r/a.PY",), ("r/b/c.cpp",), ("x",), (None,)], "p string")
    got = [tuple(r) for r in df.select(tables.language_of(F.col("p")), tables.repo_of(F.col("p")), tables.extension(F.col("p"))).collect()]
    assert got == [("python", "r", "py"), ("c", "r", "cpp"), (None, "x", ""), (None, None, None)]


def test_streams_in_several_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    rows = [(i, f"2024-01-01 0{i % 9}:00:00", i % 5, "ab"[i % 2], i / 4) for i in range(90)]
    at = tmp_path / "events"
    for k in range(3):
        part = spark.createDataFrame(rows[k * 30 : k * 30 + 30], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(str(at))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
    counts = channels.drain(stream().groupBy("event_type").agg(F.count("*").alias("n")), spark, "counts", "complete")
    assert {r.event_type: r.n for r in counts.collect()} == {"a": 45, "b": 45}
    state = {r.user_id: r for r in channels.newest(channels.drain(channels.user_state(stream()), spark, "state")).collect()}
    for u in range(5):
        own = [r for r in rows if r[2] == u]
        assert (state[u].n, state[u].first_id, state[u].last_id, state[u].last_type) == (len(own), own[0][0], own[-1][0], own[-1][3])
    windows = channels.drain(channels.windowed_counts(stream()), spark, "windows", "complete")
    assert windows.agg(F.sum("n"), F.sum("cents")).first()[:] == (90, sum(round(r[4] * 100) for r in rows))
    sessions = channels.drain(channels.session_counts(stream(), "90 minutes"), spark, "sessions", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == 90
    assert json.dumps({}) == "{}"


def test_small_tables_are_spread_only_on_demand(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.table(spark, str(tmp_path), "t").rdd.getNumPartitions() < cores
    spark.conf.set(tables.SPREAD, "true")
    try:
        assert tables.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == cores
    finally:
        spark.conf.unset(tables.SPREAD)
    assert tables.exists(spark, str(tmp_path / "t.parquet")) and tables.is_folder(spark, str(tmp_path)) and not tables.exists(spark, str(tmp_path / "x"))
