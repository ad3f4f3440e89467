"""Queries of the catalogue over runs, logs, channels, and what is written and read back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon, text
from ..operators import corpus, experiments, history, zones
from ..sources import files as sources
from ..sources.tables import table
from ..streaming import channels
from .catalog import _CHUNKS, _DECISIONS, _GRID, _SCORED, _tokens, _words, _chunks, query

# ---- logs and leaderboards; a run is a user's events

_RUN_METRICS = """runs as (select user_id as run, round(avg(k) / 100, 6) as ter, round(avg(case when event_type = 'error' then 0.0::double else 1.0::double end), 6) as ccc, round(avg(value), 6) as elapsed
  from (select user_id, event_type, value, regexp_extract(props, '[0-9]+')::bigint as k from events where user_id is not null) group by 1),
med as (select median(elapsed) as m from runs where elapsed > 0),
board as (select run, ter, ccc, round(ter * ccc, 6) as tv, round(ter * ccc * case when elapsed > 0 then greatest(0.1, least(3.0, m / elapsed)) else 1.0 end, 6) as tv_time, ter * ccc as product from runs, med)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("user_id is not null").select("user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.round(F.avg("k") / 100, 6).alias("ter"), F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 6).alias("ccc"), F.round(F.avg("value"), 6).alias("elapsed"))
    timed = experiments.speed_adjusted(runs.select("run", (F.col("ter") * F.col("ccc")).alias("score"), "elapsed"))
    return runs.join(timed.select("run", F.round("adjusted", 6).alias("tv_time")), "run").select("run", F.round(F.col("ter") * F.col("ccc"), 6).alias("tv"), "tv_time", "ter", "ccc")


def _board(mode: str, by: str, then: str) -> str:
    return f"select '{mode}' as mode, place::int as place, run, round({by}, 6) as score, round({by} - {lexicon.BASELINE[mode]}, 6) as delta from (select *, row_number() over (order by {by} desc, {then} desc, run) as place from board) where place <= 20"


@query(f"with {_RUN_METRICS} {' union all '.join(_board(m, a, b) for m, (a, b) in experiments.MODES.items())}")
def leaderboards(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best runs in each of four modes, and what they are above the baseline."""
    best = experiments.leaderboards(_metrics(spark, sf))
    return best.select("mode", "place", "run", F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


_LOGGED = f"logged as (select chunk_no as run, {_tokens('source')} as tokens, {_words('source')} as words from chunk where source is not null)"


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """run, text: a log of each chunk's measures as a benchmark prints them, with lines of later and of no use between."""
    n = corpus.distinct_chunks(_chunks(spark, sf).where("source is not null"), text.count_tokens(F.col("source")).alias("t"), text.count_words(F.col("source")).alias("w"))
    share = F.concat(F.lit("0."), F.lpad(F.expr("cast(least(999, w * 500 div greatest(t, 1)) as string)"), 3, "0"))
    lines = F.concat_ws(
        "\n", F.lit("=== run ==="), F.concat(F.lit("  Original tokens: "), F.format_number("t", 0)), F.concat(F.lit("  After skeleton: "), F.format_number("w", 0), F.lit(" (12.5%)")), F.lit("  After skeleton: 1 (99.0%)"),
        F.lit("Original tokens: 7"), F.lit("Mean CCC 0.111"), F.concat(F.lit("Mean RQS-L1 : 79.30 then "), share), F.concat(F.lit("True Value (TER × CCC) = 0.5 × 2.5 = "), share), F.lit("TOTAL TER 36.0%"),
    )
    return n.select(F.col("chunk_no").alias("run"), lines.alias("text"))


_SHARE = "(least(999, words * 500 // greatest(tokens, 1)) / 1000)::double"


@query(f"with {_CHUNKS}, {_LOGGED} select run, tokens as original_tokens, words as after_skeleton, 0.125::double as skeleton_saved, {_SHARE} as consistency, {_SHARE} as true_value, 0.36::double as c_saved from logged")
def log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics read out of the logs of runs."""
    return experiments.log_metrics(_logs(spark, sf))


@query(f"with {_GRID} select 'penalty=' || penalty || ' | threshold=' || threshold as label, dropped from result")
def setting_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of the grid by its label."""
    g = experiments.skeleton_grid(_chunks(spark, sf))
    env = F.create_map(F.lit("CQ_threshold"), F.col("threshold").cast("string"), F.lit("CQ_penalty"), F.col("penalty").cast("string"))
    return g.select(experiments.label(env, prefix="CQ_").alias("label"), "dropped")


@query()
def descended_setting(spark: SparkSession, sf: str) -> DataFrame:
    """The setting that coordinate descent finds for half of the tokens dropped."""

    def score(ranges: dict) -> dict:
        rows = experiments.skeleton_grid(_chunks(spark, sf), ranges).select("threshold", "penalty", "share").collect()  # one row a setting
        return {(r.threshold, r.penalty): -abs(r.share - 0.5) for r in rows if r.share is not None}

    best, value = experiments.coordinate_descent(score)
    return spark.createDataFrame([(best["threshold"], best["penalty"], round(value, 6))], "threshold double, penalty double, score double")


# ---- what is written and read back


@query("select path from (select distinct path from source_files where path is not null) order by sha256(path || '|42'), path limit 50")
def sampled_files(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty files by a seeded hash."""
    return sources.sample_files(table(spark, sf, "source_files"), 50)


@query("select hash, max_by(compressed, (coalesce(mined_at, timestamp '1970-01-01'), pattern_no)) as compressed from patterns where hash is not null and compressed is not null group by 1")
def cache_file(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern cache as JSON lines between lines that are none, read back with later lines in place of earlier ones."""
    at = os.path.join(channels.work_dir(spark, "cache"), "lines")
    p = table(spark, sf, "patterns").where("hash is not null and compressed is not null")
    order = F.struct(F.coalesce("mined_at", F.lit("1970-01-01").cast("timestamp_ntz")).cast("string").alias("at"), "pattern_no")
    p.select(F.explode(F.array(F.to_json(F.struct("hash", "compressed", order.alias("written"))), F.concat(F.lit('{"hash": '), "pattern_no"))).alias("value")).write.text(at)
    schema = T.StructType([T.StructField("hash", T.StringType()), T.StructField("compressed", T.StringType()), T.StructField("written", T.StructType([T.StructField("at", T.StringType()), T.StructField("pattern_no", T.LongType())]))])
    return sources.keep_last(sources.read_json_lines(spark, at, schema), "hash", "written").select("hash", "compressed")


@query("""
with r as (select event_id, strftime(ts, '%Y-%m-%d') as date, event_type, value from events where ts is not null), d as (select max(date) as last from r)
select r.event_id, r.event_type, r.value from r, d where r.date = d.last and r.event_type in ('error', 'click')""")
def experiment_log(spark: SparkSession, sf: str) -> DataFrame:
    """Runs appended to a log of one folder a day; those of the last day whose settings name an error or a click."""
    at = os.path.join(channels.work_dir(spark, "log"), "days")
    e = table(spark, sf, "events").where("ts is not null").select("event_id", "value", F.create_map(F.concat(F.lit("CQ_"), F.upper("event_type")), F.lit("1")).alias("env"), "event_type", "ts")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):  # every run of the benchmark appends
        sources.append_log(e.where(part), at, F.col("ts"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("env", T.MapType(T.StringType(), T.StringType())), T.StructField("event_type", T.StringType())])
    last = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    day = sources.read_log(spark, at, schema, last or "none")
    return sources.with_setting(day, "q_error").unionByName(sources.with_setting(day, "click")).select("event_id", "event_type", "value")


@query(f"with {_DECISIONS}, r as (select agent_id, decision_type, ts, seq, decision_value, row_number() over (partition by agent_id order by ts desc nulls last, (seq % 2) desc, seq desc) as k from d where agent_id is not null) select agent_id, seq, decision_value from (select agent_id, max_by(seq, (coalesce(ts, timestamp '1900-01-01'), seq % 2, seq)) as seq, max_by(decision_value, (coalesce(ts, timestamp '1900-01-01'), seq % 2, seq)) as decision_value from r group by 1)")
def agent_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of every agent after new decisions were merged into old ones, written and read back."""
    at = channels.work_dir(spark, "state")
    d = history.distinct_decisions(table(spark, sf, "decisions")).where("agent_id is not null").select("agent_id", "ts", "seq", "decision_value")
    last = lambda rows: rows.groupBy("agent_id").agg(F.max_by(F.struct("ts", "seq", "decision_value"), F.struct("ts", "seq")).alias("s")).select("agent_id", "s.*")
    last(d.where("seq % 2 = 0")).write.parquet(os.path.join(at, "old"))
    merged = sources.upsert(spark.read.parquet(os.path.join(at, "old")), last(d.where("seq % 2 = 1")), ["agent_id"], "ts")
    merged.write.parquet(os.path.join(at, "new"))
    return spark.read.parquet(os.path.join(at, "new")).select("agent_id", "seq", "decision_value")


@query(f"with {_DECISIONS} select seq, substr(decision_id, 1, 8) as id, decision_type, substr(rationale, 1, 100) as rationale, round(confidence, 4) as confidence from d where agent_id = 'pruner'")
def agent_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit trail appended as JSON lines, and of it one agent's decisions."""
    at = os.path.join(channels.work_dir(spark, "audit"), "lines")
    d = history.distinct_decisions(table(spark, sf, "decisions"))
    d.select("seq", F.substring("decision_id", 1, 8).alias("id"), "agent_id", "decision_type", F.substring("rationale", 1, 100).alias("rationale"), F.round("confidence", 4).alias("confidence")).write.mode("append").json(at)
    schema = T.StructType([T.StructField(n, t) for n, t in (("seq", T.LongType()), ("id", T.StringType()), ("agent_id", T.StringType()), ("decision_type", T.StringType()), ("rationale", T.StringType()), ("confidence", T.DoubleType()))])
    return history.of_agent(sources.read_json_lines(spark, at, schema), "pruner").drop("agent_id")


@query("select mark.category, count(*) as n, sum(case when d.confidence >= 0.5 then 1 else 0 end)::bigint as sure from (select distinct on (seq) * from decisions where seq is not null) d join (values " + ", ".join(f"('{c}', '{t}')" for c, ts in lexicon.TAXONOMY.items() for t in ts) + ") mark(category, tag) on d.decision_type = mark.tag or (d.decision_value like '{%' and json_extract_string(d.decision_value, '$.zone') = mark.tag) group by 1")
def tag_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by the category of their tags; the taxonomy is a JSON document written and read back."""
    at = os.path.join(channels.work_dir(spark, "taxonomy"), "document")
    channels.taxonomy(spark, lexicon.TAXONOMY).groupBy("category").agg(F.collect_list("tag").alias("tags")).coalesce(1).write.json(at)
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    known = sources.read_json_document(spark, at, schema).select("category", F.explode("tags").alias("tag")) if len(lexicon.TAXONOMY) == 1 else sources.read_json_lines(spark, at, schema).select("category", F.explode("tags").alias("tag"))
    return _tagged(spark, sf).select("seq", "confidence", F.explode("tags").alias("tag")).join(F.broadcast(known), "tag").select("seq", "confidence", "category").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("sure"))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their tags: the type and the zone of their value."""
    zone = F.when(F.col("decision_value").like("{%"), F.get_json_object("decision_value", "$.zone"))
    return history.distinct_decisions(table(spark, sf, "decisions")).withColumn("tags", F.array_compact(F.array("decision_type", zone)))


_VALID = ", ".join(f"'{t}'" for ts in lexicon.TAXONOMY.values() for t in ts if t != "zip_history")


@query(f"select seq, decision_type as unknown from (select distinct on (seq) * from decisions where seq is not null) where decision_type is not null and decision_type not in ({_VALID})")
def unknown_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of decisions that a taxonomy without one of its tags does not hold."""
    known = {c: tuple(t for t in ts if t != "zip_history") for c, ts in lexicon.TAXONOMY.items()}
    return _tagged(spark, sf).select("seq", F.explode(channels.unknown_tags(F.col("tags"), known)).alias("unknown"))


# ---- channels


@query("""
with e as (select event_type, event_id, ts from events where ts is not null), mid as (select epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 as half from e),
c as (select distinct event_type as channel from events where event_type is not null union select distinct decision_type from decisions where decision_type is not null),
t as (select event_type as channel, count(*) as total from events group by 1), r as (select event_type as channel, count(*) as cursor from e, mid where epoch_us(ts) <= half group by 1)
select channel, coalesce(total, 0) as total, greatest(0, coalesce(total, 0) - coalesce(cursor, 0)) as unread from c left join t using (channel) left join r using (channel)""")
def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of every channel, empty ones too, and those a consumer that has read the first half of the time has not read."""
    e, d = table(spark, sf, "events"), table(spark, sf, "decisions")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(at), F.max(at)).first()
    read = channels.cursors(e, "event_type", at <= F.lit((low or 0) + ((high or 0) - (low or 0)) // 2))
    listed = e.select(F.col("event_type").alias("channel")).union(d.select("decision_type")).where("channel is not null")
    return channels.queue_stats(e, "event_type", listed, read)


@query("select event_type, event_id, back::int as back from (select *, row_number() over (partition by event_type order by event_id desc) as back from events) where back <= 5")
def channel_peek(spark: SparkSession, sf: str) -> DataFrame:
    """The last five messages of each channel."""
    return channels.peek(table(spark, sf, "events"), "event_type", "event_id").select("event_type", "event_id", "back")


_STEPPED = "s as (select seq, case when decision_value like '{%' then json_extract_string(decision_value, '$.tier')::bigint end as tier from d)"


@query(f"with {_DECISIONS}, {_STEPPED} select seq, tier, case when tier is null then 'no tier' end as error, tier is null as dead from s")
def stepped_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions taken by a step that needs a tier; those without one come out as dead letters."""
    d = history.distinct_decisions(table(spark, sf, "decisions"))
    tier = F.when(F.col("decision_value").like("{%"), F.get_json_object("decision_value", "$.tier").try_cast("bigint"))
    good, dead = channels.step(d.withColumn("tier", tier), F.col("tier").isNotNull(), F.lit("no tier"))
    return good.select("seq", "tier", F.lit(None).cast("string").alias("error"), F.lit(False).alias("dead")).unionByName(dead.select("seq", "tier", "error", F.lit(True).alias("dead")))


@query("select event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by 1")
def replayed_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of each channel after it was drained once and replayed from its beginning: the replay reads them all again."""
    first = channels.drain(channels.channel(spark, sf, "events").select("event_id", "event_type"), spark, "first")
    again = channels.drain(channels.channel(spark, sf, "events").select("event_id", "event_type"), spark, "again")
    both = first.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2)))
    per = both.groupBy("event_type", "event_id").agg(F.count_if(F.col("pass") == 1).alias("a"), F.count_if(F.col("pass") == 2).alias("b")).where("a = b")
    return per.groupBy("event_type").agg(F.sum("b").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# ---- diffs


_DIFFED = """f as (select path, max(content) as content from source_files where path is not null group by path), sized as (select path, len(string_split(content, chr(10))) as n from f where length(content) > 0),
h as (select path, 1 as a, 1 as c from sized union all select path, n // 2 + 1, 3 from sized union all select path, n, 0 from sized),
changed as (select distinct path as file_path, unnest(range(a, a + c))::int as line from h)"""


@query(f"with {_DIFFED} select file_path, line from changed")
def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Changed lines read out of unified diffs of every file: one line, three lines, and a deletion."""
    return zones.diff_hunks(_diffs(spark, sf))


@query(f"""
with {_CHUNKS}, {_SCORED}, {_DIFFED},
near as (select chunk_no, any_value(pi) as pi, min(abs(start_line - line)) as distance from scored s left join changed c on s.file_path = c.file_path group by 1),
zoned as (select chunk_no, pi, coalesce(exp(-0.1 * distance), 0.0) as hzs from near)
select chunk_no, round(hzs, 6) as hzs, case when hzs > 0.10 or pi < 0.70 then 'FOREGROUND' else 'BACKGROUND' end as zone from zoned""")
def diff_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Foreground and background of all chunks by their distance to the changed lines of diffs."""
    z = zones.classify(_chunks(spark, sf), zones.diff_hunks(_diffs(spark, sf)))
    return z.select("chunk_no", F.round("hzs", 6).alias("hzs"), "zone")


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    """file_path, diff: a diff without context of every file, with one line changed at its begin, three in its middle, and one deleted."""
    f = corpus.distinct_files(table(spark, sf, "source_files")).where("length(content) > 0").select("path", F.size(F.split("content", "\n")).alias("n"))
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@ head\n-x\n+y\n@@ -9,2 +"), (F.floor(F.col("n") / 2) + 1).cast("string"), F.lit(",3 @@\n-x\n+y\n@@ -20,1 +"), F.col("n").cast("string"), F.lit(",0 @@\n-x\n"))
    return f.select(F.col("path").alias("file_path"), diff.alias("diff"))


