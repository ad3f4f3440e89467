"""The metadata index, pipelines, logs and channels against small expected values."""

import pytest
from pyspark.sql import functions as F

from chunkquarry.functions import lexicon
from chunkquarry.operators import chunking, corpus, experiments, history, masking, metadata, quality, ranking, rewriting, zones
from chunkquarry.sources import files as sources
from chunkquarry.sources import tables
from chunkquarry.streaming import channels

C = """#include <stdio.h>
#define A 1

/* The function adds the numbers that it is given to the total of all. */
static int add(int a, int b)
{
    int c = a + b;
    total = c;
    return c;
}

int *run(void) { for (;;) { add(1, 2); helper(3); } }
"""
PY = '''import os
from a.b.c.d import e, f, g, h


class K:
    """The class that holds the configuration of the module."""

    def plain(self):
        # This is the comment that explains the value of the function.
        x = 1
        y = 2
        return x


def loop(items):
    for i in items:
        plain(i)
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r/a.c", C), ("r/b.c", C.replace("add", "sum")), ("r/c.c", C), ("r/d.py", PY), ("r/e.py", PY), ("q/f.go", "package q\n\ntype Id int\n\ntype F func(a int) int\n\nfunc G() {\n}\n"), ("q/g.rs", "pub trait T {\n    fn a(&self);\n}\n"), ("q/h.txt", "x"), ("q/i.py", None), (None, "x")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "path string, content string, language string")


def test_signatures(spark):
    cases = [("add", C.split("\n\n")[1], "static int add(int a, int b)"), ("K", "class K:\n    x = 1", "class K:"), ("S", "// note\n/* x */\n\nstruct S {\n", "struct S {"), ("n", "", "n"), ("n", "\n \n", "n"), ("long", "int f(" + "a" * 400, ("int f(" + "a" * 400)[:120]), ("p", "int *run(void) {", "int *run(void)")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, source string, want string")
    for r in df.select("want", metadata.signature(F.col("name"), F.col("source")).alias("got")).collect():
        assert r.got == r.want


def test_built_index(spark, files):
    cut = chunking.with_ids(chunking.extract(files)).withColumn("chunk_no", F.concat_ws("|", "file_path", "chunk_id"))
    kinds = {(r.file_path, r.chunk_type, r.name) for r in cut.collect()}
    assert {("q/f.go", "type", "Id"), ("q/f.go", "type", "F"), ("q/f.go", "function", "G"), ("q/g.rs", "struct", "T"), ("r/a.c", "function", "add"), ("r/d.py", "class", "K")} <= kinds
    index = {(r.file_path, r.name): r for r in metadata.function_index(cut).collect()}
    run = index["r/a.c", "run"]
    assert run.callees == ["add", "helper"] and run.n_callers == 0 and run.signature == "int *run(void)" and run.complexity == "simple"
    assert index["r/a.c", "add"].n_callers == 1 and index["r/b.c", "sum"].n_callers == 1 and index["r/d.py", "plain"].n_callers == 2
    edges = {(r.repo, r.name, r.caller) for r in metadata.caller_edges(metadata.index_rows(cut)).collect()}
    assert ("r", "add", "run") in edges and ("r", "plain", "loop") in edges and not any(n == "helper" for _, n, _ in edges)
    assert metadata.function_index(cut.limit(0)).collect() == []


def test_embedding_inputs(spark):
    chunks = spark.createDataFrame([(1, "f", "c1", "x" * 3000), (1, "f", "c1", "x" * 3000), (2, "f", "c2", "y"), (3, "f", "c3", None)], "chunk_no long, file_path string, chunk_id string, source string")
    meta = spark.createDataFrame([("f", "c1", "What it does."), ("f", "c2", "  "), ("f", "c2", None)], "file_path string, chunk_id string, summary string")
    assert {r.chunk_no: r.text for r in metadata.embedding_inputs(chunks, meta).collect()} == {1: "What it does.\n" + "x" * 1800, 2: "y"}


def test_pipeline(files):
    out = {r.path: r for r in rewriting.pipeline(files).collect()}
    assert set(out) == {"r/a.c", "r/b.c", "r/c.c", "r/d.py", "r/e.py", "q/f.go", "q/g.rs"}
    py, c = out["r/d.py"], out["r/a.c"]
    assert py.n_masked >= 1 and "[§:" in py.compressed and "..." in py.compressed and py.tokens_before > py.after_skeleton > py.after_masking >= py.after_comments
    assert c.tokens_before > c.after_skeleton and "adds numbrs" in c.compressed and c.n_masked == 2 and "PI=" in c.compressed
    assert rewriting.pipeline(files.limit(0)).collect() == []


def test_variants(files):
    out = {(r.path, r.variant): r for r in rewriting.variants(files).collect()}
    assert {p for p, _ in out} == {"r/a.c", "r/b.c", "r/c.c"} and len(out) == 18
    tokens = {v: out["r/a.c", v].tokens for _, v in out}
    assert out["r/a.c", "none"].score == 1.0 and out["r/a.c", "none"].saved_percent == 0.0
    assert tokens["none"] > tokens["skeleton"] >= tokens["skeleton+masking"] >= tokens["all"] and tokens["none"] > tokens["comments"] and out["r/a.c", "all"].score < 1


def test_dispatch(spark, files):
    rows = [(1, "r/a.c", 5, C), (1, "r/a.c", 5, C), (2, "r/d.py", 1, PY), (3, "r/d.py", 1, "  \n"), (4, "q/f.go", 1, "// The configuration of the module\nfunc G() {\n}\n"), (5, "r/a.c", 1, None), (6, "r/x.c", 900, "#include <stdio.h>\nint a;\n")]
    chunks = spark.createDataFrame(rows, "chunk_no long, file_path string, start_line int, source string")
    changed = spark.createDataFrame([("r/a.c", 5), ("r/d.py", 2)], "file_path string, line int")
    out = {r.chunk_no: r for r in rewriting.dispatch(chunks, changed, files).collect()}
    assert set(out) == {1, 2, 3, 4, 6} and out[1].zone == "FOREGROUND" and out[1].final_tokens < out[1].original_tokens
    assert out[3].score == 1.0 and out[3].final_tokens == out[3].original_tokens and 0 < out[2].score < 1 and out[4].language == "go"
    rolled = rewriting.dispatch_rollup(rewriting.dispatch(chunks, changed, files)).collect()
    assert sum(r.chunks for r in rolled) == 5 and all(abs(r.value - r.saved_percent / 100 * r.mean_score) < 1e-6 for r in rolled)


def test_identifiers_and_answers(spark, files):
    mined = spark.createDataFrame([("identifier", "a_very_long_identifier", 3, "h", "§12345678"), ("identifier", "shorter", 3, "h", "§87654321"), ("include", "#include <x.h>", 3, "h", "§00000000")], "pattern_type string, pattern string, n_files long, hash string, token string")
    assert masking.identifier_keys(mined, tokens=False) == {"a_very_long_identifier": "§12345678"} and masking.identifier_keys(mined) == {}
    c = spark.createDataFrame([("a.c", "x(a_very_long_identifier, a_very_long_identifier2);"), ("b.py", "a_very_long_identifier")], "path string, content string")
    assert [tuple(r) for r in masking.mask_identifiers(c, {"a_very_long_identifier": "§12345678"}).collect()] == [("a.c", "x(§12345678, a_very_long_identifier2);", 1)]
    known = spark.createDataFrame([("§12345678", "long"), ("[§:INC_12345678]", "#include <a.h>"), ("[§:abcdef01]", "import os")], "marker string, original string")
    texts = spark.createDataFrame([(1, "a §12345678, [§:INC_12345678]\n[§:abcdef01]§12345678 [§:00000000] §x"), (2, ""), (3, None), (4, "§12345678")], "key long, text string")
    assert {r.key: r.restored for r in masking.unmask_texts(texts, known).collect()} == {1: "a long, #include <a.h>\nimport oslong [§:00000000] §x", 4: "long"}


def test_verdicts(spark):
    df = spark.createDataFrame([(0.95, 80.0, 0.9), (0.94, 80.0, 0.85), (0.85, 70.0, 0.85), (0.7, 80.0, 0.5), (0.6, 10.0, 0.9), (None, 10.0, 0.1), (0.1, None, 0.1)], "s double, t double, c double")
    got = [tuple(r) for r in df.select(quality.verdict(F.col("s")), quality.combined_verdict(F.col("t"), F.col("c"))).collect()]
    assert got == [("EXCELLENT", "EXCELLENT"), ("ACCEPTABLE", "PASSED"), ("ACCEPTABLE", "GOOD"), ("DEGRADED", "CONSISTENCY RISK"), ("FAILURE", "LOW COMPRESSION"), (None, "BELOW TARGETS"), ("FAILURE", None)]
    texts = spark.createDataFrame([("a", "def f(x): return x", "def f(x)", "def f(x) ...")], "k string, o string, i string, c string")
    assert quality.routed_score(texts, "k", "o", "c", "i").first().score == 1.0 and 0 < quality.routed_score(texts, "k", "o", "c").first().score < 1


def test_log_metrics(spark):
    logs = spark.createDataFrame([("a", "Original tokens: 1,234\nOriginal tokens: 5\nMean CCC 0.5\nMean RQS-L1: 79.3 0.65\nTrue Value (TER × CCC) = 0.793 × 0.650 = 0.516\nTOTAL TER  35.1%\nAfter skeleton: 99 (12.5%)"), ("b", "nothing"), ("c", None)], "run string, text string")
    out = {r.run: r for r in experiments.log_metrics(logs).collect()}
    assert tuple(out["a"])[1:] == pytest.approx((1234, 99, 0.125, 0.65, 0.516, 0.351)) and not any(x is not None for x in tuple(out["b"])[1:])
    env = spark.createDataFrame([({"KX_B_C": "2", "KX_A": "1", "Z": "4", "D": "3"},)], "env map<string,string>")
    assert env.select(experiments.label(F.col("env"), prefix="KX_")).first()[0] == "D=3 | A=1 | B.C=2"


def test_leaderboards_and_descent(spark):
    runs = spark.createDataFrame([("a", 0.5, 0.1, 0.9, 0.5), ("b", 0.5, 0.3, 0.8, 0.7), ("c", 0.2, 0.3, 0.8, 0.9), ("d", None, None, None, None)], "run string, tv double, tv_time double, ter double, ccc double")
    out = [(r.mode, r.run, round(r.delta, 3)) for r in experiments.leaderboards(runs, 2).orderBy("mode", "place").collect()]
    assert out == [("ccc", "c", 0.25), ("ccc", "b", 0.05), ("ter", "a", 0.107), ("ter", "b", 0.007), ("tv", "b", -0.016), ("tv", "a", -0.016), ("tv_time", "b", 0.042), ("tv_time", "c", 0.042)]
    asked = []

    def score(ranges):
        asked.append(ranges)
        return {(x, y): -((x - 5) ** 2) - (y - 1) ** 2 for x in ranges["x"] for y in ranges["y"]}

    assert experiments.coordinate_descent(score, {"x": tuple(range(8)), "y": (0, 1, 2, 3)}, rounds=5) == ({"x": 5, "y": 1}, 0)
    assert all(sum(len(v) > 1 for v in r.values()) == 1 for r in asked) and len(asked) == 4


def test_channels(spark):
    m = spark.createDataFrame([(i, "ab"[i % 2], None if i == 4 else i) for i in range(10)], "id long, channel string, v long")
    listed = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "channel string")
    read = channels.cursors(m, "channel", F.col("id") < 5)
    assert {tuple(r) for r in channels.queue_stats(m, "channel", listed, read).collect()} == {("a", 5, 2), ("b", 5, 3), ("z", 0, 0)}
    assert {(r.channel, r.id) for r in channels.peek(m, "channel", "id", 1).collect()} == {("a", 8), ("b", 9)}
    good, dead = channels.step(m, F.col("v") >= 0, F.lit("no value"))
    assert good.count() == 9 and [(r.id, r.error) for r in dead.collect()] == [(4, "no value")]
    tags = spark.createDataFrame([(["compress", "nope"],), ([],)], "tags array<string>")
    assert [r[0] for r in tags.select(channels.unknown_tags(F.col("tags"), lexicon.TAXONOMY)).collect()] == [["nope"], []]
    assert tags.select(channels.unknown_tags(F.col("tags"), {})).first()[0] == []


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"k": "a", "n": 1}\nnot json\n{"k": "a", "n": 3}\n{"k": "b", "n": 2}\n{"n": 9}\n')
    rows = sources.read_json_lines(spark, str(tmp_path / "l.json"), spark.createDataFrame([], "k string, n int").schema)
    assert {tuple(r) for r in sources.keep_last(rows, "k", "n").collect()} == {("a", 3), ("b", 2)} or {(r.k, r.n) for r in sources.keep_last(rows.withColumn("at", F.col("n")), "k", "at").collect()} == {("a", 3), ("b", 2)}
    (tmp_path / "d.json").write_text('[{"k": "a"},\n {"k": "b"}]')
    assert {r.k for r in sources.read_json_document(spark, str(tmp_path / "d.json"), spark.createDataFrame([], "k string").schema).collect()} == {"a", "b"}


def test_history_keys(spark):
    said = spark.createDataFrame([(1, 0, "user", "configuration of configuration_x and configuration"), (1, 1, "user", "see configuration again here please now thanks"), (2, 0, "user", "short words only in this one here")], "conv_id long, turn_id int, role string, content string")
    out = {r.conv_id: r for r in history.zipped(said).collect()}
    assert out[1].zipped == "user: con13 of configuration_x and con13 user: see con13 again here please now thanks" and out[1].ratio < 1 and out[2].ratio == 1.0


def test_hot_keys_are_spread(spark):
    """A line that stands in every file is looked up under many salts, each a bounded share of the rows."""
    lines = spark.range(40_000).selectExpr("concat('f', id) as path", "1 as line_no", "if(id % 100 = 0, concat('import m', id), 'import os') as line")
    known = spark.createDataFrame([("import os", 7), (None, 8)], "line string, salt int")
    out = tables.lookup(lines, known, "line", ["path", "line_no"])
    assert out.columns == ["path", "line_no", "line", "salt"] and out.where("salt = 7").count() == 39_600 and out.where("salt is null").count() == 400
    share = lines.select(F.pmod(F.xxhash64("path", "line_no"), F.lit(16)).alias("s"), "line").groupBy("line", "s").count().agg(F.max("count")).first()[0]
    assert share < 40_000 / 16 * 1.2


def test_numbered(spark):
    df = spark.range(3000).selectExpr("if(id % 50 = 0, null, cast(id % 3 as string)) as g", "id", "(id * 7919) % 3000 as k")
    got = {}
    for r in tables.numbered(df, "g", F.desc("k")).collect():
        got.setdefault(r.g, []).append((r.place, r.k))
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and [k for _, k in sorted(v)] == sorted((k for _, k in v), reverse=True) for v in got.values()) and len(got) == 4


def test_dense_blocks_agree(spark):
    q = spark.createDataFrame([(i, [float((i * j) % 7 - 3) for j in range(1, 6)]) for i in range(40)] + [(99, None)], "qid long, vector array<float>")
    r = spark.createDataFrame([(i, [float((i * j) % 11 - 5) for j in range(1, 6)]) for i in range(300)] + [(900, None)], "rec long, vector array<float>")
    key = lambda rows: {(x.qid, x.place): (x.rec, round(x.score, 9)) for x in rows}
    assert key(ranking.dense_top(q, r, 4).collect()) == key(ranking.dense_top(q, r, 4, block=7, record_block=50).collect())
    kept = ranking.restricted(spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (2, 3, 0.1)], "qid long, rec long, score double"), spark.createDataFrame([(1, 1), (2, 9)], "qid long, rec long"))
    assert {(x.qid, x.rec) for x in kept.collect()} == {(1, 1), (2, 3)}
    assert corpus.pattern_summary(spark.createDataFrame([], "pattern_type string, pattern string, n_files long")).collect() == [] and zones is not None
