import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkquarry.functions import text
from chunkquarry.operators import chunking, corpus, experiments, history, masking, quality, ranking, rewriting, zones

PY = '''"""Module text of the file, rather long."""
import os
from a.b import c
logger = logging.getLogger(__name__)

class A:
    def m(self, x):
        """Keep this documentation string."""
        self.x = x
        return x

    async def n(self):
        for i in range(3):
            while i:
                try:
                    yield i
                except E:
                    pass

def outer(a):
    def inner(b):
        return b
    return inner

# A comment about the initialization of everything
'''
C = """#include <stdio.h>
#include "a.h"
#define MAX_SIZE_OF_THINGS 10
/* A block comment that explains what the whole file is for. */
struct point { int x; int y; };
static int add(int a, int b) {
    int c = a + b;
    c += 1;
    return c;
}
void loop(char *s) {
    while (*s != '}') { for (;;) { s++; } }
}
"""
GO = "package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Get(a int) int {\n\tif a > 0 {\n\t\treturn a\n\t}\n\treturn t.x\n}\n\nfunc Free(s string) string {\n\treturn `}` + s\n}\n"
RS = "use a::b;\n\npub struct P<'a> {\n    x: &'a str,\n}\n\nimpl<'a> P<'a> {\n    pub fn get(&self) -> &'a str {\n        self.x\n    }\n}\n\nfn free(c: char) -> bool {\n    c == '{'\n}\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r/a.py", PY), ("r/a.py", PY), ("r/b.c", C), ("r/d.go", GO), ("r/e.rs", RS), ("q/bad.py", "def (:\n"), ("q/none.py", None), ("q/empty.py", ""), ("q/x.txt", "text"), (None, "x"), ("q/w.py", PY.replace("\n", "\r\n"))]
    return spark.createDataFrame([(*r, "lang", 1) for r in rows], "path string, content string, language string, line int")


def test_chunking(files):
    got = defaultdict(list)
    for r in chunking.with_ids(chunking.extract(files)).collect():
        got[r.file_path].append((r.chunk_type, r.name, r.start_line, r.end_line))
        assert r.chunk_id == f"{re.sub(r'[.][^.]*$', '', r.file_path.split('/')[-1])}::{r.name}:{r.start_line}"
    assert sorted(got["r/a.py"]) == sorted([("class", "A", 6, 18), ("function", "m", 7, 10), ("function", "n", 12, 18), ("function", "outer", 20, 23), ("function", "inner", 21, 22)]) and got["q/w.py"] == got["r/a.py"]
    assert sorted(got["r/b.c"]) == sorted([("struct", "point", 5, 5), ("function", "add", 6, 10), ("function", "loop", 11, 13), ("header", "__header__", 1, 4)])
    assert sorted(got["r/d.go"]) == sorted([("type", "T", 3, 5), ("method", "T.Get", 7, 12), ("function", "Free", 14, 16)])
    assert sorted(got["r/e.rs"]) == sorted([("struct", "P", 3, 5), ("method", "P::get", 8, 10), ("function", "free", 13, 15)])
    assert got["q/bad.py"] == [("module", "bad", 1, 1)] and set(got) == {"r/a.py", "r/b.c", "r/d.go", "r/e.rs", "q/bad.py", "q/w.py"}


def test_rewriting(spark, files):
    short, n = rewriting.skeleton_python(PY)
    assert n == 2 and "Keep this documentation string." in short and "self.x = x" not in short and "while i" in short
    import ast

    ast.parse(short)
    assert rewriting.skeleton_python(PY, frozenset({9}))[1] == 1 and rewriting.skeleton_python("def (:")[0] == "def (:"
    c, n = rewriting.skeleton_braces("c", C)
    assert n == 1 and "PI=" in c and "while (*s" in c and c.count("{") - c.count("}") == C.count("{") - C.count("}") + 0
    squeezed = rewriting.squeeze_python(PY)
    assert "# commnt abt intlztn evrythng" in squeezed and "import os" in squeezed
    assert "#include <stdio.h>" in rewriting.squeeze_braces(C) and "explns" in rewriting.squeeze_braces(C)
    changed = spark.createDataFrame([("r/a.py", 9), ("r/zz.py", 1)], "file_path string, line int")
    out = {r.path: r for r in rewriting.stage_tokens(files, changed).collect()}
    assert set(out) == {"r/a.py", "r/b.c", "r/d.go", "r/e.rs", "q/bad.py", "q/empty.py", "q/w.py"}
    assert out["r/a.py"].bodies_dropped == 1 and out["q/w.py"].bodies_dropped == 2
    assert out["q/w.py"].after_comments < out["q/w.py"].after_skeleton < out["q/w.py"].tokens_before
    roll = {r.language: r.files for r in rewriting.token_rollup(rewriting.stage_tokens(files)).collect()}
    assert roll == {"python": 4, "c": 1, "go": 1, "rust": 1}


def test_masking(spark, files, monkeypatch):
    assert {r.path: r.same for r in masking.round_trip(files).collect()} == {p: True for p in ("r/a.py", "q/bad.py", "q/empty.py", "q/w.py")}
    masked = {r.path: r for r in masking.mask(files).collect()}
    assert masked["r/a.py"].n_masked >= 1 and masked["r/a.py"].tokens_after < masked["r/a.py"].tokens_before
    monkeypatch.setattr(masking.text, "short_hash", lambda t, salt: F.concat(F.lit("0000000"), salt.cast("string")))  # all hashes agree
    known = masking.registry(masking.maskable_lines(files)).collect()
    assert len({r.marker for r in known}) == len(known) >= 3


def test_corpus(spark, files):
    got = {(r.pattern_type, r.pattern): r.n_files for r in corpus.mine_patterns(files.where("path = 'r/b.c'").unionByName(spark.createDataFrame([(f"r/c{i}.h", C, "", 1) for i in range(3)], files.schema))).collect()}
    assert got[("include", "#include <stdio.h>")] == 4 and got[("define", "#define MAX_SIZE_OF_THINGS 10")] == 4 and any(k == "comment_block" for k, _ in got)
    assert {r.line: r.n_files for r in corpus.import_frequency(files).collect()} == {"import os": 2, "from a.b import c": 2}
    patterns = spark.createDataFrame([(1, "import os  ", "§1", 2), (2, "import os", "§2", 3), (3, None, "§3", 1), (4, "x", None, 1)], "pattern_no long, original string, compressed string, mined_at int")
    cache = corpus.hash_cache(patterns)
    assert [r.compressed for r in cache.collect()] == ["§2"]
    hits = {(r.path, r.line_no): r.compressed for r in corpus.cached_lines(files, cache).collect()}
    assert hits[("r/a.py", 2)] == "§2" and hits[("r/a.py", 3)] is None and ("r/a.py", 5) not in hits
    assert corpus.uncached(files, cache).count() == len({k for k in {line.rstrip(" ") for _, c in [(0, PY), (0, C), (0, GO), (0, RS), (0, "def (:"), (0, "text")] for line in c.split("\n") if line.strip()}}) - 1
    chunks = spark.createDataFrame([(1, "f", "f(x); g(y); if (g(z)) h2(); g(1)"), (1, "f", "dup"), (2, None, None)], "chunk_no long, name string, source string")
    assert [(r.place, r.callee) for r in corpus.callees(chunks.where("chunk_no = 2 or source <> 'dup'")).orderBy("place").collect()] == [(1, "h2")]
    meta = spark.createDataFrame([("a", "1", "F", ["g", "f", "G"]), ("b", "2", "g", ["F", "x"]), ("b", "2", "g", ["F", "x"]), ("c", "3", "F", None), ("d", "4", None, ["g"])], "file_path string, chunk_id string, name string, callee_names array<string>")
    assert {r.name: (r.n_definitions, r.n_callers) for r in corpus.callers(meta).collect()} == {"f": (2, 1), "g": (1, 1)}


def test_ranking(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma_x", "delta", "eps"]
    recs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(60)] + [(100, None), (101, "")]
    asked = [(1, "alpha delta alpha"), (2, "?!"), (3, "Gamma_X"), (4, None)]
    r = spark.createDataFrame(recs, "rec long, text string")
    q = spark.createDataFrame(asked, "qid long, question string")
    want = {}
    for qid, question in asked:
        ts = set(re.findall(r"[a-z_]\w*", (question or "").lower()))
        scored = [(sum((t or "").split().count(w) for w in ts) / math.log(len((t or "").split()) + 2), i) for i, t in recs]
        want[qid] = [i for s, i in sorted(scored, key=lambda x: (-x[0], x[1])) if s > 0][:4]
    for parts in (1, 7):
        got = defaultdict(list)
        for x in ranking.best(ranking.keyword_scores(q, r.repartition(parts)), 4).orderBy("qid", "place").collect():
            got[x.qid].append(x.rec)
        assert got == {k: v for k, v in want.items() if v}
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, rec long, place int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid long, rec long, place int")
    assert [x.rec for x in ranking.fuse([a, b], 3).orderBy("place").collect()] == [11, 10, 12]


def test_expand_and_contexts(spark):
    scored = spark.createDataFrame([(1, i, float(10 - i)) for i in range(8)] + [(2, 0, 1.0)], "qid long, rec long, score double")
    rows = [(0, "Top", ["FIVE", "x"], None), (1, "b", [], ["six"]), (5, "five", None, None), (6, "Six", None, None), (7, "five", None, None), (3, None, None, None)]
    records = spark.createDataFrame(rows, "rec long, name string, callees array<string>, callers array<string>")
    got = {(r.qid, r.rec): (r.place, r.added) for r in ranking.expand(scored, records, 2).collect()}
    assert got == {(1, 0): (1, False), (1, 1): (2, False), (1, 5): (None, True), (1, 6): (None, True), (2, 0): (1, False)}
    texts = spark.createDataFrame([(0, "zero"), (1, "one")], "rec long, text string")
    assert ranking.contexts(ranking.best(scored.where("qid = 1"), 2), texts).first().context == "zero\n---\none"


def test_pattern_masking(spark):
    c = "#include <stdio.h>\n  #define SOME_LONG_NAME_HERE 10\n\nint f(void) { return 1; }\n"
    files = spark.createDataFrame([(f"r/{i}.c", c) for i in range(3)] + [("r/x.py", c), ("r/n.c", None)], "path string, content string")
    known = masking.pattern_registry(corpus.mined_tokens(corpus.mine_patterns(files)))
    masked = {r.path: r for r in masking.mask_patterns(files, known).collect()}
    assert set(masked) == {"r/0.c", "r/1.c", "r/2.c"} and masked["r/0.c"].n_masked == 2 and masked["r/0.c"].masked.split("\n")[1].startswith("  §")
    assert {r.restored for r in masking.unmask_patterns(masking.mask_patterns(files, known), known).collect()} == {c}


def test_field_ranking(spark):
    rows = [(1, "body alpha", "alpha_fn", "int alpha_fn(x)", ["beta"], None, 5), (2, "alpha alpha", "other", None, None, "alpha told", 500), (3, "zzz", "beta", "f", [], "", None)]
    r = spark.createDataFrame(rows, "rec long, text string, name string, signature string, callees array<string>, summary string, line_count int")
    q = spark.createDataFrame([(1, "alpha beta alpha_fn")], "qid long, question string")
    got = {x.rec: x.score for x in ranking.field_scores(q, r).collect()}
    assert got[1] == pytest.approx(4 + 5 + 2 / math.sqrt(3) + 2 + 1 / math.log(4), abs=1e-6)
    assert got[2] == pytest.approx(3 / math.sqrt(2) + 2 / math.log(4) / math.log(500), abs=1e-6)
    assert got[3] == pytest.approx(4 + 5, abs=1e-6)


def test_dense(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).round(1)
    v[5] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(999, None)]
    r = spark.createDataFrame(rows, "rec long, vector array<float>").repartition(5)
    q = r.where("rec % 20 = 0").withColumnRenamed("rec", "qid")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    for block in (3, 4096):
        got = defaultdict(list)
        for x in ranking.dense_top(q, r, 4, block).orderBy("qid", "place").collect():
            got[x.qid].append((x.rec, x.score))
        assert set(got) == set(range(0, 200, 20))
        for i, best in got.items():
            s = unit @ unit[i]
            assert [b[1] for b in best] == pytest.approx(sorted(s, reverse=True)[:4], abs=1e-5) and best[0][0] == i
    assert ranking.dense_top(q.limit(0), r, 4).collect() == []


def test_zones(spark):
    diff = "@@ -1,2 +10,3 @@\n x\n@@ -5 +20 @@\n@@ -7,2 +30,0 @@\n"
    hot = zones.diff_hunks(spark.createDataFrame([("a.py", diff), ("b.py", None)], "file_path string, diff string"))
    assert sorted((r.file_path, r.line) for r in hot.collect()) == [("a.py", 10), ("a.py", 11), ("a.py", 12), ("a.py", 20)]
    rng = random.Random(5)
    chunks = [(i, rng.choice(["a.py", "b.c", "c.py", None]), rng.randrange(1, 60), "x = 1\n") for i in range(80)]
    lines = [(rng.choice(["a.py", "b.c"]), rng.randrange(1, 60)) for _ in range(12)]
    out = {r.chunk_no: r for r in zones.classify(spark.createDataFrame(chunks + chunks[:3], "chunk_no long, file_path string, start_line int, source string"), spark.createDataFrame(lines, "file_path string, line int")).collect()}
    assert len(out) == 80
    for i, path, at, _ in chunks:
        near = [abs(at - line) for p, line in lines if p == path]
        assert out[i].hzs == pytest.approx(math.exp(-0.1 * min(near)) if near else 0.0)
        assert out[i].zone == ("FOREGROUND" if near and math.exp(-0.1 * min(near)) > 0.1 else "BACKGROUND")


def test_quality(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        assert quality.lcs_f1(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)
    pairs = [("1", "a b b c", "a b d", 0.5, -1.0), ("2", "", "x", -1.0, 0.25), ("3", None, "x", 1.0, 1.0), ("4", "```python\nfoo(bar)\n```", "```\nfoo(baz)\n```", None, None)]
    df = spark.createDataFrame([(*p, 100, 50) for p in pairs + pairs[:1]], "task_id string, response_full string, response_bridge string, functional double, judge double, full_tokens int, bridge_tokens int")
    got = {r.task_id: r for r in quality.scores(df).collect()}
    assert set(got) == {"1", "2", "4"} and got["1"].saved == 50.0
    c = 3 / (math.sqrt(6) * math.sqrt(3))
    assert got["1"].semantic == pytest.approx(c) and got["1"].composite == pytest.approx((0.25 * c + 0.15 + 0.2) / 0.8)
    assert got["2"].semantic == 0 and got["4"].overlap == pytest.approx(1 / 3)
    assert {r.task_id: r.code for r in df.select("task_id", quality.code_block("response_full").alias("code")).collect()}["4"] == "foo(bar)"


def test_history(spark):
    docs = spark.createDataFrame([(1, "user: I want the configuration of things now please\nassistant: ok\nnoise\nuser: configuration configuration done in the configuration_file"), (2, "no turns"), (3, None), (None, "user: x")], "doc_id long, text string")
    said = history.turns(docs)
    assert [(r.conv_id, r.turn_id, r.role) for r in said.orderBy("turn_id").collect()] == [(1, 0, "user"), (1, 1, "assistant"), (1, 3, "user")]
    z = history.condense(said, budget=5).first()
    assert (z.n_turns, z.n_pruned) == (3, 1) and z.zipped == "user: I want the configuration [...]" and z.tokens_after < z.tokens_before
    assert [(r.token, r.n, r.short_key) for r in history.facts(said).collect()] == [("configuration", 3, "con13")]
    rows = [(1, "d1", "a", 5, "x", "1", "s1", None), (2, "d2", "a", 4, "x", "2", "s2", "s1"), (2, "d2", "a", 4, "x", "2", "s2", "s1"), (3, "d3", None, None, "y", None, "s3", "s2"), (4, "d4", "b", 5, "x", "9", "s4", "gone")]
    d = spark.createDataFrame([(*r, "why", 0.5) for r in rows], "seq long, decision_id string, agent_id string, ts int, decision_type string, decision_value string, slice_id string, parent_slice_id string, rationale string, confidence double")
    assert {(r.agent_id, r.decision_value) for r in history.latest(d).collect()} == {("a", "1"), ("b", "9")}
    assert {r.slice_id: r.depth for r in history.slice_depth(d).collect()} == {"s1": 0, "s2": 1, "s3": 2, "s4": 0}
    assert [r.seq for r in history.tail(d, 2).collect()] == [4, 3]
    assert {(r.agent, r.kind): r.n for r in history.audit_summary(d).collect()}[(None, None)] == 4


def test_depth_of_long_chains_and_cycles(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(150)] + [("a", "b"), ("b", "a"), ("c", "a"), ("own", "own"), ("t", "gone")]
    d = spark.createDataFrame(rows, "slice_id string, parent_slice_id string")
    out = {r.slice_id: r.depth for r in history.slice_depth(d).collect()}
    assert out == {f"s{i}": i for i in range(150)} | {"a": None, "b": None, "c": None, "own": None, "t": 0}


def test_experiments(spark):
    rows = [(i, "a.py", "Function", PY[: 40 * (i + 1)]) for i in range(20)] + [(99, "a.c", "function", C), (98, "a.py", "class", PY), (97, "a.py", "function", None)]
    df = spark.createDataFrame(rows, "chunk_no long, file_path string, chunk_type string, source string")
    grid = experiments.skeleton_grid(df, {"threshold": (0.7, 0.8), "penalty": (0.06,)})
    for r in grid.collect():
        assert r.dropped == sum(round(rewriting.predictability(s, "python"), 9) >= r.threshold for _, p, t, s in rows if p == "a.py" and t == "Function" and s)
    assert experiments.best_setting(grid, 0.0).first().threshold == 0.8
    runs = spark.createDataFrame([(1, 1.0, 10.0), (2, 1.0, 20.0), (3, 1.0, 1000.0), (4, 1.0, None)], "run long, score double, elapsed double")
    assert [(r.run, r.adjusted) for r in experiments.leaderboard(experiments.speed_adjusted(runs), 4).collect()] == [(1, 2.0), (2, 1.0), (4, 1.0), (3, 0.1)]


def test_empty_tables(spark, files):
    none = files.limit(0)
    for out in (chunking.extract(none), rewriting.stage_tokens(none), masking.mask(none), corpus.mine_patterns(none), corpus.import_frequency(none), corpus.repo_rollup(none)):
        assert out.collect() == []
    assert Counter(text_ for (text_,) in none.select("path").collect()) == Counter()
    assert text.count_tokens is not None
