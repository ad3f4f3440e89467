import random
import re
from collections import Counter

import pytest

from chunkquarry.llm import docs, queries, split, terms


@pytest.mark.parametrize(
    "doc, name, want",
    [
        (None, "f", True), ("", "f", True), ("TODO", "f", True), ("FIXME: write documentation for this function", "f", True), ("Auto-generated stub, please fill in later.", "f", True), ("@todo document", "f", True),
        ("Verifys the score quota.", "verify_score_quota", True), ("Rank this edge slice of the function.", "Edge.rankEdgeSlice", True), ("Compresss the account depot", "compress_account_depot", True), ("sweep weight epoch", "sweep_weight_epoch", True),
        ("* @param x the edge to trim\n * @return the number of things", "f", True), ("Rank every edge of the slice before it is closed.", "rank_edge_slice", False),
        ("The cache is stale, so it is rebuilt.\n\nTODO: drop this once x is gone.", "f", False), ("Niemand weiß, warum das zweimal steht.", "f", False), ("XXX no description yet", "f", True), ("Internal helper.", "f", True),
    ],
)
def test_trivial(doc, name, want):
    assert docs.trivial(doc, name) is want


C = """#include <a.h>

/* The first function does what it says. */
int f(int a) {
    // nothing to see in this body here
    return 1;
}

// This one is followed by a blank line.

int g(int a) {
    return 2;
}
// ---------------------
int h(void) { return 3; }
// x = g(1);
// h(2);
int i(void) { return 4; }
// Explains the last function well enough.
// NOLINTNEXTLINE
int j(void) { return "/* not a comment */"[0]; }
/**
 * A block with stars explains this one.
 */
int k(void) { return 5; }
"""
PY = '''# This comment is no documentation at all.
def f(a, b="):"):
    """The docstring of f says something here."""
    return 1


class A:
    """A class docstring is not of a function."""

    async def g(self,
                x=(1, 2)) -> "int":
        # a remark first
        r\'\'\'The docstring of g, told at length.\'\'\'

    def h(self):
        x = """def z():
    \'\'\'no docstring\'\'\'
"""
        return x

    def i(self): "One line is enough for this."
    def j(self):
        f"""An f-string is no docstring, is it?"""
'''


def test_spans():
    c = dict(docs.comment_spans("c", C))
    lines = C.split("\n")
    of = {re.search(r"int (\w)\(", x)[1]: c.get(i + 1) for i, x in enumerate(lines) if re.match(r"int \w\(", x)}
    assert of == {"f": "The first function does what it says.", "g": None, "h": None, "i": None, "j": "Explains the last function well enough.", "k": of["k"]} and "explains this one" in of["k"]
    p = dict(docs.comment_spans("python", PY.replace("\n", "\r\n")))
    named = {re.search(r"def (\w)", x)[1]: p.get(i + 1) for i, x in enumerate(PY.split("\n")) if "def " in x and p.get(i + 1)}
    assert set(named) == {"f", "g", "i"} and named["g"].startswith("The docstring of g")


def test_documented_functions(spark):
    files = spark.createDataFrame([("r/a.c", C, "c"), ("r/a.c", C, "c"), ("r/b.py", PY, None), ("r/n.go", None, "go")], "path string, content string, language string")
    at = {re.search(r"int (\w)\(", x)[1]: i + 1 for i, x in enumerate(C.split("\n")) if re.match(r"int \w\(", x)}
    rows = [(i, "r/a.c", f"a::{n}:{at[n]}", "Function", n, at[n], "x") for i, n in enumerate("fghijk")]
    rows += [(20, "r/b.py", "b::f:2", "function", "f", 2, None), (20, "r/b.py", "b::f:2", "function", "f", 2, None), (21, "r/gone.py", "gone::x:1", "method", "x", 1, "x"), (22, None, None, "function", None, None, "x"), (23, "r/a.c", "a::s", "struct", "s", at["f"], "x"), (None, "r/a.c", "q", "function", "f", at["f"], "x")]
    chunks = spark.createDataFrame([(*r, "extra") for r in rows], "chunk_no long, file_path string, chunk_id string, chunk_type string, name string, start_line int, source string, doc string")
    meta = spark.createDataFrame([("r/a.c", f"a::g:{at['g']}", "The summary takes its place here."), ("r/a.c", f"a::h:{at['h']}", "No summary."), ("r/gone.py", "gone::x:1", "Something is told of it here."), ("r/a.c", f"a::f:{at['f']}", None), (None, None, "x")], "file_path string, chunk_id string, summary string")
    out = {r.chunk_no: r.origin for r in docs.documented_functions(chunks, files, meta).collect()}
    assert out == {0: "file", 1: "summary", 4: "file", 5: "file", 20: "file", 21: "summary"}
    assert {r.chunk_no for r in docs.pairs(chunks, files, meta).collect()} == {0, 1, 4, 5, 21}
    assert docs.documented_functions(chunks.limit(0), files, meta).collect() == []
    assert {r.origin for r in docs.documented_functions(chunks, files.limit(0), meta).collect()} == {"summary"}


@pytest.mark.parametrize("seed", range(25))
def test_pieces(seed):
    rng = random.Random(seed)
    limit, overlap = rng.choice([(5, 0), (10, 3), (30, 29), (300, 30)])
    text = "".join(rng.choice(["word", "x", "a.b", "end. ", "\n", "\n\n", "  ", "    y = 1\n", "é"]) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1500)))
    words = len(text.split())
    got = split.pieces(text, limit, overlap)
    if words <= limit:
        assert got == []
        return
    covered = 0
    for i, (a, b, n, boundary) in enumerate(got):
        assert n == len(text[a:b].split()) <= limit and text[a:b] == text[a:b].strip()
        assert not text[covered:a].strip() if a >= covered else i > 0
        assert (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace())
        if i:
            assert b > got[i - 1][1] and a > got[i - 1][0]
            assert len(text[a : got[i - 1][1]].split()) <= overlap or a >= got[i - 1][1]
        covered = b
    assert not text[covered:].strip()


def test_natural_boundaries():
    text = "\n\n".join(" ".join(["w"] * 8) for _ in range(6))
    assert [n for _, _, n, _ in split.pieces(text, 17, 0)] == [16, 16, 16]
    assert all(b in ("start", "section", "paragraph") for *_, b in split.pieces(text, 17, 0))
    assert [b for *_, b in split.pieces("a b c. d e f\n\ng h\ni", 3, 0)] == ["start", "sentence", "section"]


@pytest.mark.parametrize("seed", range(10))
def test_pieces_by_characters(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "x" * rng.randrange(1, 60), ". ", "\n", "\n\n", "\n\n  ", "é\u3000"]) for _ in range(200))
    limit, overlap = rng.randrange(20, 80), rng.randrange(0, 20)
    got = split.pieces(text, limit, overlap, "char")
    covered = 0
    for i, (a, b, n, boundary) in enumerate(got):
        assert n == b - a <= limit and a <= covered
        assert not i or (b > covered and covered - a <= max(overlap, 0) and a > got[i - 1][0])
        covered = b
    assert covered == len(text)
    assert len(split.pieces("x" * 1000, 300, 10, "char")) == 4 and split.pieces("x" * 300, 300, 10, "char") == []
    paragraphs = split.pieces("aaaa bbbb\n\ncccc dddd\n\neeee ffff", 12, 0, "char")
    assert [b for *_, b in paragraphs] == ["start", "section", "section"]


def test_blanks_are_all_white_space():
    assert set(split.BLANKS) == {chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not split.WORD.match(chr(i))}


def test_split_frame(spark):
    rows = [(6, "a\u3000" * 400), (7, "a\u00a0b\u2003" * 200), (1, "a " * 400), (1, "a " * 400), (2, "a " * 300), (3, None), (4, ""), (5, "x\n" + "b " * 301), (None, "a " * 900)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "rec long, text string, piece_no int")
    out = split.split_oversized(df, 300, 30).collect()
    assert {r.rec for r in out} == {1, 5, 6, 7} and len(out) == len({(r.rec, r.piece_no) for r in out})
    assert {r.rec: r.widest_line for r in out} == {1: 400, 5: 301, 6: 400, 7: 400}
    assert split.split_oversized(df.limit(0), 300, 30).collect() == []
    with pytest.raises(ValueError):
        split.split_oversized(df, 30, 30)


def test_terms(spark):
    rng = random.Random(6)
    words = ["a", "b1", "_x", "zebra", "Über", "9lives", "K"]
    texts = {i * 37: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(300)}
    rows = [(i, t, rng.choice(["Define", " define ", None, "in clude"]), i) for i, t in texts.items()]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:50] + [(9_999_999, None, "x", 1), (None, "a", "x", 1)]], "pattern_no long, original string, pattern_type string, frequency int, rec int")
    recs = terms.records(df)
    found = {i: re.findall(terms.TERM, t.lower()) for i, t in texts.items()}
    occ, rec = Counter(t for f in found.values() for t in f), Counter(t for f in found.values() for t in set(f))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked(terms.term_frequencies(recs), recs).collect()}
    assert {t: v[:2] for t, v in got.items()} == {t: (occ[t], rec[t]) for t in occ}
    assert all(v[2] == ("rare" if v[1] == 1 else "common" if v[1] > 6 else None) for v in got.values())
    assert {r.kind for r in recs.collect()} == {"define", "unknown", "in_clude"}
    assert terms.term_frequencies(terms.records(df.limit(0))).collect() == []
    assert sum(r.records for r in terms.value_frequencies(recs).collect()) == 300


def test_values_overall(spark, tmp_path):
    rows = [(1, "x", "Define", 4), (2, "x", "include", 9), (2, "x", "include", 9), (3, "y", None, None), (4, None, "define", 1)]
    rows += [(i, f"z{i}", "define", 1) for i in range(10, 70)]
    spark.createDataFrame(rows, "pattern_no long, original string, pattern_type string, frequency int").write.parquet(f"{tmp_path}/patterns.parquet")
    out = {(r.kind, r.value): tuple(r)[2:] for r in queries.QUERIES["p3_value_totals"](spark, str(tmp_path)).collect()}
    assert out["all", "x"] == (2, 2, 4, 9, "common") and out["all", "y"] == (1, 1, None, None, "rare")
    assert out["define", "x"] == (1, 1, 4, 4, "rare") and out["include", "x"] == (1, 1, 9, 9, "rare")
    assert len(out) == 62 + 63
