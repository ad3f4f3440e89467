import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkquarry.llm import queries, tokens

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def pair():
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    return tokens.Counter(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_the_tokenizer(pair):
    counter, exact = pair
    rng = random.Random(1)
    parts = ["the ", "don't", "we'll ", "''s", " 's", "\n's", "\n\n", "  ", "\t", " \n ", "getSocketEdge", "snake_case_name", "1234", "½Ⅷ", "é", "ß", "漢字", " ", " x", "🙂", "====", "->", "{\n        ", "'re", "I've", "x'd", "'", " '", "'ll", "\r\n", "a" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)] + ["", None, " ", "a ", " a", "\n", "'s", "s'"]
    got = tokens.count_batch(pa.array(texts, pa.string()), counter)
    assert got.tolist() == [len(exact.encode_ordinary(t or "")) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    if not hasattr(test_any_text, "pair"):
        test_any_text.pair = tokens.Counter(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, exact = test_any_text.pair
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tokens.count_batch(pa.array(texts, pa.string()), counter).tolist() == [len(exact.encode_ordinary(t)) for t in texts]


def test_two_vocabularies(spark, tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
    df = spark.createDataFrame([(1, "abab ab")], "doc_id long, text string").coalesce(1)
    assert tokens.token_counts(df).first().n_tokens != tokens.token_counts(df, str(tmp_path / "v")).first().n_tokens == 4


def test_frames(spark, monkeypatch):
    rows = [(1, "en", "a b c"), (2, None, None), (3, "de", ""), (4, "en", "x" * 5000), (4, "en", "x" * 5000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, language string, text string, n_tokens int")
    out = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert out[1] == 3 and out[2] == out[3] == 0 and out[4] > 0
    cube = {(r.language, r.level): (r["items"], r.tokens) for r in tokens.cube(tokens.token_counts(df.limit(3)), ["language"]).collect()}
    assert cube[None, 1][0] == 3 and cube["(none)", 0] == (1, 0)
    assert tokens.token_counts(df.limit(0)).collect() == []


def test_methods_without_a_counted_class_row_are_counted(spark, tmp_path):
    rows = [
        (1, "r/a.py", "Class", "A", None, "class A:\n    def f(self): pass"), (2, "r/a.py", "method", "f", "A", "def f(self): pass"),
        (3, "r/b.py", "method", "f", "A", "def f(self): pass"), (4, "r/c.py", "class", "A", None, None), (5, "r/c.py", "method", "f", "A", "def f(self): pass"),
        (6, "r/d.py", "class", "A", "A", "class A: pass"), (7, "r/e.py", "function", "A", None, "def A(): pass"), (8, "r/e.py", "method", "f", "A", "def f(self): pass"),
        (9, None, "method", "f", "A", "def f(self): pass"),
    ]
    df = spark.createDataFrame([(*r, "python") for r in rows + rows[:2]], "chunk_no long, file_path string, chunk_type string, name string, parent_name string, source string, language string")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r.chunk_no for r in queries._chunk_tokens(spark, str(tmp_path)).collect()} == {1, 3, 5, 6, 7, 8, 9}
