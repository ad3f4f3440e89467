import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chunkquarry.functions import lexicon, text
from chunkquarry.operators import rewriting

TOKEN = re.compile(lexicon.TOKEN_PATTERN.replace(r"\p{L}\p{N}", r"\w").replace("[A-Za-z_][\\w_]*", r"[A-Za-z_]\w*"), re.S)
SAMPLES = [
    "", "   ", "def f(x):\n    return x", "it's the dog's \"quoted text\" and more's", '"""doc\nstring""" x = 3.14 != y', "getConfigurationValue configuration snake_case_name_here",
    "é ü ß übermäßiggroß naïve", "for (int i = 0; i < 10; i++) { if(x) return; }\n\tif(y) while(z) {}\n", "a\r\nb\r\n\r\nc", "123456789 1.5.3", "'''a''' 'b' 'c\n'd'",
]


def tokens(t):
    return sum(2 if len(x) > 8 and x.isalnum() else 1 for x in TOKEN.findall(t))


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(1)
    letters = "ab_ \n\t'\"(){}=+-.,:;#x9é"
    rows = SAMPLES + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(9999, None)], "i int, t string"), rows


def test_counts(df):
    frame, rows = df
    out = {r.i: r for r in frame.select("i", text.count_tokens(F.col("t")).alias("n"), text.count_words(F.col("t")).alias("w"), text.terms(F.col("t")).alias("terms")).collect()}
    for i, t in enumerate(rows):
        assert out[i].n == tokens(t), t
        assert out[i].w == len(t.split())
        assert out[i].terms == re.findall(r"[a-zA-Z_]\w*|[0-9]+", t.lower())
    assert out[9999].n == out[9999].w == 0 and out[9999].terms is None


def test_predictability(df):
    frame, rows = df
    out = {r.i: r for r in frame.select("i", text.python_predictability(F.col("t")).alias("p"), text.c_predictability(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(rows):
        t = t.replace("\r\n", "\n")
        assert math.isclose(out[i].p, rewriting.predictability(t, "python"), abs_tol=1e-9), t
        assert math.isclose(out[i].c, rewriting.predictability(t, "c"), abs_tol=1e-9), t
    assert out[9999].p is None


def test_compression(df):
    frame, rows = df
    out = {r.i: r.s for r in frame.select("i", text.compress_text(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(rows):
        assert out[i] == rewriting.squeeze(t), t
    assert rewriting.squeeze("The configuration of an implementation, please") == "confgrtn implmnttn, plse"


def test_small_helpers(spark):
    one = spark.createDataFrame([("    #  Initialize the configuration parameters", "x|0")], "line string, k string")
    r = one.select(text.swap_synonyms(F.col("line")).alias("s"), text.compress_comment(F.col("line")).alias("c"), text.short_hash(F.lit("x"), F.lit(0)).alias("h"), text.point_id(F.lit("a")).alias("p"), text.complexity(F.lit(" if  if  if "), F.lit(3)).alias("x")).first()
    assert r.s == "    #  init the cfg params" and r.c.startswith("    #  Intlze")
    import hashlib

    assert r.h == hashlib.sha256(b"x|0").hexdigest()[:8] and r.p == int(hashlib.md5(b"a").hexdigest()[:8], 16) and r.x == "moderate"
