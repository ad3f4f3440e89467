"""Shorter forms of code: bodies dropped where they are predictable, comments compressed.

A file is rewritten by one task; changed ("hot") lines arrive as an array with it and keep the bodies that hold them.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.tables import checkpointed, language_of
from . import masking, quality, zones
from .chunking import _blank, _close, _HEADS, _NOT_FUNCTIONS
from .corpus import distinct_chunks, distinct_files, mine_patterns, tokens_of

_STOP = frozenset(lexicon.STOP_WORDS)
_PY = re.compile(lexicon.PY_COMPLEX), re.compile(lexicon.PY_SIMPLE)
_C = re.compile(lexicon.C_COMPLEX), re.compile(lexicon.C_SIMPLE)


def predictability(source: str, language: str) -> float:
    """The column functions' predictability of one text."""
    hard, simple = _C if language == "c" else _PY
    lines = [x for x in (source if language == "c" else source.strip()).split("\n") if x.strip()]
    n = len(lines)
    if not n and language != "c":
        return 1.0
    base = next((b for most, b in ((2, 0.95), (5, 0.90), (10, 0.85), (20, 0.80), (35, 0.70)) if n <= most), 0.60 if language == "c" else max(0.0, 0.70 - (n - 35) * 0.02))
    k = sum(bool(hard.search(x)) for x in lines)
    s = sum(bool(simple.match(x)) for x in lines)
    bonus = 0.0 if k else (0.15 if n and s >= 0.5 * n else 0.0) + (0.10 if n > 20 else 0.0)
    return min(1.0, max(0.0, base - min(0.30 if language == "c" else 0.35, 0.06 * k) + bonus))


def skeleton_python(source: str, hot: frozenset[int] = frozenset(), threshold: float = 0.70) -> tuple[str, int]:
    """The bodies of outermost functions that are predictable as '...', docstrings kept; and how many."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source, 0
    outer: list[ast.AST] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                outer.append(child)
            else:
                walk(child)

    walk(tree)
    lines, dropped = source.split("\n"), 0
    for f in sorted(outer, key=lambda f: -f.lineno):
        body = f.body
        doc = isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)
        rest = body[1:] if doc and len(body) > 1 else body
        first, last = rest[0].lineno, f.end_lineno
        if first <= f.body[0].lineno - 1 or first == f.lineno or any(first <= h <= last for h in hot):
            continue
        if predictability("\n".join(lines[first - 1 : last]), "python") >= threshold:
            lines[first - 1 : last] = [" " * rest[0].col_offset + "..."]
            dropped += 1
    return "\n".join(lines), dropped


def skeleton_braces(language: str, source: str, hot: frozenset[int] = frozenset(), threshold: float = 0.70, least: int = 3) -> tuple[str, int]:
    """The same for C, Go and Rust: a body of at least ``least`` lines becomes a comment that says how long it was."""
    code, cuts, reach = _blank(source), [], -1
    for m in _HEADS[language].finditer(code):
        name = m.groupdict().get("name")
        if not name or name in _NOT_FUNCTIONS or m.start() < reach:
            continue
        at = code.index("{", m.end() - 1)
        end = _close(code, at)
        if end is None:
            continue
        reach, body = end, source[at + 1 : end - 1].strip("\n")
        n = body.count("\n") + 1
        first = code.count("\n", 0, at) + 1
        score = predictability(body, "c")
        if n >= least and score >= threshold and not any(first <= h <= first + n for h in hot):
            cuts.append((at + 1, end - 1, f" /* ...{n}L PI={score:.2f}... */ "))
    for a, b, note in reversed(cuts):
        source = source[:a] + note + source[b:]
    return source, len(cuts)


def squeeze(words: str) -> str:
    """Text without stop words and with vowels pruned."""
    out = []
    for w in words.split():
        if re.sub(r"^[^a-zA-Z]+|[^a-zA-Z]+$", "", w).lower() not in _STOP:
            out.append(w if len(w) < 5 or not w[0].isalpha() else w[0] + re.sub(r"([bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])[aeiouAEIOU]+", r"\1", w[1:-1]) + w[-1])
    return " ".join(out)


def squeeze_python(source: str) -> str:
    """Comment lines and the inner lines of triple-quoted strings squeezed; code stays."""
    out, inside = [], None
    for line in source.split("\n"):
        bare = line.strip()
        indent = line[: len(line) - len(line.lstrip())]
        if inside:
            if inside in bare:
                inside = None
                out.append(line)
            else:
                out.append(indent + squeeze(bare) if bare else line)
        elif m := re.match(r"(#+\s*)(.*)", bare):
            out.append(indent + m[1] + squeeze(m[2]))
        elif m := re.match(r"""([rRuU]?)(\"\"\"|''')""", bare):
            rest = bare[m.end() :]
            if m[2] not in rest:
                inside = m[2]
                out.append(line)
            else:
                text_, tail = rest.split(m[2], 1)
                out.append(indent + m[0] + squeeze(text_) + m[2] + tail)
        else:
            out.append(line)
    return "\n".join(out)


def squeeze_braces(source: str) -> str:
    """'//' lines and block comments that stand on lines of their own squeezed; directives and code stay."""

    def block(m: re.Match) -> str:
        lines = m[2].split("\n")
        if len(lines) == 1:
            return f"{m[1]}/* {squeeze(lines[0].strip('* '))} */"
        return f"{m[1]}/*" + "\n".join((re.match(r"\s*\*?\s?", x)[0] + squeeze(re.sub(r"^\s*\*?\s?", "", x))).rstrip() for x in lines) + "*/"

    source = re.sub(r"(?m)^([ \t]*)/\*(.*?)\*/(?=[ \t]*$)", block, source, flags=re.S | re.M)
    return re.sub(r"(?m)^([ \t]*//[/!]?[ \t]*)(\S.*)$", lambda m: m[1] + squeeze(m[2]), source)


def rewrite(files: DataFrame, changed: DataFrame | None = None, threshold: float = 0.70) -> DataFrame:
    """path, language, skeleton, compressed, bodies_dropped of each file in a known language (null content is left out).

    ``changed`` (file_path, line) keeps bodies that hold a changed line.
    """
    known = distinct_files(files).withColumn("language", language_of(F.col("path"))).where("language is not null and content is not null")
    if changed is not None:
        hot = changed.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("line").alias("hot"))
        known = known.join(hot, "path", "left")
    else:
        known = known.withColumn("hot", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, source, hot in zip(b.path, b.language, b.content, b.hot):
                source, lines = source.replace("\r\n", "\n"), frozenset(() if hot is None else map(int, hot))
                python = language == "python"
                short, n = skeleton_python(source, lines, threshold) if python else skeleton_braces(language, source, lines, threshold)
                rows.append((path, language, short, (squeeze_python if python else squeeze_braces)(short), n))
            yield pd.DataFrame(rows, columns=["path", "language", "skeleton", "compressed", "bodies_dropped"])

    return known.mapInPandas(run, "path string, language string, skeleton string, compressed string, bodies_dropped int")


def stage_tokens(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """path, language, tokens_before, after_skeleton, after_comments, saved_percent."""
    whole = distinct_files(files).select("path", text.count_tokens(F.col("content")).alias("tokens_before"))
    out = rewrite(files, changed).select("path", "language", "bodies_dropped", text.count_tokens(F.col("skeleton")).alias("after_skeleton"), text.count_tokens(F.col("compressed")).alias("after_comments"))
    saved = F.when(F.col("tokens_before") > 0, 100.0 * (F.col("tokens_before") - F.col("after_comments")) / F.col("tokens_before")).otherwise(0.0)
    return out.join(whole, "path").withColumn("saved_percent", saved)


def token_rollup(stages: DataFrame) -> DataFrame:
    """Per language the sums of all stages and the ratio of sums."""
    sums = stages.groupBy("language").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("tokens_before", "after_skeleton", "after_comments", "bodies_dropped")))
    return sums.withColumn("saved_percent", F.when(F.col("tokens_before") > 0, 100.0 * (F.col("tokens_before") - F.col("after_comments")) / F.col("tokens_before")).otherwise(0.0))


def _squeezed(texts: DataFrame) -> DataFrame:
    """path, language, n_masked, skeleton_tokens, masked_tokens, compressed of rows with masked in its place."""
    columns = [f for f in texts.schema.fields if f.name != "masked"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(squeeze_python if lang == "python" else squeeze_braces)(t) for lang, t in zip(b.language, b.masked)]
            yield b.drop(columns="masked").assign(compressed=out)

    return texts.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", compressed string")


def _masked(texts: DataFrame, known: DataFrame) -> DataFrame:
    """path, masked, n_masked of texts (path, language, content): Python by boilerplate lines, C by patterns, others as they are."""
    files = texts.select("path", "content")
    python, c = masking.mask(files).select("path", "masked", "n_masked"), masking.mask_patterns(files, known)
    rest = texts.where("language not in ('python', 'c')").select("path", F.col("content").alias("masked"), F.lit(0).cast("long").alias("n_masked"))
    return python.unionByName(c).unionByName(rest)


def pipeline(files: DataFrame, changed: DataFrame | None = None, threshold: float = 0.70) -> DataFrame:
    """path, language, n_masked, compressed and the tokens before, after_skeleton, after_masking, after_comments, saved_percent.

    Every file goes through all three steps: bodies dropped but for changed ones, lines masked, comments squeezed. The
    patterns that mask C are mined from the files themselves.
    """
    known = masking.pattern_registry(tokens_of(mine_patterns(files)))
    cut = rewrite(files, changed, threshold).select("path", "language", F.col("skeleton").alias("content"))
    done = _squeezed(cut.select("path", "language", text.count_tokens(F.col("content")).alias("after_skeleton")).join(_masked(cut, known), "path").withColumn("after_masking", text.count_tokens(F.col("masked"))))
    whole = distinct_files(files).select("path", text.count_tokens(F.col("content")).alias("tokens_before"))
    sized = done.withColumn("after_comments", text.count_tokens(F.col("compressed"))).join(whole, "path")
    return sized.withColumn("saved_percent", F.when(F.col("tokens_before") > 0, 100.0 * (F.col("tokens_before") - F.col("after_comments")) / F.col("tokens_before")).otherwise(0.0))


def variants(files: DataFrame, threshold: float = 0.70) -> DataFrame:
    """path, variant, tokens, saved_percent, score: what six combinations of the steps make of each C file.

    The score is the term cosine with the file itself, 1 for an equal text.
    """
    known = checkpointed(masking.pattern_registry(tokens_of(mine_patterns(files))))
    cut = checkpointed(rewrite(files.where(language_of(F.col("path")) == "c"), None, threshold).select("path", "language", F.col("skeleton").alias("content")))
    plain = distinct_files(files).where((language_of(F.col("path")) == "c") & F.col("content").isNotNull()).select("path", F.lit("c").alias("language"), "content")
    squeezed = lambda t, c: _squeezed(t.select("path", "language", F.col(c).alias("masked"))).select("path", F.col("compressed").alias("text"))
    whole = plain.select("path", F.regexp_replace("content", "\r\n", "\n").alias("text"))
    both = masking.mask_patterns(cut, known).select("path", F.col("masked").alias("text"))
    made = {
        "none": whole, "comments": squeezed(plain, "content"), "masking": masking.mask_patterns(plain, known).select("path", F.col("masked").alias("text")),
        "skeleton": cut.select("path", F.col("content").alias("text")), "skeleton+masking": both, "all": squeezed(both.withColumn("language", F.lit("c")), "text"),
    }
    rows = None
    for name, df in made.items():
        df = df.select("path", F.lit(name).alias("variant"), "text")
        rows = df if rows is None else rows.unionByName(df)
    rows = checkpointed(rows)  # every variant made once
    paired = rows.join(whole.withColumnRenamed("text", "original"), "path").withColumn("key", F.concat_ws("|", "variant", "path"))
    scored = quality.cosine(paired, "key", "original", "text")
    sized = paired.select("key", "path", "variant", text.count_tokens(F.col("text")).alias("tokens"), text.count_tokens(F.col("original")).alias("before"), (F.col("text") == F.col("original")).alias("same"))
    saved = F.when(F.col("before") > 0, F.round(100.0 * (F.col("before") - F.col("tokens")) / F.col("before"), 1)).otherwise(0.0)
    return sized.join(scored, "key").select("path", "variant", "tokens", saved.alias("saved_percent"), F.when(F.col("same"), 1.0).otherwise(F.round("cosine", 3)).alias("score"))


def dispatch(chunks: DataFrame, changed: DataFrame, files: DataFrame, threshold: float = 0.70) -> DataFrame:
    """chunk_no, language, zone, original_tokens, final_tokens, score of each chunk with source.

    Foreground chunks of Python and C go through all steps, background ones of Python only have comments squeezed, those of
    C are masked as well; other languages have comments squeezed. Long words of comments give way to short ones in all.
    A blank chunk stays as it is, with score 1. A chunk is a text of its own: its lines are not those of a compressed file.
    """
    known = masking.pattern_registry(tokens_of(mine_patterns(files)))
    zone = zones.classify(chunks, changed).select(F.col("chunk_no").cast("string").alias("path"), "zone")
    source = F.regexp_replace("source", "\r\n", "\n")
    rows = distinct_chunks(chunks.where("source is not null"), F.coalesce(language_of(F.col("file_path")), F.lit("other")).alias("language"), source.alias("content")).select(F.col("chunk_no").cast("string").alias("path"), "language", "content")
    rows = rows.join(zone, "path")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = []
            for language, text_, front in zip(b.language, b.content, b.zone):
                skeleton = front == "FOREGROUND" and language in ("python", "c") and text_.strip()
                whole.append((skeleton_python(text_, frozenset(), threshold) if language == "python" else skeleton_braces(language, text_, frozenset(), threshold))[0] if skeleton else text_)
            yield b.assign(cut=whole)

    done = checkpointed(rows.mapInPandas(cut, "path string, language string, content string, zone string, cut string"))  # read three times below
    name = F.when(F.col("language") == "python", F.concat("path", F.lit(".py"))).when(F.col("language") == "c", F.concat("path", F.lit(".c"))).otherwise(F.col("path"))
    texts = done.select(name.alias("path"), "language", "zone", "content", F.col("cut"))
    may = texts.where("language = 'c' or (language = 'python' and zone = 'FOREGROUND')").select("path", "language", F.col("cut").alias("content"))
    masked = _masked(may, known).select("path", "masked")
    joined = texts.join(masked, "path", "left").select("path", "language", "zone", "content", F.coalesce("masked", "cut").alias("masked"))
    squeezed = _squeezed(joined)
    lines = F.transform(F.split("compressed", "\n"), lambda x: F.when(x.rlike(r"""^\s*(#|"|')"""), text.swap_synonyms(x)).otherwise(x))
    final = squeezed.withColumn("compressed", F.when(F.col("content").rlike(r"\S"), F.array_join(lines, "\n")).otherwise(F.col("content")))
    final = checkpointed(final)  # read twice below
    score = quality.cosine(final, "path", "content", "compressed")
    sized = final.select("path", "language", "zone", text.count_tokens(F.col("content")).alias("original_tokens"), text.count_tokens(F.col("compressed")).alias("final_tokens"), (~F.col("content").rlike(r"\S")).alias("blank"))
    return sized.join(score, "path").select(F.regexp_replace("path", r"\..*", "").cast("long").alias("chunk_no"), "language", "zone", "original_tokens", "final_tokens", F.when(F.col("blank"), 1.0).otherwise(F.round("cosine", 6)).alias("score"))


def dispatch_rollup(done: DataFrame) -> DataFrame:
    """By zone: chunks, tokens, the share saved (ratio of sums), the mean score (1 without chunks) and the product of both."""
    sums = done.groupBy("zone").agg(F.count("*").alias("chunks"), F.sum("original_tokens").alias("original_tokens"), F.sum("final_tokens").alias("final_tokens"), F.coalesce(F.round(F.avg("score"), 6), F.lit(1.0)).alias("mean_score"))
    saved = F.when(F.col("original_tokens") > 0, F.round(100.0 * (1 - F.col("final_tokens") / F.col("original_tokens")), 1)).otherwise(0.0)
    return sums.withColumn("saved_percent", saved).withColumn("value", F.round(F.col("saved_percent") / 100 * F.col("mean_score"), 6))
