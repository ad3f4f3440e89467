"""Functions paired with their documentation.

Comment spans are extracted from the files and function spans are read from the chunks, independently of each other. A
comment span carries the line a function would have to begin at to own it: the line after a comment that stands on
lines of its own, or the ``def`` line of a Python docstring. An as-of join (one window per file over both kinds of
spans, ordered by line) attaches the nearest span at or before each function, and it is rejected if its line isn't the
function's own: a statement, a blank line or an attribute stands between. Where no documentation is found the summary
recorded for the function takes its place. Pairs with empty or trivial documentation are dropped.

Rulers, tool directives and commented-out code are no documentation; a comment of nothing else counts as absent.
Functions whose path, line or name is null have no comment and fall back to the summary. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import language_of
from .syntax import _ENDS, _NEXT, _NESTED

_TOOL = re.compile(
    r"(?i)^(?:nolint\w*|rustfmt\b|rustfmt::|clippy::|clang-(?:format|tidy)\b|go:\w|\+build\b|lint:|cppcheck-|coverity\[|lcov_excl|iwyu\b|golint\b|gosec\b|#nosec\b|noqa\b|pylint:|pragma\b|fmt:\s*(?:on|off)|eslint-|tslint:|sonar\b|"
    r"spdx-|-\*-|vim?:|cgo\b|export\s+\w+$|region\b|endregion\b|codespell:|doxygen\b|cbindgen:|uncrustify:|astyle\b|indent-(?:on|off))"
)
_RULER = re.compile(r"^[\W_]{3,}$")
_CODE = re.compile(r"[;{}]\s*$|^(?:return|if|for|while|let|var|const|use|import|#include|#define)\b.*[;{(=]|^[\w.\->\[\]&*:]+(?:\s+[\w*&]+)?\s*(?:=|:=|\+=|-=|\|=)\s*\S.*[)\w\]\"']$|^[\w.:]+\([^()]*\);$")
_MARKS = re.compile(r"^\s*(?:///?|//!|/\*[*!]?|\*(?!/))?\s?|\s*\*/\s*$")


def _kept(lines: list[str]) -> str | None:
    """The text of a comment's lines, None if it is no documentation."""
    bare = [x.strip() for x in lines]
    said = [x for x in bare if not (_RULER.match(x) and x != "...") and not _TOOL.match(x) and not _CODE.search(x)]
    return None if not any(said) and any(bare) else "\n".join(said)


def comment_spans(language: str, text: str) -> list[tuple[int, str]]:
    """(line a function would begin at, text) of each eligible comment or docstring."""
    text = text.replace("\r\n", "\n")
    return _docstrings(text) if language == "python" else _comments(language, text)


def _comments(language: str, text: str) -> list[tuple[int, str]]:
    find, pos, out, run, line, counted = _NEXT[language].search, 0, [], [], 1, 0
    run_end = -1

    def close() -> None:
        if run and (kept := _kept([_MARKS.sub("", x) for x in run])) is not None:
            out.append((run_end + 1, kept))
        run.clear()

    while m := find(text, pos):
        token, at, pos = m[0], m.start(), m.end()
        if token == "/*":
            depth = 1
            while depth and (c := _NESTED.search(text, pos)):
                pos = c.end()
                depth += 1 if c[0] == "/*" and language == "rust" else -1 if c[0] == "*/" else 0
            if depth:
                break
        elif token == "`" or token == '"' and language == "rust":
            end = _ENDS[token].match(text, pos)
            pos = end.end() if end else len(text)
            continue
        elif language == "rust" and m.group("raw") is not None:
            end = text.find('"' + m.group("raw"), pos)
            pos = end + 1 + len(m.group("raw")) if end >= 0 else len(text)
            continue
        elif not token.startswith("//"):
            continue
        begin = text.rfind("\n", 0, at) + 1
        if text[begin:at].strip():
            continue
        line += text.count("\n", counted, at)
        counted = at
        stop = text.find("\n", pos)
        if token == "/*":
            close()
            if not text[pos : stop if stop >= 0 else len(text)].strip():
                body = text[at:pos].split("\n")
                if (kept := _kept([_MARKS.sub("", _MARKS.sub("", x)) for x in body])) is not None:
                    out.append((line + len(body), kept))
        else:
            if line != run_end + 1:
                close()
            run.append(token)
            run_end = line + token.count("\n")
    close()
    return out


_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+", re.M)
_STEP = re.compile(r"""'''|\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|#[^\n]*|[()\[\]{}:]""", re.S)
_DOC = re.compile(r"""(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuU]?(?:(?P<t>'''|\"\"\")(?P<a>(?:[^\\]|\\.)*?)(?P=t)|(?P<q>['"])(?P<b>(?:[^\\\n]|\\.)*?)(?P=q))[ \t]*(?:;|\#|\n|$)""", re.S)


def _docstrings(text: str) -> list[tuple[int, str]]:
    strings, pos, find = [], 0, _NEXT["python"].search
    while m := find(text, pos):
        pos = m.end()
        if m[0] in ("'''", '"""'):
            end = _ENDS[m[0]].match(text, pos)
            pos = end.end() if end else len(text)
            strings.append((m.start(), pos))
    out, k, line, counted = [], 0, 1, 0
    for m in _DEF.finditer(text):
        while k < len(strings) and strings[k][1] <= m.start():
            k += 1
        if k < len(strings) and strings[k][0] < m.start():
            continue
        pos, depth = m.end(), 0
        while s := _STEP.search(text, pos):
            x, pos = s[0], s.end()
            if x in "([{":
                depth += 1
            elif x in ")]}":
                depth -= 1
            elif x == ":" and depth == 0:
                break
            elif x in ("'''", '"""'):
                end = _ENDS[x].match(text, pos)
                pos = end.end() if end else len(text)
        doc = _DOC.match(text, pos)
        line += text.count("\n", counted, m.start())
        counted = m.start()
        if doc:
            out.append((line, doc["a"] if doc["a"] is not None else doc["b"]))
    return out


_WORDS = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PENDING = re.compile(
    r"(?i)\b(?:to\s?do|fixme|xxx|tbd|tba)\b.*\b(?:doc\w*|descri\w*|comment\w*|summar\w*|write|fill|explain)\b|\b(?:doc\w*|descri\w*|comment\w*|summar\w*)\b.*\b(?:to ?do|tbd|to be (?:done|written|added)|to follow|goes here|missing|pending|later|coming soon|yet)\b|"
    r"\bauto\W?(?:matically)?\W?generated\b|\bgenerated\b.*\bstub\b|\bstub\b.*\b(?:fill|replace|generated)\b|\bplaceholder\b|^(?:no|missing|add|needs?|write|insert)\b.{0,12}\b(?:description|documentation|docs?|docstring|summary|comment)\b|\bundocumented\b|\bnot (?:yet )?documented\b|\bfill (?:this |me )?in\b"
)
_FILLERS = frozenset("a an the this of function".split())


def _of_name(word: str, names: set[str]) -> bool:
    return word in names or any(len(n) > 2 and word.startswith(n[:-1]) and word[len(n) - 1 :] in (n[-1] + "s", n[-1] + "es", n[-1] + "ed", n[-1] + "d", n[-1] + "ing", "ing", "ies", "ied", "ed", n[-1] * 2 + "ing", n[-1] * 2 + "ed") for n in names)


def trivial(doc: str | None, name: str | None) -> bool:
    """Nothing, fewer than four words, only a promise of text, or only the words of the name."""
    if doc is None:
        return True
    lines = [_MARKS.sub("", x).strip() for x in doc.split("\n")]
    said = " ".join(x for x in lines if x and not x.startswith("@"))
    words = [w for w in said.split() if re.search(r"\w", w)]
    if len(words) < 4:
        return True
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", said) if re.search(r"\w", s)]
    if all(len(s.split()) <= 12 and _PENDING.search(s) for s in sentences):
        return True
    names = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name or ""))}
    return all(w in _FILLERS or _of_name(w, names) for w in (w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", said))))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(path, line, doc) for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text"))) for line, doc in comment_spans(language, text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "line", "doc"])


@F.pandas_udf(T.BooleanType())
def _is_trivial(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([trivial(d, n) for d, n in zip(doc, name)], dtype=bool)


def documented_functions(chunks: DataFrame, files: DataFrame, meta: DataFrame) -> DataFrame:
    """chunk_no, name, doc, origin (file or summary) of every function or method with non-trivial documentation."""
    is_function = F.lower(F.trim("chunk_type")).isin("function", "method")
    functions = chunks.where(is_function & F.col("chunk_no").isNotNull()).select("chunk_no", "file_path", "chunk_id", "name", "start_line").dropDuplicates(["chunk_no"])
    texts = files.select("path", language_of(F.col("path")).alias("language"), F.col("content").alias("text")).where("language is not null and length(text) > 0")
    spans = texts.mapInArrow(_spans, "path string, line int, doc string")
    both = spans.select(F.col("path").alias("file_path"), "line", F.lit(0).alias("side"), F.struct("line", "doc").alias("span"), *(F.lit(None).cast(t).alias(c) for c, t in (("chunk_no", "long"), ("chunk_id", "string"), ("name", "string")))).unionByName(
        functions.select("file_path", F.col("start_line").alias("line"), F.lit(1).alias("side"), F.lit(None).cast("struct<line:int,doc:string>").alias("span"), "chunk_no", "chunk_id", "name")
    )
    as_of = W.partitionBy("file_path").orderBy("line", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    nearest: Column = F.last("span", ignorenulls=True).over(as_of)
    attached = both.withColumn("span", nearest).where("side = 1")
    attached = attached.withColumn("found", F.when(F.col("span.line") == F.col("line"), F.col("span.doc")))
    summaries = meta.where("file_path is not null and chunk_id is not null").groupBy("file_path", "chunk_id").agg(F.max("summary").alias("summary"))
    with_summary = attached.join(summaries, ["file_path", "chunk_id"], "left")
    origin = F.when(F.col("found").isNotNull(), "file").when(F.col("summary").isNotNull(), "summary")
    pairs = with_summary.select("chunk_no", "name", F.coalesce("found", "summary").alias("doc"), origin.alias("origin")).where("doc is not null")
    return pairs.where(~_is_trivial("doc", "name"))


def pairs(chunks: DataFrame, files: DataFrame, meta: DataFrame) -> DataFrame:
    """documented_functions with their code; rows whose source is null have none to pair and are left out."""
    code = chunks.where("chunk_no is not null and source is not null").select("chunk_no", F.col("source").alias("code")).dropDuplicates(["chunk_no"])
    return documented_functions(chunks, files, meta).join(code, "chunk_no").select("chunk_no", "name", "code", F.trim("doc").alias("doc"), "origin")
