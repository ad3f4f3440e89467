"""Files to chunk rows: functions, classes, types, headers, or the whole file as a module.

Each file is read by one task and needs nothing of any other; parsing is a small helper per row inside mapInPandas.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import language_of
from .corpus import distinct_files

_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|`[^`]*`|r(#*)".*?"\1|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^\n]{1,10}?)'""", re.S)
_HEADS = {
    "c": re.compile(r"^(?P<type>struct|union|enum)\s+(?P<t>\w+)\s*\{|^(?:[A-Za-z_][\w \t*]*?[ \t*])(?P<name>[A-Za-z_]\w*)[ \t]*\((?P<args>[^;{}]*)\)\s*\{", re.M),
    "go": re.compile(r"^func\s*(?:\(\s*\w*\s*\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*\([^\n]*\{|^type\s+(?P<t>\w+)\s+(?P<type>struct|interface)\s*\{|^type\s+(?P<alias>\w+)\s+(?!struct\b|interface\b)[^\n{]+$", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*fn\s+(?P<name>\w+)[^;{}]*\{|^(?:pub(?:\([^)]*\))?\s+)?(?P<type>struct|enum|trait)\s+(?P<t>\w+)[^;{}()]*\{|^impl(?:<[^>]*>)?\s+(?:[\w:<>']+\s+for\s+)?(?P<impl>\w+)[^;{}]*\{", re.M),
}
_NOT_FUNCTIONS = frozenset("if while for switch return else do sizeof".split())


def _blank(text: str) -> str:
    """Comments and strings as blanks, lines kept."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int | None:
    """Where the brace opened at ``at`` is closed."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return None


def brace_chunks(language: str, text: str) -> list[tuple[str, str, int, int, str | None]]:
    """(type, name, first line, last line, parent) of a C, Go or Rust file."""
    code = _blank(text)
    line = lambda i: code.count("\n", 0, i) + 1
    out, impls = [], []
    for m in _HEADS[language].finditer(code):
        g = m.groupdict()
        if g.get("alias"):
            out.append(("type", g["alias"], line(m.start()), line(m.end() - 1), None))
            continue
        end = _close(code, code.index("{", m.end() - 1))
        if end is None:
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        if g.get("impl"):
            impls.append((m.start(), end, g["impl"]))
        elif g.get("t"):
            out.append(("type" if language == "go" else "struct", g["t"], line(begin), line(end - 1), None))
        elif g["name"] not in _NOT_FUNCTIONS:
            owner = g.get("owner") or next((n for a, b, n in impls if a <= m.start() < b), None)
            sep = "::" if language == "rust" else "."
            out.append(("method" if owner else "function", f"{owner}{sep}{g['name']}" if owner else g["name"], line(begin), line(end - 1), owner))
    if language == "c" and out:
        top = text.split("\n")[: min(x[2] for x in out) - 1]
        if sum(bool(x.strip()) for x in top) >= 3 and any(re.match(r"\s*#\s*(?:include|define)", x) for x in top):
            out.append(("header", "__header__", 1, len(top), None))
    return out


def python_chunks(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """The same of a Python file: every function, nested ones and methods too, and every class; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("function", child.name, child.lineno, child.end_lineno, parent))
            elif isinstance(child, ast.ClassDef):
                out.append(("class", child.name, child.lineno, child.end_lineno, parent))
                inner = child.name
            walk(child, inner)

    walk(tree, None)
    return out


def chunks_of(path: str, language: str, text: str) -> list[tuple]:
    text = text.replace("\r\n", "\n")
    found = python_chunks(text) if language == "python" else brace_chunks(language, text)
    if not found:
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        found = [("module", stem, 1, text.count("\n") + (not text.endswith("\n")), None)]
    return found


def extract(files: DataFrame) -> DataFrame:
    """file_path, chunk_type, name, start_line, end_line, parent_name, source of every file with text in a known language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text in zip(b.path, b.language, b.content):
                lines = text.replace("\r\n", "\n").split("\n")
                for kind, name, first, last, parent in chunks_of(path, language, text):
                    rows.append((path, kind, name, first, last, parent, "\n".join(lines[first - 1 : last])))
            yield pd.DataFrame(rows, columns=["file_path", "chunk_type", "name", "start_line", "end_line", "parent_name", "source"])

    known = distinct_files(files).withColumn("language", language_of(F.col("path"))).where("language is not null and length(content) > 0")
    return known.mapInPandas(run, "file_path string, chunk_type string, name string, start_line int, end_line int, parent_name string, source string")


def with_ids(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, which is unique within a file only: stem::name:line."""
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    return chunks.withColumn("chunk_id", F.concat(stem, F.lit("::"), "name", F.lit(":"), F.col("start_line").cast("string")))
