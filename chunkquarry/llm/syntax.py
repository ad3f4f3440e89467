"""Source files that do not parse in the language their extension stands for.

1. A file is taken in blocks of whole lines. Of each block a *lexer-state map* is made: for every state a block can be
   entered in (code, inside a block comment, a raw or a multi-line string) the state it is left in and a *bracket
   summary*, the brackets it leaves unmatched (closing ones, then opening ones). A file of one block has one entry state
   only, and is judged where it is read. Comments nested deeper and raw strings with more hashes than ``_STATES`` lists are
   mapped too where a block is entered in them.
2. Maps compose associatively: exit state into entry state, and summaries by cancelling an opening against a closing
   bracket. The maps of larger files are shuffled (never their texts) and reduced as a tree: each level composes runs of
   ``FAN`` neighbours to one map, so no group holds more than ``FAN`` maps however large a file is.
3. Files that close everything are cut into balanced statements, and each statement is parsed with a local grammar:
   Python's own for a top-level statement of Python, token grammars for C, Go and Rust (the alternation of operands and
   operators, what may stand before ';', '{' and '}', and which declarations a file may hold). Of Python an exact parse
   of the whole file confirms what the first two steps found.

C is parsed with the first branches of its preprocessor conditionals, then once more for each other branch with the text
around it; brackets of a file with such branches are judged in these parses. Branches of one condition change together,
and what ``#if 0`` or the rest of ``#if 1`` excludes is no code. Null content, empty files and files of other extensions are
not judged (a null or empty file parses). Rows that repeat a path count once; it is flagged if any of its rows fails.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import language_of, repo_of
from .grammars import statement_error

BLOCK = 32_768
FAN = 64
_STATES = {"python": ("N", "'''", '"""'), "c": ("N", "B1"), "go": ("N", "B1", "`"), "rust": ("N", "B1", "B2", "B3", '"', '"#', '"##', '"###')}
_NEXT = {
    "python": re.compile(r"""#[^\n]*|'''|\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|['"]|[()\[\]{}]""", re.S),
    "c": re.compile(r"""//(?:[^\n\\]|\\.)*|/\*|^[ \t]*#[ \t]*(?:error|warning)[^\n]*|^[ \t]*#[ \t]*(?P<alt>else|elif)|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|['"]|[()\[\]{}]""", re.S | re.M),
    "go": re.compile(r"""//[^\n]*|/\*|`|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|['"]|[()\[\]{}]""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*|\b(?:b|c)?r(?P<raw>#*)"|'(?:\\[^\n]{1,10}?|[^'\\\n])'|'[A-Za-z_]\w*|"|'|[()\[\]{}]""", re.S),
}
_ENDS = {"'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S), '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), "`": re.compile("[^`]*`"), '"': re.compile(r'(?:[^"\\]|\\.)*"', re.S)}
_NESTED = re.compile(r"/\*|\*/")
_PAIR = {")": "(", "]": "[", "}": "{"}


def cancel(left: str, right: str) -> str | None:
    """The bracket summary of two neighbours, None if a closing bracket meets the wrong opening one."""
    stack = list(left)
    for x in right:
        if x in _PAIR and stack and stack[-1] not in _PAIR:
            if stack.pop() != _PAIR[x]:
                return None
        else:
            stack.append(x)
    return "".join(stack)


def lex(language: str, text: str, state: str) -> tuple[str, str | None, bool]:
    """(exit state, bracket summary or None if brackets clash, whether C takes one of several branches)."""
    pos, stack, alternatives, bad = 0, [], False, False
    find = _NEXT[language].search
    while True:
        if state != "N":
            if state[0] == "B":
                depth = int(state[1:])
                while depth and (m := _NESTED.search(text, pos)):
                    pos = m.end()
                    depth += 1 if m[0] == "/*" and language == "rust" else -1 if m[0] == "*/" else 0
                if depth:
                    return f"B{depth}", None if bad else "".join(stack), alternatives
            elif state in _ENDS and state != '"#':
                if not (m := _ENDS[state].match(text, pos)):
                    return state, None if bad else "".join(stack), alternatives
                pos = m.end()
            else:
                close = state.removeprefix("r")
                end = text.find(close, pos)
                if end < 0:
                    return state, None if bad else "".join(stack), alternatives
                pos = end + len(close)
            state = "N"
        if not (m := find(text, pos)):
            return "N", None if bad else "".join(stack), alternatives
        token, pos = m[0], m.end()
        if token in "()[]{}":
            if token in _PAIR and stack and stack[-1] not in _PAIR:
                bad |= stack.pop() != _PAIR[token]
            else:
                stack.append(token)
        elif token == "/*":
            state = "B1"
        elif token in ("'''", '"""', "`") or token == '"' and language == "rust":
            state = token
        elif language == "rust" and token.endswith('"') and m.group("raw") is not None:
            state = '"' + m.group("raw") if m.group("raw") else 'r"'  # r"..." has no escapes
        elif token in ("'", '"'):
            bad = True  # a string or character that ends in another line
        elif language == "c" and m.group("alt"):
            alternatives = True


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.rfind("\n", at, at + BLOCK) + 1 if len(text) - at > BLOCK else len(text)
        if end <= at:
            end = (text.find("\n", at + BLOCK) + 1) or len(text)
        yield text[at:end]
        at = end


_MAP = "key string, block int, entry string, exit string, brackets string, branches boolean"
_MAP_SCHEMA = pa.schema([("key", pa.string()), ("block", pa.int32()), ("entry", pa.string()), ("exit", pa.string()), ("brackets", pa.string()), ("branches", pa.bool_())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def block_maps(language: str, text: str) -> list[tuple[int, str, str, str | None, bool]]:
    """(block, entry, exit, brackets, branches) of all blocks of a text and all states they may be entered in."""
    out, state = [], "N"  # the state a block is entered in indeed: comments nest and raw strings are fenced to any depth
    for i, block in enumerate(_blocks(text.replace("\r\n", "\n"))):
        exits = {entry: lex(language, block, entry) for entry in dict.fromkeys((*(_STATES[language] if i else ("N",)), state))}
        out.extend((i, entry, *found) for entry, found in exits.items())
        state = exits[state][0]
    return out


def compose(maps: list[tuple]) -> list[tuple[str, str, str | None, bool]]:
    """The maps (block, entry, exit, brackets, branches) of neighbouring blocks as one: (entry, exit, brackets, branches).

    An entry state that leads to a state the next block has no map for is left out: no file is read that way.
    """
    by: dict[int, dict[str, tuple]] = {}
    for block, entry, *rest in maps:
        by.setdefault(block, {})[entry] = tuple(rest)
    first, *others = (by[k] for k in sorted(by))
    out = []
    for entry, (state, summary, branches) in first.items():
        for block in others:
            if state not in block:
                break
            state, brackets, more = block[state]
            summary = None if summary is None or brackets is None else cancel(summary, brackets)
            branches = branches or more
        else:
            out.append((entry, state, summary, branches))
    return out


def closes(exit_state: str, brackets: str | None, branches: bool) -> bool:
    """Whether a file with this map closes everything; the brackets of C with several branches are judged by branch."""
    return exit_state == "N" and (brackets == "" or branches)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, language, text in zip(*(batch.column(c).to_pylist() for c in ("key", "language", "text"))):
            yield _rows([(key, *m) for m in block_maps(language, text)], _MAP_SCHEMA)


def _composed(group: pa.Table) -> pa.Table:
    """One level of the tree: the maps of a run of blocks as those of one."""
    cols = [group.column(c).to_pylist() for c in ("block", "entry", "exit", "brackets", "branches")]
    key, run = group.column("key")[0].as_py(), cols[0][0] // FAN
    return pa.Table.from_batches([_rows([(key, run, *m) for m in compose(list(zip(*cols)))], _MAP_SCHEMA)])


def reduced(maps: DataFrame, levels: int = 3) -> DataFrame:
    """The map of each key's whole text, by a tree of ``levels`` levels.

    Two neighbouring blocks hold more than BLOCK characters, so the longest string there can be (2 GB) has fewer than FAN ** 3.
    """
    for _ in range(levels):
        maps = maps.groupBy("key", F.expr(f"block div {FAN}")).applyInArrow(_composed, _MAP)
    return maps


_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")
_TOP = re.compile(r"^(?=[^\s#])", re.M)


def python_statements(text: str) -> Iterator[str]:
    """The top-level statements of a file whose brackets and strings are closed; decorators belong to what follows."""
    begin, held = 0, False
    spans, pos, depth, find = [], 0, 0, _NEXT["python"].search
    while m := find(text, pos):  # stretches in which a line's start is no statement's start
        token, at = m[0], m.start()
        pos = m.end()
        if token in ("'''", '"""'):
            end = _ENDS[token].match(text, pos)
            pos = end.end() if end else len(text)
            spans.append((at, pos))
        elif token in "([{":
            if not depth:
                opened = at
            depth += 1
        elif token in ")]}":
            depth -= 1
            if not depth:
                spans.append((opened, pos))
    spans.sort()
    k, reach = 0, -1
    for m in _TOP.finditer(text):
        at = m.start()
        while k < len(spans) and spans[k][0] < at:
            reach = max(reach, spans[k][1])
            k += 1
        if at < reach or at == 0 or text[at - 2 : at] == "\\\n" or _CONTINUES.match(text, at):
            continue
        if held:
            held = text[at] == "@"
            continue
        if text[begin:at].strip():
            yield text[begin:at]
        begin, held = at, text[at] == "@"
    if text[begin:].strip():
        yield text[begin:]


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def file_fails(language: str, text: str, closed: bool) -> bool:
    """Steps 3 and, for Python, the exact check."""
    text = text.removeprefix("﻿")
    if language != "python":
        return not closed or statement_error(language, text.replace("\r\n", "\n")) is not None
    lines = text.replace("\r\n", "\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return not (closed and all(map(_parses, python_statements(lines)))) and not _parses(text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of one block, whose map is known at once."""
    for batch in batches:
        fails = []
        for language, text in zip(*(batch.column(c).to_pylist() for c in ("language", "text"))):
            ((_, _, *only),) = block_maps(language, text)
            fails.append(file_fails(language, text, closes(*only)))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(fails, pa.bool_())], names=["path", "fails"])


def _judge_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails = [file_fails(language, text, closed) for language, text, closed in zip(*(batch.column(c).to_pylist() for c in ("language", "text", "closed")))]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(fails, pa.bool_())], names=["path", "fails"])


def invalid_files(files: DataFrame) -> DataFrame:
    """path of each file (path, content; other columns ignored) that does not parse in its extension's language."""
    known = files.select("path", language_of(F.col("path")).alias("language"), F.col("content").alias("text"))
    known = known.where("language is not null and length(text) > 0")
    small = known.where(F.length("text") <= BLOCK).mapInArrow(_judge, "path string, fails boolean")
    large = known.where(F.length("text") > BLOCK).withColumn("key", F.concat_ws("|", "path", F.xxhash64("text"), F.length("text")))
    maps = large.select("key", "language", "text").mapInArrow(_maps, _MAP)
    closed = F.expr("exit = 'N' and (coalesce(brackets = '', false) or branches)")
    whole = reduced(maps).where("entry = 'N'").groupBy("key").agg(F.bool_and(closed).alias("closed"))
    judged = large.join(whole, "key").select("path", "language", "text", "closed").mapInArrow(_judge_large, "path string, fails boolean")
    return small.unionByName(judged).where("fails").select("path").distinct()


def error_rates(files: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language."""
    all_paths = files.select("path").where(language_of(F.col("path")).isNotNull()).distinct()
    bad = invalid_files(files).withColumn("bad", F.lit(1))
    return (
        all_paths.join(bad, "path", "left")
        .groupBy(repo_of(F.col("path")).alias("repo"), language_of(F.col("path")).alias("language"))
        .agg(F.count("*").alias("files"), F.count("bad").alias("invalid"), (F.count("bad") / F.count("*")).alias("rate"))
    )
