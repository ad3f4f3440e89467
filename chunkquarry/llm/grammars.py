"""Token grammars for single statements of C, Go and Rust.

They accept a superset of each language: what is checked is that brackets match, that operands and operators alternate,
that a statement ends as the language wants it, and that only declarations stand at the top of a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_ID = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][\da-fA-F_']+|0[bB][01_']+|\d[\d_']*(?:\.(?!\.)[\d_]*)?(?:[eEpP][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[A-Za-z_\d]*"
_OPS = r"<<=|>>=|&\^=|\.\.\.|\.\.=|&&|\|\||->|<-|=>|::|:=|\+\+|--|[-+*/%&|^<>=!]=|<<|&\^|\.\.|[-+*/%&|^<>=!~?:;,.(){}\[\]@#$\\]"
_MARK = r"(?P<x>^(?:<{7}|>{7}|={7}|\|{7})(?=\s|$))|"  # what a merge leaves behind
_TOKENS = {
    "c": re.compile(_MARK + rf"""(?P<w>[ \t\f\v\r]+|\\\n|//(?:[^\n\\]|\\.)*|/\*.*?\*/)|(?P<nl>\n)|(?P<s>(?:L|u8|u|U|R)?"(?:[^"\\\n]|\\.)*")|(?P<c>(?:L|u8|u|U)?'(?:[^'\\\n]|\\.)+')|(?P<i>{_ID})|(?P<n>{_NUM})|(?P<o>{_OPS})""", re.S | re.M),
    "go": re.compile(_MARK + rf"""(?P<w>[ \t\f\v\r]+|//[^\n]*|/\*[^\n]*?\*/)|(?P<nl>\n|/\*.*?\*/)|(?P<s>`[^`]*`|"(?:[^"\\\n]|\\.)*")|(?P<c>'(?:[^'\\\n]|\\.[^'\n]*)')|(?P<i>{_ID})|(?P<n>{_NUM})|(?P<o>{_OPS})""", re.S | re.M),
    "rust": re.compile(_MARK + rf"""(?P<w>[ \t\f\v\r]+|//[^\n]*)|(?P<cm>/\*)|(?P<nl>\n)|(?P<s>(?:b|c)?r(?P<h>\#*)".*?"(?P=h)|(?:b|c)?"(?:[^"\\]|\\.)*")|(?P<c>b?'(?:\\[^\n]{{1,10}}?|[^'\\\n])')|(?P<l>'{_ID})|(?P<i>(?:r\#)?{_ID})|(?P<n>\d[\d_]*(?:\.\d[\d_]*)?\w*)|(?P<o>{_OPS})""", re.S | re.M),
}
_DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line ident assert".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


class Bad(Exception):
    """A statement that no rule accepts."""


_NEVER = {"0": False, "1": True}


def _c_condition(word: str, rest: str) -> tuple[str, bool]:
    """A directive's condition in one spelling, and whether it is negated."""
    plain = " ".join(re.sub(r"/\*.*?(?:\*/|$)|//.*", " ", rest, flags=re.S).replace("\\\n", " ").split())
    if word.endswith("def"):
        return f"defined {plain}", word.endswith("ndef")
    plain = re.sub(r"\bdefined\s*\(?\s*(\w+)\s*\)?", r"defined \1", plain)
    m = re.fullmatch(r"!\s*((?:defined )?\w+)", plain)
    return (m[1], True) if m else (plain, False)


def _c_lines(text: str, truth: dict[str, bool] = _NEVER, forced: dict[int, int] | None = None, others: list | None = None) -> str:
    """The text with preprocessor lines blanked and one branch of each conditional left.

    It is the first whose condition ``truth`` and the branches taken before don't make false; ``forced`` names branches by
    the conditional's number. ``others`` receives (truth, forced) for each branch not taken here that can be reached.
    """
    out, lines, i, comment, truth, forced, number = [], text.split("\n"), 0, False, dict(truth), forced or {}, 0
    stack: list[dict] = []

    def enter(condition: tuple[str, bool] | None) -> None:
        top = stack[-1]
        top["conditions"].append(condition)
        at = len(top["conditions"]) - 1
        if top["number"] in forced:
            top["live"] = forced[top["number"]] == at
        else:
            top["live"] = not top["taken"] and (condition is None or truth.get(condition[0], not condition[1]) != condition[1])
        top["taken"] |= top["live"]
        if all(x["live"] for x in stack):
            if condition is not None and top["number"] not in forced:
                truth.setdefault(condition[0], not condition[1])
        elif others is not None:
            others.append(_c_choice([(x["number"], x["conditions"]) for x in stack]))

    while i < len(lines):
        line = lines[i]
        stripped = line.lstrip()
        if not comment and stripped.startswith("#"):
            whole = stripped
            while lines[i].endswith("\\") and i + 1 < len(lines):
                i += 1
                whole += "\n" + lines[i]
            m = re.match(r"#\s*(\w*)", stripped)
            word, rest = m[1], whole[m.end() :]
            if word and word not in _DIRECTIVES or not word and stripped[1:].strip() and not stripped[1:].lstrip().startswith(("/*", "//")):
                if all(x["live"] for x in stack):
                    raise Bad(f"no directive: {stripped[:40]}")
            if word in ("if", "ifdef", "ifndef"):
                stack.append({"number": number, "conditions": [], "taken": False})
                number += 1
                enter(_c_condition(word, rest))
            elif word in ("elif", "else", "elifdef", "elifndef"):
                if not stack:
                    raise Bad("else without if")
                enter(None if word == "else" else _c_condition(word, rest))
            elif word == "endif":
                if not stack:
                    raise Bad("endif without if")
                stack.pop()
            if "/*" in stripped and "*/" not in stripped[stripped.rfind("/*") :]:
                out.append("/*" if all(x["live"] for x in stack) else "")
                comment = True
            i += 1
            continue
        if comment or "/*" in line:
            plain = re.sub(r'"(?:[^"\\]|\\.)*"|//.*', "", line) if not comment else line
            opened, closed = plain.rfind("/*"), plain.rfind("*/")
            comment = opened > closed if not comment else closed < 0 or opened > closed
        out.append(line if all(x["live"] for x in stack) else "")  # a comment holds no directive, so it is in one branch
        i += 1
    if stack:
        raise Bad("if without endif")
    return "\n".join(out)


def _c_choice(path: list[tuple[int, list]]) -> tuple[dict, dict] | None:
    """(truth, forced) that lead to the latest branch of each of the nested conditionals; None if a constant excludes it."""
    truth, clash = dict(_NEVER), False
    for _, conditions in path:
        for k, condition in enumerate(conditions):
            if condition is None:
                continue
            want = (k == len(conditions) - 1) != condition[1]
            if truth.setdefault(condition[0], want) != want:
                if condition[0] in _NEVER:
                    return None
                clash = True  # names may be redefined between two conditionals
    return (_NEVER, {n: len(c) - 1 for n, c in path}) if clash else (truth, {})


def c_choices(text: str) -> Iterator[str]:
    """The text with all first branches, then with each other branch; branches of one condition change together."""
    others: list = []
    yield _c_lines(text, others=others)
    seen = []
    for choice in others:
        if choice is not None and choice not in seen:
            seen.append(choice)
            yield _c_lines(text, *choice)


def tokens(language: str, text: str) -> list[tuple[str, str]]:
    """(kind, text): i identifier, n number, s string, c character, l lifetime, o operator; Go gets its semicolons."""
    out: list[tuple[str, str]] = []
    pos, match, n = 0, _TOKENS[language].match, len(text)
    while pos < n:
        m = match(text, pos)
        if not m:
            raise Bad(f"no token at {text[pos : pos + 20]!r}")
        kind, pos = m.lastgroup, m.end()
        if kind == "x":
            raise Bad("conflict marker")
        if kind == "h":
            kind = "s"
        if kind == "cm":
            depth = 1
            while depth:
                c = re.compile(r"/\*|\*/").search(text, pos)
                if not c:
                    raise Bad("comment without end")
                depth += 1 if c[0] == "/*" else -1
                pos = c.end()
        elif kind == "nl":
            if language == "go" and "\n" in m[0] and out and (out[-1][0] in "insc" and (out[-1][0] != "i" or out[-1][1] not in _GO_OPEN) or out[-1][1] in (")", "]", "}", "++", "--")):
                out.append(("o", ";"))
        elif kind != "w":
            out.append((kind, m[0]))
    return out


_GO_OPEN = frozenset("if for switch select case func struct interface map chan go defer var const type import package range goto else".split())
_BINARY = frozenset("+ - * / % & | ^ < > <= >= == != && || << &^ = += -= *= /= %= &= |= ^= <<= >>= &^= := , . -> :: ? : => .. ..= <- ...".split())
_UNARY = frozenset("+ - * & ! ~ ++ -- ^ <- && || .. ..= | ...".split())
_C_TYPES = frozenset("struct union enum const volatile static extern unsigned signed long short int char float double void bool inline register typedef size_t auto class template typename namespace using public private protected virtual friend constexpr explicit operator new delete throw noexcept override final restrict _Bool return goto case sizeof else do if for while switch default break continue".split())


def _group(toks: list[tuple[str, str]], i: int) -> int:
    """Index after the bracket that closes the one at i."""
    want, n = [_OPEN[toks[i][1]]], len(toks)
    i += 1
    while want:
        if i >= n:
            raise Bad("bracket without end")
        if toks[i][0] == "o":
            x = toks[i][1]
            if x in _OPEN:
                want.append(_OPEN[x])
            elif x in _CLOSE and x != want.pop():
                raise Bad(f"unexpected {x}")
        i += 1
    return i


def _split(toks: list, begin: int, end: int, seps: tuple[str, ...]) -> list[tuple[int, int]]:
    out, at, i = [], begin, begin
    while i < end:
        if toks[i][0] == "o":
            if toks[i][1] in _OPEN:
                i = _group(toks, i)
                continue
            if toks[i][1] in seps:
                out.append((at, i))
                at = i + 1
        i += 1
    out.append((at, end))
    return out


def _expression(toks: list, i: int, end: int, block, words: frozenset = frozenset(), lenient: bool = False) -> None:
    """Operands and operators alternate in i..end. ``block`` judges braces; ``words`` are prefix keywords."""
    operand, cast = False, False
    while i < end:
        kind, x = toks[i]
        if kind == "o":
            if x in "([{":
                close = _group(toks, i)
                if x == "{":
                    block(toks, i + 1, close - 1, operand)
                elif x == "(":
                    for a, b in _split(toks, i + 1, close - 1, (",", ";")):
                        _expression(toks, a, b, block, words, True)
                    cast = not operand
                elif close - i > 2:
                    for a, b in _split(toks, i + 1, close - 1, (",", ";")):
                        _expression(toks, a, b, block, words, True)
                    cast = not operand
                else:
                    cast = not operand
                operand, i = True, close
                continue
            if x in _CLOSE or x in (";", "@", "\\", "$", "#"):
                raise Bad(f"unexpected {x}")
            if operand and x == "?":  # of a conditional an operand follows, after Rust's own none does
                operand = not (i + 1 < end and (toks[i + 1][0] in "insc" or toks[i + 1][1] in ("(", "-", "&", "*", "!", "{")))
            elif operand and x in ("++", "--", "!"):
                pass
            elif operand and x in _BINARY:
                operand = cast = False
            elif not operand and (x in _UNARY or x in (">", "<", ":", "::")):
                pass
            elif operand and x == ">":
                operand = False
            else:
                raise Bad(f"operator {x} where an operand was due")
        elif kind == "l":
            pass
        elif kind == "i" and x in words:
            operand = x in ("nil", "true", "false", "self")
        else:
            if operand and not cast and not (kind == "s" and toks[i - 1][0] in "si" or kind == "i" and toks[i - 1][0] == "s") and not lenient:
                raise Bad(f"operand {x} after an operand")
            if operand and lenient and (kind in "nsc" and not cast and toks[i - 1][0] in "nsco" and kind != "s"):
                raise Bad(f"operand {x} after an operand")
            operand, cast = True, False
        i += 1


# ---- C

_C_HEADS = frozenset("if for while switch".split())


def _c_braces(toks, begin, end, operand) -> None:
    if any(t == ("o", ";") for t in toks[begin:end]):
        _c_block(toks, begin, end)  # a lambda or a statement expression
    else:
        for a, b in _split(toks, begin, end, (",",)):
            _expression(toks, a, b, _c_braces, lenient=True)


def _c_simple(toks, begin, end) -> None:
    """A declaration or expression before ';'."""
    if begin == end:
        return
    first = toks[begin][1]
    if first in ("return", "goto", "throw", "delete", "typedef", "using", "namespace", "friend", "template", "operator", "co_return"):
        if first in ("return", "throw", "delete"):
            _expression(toks, begin + 1, end, _c_braces)
        return
    if first in ("break", "continue"):
        if end - begin > 1:
            raise Bad(f"{first} with more")
        return
    i, names = begin, 0
    while i < end and (toks[i][0] == "i" or toks[i][1] in ("*", "&", "::", "&&", "const")):
        if toks[i][1] in ("def", "func", "fn", "let", "import", "package", "elif", "impl", "pub"):
            raise Bad(f"foreign word {toks[i][1]}")
        names += toks[i][0] == "i"
        i += 1
    if i == end:
        return
    if toks[i][0] != "o" or toks[i][1] in (":=", "@", "$", "#", "\\", "=>"):
        raise Bad(f"unexpected {toks[i][1]} after names")
    _expression(toks, max(i - 1, begin), end, _c_braces)


def _c_block(toks, begin, end, top: bool = False) -> None:
    i = begin
    while i < end:
        start = i
        kind, x = toks[i]
        if x == ";" and kind == "o":
            i += 1
            continue
        if kind == "o" and x == "{":
            if top:
                raise Bad("block at the top")
            close = _group(toks, i)
            _c_block(toks, i + 1, close - 1)
            i = close
            continue
        if kind == "i" and not top and x in _C_HEADS:
            if i + 1 >= end or toks[i + 1][1] != "(":
                raise Bad(f"{x} without (")
            close = _group(toks, i + 1)
            if x != "for":
                if close - i == 3:
                    raise Bad(f"{x} without condition")
                _expression(toks, i + 2, close - 1, _c_braces)
            else:
                parts = _split(toks, i + 2, close - 1, (";",))
                if len(parts) == 3:
                    _c_simple(toks, *parts[0])
                    for a, b in parts[1:]:
                        _expression(toks, a, b, _c_braces)
                elif len(parts) != 1 or not any(t[1] == ":" for t in toks[i + 2 : close - 1]):
                    raise Bad("for without its parts")
            i = close
            if i >= end:
                raise Bad(f"{x} without a body")
            continue
        if kind == "i" and not top and x in ("else", "do", "try"):
            i += 1
            if i >= end:
                raise Bad(f"{x} without a body")
            continue
        if kind == "i" and not top and x in ("case", "default"):
            while i < end and not (toks[i][0] == "o" and toks[i][1] in (":", ";", "{", "}")):
                i += 1
            if i >= end or toks[i][1] != ":":
                raise Bad("case without :")
            i += 1
            continue
        if kind == "i" and i + 1 < end and toks[i + 1] == ("o", ":") and (not top or x in ("public", "private", "protected")):
            i += 2
            continue
        # a statement up to ';', or a definition up to its '}'
        brace = None
        while i < end and not (toks[i][0] == "o" and toks[i][1] == ";"):
            if toks[i][0] == "o" and toks[i][1] in _OPEN:
                if toks[i][1] == "{" and brace is None and not any(t == ("o", "=") for t in toks[start:i]):
                    brace = i
                    i = _group(toks, i)
                    head = toks[start:brace]
                    words = [t[1] for t in head if t[0] == "i"]
                    if head and head[-1][1] == ")" or words and words[0] in ("namespace", "extern") or head and head[-1][1] in ("const", "override", "noexcept", "final"):
                        break
                    continue
                i = _group(toks, i)
                continue
            i += 1
        if brace is None:
            if i >= end:
                raise Bad(f"statement without ; at {toks[start][1]}")
            _c_simple(toks, start, i)
            if top and i - start == 1 and toks[start][0] != "i":
                raise Bad("no declaration")
            i += 1
            continue
        head, inside = toks[start:brace], (brace + 1, _group(toks, brace) - 1)
        words = [t[1] for t in head if t[0] == "i"]
        if not words:
            raise Bad("braces without a head")
        if words[0] in ("func", "fn", "def", "pub", "impl", "let", "import", "package", "trait", "mod", "type"):
            raise Bad(f"foreign word {words[0]}")
        if head[-1][1] == ")" or head[-1][1] in ("const", "override", "noexcept", "final"):
            at = start
            while toks[at][1] != "(":
                if toks[at][0] != "i" and toks[at][1] not in ("*", "&", "::", "<", ">", ",", "~", "&&", "[", "]"):
                    raise Bad(f"unexpected {toks[at][1]} in a head")
                at += 1
            if at == start or len(words) < 2 and top:
                raise Bad("function without a type")
            _c_block(toks, *inside)
        elif words[0] in ("namespace", "extern"):
            _c_block(toks, *inside, top=True)
        elif any(w in ("struct", "union", "class") for w in words):
            _c_block(toks, *inside)
            if i >= end:
                raise Bad("no ; after a type")
            i += 1
        elif "enum" in words:
            for a, b in _split(toks, *inside, (",",)):
                _expression(toks, a, b, _c_braces)
            if i >= end:
                raise Bad("no ; after a type")
            i += 1
        else:
            raise Bad(f"braces after {words[-1]}")


# ---- Go

_GO_WORDS = frozenset("range func map chan struct interface go defer return case var".split())


def _go_braces(toks, begin, end, operand) -> None:
    if any(t == ("o", ";") for t in toks[begin:end]) and not toks[begin - 2][1] in ("]",):
        inner = [t for t in toks[begin:end] if t != ("o", ";")]
        if any(t[1] in (":=", "return", "=", "if", "for") for t in inner):
            return _go_block(toks, begin, end)
    for a, b in _split(toks, begin, end, (",", ";")):
        _expression(toks, a, b, _go_braces, _GO_WORDS, True)


def _go_block(toks, begin, end) -> None:
    for a, b in _split(toks, begin, end, (";",)):
        _go_statement(toks, a, b)


def _go_brace(toks, a, b) -> int:
    """The last brace of a head that opens the body."""
    i = a
    while i < b:
        if toks[i][0] == "o" and toks[i][1] in _OPEN:
            close = _group(toks, i)
            if toks[i][1] == "{" and (close == b or toks[close] == ("i", "else")):
                return i
            i = close
            continue
        i += 1
    raise Bad(f"{toks[a][1]} without a body")


def _go_statement(toks, a, b) -> None:
    if a == b:
        return
    kind, x = toks[a]
    if kind == "o" and x == "{":
        return _go_block(toks, a + 1, _group(toks, a) - 1)
    if x in ("if", "for", "switch", "select"):
        rest = a + 1
        # for/if heads may hold ';' of their own, which end statements at this level: they are joined by _go_joined
        brace = _go_brace(toks, a, b)
        for p, q in _split(toks, rest, brace, (";",)):
            if p < q:
                _expression(toks, p, q, _go_braces, _GO_WORDS)
        if x == "if" and brace == rest:
            raise Bad("if without a condition")
        close = _group(toks, brace)
        (_go_cases if x in ("switch", "select") else _go_block)(toks, brace + 1, close - 1)
        if close < b:
            if toks[close] != ("i", "else") or close + 1 >= b or x != "if":
                raise Bad("more after a body")
            nxt = toks[close + 1]
            if nxt[1] not in ("if", "{"):
                raise Bad("else without a body")
            _go_statement(toks, close + 1, b)
        return
    if x in ("var", "const", "type", "import", "func"):
        return _go_declaration(toks, a, b)
    if x in ("break", "continue", "goto", "fallthrough"):
        if b - a > 2:
            raise Bad(f"{x} with more")
        return
    if x in ("package", "def", "class", "pub", "fn", "let", "elif", "else", "struct"):
        raise Bad(f"unexpected {x}")
    if x in ("return", "defer", "go"):
        return _expression(toks, a + 1, b, _go_braces, _GO_WORDS)
    if kind == "i" and a + 1 < b and toks[a + 1] == ("o", ":"):
        return _go_statement(toks, a + 2, b)
    _expression(toks, a, b, _go_braces, _GO_WORDS)


def _go_cases(toks, begin, end) -> None:
    for a, b in _split(toks, begin, end, (";",)):
        if a < b and toks[a][1] in ("case", "default"):
            colon = next((i for i in range(a, b) if toks[i] == ("o", ":")), None)
            if colon is None:
                raise Bad("case without :")
            a = colon + 1
        _go_statement(toks, a, b)


def _go_declaration(toks, a, b) -> None:
    x = toks[a][1]
    if x == "func":
        i = a + 1
        if i < b and toks[i][1] == "(":
            i = _group(toks, i)
        if i >= b or toks[i][0] != "i":
            raise Bad("func without a name")
        i += 1
        if i < b and toks[i][1] == "[":
            i = _group(toks, i)
        if i >= b or toks[i][1] != "(":
            raise Bad("func without parameters")
        i = _group(toks, i)
        if toks[b - 1][1] == "}":
            brace = _go_brace(toks, i, b)
            _go_block(toks, brace + 1, b - 1)
        return
    if x == "import":
        rest = toks[a + 1 : b]
        if not rest or rest[0][1] == "(" and any(t[0] not in "si" and t[1] not in (";", ".") for t in rest[1:-1]) or rest[0][1] != "(" and rest[-1][0] != "s":
            raise Bad("import of no string")
        return
    if x == "type":
        if b - a < 3 and toks[a + 1 : a + 2] != [("o", "(")]:
            raise Bad("type without a definition")
        for i in range(a, b):
            if toks[i][1] == "struct" and i + 1 < b and toks[i + 1][1] == "{":
                for p, q in _split(toks, i + 2, _group(toks, i + 1) - 1, (";",)):
                    if p < q and toks[p][0] != "i" and toks[p][1] != "*":
                        raise Bad("no field")
        return
    if b - a < 2:
        raise Bad(f"{x} of nothing")
    i = a + 1
    if toks[i][1] == "(":
        return
    while i < b and toks[i] != ("o", "="):
        i += 1
    if i < b:
        _expression(toks, i + 1, b, _go_braces, _GO_WORDS)


def _go_joined(toks: list) -> list:
    """';' inside the head of a for, if or switch as ',' so that statements split at the others only."""
    out, i, n = list(toks), 0, len(toks)
    while i < n:
        if toks[i][0] == "i" and toks[i][1] in ("for", "if", "switch"):
            j = i + 1
            while j < n and not (toks[j][0] == "o" and toks[j][1] in ("{", "}")):
                if toks[j] == ("o", ";"):
                    out[j] = ("o", ",")
                elif toks[j][0] == "o" and toks[j][1] in ("(", "["):
                    j = _group(toks, j)
                    continue
                j += 1
            i = j
            continue
        i += 1
    return out


def _go_file(toks) -> None:
    toks = _go_joined(toks)
    parts = [(a, b) for a, b in _split(toks, 0, len(toks), (";",)) if a < b]
    if not parts:
        return
    a, b = parts[0]
    if toks[a][1] != "package" or b - a != 2 or toks[a + 1][0] != "i":
        raise Bad("no package clause")
    for a, b in parts[1:]:
        if toks[a][1] not in ("import", "const", "var", "type", "func"):
            raise Bad(f"{toks[a][1]} at the top")
        _go_declaration(toks, a, b)


# ---- Rust

_RUST_ITEMS = frozenset("use mod pub fn struct impl enum trait const static type macro_rules extern unsafe async union".split())
_RUST_WORDS = frozenset("let mut ref move dyn return break in as if else match while loop for unsafe async await box where impl fn continue const static pub crate".split())


def _rust_braces(toks, begin, end, operand) -> None:
    """A struct literal, match arms or a block."""
    arms = any(t == ("o", "=>") for t in _level(toks, begin, end))
    if arms:
        i = begin
        while i < end:
            arrow = i
            while arrow < end and toks[arrow] != ("o", "=>"):
                arrow = _group(toks, arrow) if toks[arrow][0] == "o" and toks[arrow][1] in _OPEN else arrow + 1
            if arrow >= end or arrow == i:
                raise Bad("arm without =>")
            _expression(toks, i, arrow, _rust_braces, _RUST_WORDS)
            i = arrow + 1
            if i < end and toks[i] == ("o", "{"):
                close = _group(toks, i)
                _rust_block(toks, i + 1, close - 1)
                i = close
                if i < end and toks[i] == ("o", ","):
                    i += 1
                continue
            stop = i
            while stop < end and toks[stop] != ("o", ","):
                stop = _group(toks, stop) if toks[stop][0] == "o" and toks[stop][1] in _OPEN else stop + 1
            if stop == i:
                raise Bad("arm without a value")
            _expression(toks, i, stop, _rust_braces, _RUST_WORDS)
            i = stop + 1
        return
    _rust_block(toks, begin, end)


def _level(toks, begin, end):
    i = begin
    while i < end:
        yield toks[i]
        i = _group(toks, i) if toks[i][0] == "o" and toks[i][1] in _OPEN else i + 1


_RUST_BLOCKY = frozenset("if for while loop match unsafe else".split())


def _rust_block(toks, begin, end) -> None:
    i = begin
    while i < end:
        if toks[i] == ("o", ";"):
            i += 1
            continue
        if toks[i][0] == "o" and toks[i][1] == "#":
            i = _rust_attribute(toks, i, end)
            continue
        if toks[i][0] == "i" and toks[i][1] in _RUST_ITEMS and toks[i][1] not in ("unsafe", "async", "union", "type"):
            i = _rust_item(toks, i, end)
            continue
        start, blocky = i, toks[i][1] in _RUST_BLOCKY or toks[i] == ("o", "{") or toks[i][0] == "l"
        while i < end and toks[i] != ("o", ";"):
            if toks[i][0] == "o" and toks[i][1] in _OPEN:
                brace = toks[i][1] == "{"
                i = _group(toks, i)
                if brace and blocky and not (i < end and (toks[i] == ("i", "else") or toks[i][1] in (".", "?"))):
                    break
                continue
            i += 1
        if toks[start][1] in ("func", "def", "import", "package", "class", "return") and toks[start][1] != "return":
            raise Bad(f"foreign word {toks[start][1]}")
        if toks[start] == ("i", "let") and not (i < end and toks[i] == ("o", ";")):
            raise Bad("let without ;")
        _rust_expression(toks, start, i)


def _rust_expression(toks, a, b) -> None:
    flat, i = [], a
    while i < b:  # a macro call is an operand, whatever tokens it gets
        if toks[i][0] == "i" and i + 2 < b and toks[i + 1] == ("o", "!") and toks[i + 2][1] in _OPEN:
            i = _group(toks, i + 2)
            flat.append(("n", "0"))
            continue
        flat.append(toks[i])
        i += 1
    _expression(flat, 0, len(flat), _rust_braces, _RUST_WORDS, toks[a][1] == "let")


def _rust_attribute(toks, i, end) -> int:
    i += 1
    if i < end and toks[i] == ("o", "!"):
        i += 1
    if i >= end or toks[i][1] != "[":
        raise Bad("# without an attribute")
    return _group(toks, i)


def _rust_item(toks, i, end) -> int:
    while i < end and toks[i][0] == "i" and toks[i][1] in ("pub", "async", "unsafe", "extern", "const", "default") and not (toks[i][1] == "const" and i + 1 < end and toks[i + 1][1] != "fn"):
        i += 1
        if i < end and toks[i] == ("o", "(") and toks[i - 1][1] == "pub":
            i = _group(toks, i)
        if i < end and toks[i][0] == "s":
            i += 1
    if i >= end or toks[i][1] not in _RUST_ITEMS:
        if i < end and toks[i] == ("o", "{"):
            return _group(toks, i)
        raise Bad("no item")
    word = toks[i][1]
    start = i
    while i < end and toks[i] != ("o", ";") and toks[i] != ("o", "{"):
        i = _group(toks, i) if toks[i][0] == "o" and toks[i][1] in _OPEN else i + 1
    if i >= end:
        raise Bad(f"{word} without an end")
    head = toks[start + 1 : i]
    if word in ("fn", "struct", "enum", "trait", "mod", "type", "const", "static") and (not head or head[0][0] != "i"):
        raise Bad(f"{word} without a name")
    if word == "fn" and not any(t == ("o", "(") for t in head):
        raise Bad("fn without parameters")
    if toks[i] == ("o", ";"):
        if word in ("const", "static"):
            at = next((k for k in range(start, i) if toks[k] == ("o", "=")), None)
            if at is not None:
                _rust_expression(toks, at + 1, i)
        return i + 1
    if word == "use" or word in ("const", "static"):
        while i < end and toks[i] != ("o", ";"):
            i = _group(toks, i) if toks[i][0] == "o" and toks[i][1] in _OPEN else i + 1
        if i >= end:
            raise Bad(f"{word} without ;")
        return i + 1
    close = _group(toks, i)
    if word == "fn":
        _rust_block(toks, i + 1, close - 1)
    elif word in ("impl", "trait", "mod", "extern"):
        _rust_items(toks, i + 1, close - 1)
    elif word in ("struct", "enum", "union"):
        for a, b in _split(toks, i + 1, close - 1, (",",)):
            while a < b and toks[a] == ("o", "#"):
                a = _rust_attribute(toks, a, b)
            if a < b and toks[a][0] != "i" or word == "struct" and a < b and not any(toks[k] == ("o", ":") for k in range(a, b)):
                raise Bad("no field")
    return close


def _rust_items(toks, i, end) -> None:
    while i < end:
        if toks[i] == ("o", "#"):
            i = _rust_attribute(toks, i, end)
        elif toks[i] == ("o", ";"):
            i += 1
        elif toks[i][0] == "i" and i + 2 < end and toks[i + 1] == ("o", "!"):
            i += 2
            if toks[i][0] == "i":
                i += 1
            if i >= end or toks[i][1] not in _OPEN:
                raise Bad("macro without arguments")
            i = _group(toks, i)
        elif toks[i][0] == "i" and toks[i][1] in _RUST_ITEMS:
            i = _rust_item(toks, i, end)
        else:
            raise Bad(f"{toks[i][1]} at the top")


def _balanced(toks) -> None:
    i = 0
    while i < len(toks):
        if toks[i][0] == "o" and toks[i][1] in _OPEN:
            i = _group(toks, i)
        elif toks[i][0] == "o" and toks[i][1] in _CLOSE:
            raise Bad(f"unexpected {toks[i][1]}")
        else:
            i += 1


def statement_error(language: str, text: str) -> str | None:
    """Why a file does not parse, or None."""
    try:
        if language == "rust" and text.startswith("#!") and not text.startswith("#!["):
            text = text.partition("\n")[2]
        for chosen in c_choices(text) if language == "c" else (text,):
            toks = tokens(language, chosen)
            _balanced(toks)
            if language == "c":
                _c_block(toks, 0, len(toks), top=True)
            elif language == "go":
                _go_file(toks)
            else:
                _rust_items(toks, 0, len(toks))
    except Bad as e:
        return str(e)
    except RecursionError:
        return "nested too deep"
    return None
