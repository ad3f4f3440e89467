import ast
import random

import pytest

from chunkquarry.llm import syntax
from chunkquarry.llm.grammars import statement_error

GOOD = {
    "c": [
        '#include <a.h>\n#define X(a) \\\n  (a + 1)\n#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n    return a; /* don\'t } */\n}\n',
        "typedef struct node { int a[3]; struct node *next; } node_t;\nstatic const char *s = \"a\" \"b\\\"}\";\nenum e { A = 1, B };\n",
        "int main(void) { for (;;) { if (a[b] == '{') c++; else if (x) y = (int) z; switch (k) { case 1: { break; } default: g(); } do { i--; } while (i > 0); } return 0; }",
        "/*\n=======\n>>>>>>> x\n=======\n*/\nextern int f(int);\n", "template <typename T> class A : public B { public: A(); void f() const { x = y ? 1 : 2; } };\n",
    ],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tx "b/c"\n)\n\ntype T struct {\n\ta int\n\tb map[string][]int\n}\n\nconst N = 4\n\nfunc (t *T) f(a int, b []string) (int, error) {\n\tif err := g(a); err != nil {\n\t\treturn 0, fmt.Errorf("x {%d: %w", 1, err)\n\t} else if a > 2 {\n\t\ta++\n\t}\n\tfor i, v := range b {\n\t\tdefer v.Close()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tswitch a {\n\tcase 1:\n\t\tg(2)\n\tdefault:\n\t}\n\ts := `raw } "`\n\tz := []int{1, 2,\n\t\t3}\n\tr := \'{\'\n\tgo func() { h() }()\n\tt.a = \'}\' + 10\n\treturn a, nil\n}\n',
        "// only\npackage main\n\n/* a\nb */\nvar x = T{a: 1}\n",
    ],
    "rust": [
        'use a::b;\n\n#[derive(Debug)]\npub struct A<\'a> {\n    x: u32,\n    pub y: &\'a str,\n}\n\nimpl A {\n    /// doc\'s\n    pub fn f<\'a>(&self, x: &str, y: u32) -> usize {\n        let a = f(&y, 3);\n        println!("x {} y {", a);\n        for i in y.iter() {\n            if a == 3 {\n                let q = g(&i, 2);\n            }\n        }\n        match b {\n            Some(c) => d(1),\n            None => e(),\n        };\n        let s: &\'static str = r#"x } "y" 1"#;\n        let t = s.find(\'{\').unwrap_or(3);\n        374\n    }\n}\n\n/* a /* b */ c */\npub const A: u32 = 4;\nenum E { A, B(u32) }\n',
        "fn main() -> u32 { let v = [1, 2, 3]; let x = if v.len() > 2 { 1 } else { 2 }; return x; }\n",
    ],
}
FOREIGN = {"c": ["import a\n\ndef f(x):\n    return x\n", GOOD["go"][0], GOOD["rust"][0], "#!/bin/sh\nset -eu\n", "<html>\n<p>a</p>\n</html>\n", "# Title\n\nWords here.\n", "a:\n  - b: c\n", '{"a": 1}\n', "Just words, nothing more\n"]}
FOREIGN["go"] = FOREIGN["c"][:1] + [GOOD["c"][0], GOOD["rust"][0]] + FOREIGN["c"][3:]
FOREIGN["rust"] = FOREIGN["c"][:2] + [GOOD["c"][0]] + FOREIGN["c"][3:]


def fails(language, text):
    state, summary, several = "N", "", False
    for block in syntax._blocks(text):
        state, x, a = syntax.lex(language, block, state)
        several |= a
        summary = None if summary is None or x is None else syntax.cancel(summary, x)
    return syntax.file_fails(language, text, state == "N" and (summary == "" or several))


@pytest.mark.parametrize("language", ["c", "go", "rust"])
def test_grammars(language):
    for text in GOOD[language]:
        assert statement_error(language, text) is None, text
        assert not fails(language, text) and not fails(language, text.replace("\n", "\r\n"))
        lines = text.split("\n")
        open_lines = [i for i, x in enumerate(lines) if x.endswith("{")]
        if open_lines:
            assert fails(language, "\n".join(lines[: open_lines[-1] + 1]))
            at = open_lines[0] + 1
            assert fails(language, "\n".join(lines[:at] + ["<<<<<<< HEAD", "=======", ">>>>>>> x"] + lines[at:]))
    for text in FOREIGN[language]:
        assert fails(language, text), text


def test_every_branch_of_c_is_judged():
    good = [
        "#if 0\nold (junk\n#else\nint f(void) { return 1; }\n#endif\n",
        "#ifdef A\nint f(void) { {\n#else\nint f(long a) {\n#endif\n  g();\n#ifndef A\n}\n#else\n} }\n#endif\n",
        "#if A\nint a;\n#elif defined(B) && \\\n  C\nint b; /* one\n two */ int c;\n#else /* three\n four */\nint d;\n#endif\n",
        "#ifdef A\nint a;\n#else\n#ifdef B\nint b;\n#else\nint c;\n#endif\n#endif\n",
    ]
    for text in good:
        assert not fails("c", text), text
    broken = [
        "#if 0\nint f(void) { return 1; }\n#else\nint f(void) { return 1;\n#endif\n",
        "#ifdef A\nint a;\n#elif B\nint f(void) { if }\n#else\nint c;\n#endif\n",
        "int x;\n#ifdef A\nint a;\n#else\n<<<<<<< HEAD\nint b;\n=======\nint c;\n>>>>>>> x\n#endif\n",
        "#ifdef A\nint a;\n#else\n#ifdef B\nint b\n#else\nint c;\n#endif\n#endif\n", "#ifdef A\nint a;\n#else\n#ifdef B\nint b;\n#else\nint c = (;\n#endif\n#endif\n",
        "#ifdef A\n#undef A\n#ifdef A\nint a;\n#else\nint b = (;\n#endif\n#endif\n",
    ]
    for text in broken:
        assert fails("c", text), text


def test_python_statements_against_the_interpreter():
    base = open(syntax.__file__).read()
    assert not fails("python", base)
    whole = ast.parse(base)
    assert sum(len(ast.parse(x).body) for x in syntax.python_statements(base)) == len(whole.body)
    rng = random.Random(2)
    for _ in range(150):
        i = rng.randrange(len(base))
        text = base[:i] + rng.choice(["(", ")", "'", '"""', "\n", ":", " ", "<<<<<<< x\n"]) + base[i + rng.randrange(3) :]
        assert fails("python", text) == (not syntax._parses(text))


def test_maps_compose(monkeypatch):
    rng = random.Random(4)
    pieces = {"c": ["/*", "*/", '"a{"', "'{'", "{", "}", "(", ")", "// x {\n", "\n"], "go": ["/*", "*/", "`", "{", "}", "\n", '"{"', "// `\n"], "rust": ["/*", "*/", 'r#"', '"#', "{", "}", "\n", '"', "'a", "'{'"], "python": ["'''", '"""', "# '''\n", "(", ")", "\n", "'('", "\n"]}
    for language, parts in pieces.items():
        for _ in range(200):
            text = "".join(rng.choice(parts) + rng.choice(["", " x ", "\n"]) for _ in range(12)) + "\n"
            whole = syntax.lex(language, text, "N")
            monkeypatch.setattr(syntax, "BLOCK", 7)
            state, summary = "N", ""
            blocks = list(syntax._blocks(text))
            assert "".join(blocks) == text
            for block in blocks:
                state, x, _ = syntax.lex(language, block, state)
                summary = None if summary is None or x is None else syntax.cancel(summary, x)
            if whole[1] is not None and summary is not None:
                assert (state, summary) == whole[:2] or syntax.cancel("", summary) == syntax.cancel("", whole[1])


def test_files(spark):
    rows = [("r/a.PY", "x = (1\n"), ("r/b.py", ""), ("r/c.py", None), ("r/d.txt", "((("), (None, "((("), ("r/e.go", "package a\n"), ("r/e.go", "package a\n"), ("r/f.c", "int f( {"), ("r/g.rs", "fn f() {}\n" * 8000 + "}")]
    df = spark.createDataFrame([(*r, "q", True) for r in rows], "path string, content string, language string, closed boolean")
    assert {r.path for r in syntax.invalid_files(df).collect()} == {"r/a.PY", "r/f.c", "r/g.rs"}
    rates = {(r.repo, r.language): (r.files, r.invalid) for r in syntax.error_rates(df).collect()}
    assert rates == {("r", "python"): (3, 1), ("r", "c"): (1, 1), ("r", "go"): (1, 0), ("r", "rust"): (1, 1)}
    assert syntax.invalid_files(df.limit(0)).collect() == []


def test_blocks_cut_inside_deep_states(spark):
    inside = "    { not code \" ' \n" * 3000  # more than one block
    cases = {"hashes": ('const A: &str = r####"', '"### "####;'), "deep": ("/* /* /* /* /* ", "*/ { */ */ ( */ } */"), "raw": ('const A: &str = r"', '";')}
    rows = [(f"r/{k}{i}.rs", a + "\n" + (inside.replace('"', "") + "\\\n" if k == "raw" else inside) + b + tail) for k, (a, b) in cases.items() for i, tail in enumerate(("\nfn f() {}\n", "\nfn f() {\n", "\nfn f() {}\n/*"))]
    assert all(len(list(syntax._blocks(text))) > 1 for _, text in rows)
    rows.append(("r/open.rs", rows[0][1].replace('"####', '"###')))
    df = spark.createDataFrame(rows, "path string, content string")
    assert {r.path for r in syntax.invalid_files(df).collect()} == {f"r/{k}{i}.rs" for k in cases for i in (1, 2)} | {"r/open.rs"}


def test_runs_of_maps_compose_in_any_grouping(monkeypatch):
    rng = random.Random(6)
    parts = ["/*", "*/", 'r#"', '"#', "{", "}", "(", ")", "\n", '"', "'a", "\n"]
    monkeypatch.setattr(syntax, "BLOCK", 9)
    for _ in range(100):
        text = "".join(rng.choice(parts) + rng.choice(["", " x ", "\n"]) for _ in range(20)) + "\n"
        maps = syntax.block_maps("rust", text)
        n = max(m[0] for m in maps) + 1
        whole = [m for m in syntax.compose(maps) if m[0] == "N"]
        at = sorted({0, n, *(rng.randrange(n + 1) for _ in range(3))})
        runs = [(k, *m) for k, (a, b) in enumerate(zip(at, at[1:])) for m in syntax.compose([x for x in maps if a <= x[0] < b])]
        assert [m for m in syntax.compose(runs) if m[0] == "N"] == whole and len(whole) == 1


def test_large_files(spark):
    """Several hundred blocks, so that more than one level of the tree composes; an open bracket in a later branch of C."""
    line = "static int f%d(int x) { return x + (1); } /* { */\n"
    body = "".join(line % i for i in range(70_000))
    assert len(list(syntax._blocks(body))) > syntax.FAN
    rows = [("r/good.c", body), ("r/open.c", body + "int g(void) {\n"), ("r/close.c", "}\n" + body), ("r/branch.c", "#ifdef A\nint a;\n#else\nint b(void) {\n#endif\n" + body[: 3 * syntax.BLOCK].rsplit("\n", 1)[0] + "\n")]
    df = spark.createDataFrame(rows, "path string, content string")
    assert {r.path for r in syntax.invalid_files(df).collect()} == {"r/open.c", "r/close.c", "r/branch.c"}
