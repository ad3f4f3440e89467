"""Word lists and patterns whose values are fixed: results depend on exactly these."""

# English function words that text compression drops.
STOP_WORDS = (
    "a an the and or but if in on at to for of with by from as is it its be was are were been has have had do does did "
    "will would could should may might shall can that this these those then than so up out no not nor yet both either "
    "neither each few more most other some such what which who also just into only over very here there when where how "
    "all any since while"
).split()

# The lexical units that a token count counts, first match first.
TOKEN_PATTERN = (
    '""".*?"""|' + "'''.*?'''|" + r'"[^"\n]*"|' + r"'[^'\n]*'|" + r"[A-Za-z_][\p{L}\p{N}_]*|" + r"[0-9]+(?:\.[0-9]+)?|"
    r"[+\-*/=<>!&|^~%@]+|" + r"[(){}\[\],.:;]|" + r"\S"
)

# Lines that make Python code hard to predict, and lines that are boilerplate.
PY_COMPLEX = r"^\s*for\b.*\bin\b|^\s*while\b|^\s*try\s*:|^\s*except\b|\byield\b|\basync\s+for\b|\basync\s+with\b"
PY_SIMPLE = (
    r"^\s*return\b|^\s*self\.\w+\s*=|^\s*raise\b|^\s*pass\s*$|^\s*\.\.\.\s*$|^\s*super\(|^\s*logger\.|"
    r"""^\s*\w[\w\[\]"']*\s*\[[\w"'\.]+\]\s*=|^\s*[a-z_]\w*\s*=\s*\w"""
)
# The same for C.
C_COMPLEX = r"\b(?:for|while|do|switch|goto|setjmp|longjmp|__asm|asm|volatile)\b"
C_SIMPLE = (
    r"^\s*(?:return\s|[a-zA-Z_]\w*\s*=\s*|[a-zA-Z_]\w*\s*\+=|[a-zA-Z_]\w*\s*-=|[a-zA-Z_]\w*\s*\+\+|\+\+[a-zA-Z_]\w*|"
    r"[a-zA-Z_]\w*\([^)]*\)\s*;|if\s*\([^)]+\)\s*return)"
)

# Called names that are no callees of interest.
CALL_BUILTINS = "if for while switch return sizeof printf fprintf malloc free memcpy memset strcmp strlen sprintf fopen fclose assert exit abort".split()

# Identifiers that say nothing about a body, of Python and of C.
PY_COMMON = (
    "self cls return raise pass yield break continue and or not in is if else elif for while try except finally with as import from class "
    "def lambda del global nonlocal assert async await None True False len str int float bool list dict set tuple type range print open super "
    "isinstance hasattr getattr setattr enumerate zip map filter sorted reversed any all min max logger log logging os sys re json path "
    "append extend update get items keys values strip split join format upper lower replace true false none"
).split()
C_COMMON = (
    "if else for while do switch case break continue return goto typedef struct union enum void int char float double long short unsigned signed "
    "static extern const volatile register auto inline sizeof NULL true false ptr buf len idx num val tmp ret err printf malloc free memset memcpy "
    "strcmp strcpy"
).split()

# Phrases of answers that this project's gate takes for refusals.
REJECTED = ("i cannot", "i'm unable", "i don't have access", "as an ai")

# Patterns mined from C files by type.
MINED = {
    "include": r'(?m)^[^\S\n]*#[^\S\n]*include[^\S\n]*[<"][^>"\n]+[>"]',
    "define": r"(?m)^[^\S\n]*#[^\S\n]*define[^\S\n]+\w+(?:\([^)\n]*\))?[^\S\n]+\S[^\n]*",
    "pragma": r"(?m)^[^\S\n]*#[^\S\n]*pragma[^\S\n]+\S[^\n]*",
    "comment_block": r"(?s)/\*.*?\*/",
    "identifier": r"\b(?:[A-Z][A-Z0-9_]{4,}|[a-z_]\w*_[a-z]\w{4,})\b",
}

# Lines of Python modules that masking treats as boilerplate besides imports.
BOILERPLATE_LINE = r"""^(?:logger|log|_logger)\s*=\s*logging\.getLogger\(|^__all__\s*=\s*\[|^__version__\s*=\s*["']|^__author__\s*=\s*["']"""

# Long words of comments and the short ones that stand for them.
SYNONYMS = {
    "initialize": "init", "initialization": "init", "configuration": "cfg", "authenticate": "auth", "authentication": "auth",
    "authorization": "authz", "implementation": "impl", "concatenate": "cat", "concatenation": "cat", "parameter": "param",
    "parameters": "params", "exception": "exc", "iteration": "iter", "validation": "valid", "repository": "repo",
    "functionality": "fn", "documentation": "doc", "application": "app", "environment": "env", "dependency": "dep",
    "dependencies": "deps", "executable": "exe", "definition": "def", "dictionary": "dict", "argument": "arg",
    "arguments": "args", "attribute": "attr", "attributes": "attrs", "connection": "conn", "transaction": "txn",
    "serialization": "ser", "deserialization": "deser", "asynchronous": "async", "synchronous": "sync", "metadata": "meta",
    "notification": "notif", "implement": "impl", "calculate": "calc", "retrieve": "get", "instantiate": "new",
    "generate": "gen", "validate": "valid", "serialize": "ser", "deserialize": "deser", "function": "fn", "method": "fn",
    "variable": "var", "constant": "const", "interface": "iface", "namespace": "ns", "module": "mod", "package": "pkg",
}

# Weights of the fields of a function record in ranking, and the other ranking constants.
FIELD_WEIGHTS = {"name": 5.0, "summary": 3.0, "signature": 2.0, "callees": 2.0, "body": 1.0}
SYMBOL_BOOST = 4.0
LARGE_FUNCTION_LINES = 100
RRF_CONSTANT = 60

# A function's head.
SIGNATURE = r"(?m)^(?:\w+\s+)*\*?\w+\s*\([^)]*\)"

# The bounds of verdicts on a composite score, and of those on tokens saved (percent) with consistency.
VERDICTS = (("EXCELLENT", 0.95), ("ACCEPTABLE", 0.85), ("DEGRADED", 0.70))
SAVED_HIGH, SAVED_GOOD, CONSISTENT, VERY_CONSISTENT = 80, 70, 0.85, 0.90

# What runs are compared with.
BASELINE = {"ter": 0.793, "ccc": 0.650, "tv": 0.516, "tv_time": 0.258}

# Tags of messages by category.
TAXONOMY = {"action": ("compress", "route", "zip_history"), "judgement": ("classify",), "trouble": ("error", "escalate"), "zone": ("foreground", "background")}
