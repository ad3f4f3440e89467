"""Column functions on text. All stay in the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

IDENTIFIER = r"[a-zA-Z_][\p{L}\p{N}_]*"


def matches(text: Column, pattern: str) -> Column:
    """All whole matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Estimated tokens: lexical units, long purely alphanumeric ones as two. Null counts as empty."""
    units = matches(text, "(?s)" + lexicon.TOKEN_PATTERN)
    long = F.filter(units, lambda u: (F.length(u) > 8) & u.rlike(r"^[\p{L}\p{N}]+$"))
    return F.coalesce((F.size(units) + F.size(long)).cast("long"), F.lit(0).cast("long"))


def count_words(text: Column) -> Column:
    """Runs of non-blank characters. Null counts as empty."""
    return F.coalesce(F.size(matches(text, r"\S+")).cast("long"), F.lit(0).cast("long"))


def identifiers(text: Column) -> Column:
    """Lower-cased identifiers, in order, repeated ones included."""
    return matches(F.lower(text), IDENTIFIER)


def terms(text: Column) -> Column:
    """Lower-cased identifiers and whole numbers."""
    return matches(F.lower(text), IDENTIFIER + "|[0-9]+")


def lines(text: Column) -> Column:
    """Lines without their ends; Windows ends count as one."""
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def code_lines(text: Column) -> Column:
    """The lines that hold anything."""
    return F.filter(lines(text), lambda x: x.rlike(r"\S"))


def _ladder(n: Column, beyond: Column) -> Column:
    return F.when(n <= 2, 0.95).when(n <= 5, 0.90).when(n <= 10, 0.85).when(n <= 20, 0.80).when(n <= 35, 0.70).otherwise(beyond)


def line_features(text: Column, complex_lines: str, simple_lines: str) -> Column:
    """n lines with text, k complex and s simple ones: all that predictability depends on, whatever its parameters."""
    held = code_lines(text)
    count = lambda p: F.size(F.filter(held, lambda x: x.rlike(p)))
    return F.struct(F.size(held).alias("n"), count(complex_lines).alias("k"), count(simple_lines).alias("s"))


def predictability(f: Column, beyond: Column, cap: float, penalty: float = 0.06, simple_share: float = 0.5, boilerplate: float = 0.15, loop_free: float = 0.10) -> Column:
    """How predictable code is, 0 to 1, from its line features."""
    n, k, s = f["n"], f["k"], f["s"]
    plain = k == 0
    bonus = F.when(plain & (n > 0) & (s >= simple_share * n), boilerplate).otherwise(0.0) + F.when(plain & (n > 20), loop_free).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _ladder(n, beyond) - F.least(F.lit(cap), penalty * k) + bonus))


def python_predictability(text: Column) -> Column:
    """Of Python code; blank text is wholly predictable."""
    f = line_features(strip(text), lexicon.PY_COMPLEX, lexicon.PY_SIMPLE)
    return F.when(text.isNull(), None).when(f["n"] == 0, 1.0).otherwise(predictability(f, F.greatest(F.lit(0.0), 0.70 - (f["n"] - 35) * 0.02), 0.35))


def c_predictability(text: Column) -> Column:
    """Of C code."""
    f = line_features(text, lexicon.C_COMPLEX, lexicon.C_SIMPLE)
    return F.when(text.isNotNull(), predictability(f, F.lit(0.60), 0.30))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def branches(source: Column) -> Column:
    low = F.lower(source)
    return sum((occurrences(low, x) for x in ("\tif(", "\nif(", " for(", " while(", " switch(")), occurrences(low, " if "))


def complexity(source: Column, line_count: Column) -> Column:
    """simple, moderate or complex by branches and length."""
    b = branches(source)
    return F.when((b >= 8) | (line_count > 150), "complex").when((b >= 3) | (line_count > 40), "moderate").otherwise("simple")


def prune_vowels(word: Column, least: int = 5) -> Column:
    """A word without the vowels that follow a consonant inside it; short words and those that begin otherwise stay."""
    inner = F.substring(word, 2, F.length(word) - 2)
    pruned = F.regexp_replace(inner, "([bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])[aeiouAEIOU]+", "$1")
    keep = (F.length(word) < least) | ~F.substring(word, 1, 1).rlike(r"\p{L}")
    return F.when(keep, word).otherwise(F.concat(F.substring(word, 1, 1), pruned, F.right(word, F.lit(1))))


def compress_text(text: Column) -> Column:
    """Words without stop words, vowels pruned, one blank between."""
    words = matches(text, r"\S+")
    bare = lambda w: F.lower(F.regexp_replace(w, "^[^a-zA-Z]+|[^a-zA-Z]+$", ""))
    kept = F.filter(words, lambda w: ~bare(w).isin(*lexicon.STOP_WORDS))
    return F.array_join(F.transform(kept, lambda w: prune_vowels(w)), " ")


def compress_comment(line: Column) -> Column:
    """A '#' comment line with its text compressed; indent and marker stay."""
    part = lambda i: F.regexp_extract(line, r"^(\s*)(#+\s*)(.*)$", i)
    return F.concat(part(1), part(2), compress_text(part(3)))


def swap_synonyms(line: Column) -> Column:
    """Long words of a line by their short forms, the longest first."""
    for long, short in sorted(lexicon.SYNONYMS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        line = F.regexp_replace(line, rf"(?i)\b{long}\b", short)
    return line


def swapped_words(line: Column) -> Column:
    """The long words of a line that swap_synonyms would take, in their order."""
    return F.array_compact(F.array(*[F.when(line.rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in sorted(lexicon.SYNONYMS)]))


def short_hash(text: Column, salt: Column) -> Column:
    """The first 8 hex digits of the hash of a text and a salt."""
    return F.substring(F.sha2(F.concat(text, F.lit("|"), salt.cast("string")), 256), 1, 8)


def point_id(key: Column) -> Column:
    """A 32-bit number from a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def overlap(asked: Column, field: Column) -> Column:
    """Shared tokens over the root of the field's size; 0 for an empty field."""
    return F.when(F.size(field) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, field)) / F.sqrt(F.size(field)))
