"""Reversible masking of boilerplate lines behind hash markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.tables import extension, language_of, lookup
from .corpus import distinct_files, file_lines


def maskable_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line, maskable of Python files: imports and module boilerplate may be masked."""
    bare = text.strip(F.col("line"))
    may = bare.startswith("import ") | bare.startswith("from ") | bare.rlike(lexicon.BOILERPLATE_LINE)
    return file_lines(files.where(extension(F.col("path")) == "py")).withColumn("maskable", may)


MARKER = r"\[§:[0-9a-f]{8}\]"


def _marker(line, salt):
    return F.concat(F.lit("[§:"), text.short_hash(line, salt), F.lit("]"))


def registry(lines: DataFrame) -> DataFrame:
    """line, marker, salt: a marker for every distinct maskable line.

    Lines whose short hashes agree get salts 0, 1, ... in the order of their texts, so that the registry does not depend
    on the order of files.
    """
    distinct = lines.where("maskable").select("line").distinct()
    first = distinct.withColumn("h", text.short_hash(F.col("line"), F.lit(0)))
    salted = first.withColumn("salt", F.row_number().over(W.partitionBy("h").orderBy("line")) - 1)
    return salted.select("line", _marker(F.col("line"), F.col("salt")).alias("marker"), "salt")


def mask(files: DataFrame) -> DataFrame:
    """path, masked, n_masked, tokens_before, tokens_after: maskable lines by their markers where that saves tokens.

    A marker is a function of its line; only the rare lines with a salt, whose short hashes clash, are looked up.
    """
    lines = maskable_lines(files)
    clashes = registry(lines).where("salt > 0").select("line", "salt")
    may = lookup(lines.where("maskable"), clashes, "line", ["path", "line_no"]).withColumn("marker", _marker(F.col("line"), F.coalesce("salt", F.lit(0)))).drop("salt")
    joined = may.unionByName(lines.where("not coalesce(maskable, false)").withColumn("marker", F.lit(None).cast("string")))
    saves = F.col("marker").isNotNull() & (text.count_tokens(F.col("marker")) < text.count_tokens(F.col("line")))
    out = joined.select("path", "line_no", F.when(saves, F.col("marker")).otherwise(F.col("line")).alias("out"), saves.alias("hit"), text.count_tokens(F.col("line")).alias("before"), F.when(saves, text.count_tokens(F.col("marker"))).otherwise(text.count_tokens(F.col("line"))).alias("after"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "out")))
    return out.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["out"]), "\n").alias("masked"), F.sum(F.col("hit").cast("long")).alias("n_masked"), F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"))


def pattern_registry(mined: DataFrame) -> DataFrame:
    """line, marker of mined C patterns that are whole lines (mined_tokens of corpus); only markers that save tokens."""
    rows = mined.where(F.col("pattern_type").isin("include", "define", "pragma")).select(F.col("pattern").alias("line"), F.col("token").alias("marker")).distinct()
    return rows.where(text.count_tokens(F.col("marker")) < text.count_tokens(F.col("line")))


def _space(i: int, c: str):
    return F.regexp_extract(c, r"^(\s*).*?(\s*)$", i)


def mask_patterns(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, masked, n_masked: lines of C files that a pattern makes up as its marker; white space around them stays.

    Only directives are looked up.
    """
    lines = file_lines(files.where(language_of(F.col("path")) == "c")).withColumn("key", text.strip(F.col("line")))
    directive = F.col("key").startswith("#")
    found = lookup(lines.where(directive), known.select(F.col("line").alias("key"), "marker"), "key", ["path", "line_no"])
    joined = found.unionByName(lines.where(~directive).withColumn("marker", F.lit(None).cast("string")))
    out = joined.select("path", "line_no", "marker", F.when(F.col("marker").isNotNull(), F.concat(_space(1, "line"), "marker", _space(2, "line"))).otherwise(F.col("line")).alias("out"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "out")))
    return out.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["out"]), "\n").alias("masked"), F.count("marker").alias("n_masked"))


def _restored(masked: DataFrame, known: DataFrame, may) -> DataFrame:
    """path, restored: lines that are markers (``may`` tells which can be) by what they stand for; unknown ones stay."""
    lines = masked.select("path", F.posexplode(F.split("masked", "\n")).alias("i", "out")).withColumn("marker", text.strip(F.col("out")))
    found = lookup(lines.where(may), known.select("marker", "line"), "marker", ["path", "i"])
    back = found.unionByName(lines.where(~may).withColumn("line", F.lit(None).cast("string")))
    line = F.when(F.col("line").isNotNull(), F.concat(_space(1, "out"), "line", _space(2, "out"))).otherwise(F.col("out"))
    parts = F.array_sort(F.collect_list(F.struct("i", line.alias("x"))))
    return back.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["x"]), "\n").alias("restored"))


def unmask_patterns(masked: DataFrame, known: DataFrame) -> DataFrame:
    """path, restored: the markers of mask_patterns by their lines."""
    return _restored(masked, known, F.col("marker").rlike("^§[0-9a-f]{8}$"))


def unmask(masked: DataFrame, known: DataFrame) -> DataFrame:
    """path, restored: markers by the lines they stand for; unknown markers stay."""
    return _restored(masked, known, F.col("marker").rlike(f"^{MARKER}$"))


def round_trip(files: DataFrame) -> DataFrame:
    """path, same: whether masking and unmasking gives the text back (line ends aside)."""
    known = registry(maskable_lines(files))
    back = unmask(mask(files), known)
    whole = distinct_files(files).select("path", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    return back.join(whole, "path").select("path", (F.col("restored") == F.col("content")).alias("same"))


def identifier_keys(mined: DataFrame, most: int = 60, tokens: bool = True) -> dict[str, str]:
    """The longest ``most`` mined identifiers (pattern_type, pattern, token) whose token is shorter, by tokens or by characters."""
    names = mined.where("pattern_type = 'identifier'")
    size = text.count_tokens if tokens else F.length
    saving = names.where(size(F.col("token")) < size(F.col("pattern")))
    return {r.pattern: r.token for r in saving.orderBy(F.desc(F.length("pattern")), "pattern").limit(most).select("pattern", "token").collect()}


def mask_identifiers(files: DataFrame, keys: dict[str, str]) -> DataFrame:
    """path, masked, n_masked: whole identifiers of C files by their tokens."""
    c = distinct_files(files.where(language_of(F.col("path")) == "c")).where("content is not null")
    if not keys:
        return c.select("path", F.col("content").alias("masked"), F.lit(0).alias("n_masked"))
    known = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    parts = text.matches(F.col("content"), r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+")
    return c.select("path", F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(known, w), w)), "").alias("masked"), F.size(F.filter(parts, lambda w: F.map_contains_key(known, w))).alias("n_masked"))


#: A marker of either form.
ANY_MARKER = r"\[§:(?:[A-Z]+_)?[0-9a-f]{8}\]|§[0-9a-f]{8}"


def unmask_texts(texts: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """key, restored: markers of either form anywhere in a text (key, text) by their originals (marker, original); unknown ones stay."""
    parts = texts.where("text is not null").select(key, F.posexplode(text.matches(F.col("text"), rf"(?s){ANY_MARKER}|(?:(?!{ANY_MARKER}).)+")).alias("i", "part"))
    marker = F.col("part").rlike(f"^(?:{ANY_MARKER})$")
    found = lookup(parts.where(marker).withColumnRenamed("part", "marker"), known, "marker", [key, "i"]).select(key, "i", F.coalesce("original", "marker").alias("part"))
    merged = found.unionByName(parts.where(~marker))
    back = F.array_sort(F.collect_list(F.struct("i", "part")))
    return merged.groupBy(key).agg(F.array_join(F.transform(back, lambda x: x["part"]), "").alias("restored"))
