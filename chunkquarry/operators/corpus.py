"""Scans and mining over source files and chunks: distinct rows, lines, document frequencies, patterns, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.tables import extension, language_of, lookup, numbered, repo_of


#: A line that a docstring begins on, and what it says.
DOC_LINE = r"""^[rRuU]?(?:\"\"\"|\'\'\')(.*?)(?:\"\"\"|\'\'\')?$"""


def distinct_chunks(chunks: DataFrame, *columns: str | Column) -> DataFrame:
    """Each chunk_no once, with columns or expressions, which are computed first: repeated rows differ in ingested_at only.

    What is derived from source should be given as an expression, so that it is shuffled instead of the text.
    """
    return chunks.where("chunk_no is not null").select("chunk_no", *columns).dropDuplicates(["chunk_no"])


def distinct_files(files: DataFrame) -> DataFrame:
    """path, content of each path once."""
    return files.where("path is not null").groupBy("path").agg(F.max("content").alias("content"))


def file_lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    return distinct_files(files).select("path", F.posexplode(text.lines(F.col("content"))).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def import_frequency(files: DataFrame) -> DataFrame:
    """Import lines of Python files by the number of files that hold them."""
    stripped = file_lines(files.where(extension(F.col("path")) == "py")).select("path", text.strip(F.col("line")).alias("line"))
    return stripped.where("line like 'import %' or line like 'from %'").groupBy("line").agg(F.countDistinct("path").alias("n_files"))


def mine_patterns(files: DataFrame, least_files: int = 3, most_define: int = 120, comment_words: int = 12, least_comment: int = 40, least_in_file: int = 4, least_identifier: int = 13) -> DataFrame:
    """pattern_type, pattern, n_files: what recurs in at least ``least_files`` C files.

    Comment blocks are known by their first words; identifiers count for a file only where they recur in it.
    """
    c = distinct_files(files.where(language_of(F.col("path")) == "c"))

    def typed(kind: str) -> Column:
        return F.transform(text.matches(F.col("content"), lexicon.MINED[kind]), lambda m: F.struct(F.lit(kind).alias("pattern_type"), m.alias("m")))

    found = F.concat(*map(typed, lexicon.MINED))
    raw = c.select("path", F.explode(found).alias("x")).select("path", "x.pattern_type", "x.m")
    kind, m = F.col("pattern_type"), F.col("m")
    bare = text.strip(m)
    pattern = (
        F.when((kind == "define") & (F.length(bare) > most_define), None)
        .when((kind == "comment_block") & (F.length(m) > least_comment), F.array_join(F.slice(text.matches(m, r"\S+"), 1, comment_words), " "))
        .when(kind == "comment_block", None).when((kind == "identifier") & (F.length(m) < least_identifier), None).when(kind == "identifier", m).otherwise(bare)
    )
    each = raw.select("path", "pattern_type", pattern.alias("pattern")).where("pattern is not null").groupBy("path", "pattern_type", "pattern").agg(F.count("*").alias("n"))
    counted = each.where((kind != "identifier") | (F.col("n") >= least_in_file))
    return counted.groupBy("pattern_type", "pattern").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least_files)


def tokens_of(mined: DataFrame) -> DataFrame:
    """Mined patterns with their hash and the token that stands for them."""
    h = F.sha2("pattern", 256)
    return mined.select("pattern_type", "pattern", "n_files", h.alias("hash"), F.concat(F.lit("§"), F.substring(h, 1, 8)).alias("token"))


def mined_tokens(mined: DataFrame) -> DataFrame:
    """The same with their order within the type."""
    return numbered(tokens_of(mined), "pattern_type", F.desc("n_files"), F.col("pattern").asc())


def pattern_summary(mined: DataFrame) -> DataFrame:
    """Patterns of each type, the files that hold them, and the share of patterns whose token is shorter."""
    shorter = text.count_tokens(F.col("token")) < text.count_tokens(F.col("pattern"))
    return tokens_of(mined).groupBy("pattern_type").agg(F.count("*").alias("n_patterns"), F.max("n_files").alias("most_files"), F.count_if(shorter).alias("n_saving"))


def hash_cache(patterns: DataFrame) -> DataFrame:
    """hash, compressed: the newest form of each pattern; the hash is that of the text without trailing blanks."""
    rows = patterns.where("original is not null and compressed is not null").select(F.sha2(F.rtrim("original"), 256).alias("hash"), "compressed", "mined_at", "pattern_no")
    return rows.groupBy("hash").agg(F.max_by("compressed", F.struct("mined_at", "pattern_no", "compressed")).alias("compressed"))


def hashed_lines(files: DataFrame) -> DataFrame:
    """path, hash, n: how often each line that holds anything stands in a file."""
    held = file_lines(files).where(F.col("line").rlike(r"\S"))
    return held.groupBy("path", F.sha2(F.rtrim("line"), 256).alias("hash")).agg(F.count("*").alias("n"))


def cached_lines(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, line_no, hash, compressed (null if the cache has no such line) of every line that holds anything."""
    hashed = file_lines(files).where(F.col("line").rlike(r"\S")).select("path", "line_no", F.sha2(F.rtrim("line"), 256).alias("hash"))
    return lookup(hashed, cache, "hash", ["path", "line_no"])


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, lines, hits, any_hit: lines of each file that hold anything, and those the cache (hash, compressed) holds."""
    found = lookup(hashed_lines(files), cache, "hash", ["path", "hash"])
    hit = F.col("compressed").isNotNull()
    return found.groupBy("path").agg(F.sum("n").alias("lines"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.bool_or(hit).alias("any_hit"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct lines that the cache does not hold, with the files that hold them; lines are counted before they meet the cache."""
    counted = hashed_lines(files).groupBy("hash").agg(F.count("*").alias("n_files"))
    return counted.join(cache, "hash", "left_anti")


def repo_rollup(files: DataFrame) -> DataFrame:
    """Files, lines, words and estimated tokens of each repository and language."""
    f = distinct_files(files).select(repo_of(F.col("path")).alias("repo"), F.coalesce(language_of(F.col("path")), F.lit("other")).alias("language"), "content")
    sized = f.select("repo", "language", F.coalesce(F.size(text.lines(F.col("content"))).cast("long"), F.lit(0)).alias("lines"), text.count_words(F.col("content")).alias("words"), text.count_tokens(F.col("content")).alias("tokens"))
    return sized.groupBy("repo", "language").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("lines", "words", "tokens")))


def callees(chunks: DataFrame, most: int = 30) -> DataFrame:
    """chunk_no, place, callee: distinct names called, in the order of their first call, without builtins and itself."""
    calls = F.slice(F.filter(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\b([A-Za-z_]\w+)\s*\("), F.lit(1))), lambda c: F.length(c) >= 2), 1, most)
    rows = distinct_chunks(chunks, "name", calls.alias("calls"))
    named = rows.select("chunk_no", "name", F.posexplode("calls").alias("place", "callee"))
    other = ~F.col("callee").isin(*lexicon.CALL_BUILTINS) & (F.lower("callee") != F.lower(F.coalesce("name", F.lit(""))))
    return named.where(other).select("chunk_no", "place", "callee")


def rare_identifiers(chunks: DataFrame, most: int = 15) -> DataFrame:
    """chunk_no, place, word: the rarest identifiers of every function, ties in the order of words; common ones and constants are left out."""
    rows = distinct_chunks(chunks, "file_path", "chunk_type", "source").where(F.lower("chunk_type").isin("function", "method"))
    c = language_of(F.col("file_path")) == "c"
    words = rows.select("chunk_no", F.coalesce(c, F.lit(False)).alias("c"), F.explode(text.matches(F.col("source"), r"[a-zA-Z_]\w*")).alias("word"))
    counts = words.groupBy("chunk_no", "c", "word").agg(F.count("*").alias("n"))
    upper = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    of_c = ~F.col("word").isin(*lexicon.C_COMMON) & ~F.col("word").startswith("_") & (F.length("word") >= 4)
    of_py = ~F.col("word").isin(*lexicon.PY_COMMON) & ~F.col("word").startswith("__") & (F.length("word") >= 3)
    kept = counts.where(~upper & F.when(F.col("c"), of_c).otherwise(of_py))
    place = F.row_number().over(W.partitionBy("chunk_no").orderBy("n", "word"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("chunk_no", "place", "word")


def interfaces(files: DataFrame, most: int = 120) -> DataFrame:
    """path, line_no, entry: the head of every Python function and class, with the first line of a docstring on the next line."""
    lines = file_lines(files.where(extension(F.col("path")) == "py")).withColumn("bare", text.strip(F.col("line")))
    after = F.lead("bare").over(W.partitionBy("path").orderBy("line_no"))
    heads = lines.withColumn("after", after).where(F.col("bare").rlike(r"^(?:def|class|async def) "))
    told = F.regexp_extract("after", DOC_LINE, 1)
    entry = F.when(F.length(told) > 0, F.concat("bare", F.lit("  # "), F.substring(told, 1, most))).otherwise(F.col("bare"))
    return heads.select("path", "line_no", entry.alias("entry"))


def callers(meta: DataFrame) -> DataFrame:
    """name, n_definitions, n_callers: of every function name the distinct names that call it (compared in lower case).

    Callers are gathered per name, not per pair of definitions, so a name defined in many files costs one row each.
    """
    rows = meta.where("name is not null").select("file_path", "chunk_id", "name", "callee_names").dropDuplicates(["file_path", "chunk_id"])
    calls = rows.select(F.lower("name").alias("caller"), F.explode("callee_names").alias("c")).select("caller", F.lower("c").alias("name"))
    calling = calls.where("caller <> name").groupBy("name").agg(F.countDistinct("caller").alias("n_callers"))
    defined = rows.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n_definitions"))
    return defined.join(calling, "name", "left").fillna(0, ["n_callers"])
