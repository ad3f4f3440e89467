"""The metadata index of functions: signatures, calls both ways, complexity, and what is embedded of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.tables import repo_of
from .corpus import distinct_chunks

#: Types of chunks an index holds. Fixed values.
INDEXED = ("function", "struct", "class")


def signature(name: Column, source: Column, within: int = 300, most: int = 120) -> Column:
    """The first function head near the beginning of a source, else its first line that is no comment, else the name."""
    head = F.regexp_extract(F.substring(source, 1, within), lexicon.SIGNATURE, 0)
    lines = F.filter(F.transform(text.lines(source), text.strip), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*"))
    cut = text.strip(F.substring(head, 1, most))
    return F.when(head != "", cut).otherwise(F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, most), name))


def called(name: Column, source: Column, most: int = 30) -> Column:
    """Distinct names called, in the order of the first call, without builtins and the function itself."""
    calls = F.slice(F.filter(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_]\w+)\s*\("), F.lit(1))), lambda c: F.length(c) >= 2), 1, most)
    return F.filter(calls, lambda c: ~c.isin(*lexicon.CALL_BUILTINS) & (F.lower(c) != F.lower(F.coalesce(name, F.lit("")))))


def index_rows(chunks: DataFrame) -> DataFrame:
    """chunk_no, repo, file_path, name, signature, callees, complexity, line_count of each function, struct and class once.

    Chunks without source are left out; what is derived of the source is shuffled instead of it.
    """
    n = F.col("end_line") - F.col("start_line") + 1
    kept = chunks.where(F.lower("chunk_type").isin(*INDEXED) & F.col("source").isNotNull())
    return distinct_chunks(
        kept, repo_of(F.col("file_path")).alias("repo"), "file_path", "name", signature(F.col("name"), F.col("source")).alias("signature"),
        called(F.col("name"), F.col("source")).alias("callees"), text.complexity(F.col("source"), n).alias("complexity"), n.alias("line_count"),
    )


def caller_edges(index: DataFrame) -> DataFrame:
    """repo, name, caller (both in lower case): who calls whom among the index's names, each pair once.

    Pairs of names, not of definitions: a name defined a thousand times has its callers once. A name that a third of all
    functions call has as many rows, in no single group.
    """
    calls = index.select("repo", F.lower("name").alias("caller"), F.explode(F.array_distinct(F.transform("callees", lambda c: F.lower(c)))).alias("name")).where("caller is not null").distinct()
    return calls.join(index.select("repo", F.lower("name").alias("name")).distinct(), ["repo", "name"], "left_semi").select("repo", "name", "caller")


def function_index(chunks: DataFrame) -> DataFrame:
    """The index rows with n_callers, the distinct names that call a function's name in its repository."""
    index = index_rows(chunks)
    n = caller_edges(index).groupBy("repo", F.col("name").alias("_name")).agg(F.count("*").alias("n_callers"))
    return index.withColumn("_name", F.lower("name")).join(n, ["repo", "_name"], "left").drop("_name").fillna(0, ["n_callers"])


def embedding_inputs(chunks: DataFrame, meta: DataFrame, with_summary: int = 1800, without: int = 2000) -> DataFrame:
    """chunk_no, point, text: what is embedded of each chunk, its summary first where there is one, and the number of its point."""
    said = meta.where(F.length(F.trim("summary")) > 0).groupBy("file_path", "chunk_id").agg(F.min("summary").alias("summary"))
    rows = distinct_chunks(chunks.where("source is not null"), "file_path", "chunk_id", F.substring("source", 1, without).alias("head"))
    joined = rows.join(said, ["file_path", "chunk_id"], "left")
    return joined.select("chunk_no", text.point_id(F.col("chunk_id")).alias("point"), F.when(F.col("summary").isNotNull(), F.concat("summary", F.lit("\n"), F.substring("head", 1, with_summary))).otherwise(F.col("head")).alias("text"))


def summary_candidates(meta: DataFrame, most: int = 50) -> DataFrame:
    """The first functions that are not simple and have no summary."""
    open_ = meta.where(F.col("complexity").isin("complex", "moderate") & (F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0))
    return open_.select("file_path", "chunk_id", "name", "complexity").distinct().orderBy("file_path", "chunk_id", "name", "complexity").limit(most)


def payloads(chunks: DataFrame) -> DataFrame:
    """chunk_no, point, payload: a chunk's number in an index and what is kept with it, as JSON; its text is not."""
    fields = ("chunk_id", "file_path", "name", "chunk_type", "start_line", "end_line", "parent_name")
    return distinct_chunks(chunks, text.point_id(F.col("chunk_id")).alias("point"), F.to_json(F.struct(*fields)).alias("payload"))


def load_stats(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Files, chunks with source, those whose text the cache (hash) holds, those left to embed, and all tokens."""
    rows = distinct_chunks(chunks.where("source is not null"), "file_path", F.sha2(F.rtrim("source"), 256).alias("hash"), text.count_tokens(F.col("source")).alias("tokens"))
    per = rows.groupBy("hash").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))  # copies are one hash before they meet the cache
    held = per.join(cache.select("hash", F.lit(True).alias("held")).distinct(), "hash", "left")
    sums = held.agg(F.sum("n").alias("chunks"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("cached"), F.sum("tokens").alias("tokens"))
    files = rows.select("file_path").distinct().agg(F.count("file_path").alias("files"))
    return files.join(sums, F.lit(True)).select("files", "chunks", "cached", (F.col("chunks") - F.col("cached")).alias("to_embed"), "tokens")


def selected(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with selected: whether any selected record has their name (rows of one name are all selected)."""
    chosen = names.where("name is not null").select("name").distinct().withColumn("selected", F.lit(True))
    return rows.join(chosen, "name", "left").fillna(False, ["selected"])
