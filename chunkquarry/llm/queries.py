"""The pN_ queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, language_of, repo_of, table
from . import docs, mix, pack, pii, replies, spans, split, syntax, terms, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _span_records(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_records(*(table(spark, sf, t) for t in ("chunks", "patterns")))


@query
def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each record is shared elsewhere; the stretches begin at 0."""
    out = spans.shared_spans(_span_records(spark, sf))
    covered = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*spans.rec_columns(), covered.alias("covered_chars"), F.size("starts").alias("n_spans"), "starts", "lengths")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that share a run of 200 or more characters with a record elsewhere."""
    return p1_coverage(spark, sf).select("rec_kind", "rec_no")


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that only one record holds, or more than 2 % of all."""
    recs = terms.records(table(spark, sf, "patterns"))
    return terms.marked(terms.term_frequencies(recs), recs).where("mark is not null").select("term", "mark")


_RECORDS_SQL = """
    select pattern_no as rec, min_by(original, original) as text,
           coalesce(min_by(kind, (original, kind is not null, kind, frequency is not null, frequency)), 'unknown') as kind,
           min_by(frequency, (original, kind is not null, kind, frequency is not null, frequency)) as recorded
    from (select pattern_no, original, frequency, nullif(regexp_replace(lower(trim(pattern_type)), '[\\s\\-]+', '_', 'g'), '') as kind
          from patterns where pattern_no is not null and original is not null)
    group by pattern_no"""

ORACLES["p3_found"] = """
with recs as (select pattern_no as rec, min(original) as text from patterns where original is not null and pattern_no is not null group by 1),
terms as (select distinct rec, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) as term from recs),
freq as (select term, count(*) as n from terms group by 1)
select term, case when n = 1 then 'rare' else 'common' end as mark
from freq where n = 1 or n > 0.02 * (select count(*) from recs)"""


def _all_kinds(recs: DataFrame) -> DataFrame:
    """A row of each record's kind and one of kind 'all'."""
    return recs.select(F.explode(F.array("kind", F.lit("all"))).alias("kind"))


@query
def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every term, overall (kind 'all') and by pattern type, marked within each."""
    recs = terms.records(table(spark, sf, "patterns"))
    freq = terms.with_all(terms.term_frequencies(recs, per_kind=True), "term")
    return terms.marked(freq, _all_kinds(recs), keys=("kind",)).select("kind", "term", "occurrences", "records", "mark")


ORACLES["p3_terms"] = f"""
with recs as ({_RECORDS_SQL}),
typed as (select rec, kind, text from recs union all select rec, 'all', text from recs),
terms as (select kind, rec, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) as term from typed),
freq as (select kind, term, count(*) as occurrences, count(distinct rec) as records from terms group by 1, 2),
total as (select kind, count(*) as n from typed group by 1)
select kind, term, occurrences, records,
       case when records = 1 then 'rare' when records > 0.02 * n then 'common' end as mark
from freq join total using (kind)"""


@query
def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    """Records of every distinct text by type, next to the frequencies they claim."""
    return terms.value_frequencies(terms.records(table(spark, sf, "patterns"))).select("kind", "value", "occurrences", "records", "recorded_least", "recorded_most")


ORACLES["p3_values"] = f"""
with recs as ({_RECORDS_SQL})
select kind, text as value, count(*) as occurrences, count(distinct rec) as records,
       min(recorded) as recorded_least, max(recorded) as recorded_most
from recs group by 1, 2"""


@query
def p3_value_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The same overall (kind 'all') as well as by type, marked within each as terms are."""
    recs = terms.records(table(spark, sf, "patterns"))
    out = terms.marked(terms.with_all(terms.value_frequencies(recs), "value"), _all_kinds(recs), keys=("kind",))
    return out.select("kind", "value", "occurrences", "records", "recorded_least", "recorded_most", "mark")


ORACLES["p3_value_totals"] = f"""
with recs as ({_RECORDS_SQL}),
typed as (select rec, kind, text, recorded from recs union all select rec, 'all', text, recorded from recs),
freq as (select kind, text as value, count(*) as occurrences, count(distinct rec) as records,
                min(recorded) as recorded_least, max(recorded) as recorded_most from typed group by 1, 2),
total as (select kind, count(*) as n from typed group by 1)
select kind, value, occurrences, records, recorded_least, recorded_most,
       case when records = 1 then 'rare' when records > 0.02 * n then 'common' end as mark
from freq join total using (kind)"""


def _limit(spark: SparkSession, sf: str, name: str):
    """A row of size_limits, a table of a handful of settings."""
    return table(spark, sf, "size_limits").where(F.col("limit_name") == name).orderBy("capacity").first()


def _split_chunks(spark: SparkSession, sf: str) -> DataFrame:
    limit = _limit(spark, sf, "split_chunk")
    items = table(spark, sf, "chunks").select(F.col("chunk_no").alias("rec"), F.col("source").alias("text"))
    return split.split_oversized(items, limit.capacity, limit.overlap, limit.unit)


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of more than 300 words, and whether a single line of them is over the limit."""
    capacity = _limit(spark, sf, "split_chunk").capacity
    cut = F.when(F.col("widest_line") > capacity, "inside_line").otherwise("at_line")
    return _split_chunks(spark, sf).where("piece_no = 0").select(F.col("rec").alias("chunk_no"), cut.alias("cut"))


ORACLES["p7_found"] = r"""
with big as (select chunk_no, max(source) as source from chunks
             where len(regexp_extract_all(source, '\S+')) > 300 group by 1)
select chunk_no, case when list_max(list_transform(string_split(source, chr(10)), lambda x: len(regexp_extract_all(x, '\S+')))) > 300
                      then 'inside_line' else 'at_line' end as cut
from big"""


@query
def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The overlapping pieces of every chunk over the limit."""
    return _split_chunks(spark, sf).withColumnRenamed("rec", "chunk_no").drop("widest_line")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that do not parse in the language of their extension."""
    return syntax.invalid_files(table(spark, sf, "source_files"))


@query
def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Invalid files per repository and language."""
    return syntax.error_rates(table(spark, sf, "source_files"))


def _doc_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("chunks", "source_files", "fn_meta")]


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and methods with documentation that says something."""
    return docs.documented_functions(*_doc_tables(spark, sf)).select("chunk_no")


@query
def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Code and its documentation."""
    return docs.pairs(*_doc_tables(spark, sf))


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Defective answers with their defect."""
    pairs = table(spark, sf, "response_pairs")
    return replies.defects(pairs, replies.fit(table(spark, sf, "documents"), pairs))


@query
def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of each side and how many have which defect."""
    pairs = table(spark, sf, "response_pairs")
    answered = pairs.where("task_id is not null").groupBy("task_id").agg(*(F.max(F.col(f"response_{s}").isNotNull()).alias(s) for s in ("full", "bridge")))
    asked = answered.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("long").alias("answers")) for s in ("full", "bridge")])).alias("a")).groupBy("a.side").agg(F.sum("a.answers").alias("answers"))
    return p2_found(spark, sf).groupBy("side", "defect").agg(F.count("*").alias("n")).join(asked, "side").select("side", "defect", "n", (F.col("n") / F.col("answers")).alias("share"))


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct mention of personal information in a document."""
    found = pii.mentions(table(spark, sf, "documents"), table(spark, sf, "given_names"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.mention").distinct()


@query
def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with placeholders for personal information."""
    return pii.redacted(table(spark, sf, "documents"), table(spark, sf, "given_names"))


def _chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """repo, language, n_tokens of every chunk; Python chunks that the class row of their parent holds already are left out."""
    chunks = table(spark, sf, "chunks").where("chunk_no is not null and source is not null")
    language = F.coalesce(language_of(F.col("file_path")), tokens.plain_language(F.col("language")))
    items = chunks.select("chunk_no", repo_of(F.col("file_path")).alias("source"), language.alias("language"), "file_path", "parent_name", F.col("source").alias("text"))
    counted = tokens.token_counts(items).dropDuplicates(["chunk_no"])
    classes = chunks.where("lower(trim(chunk_type)) = 'class'").groupBy("file_path", F.col("name").alias("parent_name")).agg(F.min("chunk_no").alias("first"), F.max("chunk_no").alias("last"))
    held = F.expr("language <=> 'python' and (first <> chunk_no or last <> chunk_no)")  # a class doesn't hold itself
    return counted.join(classes, ["file_path", "parent_name"], "left").where(~F.coalesce(held, F.lit(False))).select("chunk_no", "source", "language", "n_tokens")


def _document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select("doc_id", "source", tokens.plain_language(F.col("lang")).alias("language"), "domain", "text")
    return tokens.token_counts(items)


@query
def p4_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every slice: chunks by repository and language, documents by source, language and domain."""
    code = tokens.cube(_chunk_tokens(spark, sf), ["source", "language"]).select(F.lit("chunks").alias("origin"), "source", "language", F.lit(None).cast("string").alias("domain"), "level", "items", "tokens")
    text = tokens.cube(_document_tokens(spark, sf), ["source", "language", "domain"]).select(F.lit("documents").alias("origin"), "source", "language", "domain", "level", "items", "tokens")
    return code.unionByName(text)


@query
def p4_document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document."""
    return _document_tokens(spark, sf).select("doc_id", "n_tokens")


@query
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or piece of one over the capacity, for each token capacity."""
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    items = checkpointed(tokens.token_counts(texts).select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size")))
    limits = table(spark, sf, "size_limits").where("unit = 'token'").orderBy("capacity", "limit_name").collect()  # a handful of settings
    packed = [pack.pack(items, r.capacity).select(F.lit(r.limit_name).alias("limit_name"), "container", F.col("id").alias("doc_id"), "piece", "start", "size") for r in limits]
    return functools.reduce(DataFrame.unionByName, packed)


@query
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each capacity and how full they are."""
    limits = table(spark, sf, "size_limits").select("limit_name", "capacity")
    per = p8_containers(spark, sf).groupBy("limit_name", "container").agg(F.sum("size").alias("tokens"))
    whole = per.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return whole.join(limits, "limit_name").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def _sized_documents(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(_document_tokens(spark, sf).select("doc_id", "source", "n_tokens"))


@query
def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """One mixture of the ten sources at their target shares, in the order of slot and seq."""
    return mix.mixture(_sized_documents(spark, sf), table(spark, sf, "mix_targets"))


@query
def p9_available(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture as large as all sources together, in which small sources stay below their shares (see p9_shares)."""
    return mix.mixture(_sized_documents(spark, sf), table(spark, sf, "mix_targets"), total="available")


@query
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares, at the largest total with exact shares and at the size of all sources together."""
    docs_, targets = _sized_documents(spark, sf), table(spark, sf, "mix_targets")
    both = [mix.shares(mix.mixture(docs_, targets, total=t), targets).withColumn("total", F.lit(t)) for t in ("feasible", "available")]
    return both[0].unionByName(both[1])
