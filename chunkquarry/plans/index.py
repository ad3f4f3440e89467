"""Queries of the catalogue over the metadata index, rankings with vectors and filters, whole pipelines and restored texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import chunking, corpus, history, masking, metadata, quality, ranking, rewriting
from ..sources.tables import language_of, table
from ..streaming.channels import work_dir
from .catalog import _ASKED, _BUILTINS, _CACHE, _CHUNKS, _COSINE, _FIELDS, _KEYWORD, _LANG, _LINE, _FILES, _MINED_SQL, _PAIRS, _QUESTIONS, _REC_TERMS, _SCORES, _TURNS, _best, _changed, _chunks, _field_records, _files, _lines, _questions, _records, _strip, _tokens, _words, query

_SIGNATURE = lexicon.SIGNATURE.replace("'", "''")
_HEADS = f"regexp_extract(substr(source, 1, 300), '{_SIGNATURE}')"
_FIRST = f"list_filter(list_transform({_lines('source')}, lambda x: {_strip('x')}), lambda x: x <> '' and not starts_with(x, '//') and not starts_with(x, '/*'))"
_INDEX = rf"""{_CHUNKS},
idx as (select chunk_no, regexp_extract(file_path, '^[^/]*') as repo, file_path, name, end_line - start_line + 1 as line_count, source,
  case when {_HEADS} <> '' then {_strip(f"substr({_HEADS}, 1, 120)")} else coalesce(substr(({_FIRST})[1], 1, 120), name) end as signature,
  (select list(c order by i) from (select c, min(i) as i from (select unnest(l) as c, generate_subscripts(l, 1) as i from (select regexp_extract_all(source, '\b([A-Za-z_]\w+)\s*\(', 1) as l)) where length(c) >= 2 group by c order by i limit 30) where c not in ({_BUILTINS}) and lower(c) <> lower(coalesce(name, ''))) as callees
  from chunk where lower(chunk_type) in ('function', 'struct', 'class') and source is not null),
edge as (select distinct repo, lower(name) as caller, lower(unnest(callees)) as name from idx where name is not null),
edges as (select repo, name, caller from edge semi join (select distinct repo, lower(name) as name from idx) using (repo, name))"""


@query(f"with {_INDEX} select chunk_no, signature from idx")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """The signature of every indexed chunk."""
    return metadata.index_rows(_chunks(spark, sf)).select("chunk_no", "signature")


@query(f"with {_INDEX} select repo, name, caller from edges")
def caller_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Who calls whom within each repository."""
    return metadata.caller_edges(metadata.index_rows(_chunks(spark, sf)))


_BRANCHES = " + ".join(f"(length(lower(source)) - length(replace(lower(source), {lit}, ''))) // {n}" for lit, n in (("' if '", 4), ("chr(9) || 'if('", 4), ("chr(10) || 'if('", 4), ("' for('", 5), ("' while('", 7), ("' switch('", 8)))
_INDEX_ROWS = f"""select i.chunk_no, i.repo, i.file_path, i.name, i.signature, array_to_string(coalesce(i.callees, []), ',') as callees, i.line_count, coalesce(n.n, 0) as n_callers,
  case when {_BRANCHES} >= 8 or line_count > 150 then 'complex' when {_BRANCHES} >= 3 or line_count > 40 then 'moderate' else 'simple' end as complexity
from idx i left join (select repo, name, count(*) as n from edges group by 1, 2) n on n.repo = i.repo and n.name = lower(i.name)"""


@query(f"with {_INDEX} {_INDEX_ROWS}")
def function_index(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata index of all chunks: signature, calls, callers, complexity."""
    return metadata.function_index(_chunks(spark, sf)).withColumn("callees", F.array_join("callees", ","))


@query(f"with {_INDEX}, rows as ({_INDEX_ROWS}) select repo, count(*) as functions, count(*) filter (complexity = 'complex') as complex_functions, sum(n_callers)::bigint as callers, count(*) filter (n_callers = 0) as uncalled from rows group by 1")
def saved_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every repository's index, written by repository and read back."""
    at = os.path.join(work_dir(spark, "index"), "functions")
    metadata.function_index(_chunks(spark, sf)).write.partitionBy("repo").parquet(at)
    rows = spark.read.option("basePath", at).schema("chunk_no long, file_path string, name string, signature string, callees array<string>, complexity string, line_count int, n_callers long, repo string").parquet(at)
    return rows.groupBy("repo").agg(F.count("*").alias("functions"), F.count_if(F.col("complexity") == "complex").alias("complex_functions"), F.sum("n_callers").alias("callers"), F.count_if(F.col("n_callers") == 0).alias("uncalled"))


@query()
def built_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index built end to end from the source files: chunks cut from them, their signatures, calls and callers."""
    cut = chunking.with_ids(chunking.extract(_files(spark, sf))).withColumn("chunk_no", F.concat_ws("|", "file_path", "chunk_id"))
    return metadata.function_index(cut).drop("chunk_no")


@query(f"""
with {_CHUNKS}, said as (select file_path, chunk_id, min(summary) as summary from fn_meta where length(trim(summary)) > 0 group by 1, 2)
select chunk_no, ('0x' || substr(md5(chunk_id), 1, 8))::bigint as point, case when summary is not null then summary || chr(10) || substr(source, 1, 1800) else substr(source, 1, 2000) end as text
from chunk left join said using (file_path, chunk_id) where source is not null""")
def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What is embedded of every chunk."""
    return metadata.embedding_inputs(_chunks(spark, sf), table(spark, sf, "fn_meta"))


@query("select distinct file_path, chunk_id, name, complexity from fn_meta where complexity in ('complex', 'moderate') and length(trim(coalesce(summary, ''))) = 0 order by all limit 50")
def summary_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first functions that a summary should be written of."""
    return metadata.summary_candidates(table(spark, sf, "fn_meta"))


@query(f"""
with {_CHUNKS} select chunk_no, ('0x' || substr(md5(chunk_id), 1, 8))::bigint as point,
  '{{' || array_to_string(list_filter(['"chunk_id":' || to_json(chunk_id), '"file_path":' || to_json(file_path), '"name":' || to_json(name), '"chunk_type":' || to_json(chunk_type), '"start_line":' || start_line, '"end_line":' || end_line, '"parent_name":' || to_json(parent_name)], lambda x: x is not null), ',') || '}}' as payload from chunk""")
def chunk_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of every chunk beside its vector."""
    return metadata.payloads(_chunks(spark, sf))


@query(f"""
with {_CHUNKS}, {_CACHE}, s as (select file_path, sha256(rtrim(source)) as hash, {_tokens('source')} as tokens from chunk where source is not null)
select count(distinct file_path) as files, count(*) as chunks, count(compressed) as cached, count(*) - count(compressed) as to_embed, sum(tokens)::bigint as tokens from s left join cache using (hash)""")
def load_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Files and chunks of a load, and how many of them the cache spares."""
    return metadata.load_stats(_chunks(spark, sf), corpus.hash_cache(table(spark, sf, "patterns")))


@query(f"with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, top as ({_best('kw', 5)}), named as (select distinct name from chunk join top on chunk_no = rec where name is not null) select chunk_no, coalesce(name in (select name from named), false) as selected from chunk where {_LANG.format('file_path')} = 'c'")
def selected_names(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of C files, marked where a chunk of their name is among the best of any question."""
    top = ranking.best(ranking.keyword_scores(_questions(spark, sf), _records(spark, sf)), 5).select(F.col("rec").alias("chunk_no")).distinct()
    rows = corpus.distinct_chunks(_chunks(spark, sf), "file_path", "name")
    return metadata.selected(rows.where(language_of(F.col("file_path")) == "c"), rows.join(top, "chunk_no", "left_semi")).select("chunk_no", "selected")


_LONG = ", ".join(f"'{w}'" for w in sorted(lexicon.SYNONYMS))


@query(rf"""
with {_FILES}, {_LINE}, c as (select path, line_no, line from line where lower(path) like '%.py' and regexp_matches(line, '^\s*(#|"|'')'))
select path, line_no, words from (select path, line_no, array_to_string(list_filter([{_LONG}], lambda w: regexp_matches(line, '(?i)\b' || w || '\b')), ' ') as words from c) where words <> ''""")
def synonym_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The long words of comment and docstring lines that give way to short ones."""
    lines = corpus.file_lines(_files(spark, sf).where(F.lower("path").endswith(".py"))).where(F.col("line").rlike(r"""^\s*(#|"|')"""))
    return lines.select("path", "line_no", F.array_join(text.swapped_words(F.col("line")), " ").alias("words")).where("words <> ''")


# ---- rankings with vectors and filters; vectors belong to the chunks and questions of their number

_DENSE = """e as (select vec_id, embedding::double[] as v from embeddings),
dn as (select q.qid, r.vec_id as rec, list_cosine_similarity(a.v, r.v) as score from question q join e a on a.vec_id = q.qid join e r on r.vec_id in (select chunk_no from chunk) )"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = v.withColumnRenamed("vec_id", "qid").join(_questions(spark, sf).select("qid"), "qid", "left_semi")
    return asked, v.withColumnRenamed("vec_id", "rec").join(_records(spark, sf).select("rec"), "rec", "left_semi")


@query(f"""
with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, {_DENSE}, a as ({_best('kw', 10)}), b as ({_best('dn', 10)}),
f as (select qid, rec, round(sum(1.0::double / ({lexicon.RRF_CONSTANT} + place)), 12) as score from (select qid, rec, place from a union all select qid, rec, place from b) group by 1, 2)
select qid, rec, score, place::int as place from ({_best('f', 5)})""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword ranking fused with the ranking by vectors."""
    return ranking.retrieve(_questions(spark, sf), _records(spark, sf), 5, vectors=_vectors(spark, sf))


@query(f"with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, {_FIELDS} select qid, rec, score, place::int as place from ({_best('fs', 5)})")
def indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """What retrieval chooses where there is an index: the ranking by fields."""
    return ranking.retrieve(_questions(spark, sf), _records(spark, sf), 5, fields=_field_records(spark, sf), vectors=_vectors(spark, sf))


@query(f"""
with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD},
own as (select distinct p.pattern_no as qid, c.chunk_no as rec from patterns p join chunk c on c.repo = p.repo where p.pattern_no % 100 = 0),
kept as (select kw.* from kw semi join own using (qid, rec)), rs as (select qid, rec, score from kept union all select qid, rec, score from kw where qid not in (select qid from kept))
select qid, rec, round(score, 9) as score, place::int as place from ({_best('rs', 5)})""")
def repository_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword ranking within the repository of each question, over all of them where that has no match."""
    asked = _questions(spark, sf)
    scored = ranking.keyword_scores(asked, _records(spark, sf))
    of = table(spark, sf, "patterns").where("pattern_no % 100 = 0 and repo is not null").select(F.col("pattern_no").alias("qid"), "repo").distinct()
    homes = corpus.distinct_chunks(_chunks(spark, sf), "repo").select(F.col("chunk_no").alias("rec"), "repo")
    near = scored.join(homes, "rec").join(of, ["qid", "repo"], "left_semi").select("qid", "rec")
    return ranking.best(ranking.restricted(scored, near), 5).select("qid", "rec", F.round("score", 9).alias("score"), "place")


# ---- whole pipelines


@query()
def pipeline_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every file after dropping bodies, after masking, and after squeezing comments."""
    return rewriting.pipeline(_files(spark, sf), _changed(spark, sf)).drop("compressed")


@query()
def variant_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """What each combination of the three steps makes of every C file: tokens, share saved, consistency."""
    return rewriting.variants(_files(spark, sf))


@query()
def dispatched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk compressed in the way of its language and zone, with its score."""
    return rewriting.dispatch(_chunks(spark, sf), _changed(spark, sf), _files(spark, sf))


@query()
def dispatch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Share saved and mean score of the compressed chunks by zone, and their product."""
    return rewriting.dispatch_rollup(rewriting.dispatch(_chunks(spark, sf), _changed(spark, sf), _files(spark, sf)))


@query(f"with {_CHUNKS}, {_FILES}, w as (select path, {_tokens('content')} as n from file), c as (select file_path as path, sum({_tokens('source')})::bigint as n, count(*) as chunks from chunk where source is not null group by 1) select path, w.n as file_tokens, c.n as chunk_tokens, chunks, round(c.n / greatest(w.n, 1), 6) as ratio from w join c using (path)")
def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each file and the sum over its chunks, which overlap."""
    whole = corpus.distinct_files(_files(spark, sf)).select("path", text.count_tokens(F.col("content")).alias("file_tokens"))
    sized = corpus.distinct_chunks(_chunks(spark, sf).where("source is not null"), F.col("file_path").alias("path"), text.count_tokens(F.col("source")).alias("n"))
    per = sized.groupBy("path").agg(F.sum("n").alias("chunk_tokens"), F.count("*").alias("chunks"))
    return whole.join(per, "path").withColumn("ratio", F.round(F.col("chunk_tokens") / F.greatest("file_tokens", F.lit(1)), 6))


# ---- masks


@query(f"with {_MINED_SQL} select pattern_type, count(*) as n_patterns, max(n_files) as most_files, count(*) filter ({_tokens(chr(39) + '§' + chr(39) + ' || substr(sha256(pattern), 1, 8)')} < {_tokens('pattern')}) as n_saving from mined group by 1")
def pattern_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mined patterns by type."""
    return corpus.pattern_summary(corpus.mine_patterns(_files(spark, sf)))


@query(rf"""
with {_MINED_SQL}, k as (select pattern, '§' || substr(sha256(pattern), 1, 8) as token from mined where pattern_type = 'identifier' and length(pattern) > 9 order by length(pattern) desc, pattern limit 60),
known as (select map(list(pattern), list(token)) as m from k), w as (select path, regexp_extract_all(content, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+') as l, m from c, known where content is not null)
select path, array_to_string(list_transform(l, lambda x: coalesce(m[x], x)), '') as masked, len(list_filter(l, lambda x: m[x] is not null))::int as n_masked from w""")
def identifier_masked_files(spark: SparkSession, sf: str) -> DataFrame:
    """C files with the longest mined identifiers behind their shorter tokens."""
    keys = masking.identifier_keys(corpus.tokens_of(corpus.mine_patterns(_files(spark, sf))), tokens=False)
    return masking.mask_identifiers(_files(spark, sf), keys)


_SAID = "'use ' || compressed || ', then (' || compressed || ') again; §none [§:00] stays'"


@query(f"""
with known as (select compressed, min(original) as original from patterns where original is not null and regexp_full_match(compressed, '{masking.ANY_MARKER}') group by 1), p as (select pattern_no, min(compressed) as compressed from patterns where pattern_no is not null and compressed is not null group by 1)
select pattern_no, replace({_SAID}, compressed, coalesce(original, compressed)) as restored from p left join known using (compressed)""")
def restored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold markers of either form, with the originals in their place."""
    p = table(spark, sf, "patterns")
    known = p.where(F.col("original").isNotNull() & F.col("compressed").rlike(f"^(?:{masking.ANY_MARKER})$")).groupBy(F.col("compressed").alias("marker")).agg(F.min("original").alias("original"))
    texts = p.where("pattern_no is not null and compressed is not null").groupBy("pattern_no").agg(F.min("compressed").alias("compressed")).select("pattern_no", F.expr(_SAID).alias("text"))
    return masking.unmask_texts(texts, known, "pattern_no")


# ---- scores


@query(f"""
with {_SCORES} select task_id, case when composite >= 0.95 then 'EXCELLENT' when composite >= 0.85 then 'ACCEPTABLE' when composite >= 0.70 then 'DEGRADED' else 'FAILURE' end as verdict,
case when saved is null then null when saved >= 80 and semantic >= 0.90 then 'EXCELLENT' when saved >= 80 and semantic >= 0.85 then 'PASSED' when saved >= 70 and semantic >= 0.85 then 'GOOD' when saved >= 80 then 'CONSISTENCY RISK' when saved < 70 and semantic >= 0.85 then 'LOW COMPRESSION' else 'BELOW TARGETS' end as combined from
(select task_id, round(composite, 9) as composite, round(semantic, 9) as semantic, round(saved, 9) as saved from score)""")
def response_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The bands of every pair's composite score, and of its tokens saved with its consistency."""
    s = quality.scores(table(spark, sf, "response_pairs")).select("task_id", *(F.round(c, 9).alias(c) for c in ("composite", "semantic", "saved")))
    return s.select("task_id", quality.verdict(F.col("composite")).alias("verdict"), quality.combined_verdict(F.col("saved"), F.col("semantic")).alias("combined"))


@query(f"""
with {_PAIRS.split('full_pair')[0].rstrip().rstrip(',')}, full_pair as (select task_id, question as response_full, response_full as response_bridge from pair where question is not null and response_full is not null), {_COSINE}
select task_id, round(cosine, 4) as confidence from cosine""")
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Term cosine of each question and its full answer."""
    return quality.confidence(table(spark, sf, "response_pairs"), "response_full")


@query(f"with {_SCORES}, g as (select composite, {_words('response_full')} >= 20 and {_words('response_bridge')} >= 20 as long from score join full_pair using (task_id)) select count(*) filter (long) as kept, count(*) filter (not long) as dropped, round(avg(composite) filter (long), 4) as mean_score from g")
def gated_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of the pairs whose answers are long enough on both sides."""
    return quality.gated_mean(table(spark, sf, "response_pairs"))


@query()
def interface_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The longest common subsequence of every Python file's interface and its compressed form."""
    heads = corpus.interfaces(_files(spark, sf)).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "entry"))), lambda x: x["entry"]), "\n").alias("heads"))
    out = rewriting.rewrite(_files(spark, sf), _changed(spark, sf)).where("language = 'python'").select("path", "compressed")
    both = corpus.distinct_files(_files(spark, sf)).join(out, "path").join(heads, "path", "left")
    texts = both.select("path", "content", "compressed", F.coalesce("heads", F.substring("content", 1, 500)).alias("interface"))
    return quality.routed_score(texts, "path", "content", "compressed", "interface").select("path", F.round("score", 6).alias("score"))


_MAPPED = r"regexp_extract_all(kept, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"


@query(rf"""
with {_TURNS}, tk as (select conv_id, turn_id, unnest(l) as token, generate_subscripts(l, 1) as i from (select conv_id, turn_id, regexp_extract_all(content, '[a-zA-Z_][\p{{L}}\p{{N}}_]{{4,}}') as l from turn)),
c as (select conv_id, token, count(*) as n, min((turn_id, i)) as first from tk group by 1, 2),
r as (select *, row_number() over (partition by conv_id order by n desc, first) as place from c),
f as (select conv_id, map(list(token), list(substr(token, 1, 3) || length(token))) as m from r where place <= 10 and n >= 3 and length(token) >= 7 group by 1),
g as (select conv_id, string_agg(role || ': ' || content, ' ' order by turn_id) as whole, coalesce(string_agg(role || ': ' || content, ' ' order by turn_id) filter (not pruned), '') as kept from judged group by 1),
s as (select conv_id, whole, case when m is null then kept else array_to_string(list_transform({_MAPPED}, lambda x: coalesce(m[x], x)), '') end as short from g left join f using (conv_id)),
z as (select conv_id, whole, case when len(regexp_extract_all(short, '\S+')) > 38 then array_to_string(regexp_extract_all(short, '\S+')[1:38], ' ') || ' [...]' else short end as zipped from s)
select conv_id, zipped, {_tokens('whole')} as tokens_before, {_tokens('zipped')} as tokens_after, round({_tokens('zipped')} / greatest({_tokens('whole')}, 1), 4) as ratio from z""")
def history_substituted(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations condensed, with recurring long words by short keys, and the ratio of tokens left."""
    return history.zipped(history.turns(table(spark, sf, "documents")))
