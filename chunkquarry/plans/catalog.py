"""The catalogue of queries over the given tables, each with the SQL that DuckDB can run for the same result.

Queries that a parser, a stream or a vector product computes have no SQL; their tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import chunking, corpus, experiments, history, masking, quality, ranking, rewriting, zones
from ..sources.tables import table
from ..streaming import channels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- pieces of SQL

_Q = TOKEN_SQL = lexicon.TOKEN_PATTERN.replace("'", "''")
_ALNUM = r"^[\p{L}\p{N}]+$"


def _tokens(c: str) -> str:
    found = f"regexp_extract_all({c}, '{_Q}', 0, 's')"
    return f"coalesce(len({found}) + len(list_filter({found}, lambda u: length(u) > 8 and regexp_matches(u, '{_ALNUM}'))), 0)"


def _words(c: str) -> str:
    return rf"coalesce(len(regexp_extract_all({c}, '\S+')), 0)"


def _names(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[a-zA-Z_][\p{{L}}\p{{N}}_]*')"


def _terms(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[a-zA-Z_][\p{{L}}\p{{N}}_]*|[0-9]+')"


def _lines(c: str) -> str:
    return f"string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_LANG = "case lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1)) when 'py' then 'python' when 'c' then 'c' when 'h' then 'c' when 'cc' then 'c' when 'cpp' then 'c' when 'go' then 'go' when 'rs' then 'rust' end"
_CHUNKS = "chunk as (select distinct on (chunk_no) * from chunks where chunk_no is not null)"
_FILES = "file as (select path, max(content) as content from source_files where path is not null group by path)"
_LINE = f"line as (select path, unnest({_lines('content')}) as line, generate_subscripts({_lines('content')}, 1) as line_no from file where content is not null)"


def _pi(language: str) -> str:
    """SQL of predictability from n, k, s."""
    beyond, cap = ("0.60", "0.30") if language == "c" else ("greatest(0.0, 0.70 - (n - 35) * 0.02)", "0.35")
    ladder = f"case when n <= 2 then 0.95 when n <= 5 then 0.90 when n <= 10 then 0.85 when n <= 20 then 0.80 when n <= 35 then 0.70 else {beyond} end"
    bonus = "case when k = 0 and n > 0 and s >= 0.5 * n then 0.15 else 0.0 end + case when k = 0 and n > 20 then 0.10 else 0.0 end"
    return f"greatest(0.0::double, least(1.0::double, ({ladder})::double - least({cap}::double, 0.06::double * k) + ({bonus})::double))"


def _features(c: str, hard: str, simple: str) -> str:
    held = rf"list_filter({_lines(c)}, lambda x: regexp_matches(x, '\S'))"
    q = lambda p: p.replace("'", "''")
    return f"len({held}) as n, len(list_filter({held}, lambda x: regexp_matches(x, '{q(hard)}'))) as k, len(list_filter({held}, lambda x: regexp_matches(x, '{q(simple)}'))) as s"


_SCORED = f"""scored as (
  select chunk_no, file_path, start_line, n, k, s, case when lang = 'c' then {_pi('c')} when n = 0 then 1.0 else {_pi('python')} end as pi
  from (select chunk_no, file_path, start_line, 'c' as lang, {_features('source', lexicon.C_COMPLEX, lexicon.C_SIMPLE)} from chunk where source is not null and coalesce({_LANG.format('file_path')}, '') = 'c'
        union all
        select chunk_no, file_path, start_line, 'python', {_features('stripped', lexicon.PY_COMPLEX, lexicon.PY_SIMPLE)} from (select *, {_strip('source')} as stripped from chunk where source is not null and coalesce({_LANG.format('file_path')}, '') <> 'c')))"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files")


# ---- text measures


@query(f"with {_CHUNKS} select chunk_no, {_tokens('source')} as tokens, {_words('source')} as words from chunk")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens and words of every chunk, next to the recorded number."""
    return corpus.distinct_chunks(_chunks(spark, sf), text.count_tokens(F.col("source")).alias("tokens"), text.count_words(F.col("source")).alias("words"))


@query(f"select doc_id, term, count(*) as n from (select doc_id, unnest({_terms('text')}) as term from documents) group by 1, 2")
def term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies of every document."""
    each = table(spark, sf, "documents").select("doc_id", F.explode(text.terms(F.col("text"))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("""
with ch as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(text, '')) as c from documents where length(text) > 0) group by 1, 2),
tot as (select doc_id, sum(n) as total from ch group by 1)
select doc_id, round(sum(-(n / total) * log2(n / total)), 6) as entropy from ch join tot using (doc_id) group by 1""")
def char_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Bits per character of every document that has any."""
    ch = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    n = ch.groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    sums = n.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("doc_id", F.round(F.abs(F.log2("t") - F.col("s") / F.col("t")), 6).alias("entropy"))


@query(f"with {_CHUNKS}, {_SCORED} select chunk_no, round(pi, 6) as pi from scored")
def predictability(spark: SparkSession, sf: str) -> DataFrame:
    """How predictable every chunk is in its language."""
    return corpus.distinct_chunks(zones.predicted(_chunks(spark, sf).where("source is not null")), F.round("pi", 6).alias("pi"))


_BRANCHES = " + ".join(f"(length(low) - length(replace(low, {lit}, ''))) // {n}" for lit, n in (("' if '", 4), ("chr(9) || 'if('", 4), ("chr(10) || 'if('", 4), ("' for('", 5), ("' while('", 7), ("' switch('", 8)))


@query(f"""
with {_CHUNKS}, b as (select chunk_no, end_line - start_line + 1 as n, {_BRANCHES} as branches from (select *, lower(source) as low from chunk where source is not null))
select chunk_no, branches, case when branches >= 8 or n > 150 then 'complex' when branches >= 3 or n > 40 then 'moderate' else 'simple' end as complexity from b""")
def complexity_class(spark: SparkSession, sf: str) -> DataFrame:
    """Branches and complexity class of every chunk."""
    rows = _chunks(spark, sf).where("source is not null")
    return corpus.distinct_chunks(rows, text.branches(F.col("source")).alias("branches"), text.complexity(F.col("source"), F.col("end_line") - F.col("start_line") + 1).alias("complexity"))


_STOPS = ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS)
_PRUNED = r"case when length(w) < 5 or not regexp_matches(w[1], '\p{L}') then w else w[1] || regexp_replace(w[2:-2], '([bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])[aeiouAEIOU]+', '\1', 'g') || w[-1] end"


def _squeezed(c: str) -> str:
    return rf"array_to_string(list_transform(list_filter(regexp_extract_all({c}, '\S+'), lambda w: lower(regexp_replace(w, '^[^a-zA-Z]+|[^a-zA-Z]+$', '', 'g')) not in ({_STOPS})), lambda w: {_PRUNED}), ' ')"


@query(f"select doc_id, {_squeezed('text')} as squeezed from documents where text is not null")
def compressed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without stop words and with vowels pruned."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.compress_text(F.col("text")).alias("squeezed"))


@query(rf"""
with {_FILES}, {_LINE},
c as (select path, line_no, line from line where lower(path) like '%.py' and regexp_matches(line, '^\s*#'))
select path, line_no, regexp_extract(line, '^(\s*)(#+\s*)(.*)$', 1) || regexp_extract(line, '^(\s*)(#+\s*)(.*)$', 2) || {_squeezed("regexp_extract(line, '^(\\s*)(#+\\s*)(.*)$', 3)")} as squeezed from c""")
def compressed_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comment lines of Python files, squeezed."""
    lines = corpus.file_lines(_files(spark, sf).where(F.lower("path").endswith(".py"))).where(F.col("line").rlike(r"^\s*#"))
    return lines.select("path", "line_no", text.compress_comment(F.col("line")).alias("squeezed"))


_SWAPPED = "line"
for _long, _short in sorted(lexicon.SYNONYMS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
    _SWAPPED = rf"regexp_replace({_SWAPPED}, '\b{_long}\b', '{_short}', 'gi')"


@query(rf"""
with {_FILES}, {_LINE},
c as (select path, line_no, line from line where lower(path) like '%.py' and regexp_matches(line, '^\s*(#|"|'')'))
select path, line_no, swapped from (select path, line_no, line, {_SWAPPED} as swapped from c) where swapped <> line""")
def synonym_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Comment and docstring lines of Python files in which a long word gives way to a short one."""
    lines = corpus.file_lines(_files(spark, sf).where(F.lower("path").endswith(".py"))).where(F.col("line").rlike(r"""^\s*(#|"|')"""))
    return lines.withColumn("swapped", text.swap_synonyms(F.col("line"))).where("swapped <> line").select("path", "line_no", "swapped")


@query(f"""
with {_CHUNKS} select chunk_no, sha256(source) as hash, substr(sha256(source || '|0'), 1, 8) as short, ('0x' || substr(md5(chunk_id), 1, 8))::bigint as point from chunk""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Content hash, short hash and point number of every chunk."""
    return corpus.distinct_chunks(_chunks(spark, sf), F.sha2("source", 256).alias("hash"), text.short_hash(F.col("source"), F.lit(0)).alias("short"), text.point_id(F.col("chunk_id")).alias("point"))


# ---- mining and caches


@query(rf"""
with {_FILES}, {_LINE}, s as (select path, {_strip('line')} as line from line where lower(path) like '%.py')
select line, count(distinct path) as n_files from s where line like 'import %' or line like 'from %' group by 1""")
def import_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """In how many Python files each import line stands."""
    return corpus.import_frequency(_files(spark, sf))


def _mined(kind: str) -> str:
    pattern = lexicon.MINED[kind].removeprefix("(?m)").removeprefix("(?s)").replace("'", "''")
    if lexicon.MINED[kind].startswith("(?m)"):
        pattern = pattern.replace("^[", "(?:^|\\n)[", 1)
    return f"select path, '{kind}' as pattern_type, unnest(regexp_extract_all(content, '{pattern}', 0, '{'s' if kind == 'comment_block' else 'n'}')) as m from c"


_MINED_SQL = rf"""
{_FILES}, c as (select path, content from file where {_LANG.format('path')} = 'c'),
raw as ({' union all '.join(_mined(k) for k in lexicon.MINED)}),
pat as (
  select path, pattern_type, {_strip('m')} as pattern from raw where pattern_type in ('include', 'pragma')
  union all select path, pattern_type, p from (select *, {_strip('m')} as p from raw where pattern_type = 'define') where length(p) <= 120
  union all select path, pattern_type, array_to_string(regexp_extract_all(m, '\S+')[1:12], ' ') from raw where pattern_type = 'comment_block' and length(m) > 40
  union all select path, pattern_type, m from raw where pattern_type = 'identifier' and length(m) >= 13 group by 1, 2, 3 having count(*) >= 4),
mined as (select pattern_type, pattern, count(distinct path) as n_files from pat group by 1, 2 having count(distinct path) >= 3)"""


@query(rf"""
with {_MINED_SQL}
select pattern_type, pattern, n_files, sha256(pattern) as hash, '§' || substr(sha256(pattern), 1, 8) as token,
       row_number() over (partition by pattern_type order by n_files desc, pattern) as place from mined""")
def mined_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Includes, defines, pragmas, comment blocks and identifiers that recur in C files, with the tokens that stand for them."""
    return corpus.mined_tokens(corpus.mine_patterns(_files(spark, sf)))


_CACHE = "cache as (select sha256(rtrim(original)) as hash, max_by(compressed, (mined_at, pattern_no, compressed)) as compressed from patterns where original is not null and compressed is not null group by 1)"
_HASHED = f"{_FILES}, {_LINE}, h as (select path, line_no, sha256(rtrim(line)) as hash from line where regexp_matches(line, '\\S'))"


@query(f"with {_HASHED}, {_CACHE} select path, count(*) as lines, count(compressed) as hits, bool_or(compressed is not null) as any_hit from h left join cache using (hash) group by 1")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every file and how many of them the pattern cache holds."""
    return corpus.cache_hits(_files(spark, sf), corpus.hash_cache(table(spark, sf, "patterns")))


@query(f"with {_HASHED}, {_CACHE} select hash, count(distinct path) as n_files from h anti join cache using (hash) group by 1")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lines the cache lacks, which would have to be embedded."""
    return corpus.uncached(_files(spark, sf), corpus.hash_cache(table(spark, sf, "patterns")))


@query(f"with {_FILES} select regexp_extract(path, '^[^/]*') as repo, coalesce({_LANG.format('path')}, 'other') as language, count(*) as files, sum(coalesce(len({_lines('content')}), 0))::bigint as lines, sum({_words('content')})::bigint as words, sum({_tokens('content')})::bigint as tokens from file group by 1, 2")
def repo_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Files, lines, words and tokens by repository and language."""
    return corpus.repo_rollup(_files(spark, sf))


@query(f"""
with {_FILES}, {_LINE},
m as (select path, line_no, line, {_strip('line')} as s from line where lower(path) like '%.py'),
m2 as (select *, s like 'import %' or s like 'from %' or regexp_matches(s, '{lexicon.BOILERPLATE_LINE.replace("'", "''")}') as maskable from m),
reg as (select line, '[§:' || substr(sha256(line || '|' || salt), 1, 8) || ']' as marker from (
  select line, row_number() over (partition by substr(sha256(line || '|0'), 1, 8) order by line) - 1 as salt from (select distinct line from m2 where maskable))),
j as (select m2.path, line_no, m2.line, marker, marker is not null and maskable and {_tokens('marker')} < {_tokens('m2.line')} as hit from m2 left join reg using (line))
select path, string_agg(case when hit then marker else line end, chr(10) order by line_no) as masked, sum(hit::bigint)::bigint as n_masked,
       sum({_tokens('line')})::bigint as tokens_before, sum(case when hit then {_tokens('marker')} else {_tokens('line')} end)::bigint as tokens_after
from j group by path""")
def masked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Python files with boilerplate lines behind markers."""
    return masking.mask(_files(spark, sf))


@query("select path, true as same from (select path, max(content) as content from source_files where path is not null group by path) where lower(path) like '%.py' and content is not null")
def mask_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether masking and unmasking gives every Python file back."""
    return masking.round_trip(_files(spark, sf))


def _pattern_markers(spark: SparkSession, sf: str) -> DataFrame:
    return masking.pattern_registry(corpus.tokens_of(corpus.mine_patterns(_files(spark, sf))))


_PATTERN_LINES = rf"""{_MINED_SQL}, {_LINE},
known as (select distinct pattern as key, '§' || substr(sha256(pattern), 1, 8) as marker from mined where pattern_type in ('include', 'define', 'pragma')),
saves as (select * from known where {_tokens('marker')} < {_tokens('key')}),
pl as (select path, line_no, line, marker from (select *, {_strip('line')} as key from line where {_LANG.format('path')} = 'c') left join saves using (key))"""


@query(rf"""
with {_PATTERN_LINES}
select path, string_agg(case when marker is null then line else regexp_extract(line, '^(\s*).*?(\s*)$', 1) || marker || regexp_extract(line, '^(\s*).*?(\s*)$', 2) end, chr(10) order by line_no) as masked, count(marker) as n_masked
from pl group by path""".replace("\\\\", "\\"))
def pattern_masked_files(spark: SparkSession, sf: str) -> DataFrame:
    """C files with mined includes, defines and pragmas behind their tokens."""
    return masking.mask_patterns(_files(spark, sf), _pattern_markers(spark, sf))


@query(f"with {_FILES} select path, true as same from file where content is not null and {_LANG.format('path')} = 'c'")
def pattern_mask_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether masking and unmasking patterns gives every C file back."""
    known = _pattern_markers(spark, sf)
    back = masking.unmask_patterns(masking.mask_patterns(_files(spark, sf), known), known)
    whole = corpus.distinct_files(_files(spark, sf)).select("path", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    return back.join(whole, "path").select("path", (F.col("restored") == F.col("content")).alias("same"))


_RARE = "case when c then w not in ({c}) and w not like '\\_%' escape '\\' and length(w) >= 4 else w not in ({py}) and w not like '\\_\\_%' escape '\\' and length(w) >= 3 end".format(c=", ".join(f"'{x}'" for x in lexicon.C_COMMON), py=", ".join(f"'{x}'" for x in lexicon.PY_COMMON))


@query(rf"""
with {_CHUNKS}, x as (select chunk_no, coalesce({_LANG.format('file_path')} = 'c', false) as c, unnest(regexp_extract_all(source, '[a-zA-Z_]\w*')) as w from chunk where lower(chunk_type) in ('function', 'method')),
n as (select chunk_no, c, w, count(*) as n from x group by 1, 2, 3)
select chunk_no, place::int as place, w as word from (select chunk_no, w, row_number() over (partition by chunk_no order by n, w) as place from n where not (w = upper(w) and w <> lower(w)) and {_RARE}) where place <= 15""")
def rare_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """The rarest identifiers of every function."""
    return corpus.rare_identifiers(_chunks(spark, sf))


_DOC_LINE = corpus.DOC_LINE.replace("'", "''")


@query(rf"""
with {_FILES}, {_LINE}, b as (select path, line_no, {_strip('line')} as bare from line where lower(path) like '%.py'),
a as (select *, lead(bare) over (partition by path order by line_no) as after from b),
h as (select *, regexp_extract(after, '{_DOC_LINE}', 1) as told from a where regexp_matches(bare, '^(?:def|class|async def) '))
select path, line_no, case when length(told) > 0 then bare || '  # ' || substr(told, 1, 120) else bare end as entry from h""")
def python_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of functions and classes with the first line of their docstring."""
    return corpus.interfaces(_files(spark, sf))


# ---- calls

_BUILTINS = ", ".join(f"'{x}'" for x in lexicon.CALL_BUILTINS)
_CALLS = r"""call as (select chunk_no, name, unnest(l) as callee, generate_subscripts(l, 1) as i from (select chunk_no, name, regexp_extract_all(source, '\b([A-Za-z_]\w+)\s*\(', 1) as l from chunk)),
first as (select chunk_no, name, callee, row_number() over (partition by chunk_no order by min(i)) - 1 as place from call where length(callee) >= 2 group by 1, 2, 3)"""


@query(f"with {_CHUNKS}, {_CALLS} select chunk_no, place::int as place, callee from first where place < 30 and callee not in ({_BUILTINS}) and lower(callee) <> lower(coalesce(name, ''))")
def chunk_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Names each chunk calls, in the order of the first call."""
    return corpus.callees(_chunks(spark, sf))


@query("""
with m as (select distinct on (file_path, chunk_id) file_path, chunk_id, name, callee_names from fn_meta where name is not null),
c as (select lower(name) as caller, lower(unnest(callee_names)) as name from m),
n as (select name, count(distinct caller) as n_callers from c where caller <> name group by 1),
d as (select lower(name) as name, count(*) as n_definitions from m group by 1)
select name, n_definitions, coalesce(n_callers, 0) as n_callers from d left join n using (name)""")
def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions and callers of every function name."""
    return corpus.callers(table(spark, sf, "fn_meta"))


@query("""
with m as (select distinct on (file_path, chunk_id) * from fn_meta)
select regexp_extract(file_path, '^[^/]*') as repo, count(*) as functions, count(*) filter (complexity = 'complex') as complex_functions, count(*) filter (length(trim(summary)) > 0) as summarized from m group by 1""")
def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of every repository's index, complex ones, and those with a summary."""
    m = table(spark, sf, "fn_meta").dropDuplicates(["file_path", "chunk_id"])
    return m.groupBy(F.substring_index("file_path", "/", 1).alias("repo")).agg(F.count("*").alias("functions"), F.count_if(F.col("complexity") == "complex").alias("complex_functions"), F.count_if(F.length(F.trim("summary")) > 0).alias("summarized"))


# ---- ranking: questions are the patterns whose number is divisible by 100

_QUESTIONS = "question as (select pattern_no as qid, min(original) as q from patterns where pattern_no % 100 = 0 and original is not null group by 1)"
_ASKED = f"asked as (select distinct qid, unnest({_names('q')}) as term from question)"
_REC_TERMS = f"rt as (select rec, term, size, count(*) as n from (select chunk_no as rec, len({_names('source')}) as size, unnest({_names('source')}) as term from chunk) group by 1, 2, 3)"
_KEYWORD = "kw as (select qid, rec, sum(n) / ln(size + 2) as score from rt join asked using (term) group by qid, rec, size)"


def _best(cte: str, k: int) -> str:
    return f"select qid, rec, score, place from (select *, row_number() over (partition by qid order by score desc, rec) as place from {cte}) where place <= {k}"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "patterns").where("pattern_no % 100 = 0 and original is not null")
    return p.groupBy(F.col("pattern_no").alias("qid")).agg(F.min("original").alias("question"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.distinct_chunks(_chunks(spark, sf), "source").select(F.col("chunk_no").alias("rec"), F.col("source").alias("text"))


@query(f"with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD} select qid, rec, round(score, 9) as score, place::int as place from ({_best('kw', 5)})")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five chunks that match each question's words best."""
    top = ranking.best(ranking.keyword_scores(_questions(spark, sf), _records(spark, sf)), 5)
    return top.select("qid", "rec", F.round("score", 9).alias("score"), "place")


_FIELD_RECORDS = """fr as (select c.chunk_no as rec, m.name, m.signature, m.callee_names, m.summary, m.line_count from chunk c join
  (select file_path, chunk_id, min(name) as name, min(signature) as signature, min(callee_names) as callee_names, min(summary) as summary, min(line_count) as line_count from fn_meta group by 1, 2) m using (file_path, chunk_id))"""


def _field_part(c: str, value: str) -> str:
    w = lexicon.FIELD_WEIGHTS[c]
    return f"select qid, rec, {w} * count(*) / sqrt(size) as part from (select distinct rec, len(list_distinct({_names(value)})) as size, unnest({_names(value)}) as term from fr) join asked using (term) group by qid, rec, size"


_FIELDS = f"""{_FIELD_RECORDS}, parts as (
  {' union all '.join(_field_part(c, v) for c, v in (('name', 'name'), ('signature', 'signature'), ('callees', "array_to_string(callee_names, ' ')"), ('summary', 'summary')))}
  union all select qid, rec, {lexicon.SYMBOL_BOOST} from (select rec, lower(name) as term from fr) join asked using (term)
  union all select qid, rec, case when line_count > {lexicon.LARGE_FUNCTION_LINES} then score / ln(line_count) else score end from kw join (select rec, line_count from fr) using (rec)),
fs as (select qid, rec, round(sum(part), 9) as score from parts group by 1, 2)"""


def _field_records(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "fn_meta").groupBy("file_path", "chunk_id").agg(*(F.min(a).alias(b) for a, b in (("name", "name"), ("signature", "signature"), ("callee_names", "callees"), ("summary", "summary"), ("line_count", "line_count"))))
    c = corpus.distinct_chunks(_chunks(spark, sf), "file_path", "chunk_id", "source")
    return c.join(m, ["file_path", "chunk_id"]).select(F.col("chunk_no").alias("rec"), F.col("source").alias("text"), "name", "signature", "callees", "summary", "line_count")


@query(f"with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, {_FIELDS} select qid, rec, score, place::int as place from ({_best('fs', 5)})")
def field_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five function chunks that match each question best by name, signature, callees, summary and body."""
    return ranking.best(ranking.field_scores(_questions(spark, sf), _field_records(spark, sf)), 5)


@query(f"""
with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, {_FIELDS}, a as ({_best('kw', 10)}), b as ({_best('fs', 10)}),
f as (select qid, rec, round(sum(1.0::double / ({lexicon.RRF_CONSTANT} + place)), 12) as score from (select qid, rec, place from a union all select qid, rec, place from b) group by 1, 2)
select qid, rec, score, place::int as place from ({_best('f', 5)})""")
def fused_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and field ranking fused by reciprocal ranks."""
    asked = _questions(spark, sf)
    words = ranking.best(ranking.keyword_scores(asked, _records(spark, sf)), 10)
    fields = ranking.best(ranking.field_scores(asked, _field_records(spark, sf)), 10)
    return ranking.fuse([words, fields], 5)


@query("""
with e as (select vec_id, embedding::double[] as v from embeddings), s as (
  select q.vec_id as qid, r.vec_id as rec, list_cosine_similarity(q.v, r.v) as score from e q join e r on true where q.vec_id % 100 = 0)
select qid, rec, round(score, 6) as score, place::int as place from (select *, row_number() over (partition by qid order by score desc, rec) as place from s) where place <= 5""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five vectors nearest to each vector whose id is divisible by 100."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    top = ranking.dense_top(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), v.withColumnRenamed("vec_id", "rec"), 5)
    return top.select("qid", "rec", F.round("score", 6).alias("score"), "place")


_CHAINED = f"""{_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, {_FIELDS},
ranked as (select *, row_number() over (partition by qid order by score desc, rec) as place from fs),
nm as (select c.chunk_no as rec, lower(min(m.name)) as name, min(callee_names) as cal, min(caller_names) as clr from chunk c join fn_meta m using (file_path, chunk_id) group by 1),
want as (select distinct qid, lower(unnest(list_concat(coalesce(cal, [])[1:3], coalesce(clr, [])[1:2]))) as name from ranked join nm using (rec) where place <= 5),
more as (select qid, rec, score, place, row_number() over (partition by qid order by place) as n from ranked join nm using (rec) semi join want using (qid, name) where place > 5)"""


@query(f"with {_CHAINED} select qid, rec, score, place::int as place, false as added from ranked where place <= 5 union all select qid, rec, score, null::int, true from more where n <= 2")
def chain_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The five best function chunks of each question and up to two that they call or are called by."""
    scored = ranking.field_scores(_questions(spark, sf), _field_records(spark, sf))
    m = table(spark, sf, "fn_meta").groupBy("file_path", "chunk_id").agg(F.min("name").alias("name"), F.min("callee_names").alias("callees"), F.min("caller_names").alias("callers"))
    named = corpus.distinct_chunks(_chunks(spark, sf), "file_path", "chunk_id").join(m, ["file_path", "chunk_id"]).select(F.col("chunk_no").alias("rec"), "name", "callees", "callers")
    return ranking.expand(scored, named, 5)


@query(f"""
with {_CHUNKS}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, top as ({_best('kw', 5)})
select qid, string_agg(source, chr(10) || '---' || chr(10) order by place) as context from top join chunk on chunk_no = rec group by 1""")
def question_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The context of each question: its five best chunks in order."""
    records = _records(spark, sf)
    return ranking.contexts(ranking.best(ranking.keyword_scores(_questions(spark, sf), records), 5), records)


# ---- zones; changed lines are the starts of complex functions

_CHANGED = "changed as (select distinct file_path, start_line as line from fn_meta where complexity = 'complex' and file_path is not null and start_line is not null)"
_ZONED = f"""{_CHUNKS}, {_SCORED}, {_CHANGED},
near as (select chunk_no, any_value(s.file_path) as file_path, any_value(pi) as pi, min(abs(start_line - line)) as distance from scored s left join changed c on s.file_path = c.file_path group by 1),
zoned as (select chunk_no, file_path, pi, coalesce(exp(-0.1 * distance), 0.0) as hzs from near)"""


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fn_meta").where("complexity = 'complex'").select("file_path", F.col("start_line").alias("line")).dropna().distinct()


@query(f"with {_ZONED} select chunk_no, round(pi, 6) as pi, round(hzs, 6) as hzs, case when hzs > 0.10 or pi < 0.70 then 'FOREGROUND' else 'BACKGROUND' end as zone from zoned")
def zone_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Foreground and background of all chunks."""
    z = zones.classify(_chunks(spark, sf), _changed(spark, sf))
    return z.select("chunk_no", F.round("pi", 6).alias("pi"), F.round("hzs", 6).alias("hzs"), "zone")


@query(f"""
with {_ZONED}, r as (select regexp_extract(file_path, '^[^/]*') as repo, count(*) filter (hzs > 0.10 or pi < 0.70) as foreground, count(*) filter (not (hzs > 0.10 or pi < 0.70)) as background from zoned group by 1)
select repo, foreground, background, round(foreground / (foreground + background), 6) as ratio, round(1 - abs(foreground / (foreground + background) - 0.20), 6) as confidence from r""")
def zone_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Zones by repository."""
    r = zones.zone_rollup(zones.classify(_chunks(spark, sf), _changed(spark, sf)))
    return r.select("repo", "foreground", "background", F.round("ratio", 6).alias("ratio"), F.round("confidence", 6).alias("confidence"))


@query()
def question_context(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the chunks found for each question, their zone and tokens, and what the context of a question costs."""
    top = ranking.best(ranking.keyword_scores(_questions(spark, sf), _records(spark, sf)), 5)
    z = zones.classify(_chunks(spark, sf), _changed(spark, sf)).select(F.col("chunk_no").alias("rec"), "zone")
    size = token_counts(spark, sf).select(F.col("chunk_no").alias("rec"), "tokens")
    return top.join(z, "rec").join(size, "rec").groupBy("qid").agg(F.count("*").alias("chunks"), F.count_if(F.col("zone") == "FOREGROUND").alias("foreground"), F.sum("tokens").alias("tokens"), F.round(F.max("score"), 9).alias("best_score"))


ORACLES["question_context"] = f"""
with {_ZONED}, {_QUESTIONS}, {_ASKED}, {_REC_TERMS}, {_KEYWORD}, top as ({_best('kw', 5)})
select qid, count(*) as chunks, count(*) filter (hzs > 0.10 or pi < 0.70) as foreground, sum({_tokens('source')})::bigint as tokens, round(max(score), 9) as best_score
from top join zoned z on z.chunk_no = rec join chunk c on c.chunk_no = rec group by 1"""


# ---- quality of paired responses

_PAIRS = "pair as (select distinct on (task_id) * from response_pairs where task_id is not null), full_pair as (select * from pair where response_full is not null and response_bridge is not null)"
_COSINE = f"""t as (select task_id, side, unnest(l) as term from (select task_id, 0 as side, {_terms('response_full')} as l from full_pair union all select task_id, 1, {_terms('response_bridge')} from full_pair)),
tf as (select task_id, term, count(*) filter (side = 0) as n, count(*) filter (side = 1) as m from t group by 1, 2),
cs as (select task_id, sum(n * m) as dot, sum(n * n) as nn, sum(m * m) as mm from tf group by 1),
cosine as (select p.task_id, case when nn > 0 and mm > 0 then dot / (sqrt(nn) * sqrt(mm)) else 0.0 end as cosine from full_pair p left join cs using (task_id))"""


@query(f"with {_PAIRS}, {_COSINE} select task_id, round(cosine, 6) as cosine from cosine")
def response_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Term cosine of the two responses of each pair."""
    out = quality.cosine(quality.distinct_pairs(table(spark, sf, "response_pairs")), "task_id", "response_full", "response_bridge")
    return out.select("task_id", F.round("cosine", 6).alias("cosine"))


@query(f"""
with {_PAIRS}, {_COSINE}, u as (select task_id, count(*) filter (n > 0) as u from tf group by 1),
w as (select task_id, n * w as x, m * w as y from (select task_id, n, m, case when n > 0 then greatest(ln(u / (1 + n)), 0.01) else 1.0 end as w from tf join u using (task_id))),
s as (select task_id, sum(x * y) as dot, sum(x * x) as xx, sum(y * y) as yy from w group by 1)
select p.task_id, round(case when xx > 0 and yy > 0 then dot / (sqrt(xx) * sqrt(yy)) else 0.0 end, 6) as cosine from full_pair p left join s using (task_id)""")
def response_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """The same weighted by rarity within the full response."""
    out = quality.tfidf_cosine(quality.distinct_pairs(table(spark, sf, "response_pairs")), "task_id", "response_full", "response_bridge")
    return out.select("task_id", F.round("cosine", 6).alias("cosine"))


_FENCED = "list_distinct(regexp_extract_all(array_to_string(regexp_extract_all({0}, '```(?:python)?\\n(.*?)```', 1, 's'), chr(10)), '[a-zA-Z_]\\w*'))"
_OVERLAP = f"over as (select task_id, case when len(a) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end as overlap from (select task_id, {_FENCED.format('response_full')} as a, {_FENCED.format('response_bridge')} as b from full_pair))"
_COMPOSITE = "(0.25 * cosine + 0.15 * overlap + case when functional >= 0 then 0.40 * functional else 0 end + case when judge >= 0 then 0.20 * judge else 0 end) / (0.40 + case when functional >= 0 then 0.40 else 0 end + case when judge >= 0 then 0.20 else 0 end)"
_SCORES = f"{_PAIRS}, {_COSINE}, {_OVERLAP}, score as (select task_id, cosine as semantic, overlap, {_COMPOSITE} as composite, case when full_tokens > 0 then 100.0 * (full_tokens - bridge_tokens) / full_tokens end as saved from full_pair join cosine using (task_id) join over using (task_id))"


@query(f"with {_SCORES} select task_id, round(semantic, 6) as semantic, round(overlap, 6) as overlap, round(composite, 6) as composite, round(saved, 6) as saved from score")
def response_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity, code overlap, composite score and tokens saved of each pair."""
    s = quality.scores(table(spark, sf, "response_pairs"))
    return s.select("task_id", *(F.round(c, 6).alias(c) for c in ("semantic", "overlap", "composite", "saved")))


@query(f"with {_SCORES} select count(*) as pairs, round(avg(saved), 6) as saved, round(avg(composite), 6) as composite, count(*) filter (round(composite, 9) < 0.85) as below from score")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, mean saving, mean score, and how many fall below the floor."""
    s = quality.scores(table(spark, sf, "response_pairs"))
    return s.agg(F.count("*").alias("pairs"), F.round(F.avg("saved"), 6).alias("saved"), F.round(F.avg("composite"), 6).alias("composite"), F.count_if(F.round("composite", 9) < 0.85).alias("below"))


@query()
def response_rouge(spark: SparkSession, sf: str) -> DataFrame:
    """Longest common subsequence score of each pair."""
    return quality.rouge_l(quality.distinct_pairs(table(spark, sf, "response_pairs")), "task_id", "response_full", "response_bridge")


@query(rf"""
with {_PAIRS}
select task_id, coalesce(nullif({_strip("regexp_extract(response_full, '```(?:python)?\\n(.*?)```', 1, 's')")}, ''), nullif({_strip("regexp_extract(response_full, '(def \\w+.*?)(?:\\n\\n|\\z)', 1, 's')")}, '')) as code from pair""")
def response_code(spark: SparkSession, sf: str) -> DataFrame:
    """The first code block of each full response."""
    return quality.distinct_pairs(table(spark, sf, "response_pairs")).select("task_id", quality.code_block("response_full").alias("code"))


_IDS = r"list_sort(list_distinct(regexp_extract_all({0}, '[a-zA-Z_]\w*')))"


@query(f"""
with {_PAIRS}, i as (select task_id, {_IDS.format('response_full')} as a, {_IDS.format('response_bridge')} as b from full_pair)
select task_id, array_to_string(list_filter(a, lambda x: not list_contains(b, x))[1:8], ' ') as lost, array_to_string(list_filter(b, lambda x: not list_contains(a, x))[1:5], ' ') as gained from i""")
def response_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that only one of the two responses has, the first of each in order."""
    rows = quality.distinct_pairs(table(spark, sf, "response_pairs")).where("response_full is not null and response_bridge is not null")
    ids = lambda c: F.array_distinct(text.matches(F.col(c), r"[a-zA-Z_]\w*"))
    s = rows.select("task_id", ids("response_full").alias("a"), ids("response_bridge").alias("b"))
    part = lambda x, y, n: F.array_join(F.slice(F.sort_array(F.array_except(x, y)), 1, n), " ")
    return s.select("task_id", part("a", "b", 8).alias("lost"), part("b", "a", 5).alias("gained"))


_REJECTED = "|".join(lexicon.REJECTED)


@query(f"""with {_PAIRS} select task_id, {_words('response_bridge')} >= 20 and not regexp_matches(lower(response_bridge), '{_REJECTED.replace("'", "''")}') as accepted from pair where response_bridge is not null""")
def answer_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each short answer has enough words and none of the phrases that reject it."""
    rows = quality.distinct_pairs(table(spark, sf, "response_pairs")).where("response_bridge is not null")
    ok = (text.count_words(F.col("response_bridge")) >= 20) & ~F.lower("response_bridge").rlike(_REJECTED)
    return rows.select("task_id", ok.alias("accepted"))


@query("""
with d as (select distinct on (seq) * from decisions where seq is not null),
v as (select decision_type, case when decision_value like '{%' then json_extract_string(decision_value, '$.zone') end as zone, case when decision_value like '{%' then json_extract_string(decision_value, '$.tier')::bigint else try_cast(decision_value as bigint) end as value from d)
select decision_type, coalesce(zone, '(number)') as zone, count(*) as n, count(value) as n_values, sum(value)::bigint as total, max(value) as most from v group by 1, 2""")
def decision_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Values of decisions, which are numbers or JSON, by type and zone."""
    d = history.distinct_decisions(table(spark, sf, "decisions"))
    is_json = F.col("decision_value").like("{%")
    v = d.select("decision_type", F.when(is_json, F.get_json_object("decision_value", "$.zone")).alias("zone"), F.when(is_json, F.get_json_object("decision_value", "$.tier")).otherwise(F.col("decision_value")).try_cast("bigint").alias("value"))
    return v.groupBy("decision_type", F.coalesce("zone", F.lit("(number)")).alias("zone")).agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"), F.max("value").alias("most"))


# ---- histories and audit

_TURNS = rf"""l as (select doc_id as conv_id, unnest({_lines('text')}) as line, generate_subscripts({_lines('text')}, 1) - 1 as turn_id from documents where doc_id is not null),
turn as (select conv_id, turn_id, regexp_extract(line, '{history.ROLE}', 1) as role, regexp_extract(line, '{history.ROLE}', 2) as content from l where regexp_matches(line, '{history.ROLE}')),
judged as (select *, (w < 3 or (w < 10 and names < 0.15 * w)) as pruned from (select *, {_words('content')} as w, len(regexp_extract_all(content, '[a-zA-Z_][\p{{L}}\p{{N}}_]{{3,}}')) as names from turn))"""


@query(f"with {_TURNS} select conv_id, turn_id::int as turn_id, role, pruned from judged")
def turn_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all conversations and whether they say too little."""
    said = history.turns(table(spark, sf, "documents"))
    return said.select("conv_id", "turn_id", "role", history.pruned().alias("pruned"))


@query(rf"""
with {_TURNS}, g as (select conv_id, count(*) as n_turns, count(*) filter (pruned) as n_pruned, string_agg(role || ': ' || content, ' ' order by turn_id) as whole,
  coalesce(string_agg(role || ': ' || content, ' ' order by turn_id) filter (not pruned), '') as kept from judged group by 1),
z as (select *, case when len(regexp_extract_all(kept, '\S+')) > 38 then array_to_string(regexp_extract_all(kept, '\S+')[1:38], ' ') || ' [...]' else kept end as zipped from g)
select conv_id, n_turns::int as n_turns, n_pruned::int as n_pruned, zipped, {_tokens('whole')} as tokens_before, {_tokens('zipped')} as tokens_after from z""")
def history_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations condensed to their first words."""
    return history.condense(history.turns(table(spark, sf, "documents")))


@query(rf"""
with {_TURNS}, tk as (select conv_id, turn_id, unnest(l) as token, generate_subscripts(l, 1) as i from (select conv_id, turn_id, regexp_extract_all(content, '[a-zA-Z_][\p{{L}}\p{{N}}_]{{4,}}') as l from turn)),
c as (select conv_id, token, count(*) as n, min((turn_id, i)) as first from tk group by 1, 2),
r as (select *, row_number() over (partition by conv_id order by n desc, first) as place from c)
select conv_id, token, n, substr(token, 1, 3) || length(token) as short_key from r where place <= 10 and n >= 3 and length(token) >= 7""")
def session_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Long tokens that recur in a conversation."""
    return history.facts(history.turns(table(spark, sf, "documents")))


_DECISIONS = "d as (select distinct on (seq) * from decisions where seq is not null)"


@query(f"""
with {_DECISIONS}, x as (select coalesce(agent_id, '(none)') as agent, coalesce(decision_type, '(none)') as kind, confidence from d)
select agent, kind, count(*) as n, round(avg(confidence), 9) as confidence, grouping_id(agent, kind)::bigint as level from x group by grouping sets ((agent), (kind), ())""")
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by agent, by type, and in all."""
    return history.audit_summary(table(spark, sf, "decisions"))


@query(f"with {_DECISIONS} select seq, decision_id, agent_id, decision_type, substr(rationale, 1, 100) as rationale, round(confidence, 4) as confidence from d order by seq desc limit 20")
def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last 20 decisions."""
    return history.tail(table(spark, sf, "decisions"))


@query(f"""
with {_DECISIONS}, r as (select *, row_number() over (partition by agent_id, decision_type order by ts desc, seq desc) as k from d where agent_id is not null and ts is not null)
select agent_id, decision_type, decision_value, seq from r where k = 1""")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """The newest value of each agent's decisions of a type."""
    return history.latest(table(spark, sf, "decisions"))


@query("""
with recursive r as (select slice_id, max(parent_slice_id) as parent from decisions where slice_id is not null group by 1),
w as (select slice_id, parent as up, 0 as depth from r union all select w.slice_id, r.parent, w.depth + 1 from w join r on w.up = r.slice_id where w.depth < 64)
select slice_id, max(depth)::int as depth from w group by 1""")
def slice_depth(spark: SparkSession, sf: str) -> DataFrame:
    """How deep each message slice lies below its first ancestor."""
    return history.slice_depth(table(spark, sf, "decisions"))


@query("""
with a as (select task_id, regexp_extract_all(coalesce(max(question), ''), '[a-z]+_[a-z_]+') as asked, regexp_extract_all(coalesce(max(response_full), ''), '[a-z]+_[a-z_]+') as said from response_pairs where task_id is not null group by 1)
select task_id, len(list_distinct(asked))::int as asked, len(list_distinct(said))::int as said, len(list_intersect(asked, said))::int as both, len(list_distinct(list_concat(asked, said)))::int as either,
       len(list_filter(list_distinct(asked), lambda x: not list_contains(said, x)))::int as missed from a""")
def name_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the question and of the full response as sets."""
    p = table(spark, sf, "response_pairs").where("task_id is not null").groupBy("task_id").agg(F.max("question").alias("q"), F.max("response_full").alias("r"))
    names = lambda c: F.array_distinct(text.matches(F.coalesce(F.col(c), F.lit("")), "[a-z]+_[a-z_]+"))
    s = p.select("task_id", names("q").alias("a"), names("r").alias("b"))
    return s.select("task_id", F.size("a").alias("asked"), F.size("b").alias("said"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("missed"))


# ---- experiments

_GRID_FEATURES = f"""feature as (select n, k, (s >= 0.5 * n) as plain, count(*) as chunks, sum(tokens) as tokens from (
  select {_features('stripped', lexicon.PY_COMPLEX, lexicon.PY_SIMPLE)}, {_tokens('source')} as tokens from (select *, {_strip('source')} as stripped from chunk where source is not null and lower(chunk_type) in ('function', 'method') and {_LANG.format('file_path')} = 'python')) group by 1, 2, 3)"""
_GRID = f"""{_CHUNKS}, {_GRID_FEATURES},
g as (select unnest([{', '.join(map(str, experiments.GRID['threshold']))}])::double as threshold), h as (select unnest([{', '.join(map(str, experiments.GRID['penalty']))}])::double as penalty),
tried as (select *, {_pi('python').replace('0.06::double', 'penalty').replace('s >= 0.5 * n', 'plain')} as pi from feature, g, h),
result as (select threshold, penalty, sum(case when round(pi, 9) >= threshold then chunks else 0 end)::bigint as dropped, sum(case when round(pi, 9) >= threshold then tokens else 0 end)::bigint as tokens_dropped, sum(tokens)::bigint as tokens from tried group by 1, 2)"""


@query(f"with {_GRID} select threshold, penalty, dropped, tokens_dropped, tokens, round(tokens_dropped / tokens, 6) as share from result")
def parameter_grid(spark: SparkSession, sf: str) -> DataFrame:
    """What each setting of threshold and penalty would drop."""
    return experiments.skeleton_grid(_chunks(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"with {_GRID} select threshold, penalty, round(tokens_dropped / tokens, 6) as share from result order by abs(tokens_dropped / tokens - 0.5), threshold, penalty limit 1")
def best_setting(spark: SparkSession, sf: str) -> DataFrame:
    """The setting that drops closest to half of the tokens."""
    return experiments.best_setting(experiments.skeleton_grid(_chunks(spark, sf))).withColumn("share", F.round("share", 6))


_RUNS = "runs as (select user_id as run, avg(k) as score, round(avg(value), 6) as elapsed from (select user_id, value, regexp_extract(props, '[0-9]+')::bigint as k from events where user_id is not null) group by 1)"
_ADJUSTED = f"{_RUNS}, med as (select median(elapsed) as m from runs where elapsed > 0), adj as (select run, score, elapsed, score * case when elapsed > 0 then greatest(0.1, least(3.0, m / elapsed)) else 1.0 end as adjusted from runs, med)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("user_id is not null").select("user_id", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    return e.groupBy(F.col("user_id").alias("run")).agg(F.avg("k").alias("score"), F.round(F.avg("value"), 6).alias("elapsed"))


@query(f"with {_ADJUSTED} select run, round(score, 6) as score, elapsed, round(adjusted, 6) as adjusted from adj")
def speed_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of runs corrected for their speed against the median."""
    s = experiments.speed_adjusted(_runs(spark, sf))
    return s.select("run", F.round("score", 6).alias("score"), "elapsed", F.round("adjusted", 6).alias("adjusted"))


@query(f"with {_ADJUSTED} select run, round(score, 6) as score, elapsed, round(adjusted, 6) as adjusted from adj order by round(adjusted, 9) desc, run limit 20")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best runs."""
    s = experiments.speed_adjusted(_runs(spark, sf)).withColumn("adjusted", F.round("adjusted", 9))
    return experiments.leaderboard(s).select("run", F.round("score", 6).alias("score"), "elapsed", F.round("adjusted", 6).alias("adjusted"))


# ---- parsing and rewriting


@query()
def extracted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every source file."""
    return chunking.with_ids(chunking.extract(_files(spark, sf)))


@query()
def stage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every file before, after dropping bodies, and after squeezing comments; changed lines keep their bodies."""
    return rewriting.stage_tokens(_files(spark, sf), _changed(spark, sf))


@query()
def compression_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The same summed by language."""
    return rewriting.token_rollup(rewriting.stage_tokens(_files(spark, sf), _changed(spark, sf)))


@query()
def compressed_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Term cosine of every file and its rewritten form."""
    out = rewriting.rewrite(_files(spark, sf), _changed(spark, sf)).select("path", "compressed")
    both = out.join(corpus.distinct_files(_files(spark, sf)), "path")
    return quality.cosine(both, "path", "content", "compressed").select("path", F.round("cosine", 6).alias("cosine"))


# ---- streams

_STREAM_COUNTS = "select event_type, count(*) as n from events group by 1"


@query(_STREAM_COUNTS)
def stream_channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages per channel, counted by a streaming query that drains the table."""
    events = channels.channel(spark, sf, "events")
    return channels.drain(events.groupBy("event_type").agg(F.count("*").alias("n")), spark, "counts", "complete")


@query("""
select time_bucket(interval 1 hour, ts) as begins, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents
from events where ts is not null group by 1, 2""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Messages per channel and hour by a streaming window aggregation."""
    out = channels.drain(channels.windowed_counts(channels.channel(spark, sf, "events")), spark, "windows", "update")
    return channels.current(out, "w", "event_type").select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "event_type", "n", "cents")


@query("""
select user_id, count(*) as n, min(event_id) as first_id, max(event_id) as last_id, max_by(event_type, event_id) as last_type
from events where user_id is not null and event_id is not null group by 1""")
def stream_user_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state kept for each user by a stateful streaming query."""
    return channels.newest(channels.drain(channels.user_state(channels.channel(spark, sf, "events")), spark, "state"))


from . import index, runs  # noqa: E402, F401  they register their queries here
