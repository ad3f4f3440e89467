"""Conversation histories: turns, pruning, condensing, recurring facts, audit trails and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import checkpointed

ROLE = r"^(user|assistant|system): (.*)$"


def turns(documents: DataFrame) -> DataFrame:
    """conv_id, turn_id, role, content from the lines of chat texts ('role: content')."""
    lines = documents.where("doc_id is not null").select(F.col("doc_id").alias("conv_id"), F.posexplode(text.lines(F.col("text"))).alias("turn_id", "line"))
    said = lines.where(F.col("line").rlike(ROLE))
    return said.select("conv_id", "turn_id", F.regexp_extract("line", ROLE, 1).alias("role"), F.regexp_extract("line", ROLE, 2).alias("content"))


def pruned(density: float = 0.15):
    """Whether a turn (turn_id, content) says too little: under three words, or short and almost without identifiers. Negative ids never."""
    words = text.count_words(F.col("content"))
    names = F.size(text.matches(F.col("content"), r"[a-zA-Z_][\p{L}\p{N}_]{3,}"))
    return (F.col("turn_id") >= 0) & ((words < 3) | ((words < 10) & (names < density * words)))


def condense(said: DataFrame, budget: int = 38) -> DataFrame:
    """conv_id, n_turns, n_pruned, zipped, tokens_before, tokens_after: kept turns in order, cut to a number of words."""
    whole = F.concat_ws(": ", "role", "content")
    rows = said.select("conv_id", "turn_id", whole.alias("x"), pruned().alias("drop"))
    parts = F.array_sort(F.collect_list(F.struct("turn_id", "x", "drop")))
    per = rows.groupBy("conv_id").agg(parts.alias("p"))
    all_text = F.array_join(F.transform("p", lambda t: t["x"]), " ")
    kept = F.array_join(F.transform(F.filter("p", lambda t: ~t["drop"]), lambda t: t["x"]), " ")
    words = text.matches(kept, r"\S+")
    zipped = F.when(F.size(words) > budget, F.concat(F.array_join(F.slice(words, 1, budget), " "), F.lit(" [...]"))).otherwise(kept)
    out = per.select("conv_id", F.size("p").alias("n_turns"), F.size(F.filter("p", lambda t: t["drop"])).alias("n_pruned"), zipped.alias("zipped"), text.count_tokens(all_text).alias("tokens_before"))
    return out.withColumn("tokens_after", text.count_tokens(F.col("zipped")))


def facts(said: DataFrame, most: int = 10, least: int = 3, length: int = 7) -> DataFrame:
    """conv_id, token, n, short_key: long tokens that recur, of the ten most frequent (ties: first seen)."""
    each = said.select("conv_id", "turn_id", F.posexplode(text.matches(F.col("content"), r"[a-zA-Z_][\p{L}\p{N}_]{4,}")).alias("i", "token"))
    counts = each.groupBy("conv_id", "token").agg(F.count("*").alias("n"), F.min(F.struct("turn_id", "i")).alias("first"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "first"))
    top = counts.withColumn("place", place).where((F.col("place") <= most) & (F.col("n") >= least) & (F.length("token") >= length))
    return top.select("conv_id", "token", "n", F.concat(F.substring("token", 1, 3), F.length("token").cast("string")).alias("short_key"))


def distinct_decisions(decisions: DataFrame) -> DataFrame:
    """Each seq once."""
    return decisions.where("seq is not null").dropDuplicates(["seq"])


def audit_summary(decisions: DataFrame) -> DataFrame:
    """Decisions in all, by agent and by type (grouping sets); level tells which."""
    d = distinct_decisions(decisions).select(F.coalesce("agent_id", F.lit("(none)")).alias("agent"), F.coalesce("decision_type", F.lit("(none)")).alias("kind"), "confidence")
    agent, kind = F.col("agent"), F.col("kind")
    sets = d.groupingSets([[agent], [kind], []], agent, kind)
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"), F.grouping_id().alias("level"))


def tail(decisions: DataFrame, n: int = 20) -> DataFrame:
    """The last n decisions by seq."""
    return distinct_decisions(decisions).orderBy(F.desc("seq")).limit(n).select("seq", "decision_id", "agent_id", "decision_type", F.substring("rationale", 1, 100).alias("rationale"), F.round("confidence", 4).alias("confidence"))


def latest(decisions: DataFrame) -> DataFrame:
    """agent_id, decision_type, decision_value, seq of the newest decision by time (late rows by their time, ties by seq)."""
    d = distinct_decisions(decisions).where("agent_id is not null and ts is not null")
    newest = d.groupBy("agent_id", "decision_type").agg(F.max(F.struct("ts", "seq", "decision_value")).alias("m"))
    return newest.select("agent_id", "decision_type", "m.decision_value", "m.seq")


def slice_depth(decisions: DataFrame) -> DataFrame:
    """slice_id, depth: how many ancestors a message slice has within the table, null if they run into a cycle.

    Ancestors are followed by pointer doubling: each round joins the table of pointers with itself and doubles the
    distance they span, until no pointer is left. Pointers that are left once they span more than all rows never end.
    """
    rows = decisions.where("slice_id is not null").groupBy("slice_id").agg(F.max("parent_slice_id").alias("parent"))
    known = rows.select(F.col("slice_id").alias("parent"), F.lit(1).cast("long").alias("steps"))
    level = rows.join(known, "parent", "left").select("slice_id", F.when(F.col("steps") == 1, F.col("parent")).alias("up"), F.coalesce("steps", F.lit(0)).alias("depth"))
    level = checkpointed(level)
    for _ in range(level.count().bit_length()):
        if level.where("up is not null").isEmpty():
            break
        above = level.select(F.col("slice_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        level = checkpointed(level.join(above, "up", "left").select("slice_id", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return level.select("slice_id", F.when(F.col("up").isNull(), F.col("depth")).cast("int").alias("depth"))


def substitute(words, keys):
    """Whole words of a text by their short keys (a map column); what stands between words stays."""
    parts = text.matches(words, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+")
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(keys, w), w)), "")


def zipped(said: DataFrame, budget: int = 38) -> DataFrame:
    """conv_id, zipped, tokens_before, tokens_after, ratio: kept turns with recurring long words by their short keys, cut to a number of words."""
    keys = facts(said).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "short_key")))).alias("keys"))  # at most ten
    parts = F.array_sort(F.collect_list(F.struct("turn_id", F.concat_ws(": ", "role", "content").alias("x"), pruned().alias("drop"))))
    per = said.groupBy("conv_id").agg(parts.alias("p")).join(keys, "conv_id", "left")
    whole = F.array_join(F.transform("p", lambda t: t["x"]), " ")
    kept = F.array_join(F.transform(F.filter("p", lambda t: ~t["drop"]), lambda t: t["x"]), " ")
    short = F.when(F.col("keys").isNull(), kept).otherwise(substitute(kept, F.col("keys")))
    words = text.matches(F.col("short"), r"\S+")
    cut = F.when(F.size(words) > budget, F.concat(F.array_join(F.slice(words, 1, budget), " "), F.lit(" [...]"))).otherwise(F.col("short"))
    out = per.select("conv_id", text.count_tokens(whole).alias("tokens_before"), short.alias("short")).select("conv_id", "tokens_before", cut.alias("zipped"))
    sized = out.withColumn("tokens_after", text.count_tokens(F.col("zipped")))
    return sized.withColumn("ratio", F.round(F.col("tokens_after") / F.greatest("tokens_before", F.lit(1)), 4))


def of_agent(decisions: DataFrame, agent: str) -> DataFrame:
    """The decisions of one agent."""
    return distinct_decisions(decisions).where(F.col("agent_id") == agent)
