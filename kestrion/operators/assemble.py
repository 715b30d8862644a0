"""From ranked hits to a context block: budget, tags, rendering, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrion.functions import text

BUDGET, MIN_SCORE, TAG = 10_000, 0.15, "context"


def ranked(hits: DataFrame, score: str = "final") -> DataFrame:
    """query_id and the plan's hits (score, chunk_id, token_est), the best first, as one array; a plan has at most top-k of them."""
    hit = F.struct((-F.col(score)).alias("order"), F.col("chunk_id"), F.col(score).alias("score"), F.coalesce("token_est", F.lit(0)).cast("long").alias("token_est"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def select_within_budget(hits: DataFrame, budget: int = BUDGET, min_score: float = MIN_SCORE, score: str = "final") -> DataFrame:
    """query_id, place (from 1), chunk_id, token_est, tokens_used (of the whole selection).

    Hits are taken from the best down. One that scores too low, or doesn't fit into what the budget has left, is passed over, and the next is tried.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<chunk_id:bigint,token_est:bigint>>").alias("taken"))

    def step(acc: Column, hit: Column) -> Column:
        fits = (hit["score"] >= min_score) & (acc["used"] + hit["token_est"] <= budget)
        grown = F.concat(acc["taken"], F.array(F.struct(hit["chunk_id"].cast("long").alias("chunk_id"), hit["token_est"].alias("token_est"))))
        return F.when(fits, F.struct((acc["used"] + hit["token_est"]).alias("used"), grown.alias("taken"))).otherwise(acc)

    folded = ranked(hits, score).select("query_id", F.aggregate("hits", start, step).alias("r"))
    taken = folded.select("query_id", F.col("r.used").alias("tokens_used"), F.posexplode("r.taken").alias("place", "hit"))
    return taken.select("query_id", (F.col("place") + 1).alias("place"), "hit.chunk_id", "hit.token_est", "tokens_used")


def cumulative_tokens(selected: DataFrame) -> DataFrame:
    """The selection with the running sum of its tokens."""
    order = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return selected.withColumn("cumulative_tokens", F.sum("token_est").over(order))


def render(hits: DataFrame, tag: str | Column = TAG) -> DataFrame:
    """query_id, block from (query_id, place, label, doc_type, content): a tagged block with one section a hit."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    section = F.concat(F.lit("## "), "label", F.lit(" ["), "doc_type", F.lit("]\n"), "content", F.lit("\n"))
    parts = hits.withColumn("__tag", tag).groupBy("query_id").agg(F.first("__tag").alias("tag"), F.array_sort(F.collect_list(F.struct("place", section.alias("s")))).alias("parts"))
    body = F.concat_ws("\n", F.transform("parts", lambda p: p["s"]))
    return parts.select("query_id", F.concat(F.lit("<"), "tag", F.lit(">\n"), body, F.lit("</"), "tag", F.lit(">\n")).alias("block"))


def resolve_domains(plans: DataFrame, projects: DataFrame) -> DataFrame:
    """query_id, domain: of the first named project that has one (names compared case-insensitively in ASCII); null if none has."""
    names = plans.select("query_id", F.posexplode("projects").alias("pos", "name")).withColumn("folded", text.ascii_lower(F.col("name")))
    known = projects.where("domain is not null").select(text.ascii_lower(F.col("name")).alias("folded"), "domain")
    first = names.join(known, "folded").groupBy("query_id").agg(F.min_by("domain", "pos").alias("domain"))
    return plans.select("query_id").join(first, "query_id", "left")


def tag_of(domain: Column, default: str = TAG) -> Column:
    return F.coalesce(F.concat(domain, F.lit("-context")), F.lit(default))
