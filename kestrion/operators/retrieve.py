"""Answering prompts: plan, search, select, render; with an outcome for every prompt and no exception for any of them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kestrion.functions import models, text
from kestrion.operators import assemble, planning, search
from kestrion.sources.scratch import Scratch

#: Why nothing was injected on purpose, and where an answer failed, in the order of the steps.
SKIPS = ("empty-prompt", "router-skip", "no-hits")
STAGES = ("stdin", "config", "router-build", "embedder-build", "db-open", "router-plan", "embed-query", "query")


@dataclass(frozen=True)
class Settings:
    alpha: float = search.ALPHA
    budget: int = assemble.BUDGET
    min_score: float = assemble.MIN_SCORE
    tag: str = assemble.TAG
    stem: bool = True


def plan_prompts(prompts: DataFrame, projects: DataFrame, client: models.ChatClient | None = None) -> DataFrame:
    """query_id, status and the five lists; an empty prompt is `empty`, a reply that can't be read malformed."""
    if client:
        replies = prompts.select("query_id", models.ask_column(client, models.PLAN_PROMPT)("prompt").alias("reply"))
    else:
        names = [r.name for r in projects.select("name").collect()]
        replies = models.plans_by_rules(prompts, names, {"doc_types": planning.DOC_TYPES, "languages": planning.LANGUAGES})
    plans = planning.parse_replies(replies)
    empty = prompts.where("prompt is null or trim(prompt) = ''").select("query_id", F.lit(True).alias("__empty"))
    return plans.join(empty, "query_id", "left").withColumn("status", F.when(F.col("__empty"), "empty").otherwise(F.col("status"))).drop("__empty")


def retrieve(prompts: DataFrame, chunks: DataFrame, projects: DataFrame, embedder, settings: Settings = Settings(), client: models.ChatClient | None = None, overrides: DataFrame | None = None, index: search.TermIndex | None = None, took: dict[str, int] | None = None, planned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes) for (query_id, prompt).

    hits: query_id, place, chunk_id, bm25, cosine, bm25_norm, final, relaxed, label, doc_type, content, token_est, tokens_used, cumulative_tokens.
    outcomes: query_id, outcome (injected, skip, failed), reason (of SKIPS), stage (of STAGES), block, chunks, tokens.
    With `took`, plans, vectors and hits are written one after the other and their milliseconds noted there. Plans may be given as `planned`.
    """

    def timed(df: DataFrame, name: str) -> DataFrame:
        if took is None:
            return df
        began = time.time()
        out = Scratch(df.sparkSession, "retrieve").keep(df, name)
        took[f"{name}_ms"] = int((time.time() - began) * 1000)
        return out

    planned = timed(plan_prompts(prompts, projects, client) if planned is None else planned, "router")
    if overrides is not None:
        planned = planning.override(planned, overrides)
    asked = prompts.join(planned.where("status = 'ok'").select("query_id"), "query_id", "left_semi")
    vectors = timed(asked.select("query_id", models.embed_column(embedder, models.QUERY_PREFIX)(F.col("prompt")).alias("embedding")), "embed")
    active = planned.where("status = 'ok'").join(vectors, "query_id")
    named = active
    active = search.resolve_projects(active.where("embedding is not null"), projects)
    found = search.hybrid_search(chunks, active, settings.alpha, stem=settings.stem, index=index)
    scored = found.join(chunks.select("chunk_id", "label", "doc_type", "content", text.token_estimate(F.col("content")).alias("token_est")), "chunk_id")
    picked = assemble.cumulative_tokens(assemble.select_within_budget(scored, settings.budget, settings.min_score)).drop("token_est")
    hits = timed(picked.join(scored, ["query_id", "chunk_id"]), "query")
    if took is not None:
        picked = hits
    tags = assemble.resolve_domains(named, projects).select("query_id", assemble.tag_of(F.col("domain"), settings.tag).alias("tag"))
    blocks = assemble.render(hits.join(tags, "query_id"), F.col("tag"))
    totals = picked.groupBy("query_id").agg(F.count("*").cast("int").alias("chunks"), F.max("tokens_used").alias("tokens"))
    failed_vector = named.where("embedding is null").select("query_id", F.lit(True).alias("__failed"))
    out = planned.select("query_id", "status").join(failed_vector, "query_id", "left").join(blocks, "query_id", "left").join(totals, "query_id", "left")
    stage = F.when(F.col("status") == "malformed", "router-plan").when(F.col("__failed"), "embed-query")
    reason = F.when(F.col("status") == "empty", "empty-prompt").when(F.col("status") == "skip", "router-skip").when(stage.isNull() & F.col("block").isNull(), "no-hits")
    outcome = F.when(stage.isNotNull(), "failed").when(reason.isNotNull(), "skip").otherwise("injected")
    return hits, out.select("query_id", outcome.alias("outcome"), reason.alias("reason"), stage.alias("stage"), "block", "chunks", "tokens")
