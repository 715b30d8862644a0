"""Command line: configure, sync, retrieve, diagnose, server."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

from kestrion.functions import models, text
from kestrion.functions.service import Service
from kestrion.operators import index, planning, retrieve
from kestrion.operators.planning import DOC_TYPES, LANGUAGES, LISTS
from kestrion.sources import config as configs, telemetry
from kestrion.sources.scratch import Scratch
from kestrion.store import Store


def listed(domain: tuple[str, ...] | None = None):
    def parse(value: str) -> list[str]:
        items = [x.strip() for x in value.split(",") if x.strip()]
        if domain and (wrong := [x for x in items if x not in domain]):
            raise argparse.ArgumentTypeError(f"unknown: {', '.join(wrong)}")
        return items

    return parse


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("kestrion")
    parser.add_argument("--home", default="~/.kestrion")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("configure").add_argument("--force", action="store_true")
    sync = commands.add_parser("sync")
    sync.add_argument("repo")
    sync.add_argument("--name")
    sync.add_argument("--domain")
    sync.add_argument("--dry-run", action="store_true")
    commands.add_parser("retrieve").add_argument("prompt", nargs="?")
    commands.add_parser("server").add_argument("action", choices=("start", "stop", "status", "logs"))
    diagnose = commands.add_parser("diagnose")
    diagnose.add_argument("prompt")
    for name in LISTS:
        domain = {"doc_types": DOC_TYPES, "languages": LANGUAGES}.get(name)
        diagnose.add_argument(f"--{name.replace('_', '-')}", type=listed(domain), default=[])
    diagnose.add_argument("--alpha", type=float)
    diagnose.add_argument("--top", type=int, default=10)
    diagnose.add_argument("--stub", action="store_true", help="vectors of the stub embedder; cosines then mean nothing")
    diagnose.add_argument("--no-router", action="store_true", help="the plan is what the options say")
    return parser


class Failed(Exception):
    """A step of an answer that failed."""

    def __init__(self, stage: str, detail: str):
        super().__init__(f"{stage}: {detail}")
        self.stage, self.detail = stage, detail


def step(stage: str, work, *args, **named):
    try:
        return work(*args, **named)
    except Exception as error:
        raise Failed(stage, str(error) or type(error).__name__) from error


def read_prompt(envelope: str) -> str:
    """The prompt of a JSON object; other fields are ignored."""
    prompt = json.loads(envelope)["prompt"]
    if not isinstance(prompt, str):
        raise ValueError("the prompt is no text")
    return prompt


def client_of(service: configs.Service) -> models.ChatClient | None:
    """The configured planner or classifier; None stands for rules."""

    def made(url: str, name: str, protocol: str, key_env: str) -> models.ChatClient:
        key = models.require_key(key_env) if key_env else ""
        return models.ChatClient(url, models.resolve_model(name, service.aliases, protocol), protocol, key, service.timeout_ms / 1000, thinking=service.thinking if protocol == "openai" else None)

    if service.mode == "rules":
        return None
    if service.mode == "http":
        return made(service.url, service.model, service.protocol, service.key_env)
    if service.url and models.reachable(service.url):
        return made(service.url, service.model, service.protocol, service.key_env)
    if service.hosted_url and os.environ.get(service.hosted_key_env, "").strip():
        return made(service.hosted_url, service.hosted_model, service.hosted_protocol, service.hosted_key_env)
    return None


def embedder_of(e: configs.Embeddings, timeout_ms: int, stub: bool = False):
    if stub or not e.url:
        return models.StubEmbedder(e.dims)
    embedder = models.HttpEmbedder(e.url, e.dims, timeout_ms / 1000)
    embedder.verify(e.model)
    return embedder


def session() -> SparkSession:
    return SparkSession.builder.appName("kestrion").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def answer(home: str, path: str, prompt: str | None) -> tuple[str, dict]:
    """The block to inject, and the telemetry record; whatever fails, a caller gets an empty block and the step that failed."""
    took: dict = {}
    try:
        prompt = step("stdin", lambda: read_prompt(sys.stdin.read())) if prompt is None else prompt
        if not prompt.strip():
            return "", {"outcome": "skip", "reason": "empty-prompt"}
        config = step("config", lambda: configs.load(path) if os.path.exists(path) else configs.Config())
        client = step("router-build", client_of, config.router)
        took["backend"] = client.protocol if client else "rules"
        embedder = step("embedder-build", embedder_of, config.embeddings, config.embeddings.query_timeout_ms)
        spark, d = session(), config.defaults
        store = step("db-open", Store, spark, os.path.join(home, "store"), config.embeddings.model, config.embeddings.dims)
        settings = retrieve.Settings(d.alpha, d.token_budget, d.min_score, d.context_tag)
        prompts = spark.createDataFrame([(0, prompt)], "query_id long, prompt string")
        _, outcomes = step("query", retrieve.retrieve, prompts, store.searchable(), store.table("projects"), embedder, settings, client, None, store.index(), took)
        found = step("query", outcomes.first)
        return found.block or "", {"outcome": found.outcome, "reason": found.reason, "stage": found.stage, "chunks": found.chunks, "tokens": found.tokens} | took
    except Failed as failed:
        return "", {"outcome": "failed", "stage": failed.stage, "error": failed.detail} | took


def header(prompt: str, plan, overrides: dict, settings: retrieve.Settings, how: str, stub: bool) -> list[str]:
    lists = ", ".join(f"{x} {plan[x]}" for x in LISTS) if plan else "none"
    given = ", ".join(f"{k} {v}" for k, v in overrides.items() if v) or "none"
    decision = {"skip": " (says that no context is needed)", "malformed": " (its answer can't be read)", "empty": " (the prompt is empty)"}.get(plan["status"] if plan else "", "")
    return [f"prompt {prompt!r}", f"router {how}{decision}", f"plan {lists}", f"overrides {given}", f"alpha {settings.alpha}, budget {settings.budget} tokens, least score {settings.min_score}", "embedder stub: cosines mean nothing" if stub else "embedder service"]


def diagnose(args, home: str, config: configs.Config) -> list[str]:
    """How a prompt is planned and what is found, arm by arm."""
    spark, e, d = session(), config.embeddings, config.defaults
    stub = args.stub or not e.url
    embedder = embedder_of(e, e.query_timeout_ms, args.stub)
    store = Store(spark, os.path.join(home, "store"), e.model, e.dims)
    settings = retrieve.Settings(d.alpha if args.alpha is None else args.alpha, d.token_budget, d.min_score, d.context_tag)
    given = {x: getattr(args, x) for x in LISTS}
    prompts = spark.createDataFrame([(0, args.prompt)], "query_id long, prompt string")
    overrides = spark.createDataFrame([(0, *given.values())], "query_id long, " + ", ".join(f"{x} array<string>" for x in LISTS))
    client = None if args.no_router else client_of(config.router)
    if args.no_router:
        planned = overrides.withColumn("status", F.lit("ok")).select("query_id", "status", *LISTS)
    else:
        planned = retrieve.plan_prompts(prompts, store.table("projects"), client)
    planned = Scratch(spark, "diagnose").keep(planned, "plan")
    plan = planning.override(planned, overrides).first()
    how = "passed over" if args.no_router else f"{client.protocol} {client.model}" if client else "rules"
    out = header(args.prompt, plan, given, settings, how, stub)
    if plan.status != "ok":
        return [*out, "nothing was searched: the plan is no search"]
    hits, _ = retrieve.retrieve(prompts, store.searchable(), store.table("projects"), embedder, settings, None, overrides, store.index(), {}, planned)
    n = hits.count()
    out.append(f"{n} chunks within the budget" + (f", the best {args.top} shown" if n > args.top else ""))
    for h in hits.withColumn("snippet", text.snippet(F.regexp_replace("content", r"\s+", " "))).orderBy("place").limit(args.top).collect():
        out.append(f"{h.place:3} final {h.final:.4f} bm25 {h.bm25:.4f} ({h.bm25_norm:.4f}) cosine {h.cosine:.4f} tokens {h.token_est} sum {h.cumulative_tokens} {h.label} [{h.doc_type}]" + (" (filters dropped)" if h.relaxed else ""))
        out.append(f"    {h.snippet}")
    return out


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    home = os.path.expanduser(args.home)
    path = os.path.join(home, "config.toml")
    if args.command == "configure":
        print("written" if configs.seed(path, args.force) else "kept", path)
        return 0
    if args.command == "retrieve":
        began = time.time()
        block, record = answer(home, path, args.prompt)
        print(block, end="")
        if record["outcome"] == "failed":
            print(f"kestrion: {record['stage']} failed", file=sys.stderr)
        record = {"ts": int(began)} | record | {"total_ms": int((time.time() - began) * 1000)}
        telemetry.append(os.path.join(home, "telemetry.log"), [telemetry.line(record)])
        return 0
    config = configs.load(path) if os.path.exists(path) else configs.Config()
    if args.command == "server":
        server = Service(home, config.embeddings.launcher_cmd, config.embeddings.url)
        got = getattr(server, args.action)()
        print("\n".join(got) if isinstance(got, list) else got)
        return 0
    if args.command == "diagnose":
        print("\n".join(diagnose(args, home, config)))
        return 0
    spark, e = session(), config.embeddings
    embedder = embedder_of(e, e.sync_timeout_ms)
    client = client_of(config.classifier)
    classify = models.classify_by_model(client) if client else models.classify_by_extension
    store = None if args.dry_run else Store(spark, os.path.join(home, "store"), e.model, e.dims)
    print(index.sync(spark, store, args.repo, args.name, args.domain, args.dry_run, classify, embedder, config.indexer.exclude, client is not None), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
