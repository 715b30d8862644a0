"""Embedders, planners and classifiers: deterministic defaults, and clients of HTTP services where one is configured."""

from __future__ import annotations

import json
import os
import re
import socket
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from kestrion.functions import text

DOCUMENT_PREFIX, QUERY_PREFIX, AT_ONCE = "search_document: ", "search_query: ", 32
#: Calls of a chat model that one task has under way.
CALLS_AT_ONCE = 8


class ModelError(RuntimeError):
    """A service that doesn't answer, or answers what wasn't asked."""


def post(url: str, body: dict, timeout: float, headers: dict | None = None):
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError) as error:
        raise ModelError(f"{url}: {error}") from error


@dataclass(frozen=True)
class StubEmbedder:
    """One-hot vectors at a hash of the text."""

    dim: int = 768

    def embed(self, texts: list[str], prefix: str = DOCUMENT_PREFIX) -> list[np.ndarray]:
        out = np.zeros((len(texts), self.dim), np.float32)
        out[np.arange(len(texts)), [xxhash.xxh3_64_intdigest(t.encode()) % self.dim for t in texts]] = 1
        return list(out)


@dataclass(frozen=True)
class HttpEmbedder:
    """A text-embeddings service: POST {inputs} to /embed, a list of vectors back."""

    url: str
    dim: int
    timeout: float = 60.0

    def embed(self, texts: list[str], prefix: str = DOCUMENT_PREFIX) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for low in range(0, len(texts), AT_ONCE):
            part = [prefix + t for t in texts[low : low + AT_ONCE]]
            got = post(self.url.rstrip("/") + "/embed", {"inputs": part}, self.timeout)
            if len(got) != len(part) or any(len(v) != self.dim for v in got):
                raise ModelError(f"{self.url}: {len(got)} vectors for {len(part)} texts, or not of {self.dim} dimensions")
            out += [np.asarray(v, np.float32) for v in got]
        return out

    def verify(self, model: str) -> None:
        """Refuses a server of another model or dimension, whose vectors would spoil a store for good. A server that doesn't tell its model passes."""
        self.embed(["ping"], QUERY_PREFIX)
        try:
            with urllib.request.urlopen(self.url.rstrip("/") + "/info", timeout=self.timeout) as answer:
                found = json.loads(answer.read()).get("model_id")
        except (OSError, ValueError, AttributeError):
            return
        if found and found != model:
            raise ModelError(f"{self.url} serves {found}, not {model}")


def embed_column(embedder, prefix: str = DOCUMENT_PREFIX):
    """A vector for each text, null where the embedder fails; in Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series(embedder.embed(texts.fillna("").tolist(), prefix), dtype=object)
            except ModelError:
                yield pd.Series([None] * len(texts), dtype=object)

    return run


@dataclass(frozen=True)
class ChatClient:
    """A chat model over HTTP: `openai` (POST /chat/completions) or `messages` (POST /v1/messages)."""

    url: str
    model: str
    protocol: str = "openai"
    key: str = ""
    timeout: float = 3.0
    most_tokens: int = 512
    headers: tuple[tuple[str, str], ...] = ()
    thinking: bool | None = None  # None: the server's own choice; False spares a local model's long deliberation

    def endpoint(self) -> str:
        return self.url.rstrip("/") + ("/chat/completions" if self.protocol == "openai" else "/v1/messages")

    def ask(self, system: str, prompt: str) -> str:
        if self.protocol == "openai":
            headers = ({"Authorization": f"Bearer {self.key}"} if self.key else {}) | dict(self.headers)
            body = {"model": self.model, "max_tokens": self.most_tokens, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            if self.thinking is not None:
                body["chat_template_kwargs"] = {"enable_thinking": self.thinking}
            got = post(self.endpoint(), body, self.timeout, headers)
            try:
                return got["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError) as error:
                raise ModelError("no message in the reply") from error
        body = {"model": self.model, "max_tokens": self.most_tokens, "system": system, "messages": [{"role": "user", "content": prompt}]}
        got = post(self.endpoint(), body, self.timeout, {"x-api-key": self.key, **dict(self.headers)})
        try:
            return "".join(part.get("text", "") for part in got["content"])
        except (KeyError, TypeError) as error:
            raise ModelError("no content in the reply") from error


def resolve_model(name: str, aliases: dict[str, str], protocol: str) -> str:
    """A model's full name. Aliases belong to the `messages` protocol; elsewhere an alias is a mistake that is told at once."""
    if protocol == "messages":
        return aliases.get(name, name)
    if name.strip().lower() in aliases:
        raise ModelError(f"{name!r} is an alias of the messages protocol; name the provider's own model")
    return name


def require_key(variable: str) -> str:
    """The key in an environment variable."""
    key = os.environ.get(variable, "").strip()
    if not key:
        raise ModelError(f"set {variable}")
    return key


PLAN_PROMPT = (
    "Decide what project knowledge would help with the user's prompt. Answer with one JSON object: "
    '{"skip": true} if none would, else lists of strings named projects, type_names, topics, doc_types (contract, plan, convention, meta) '
    "and languages (go, rust, scala, proto, openapi, helm, markdown)."
)
CLASSIFY_PROMPT = (
    "Classify the file. Answer with one JSON object with doc_type (contract, plan, convention or meta) and language "
    "(go, rust, scala, proto, openapi, helm, markdown or unknown)."
)


def ask_column(client: ChatClient, system: str):
    """The model's reply to each prompt, null where it fails; up to CALLS_AT_ONCE calls of a task wait together."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def run(prompts: pd.Series) -> pd.Series:
        def one(prompt):
            try:
                return client.ask(system, prompt or "")
            except ModelError:
                return None

        with ThreadPoolExecutor(CALLS_AT_ONCE) as pool:
            return pd.Series(list(pool.map(one, prompts)), dtype=object)

    return run


_TYPE_NAME = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+\b")
_WORD = re.compile(r"[^\W\d_]{4,}")
#: Words that say nothing about a topic, and whole prompts that need no context.
COMMON = frozenset("about after again also because before could does from have here into just like make more need only over please should show some than that their them then there these they this those through using want were what when where which while will with would write your".split())
SMALL_TALK = frozenset("hello hi thanks thank ok okay yes no continue go stop".split())


def plan_by_rules(prompt: str | None, projects: list[str], domain_values: dict[str, tuple[str, ...]]) -> dict:
    """A plan without a model: known projects, CamelCase names, longer words, and values of enumerations that the prompt names."""
    words = re.findall(r"[\w-]+", (prompt or "").lower())
    if not words or (len(words) <= 3 and all(w in SMALL_TALK for w in words)):
        return {"skip": True}
    types = list(dict.fromkeys(_TYPE_NAME.findall(prompt)))
    topics = list(dict.fromkeys(w.lower() for w in _WORD.findall(prompt) if w.lower() not in COMMON and w not in types))
    return {"skip": False, "projects": [p for p in projects if p.lower() in words], "type_names": types, "topics": topics, **{k: [v for v in values if v in words] for k, values in domain_values.items()}}


def plans_by_rules(prompts: DataFrame, projects: list[str], domain_values: dict[str, tuple[str, ...]]) -> DataFrame:
    """query_id, reply from (query_id, prompt): rule-based plans in the form of a model's reply."""
    from pyspark.sql.types import StringType

    reply = F.pandas_udf(lambda s: s.map(lambda p: json.dumps(plan_by_rules(p, projects, domain_values))), StringType())
    return prompts.select("query_id", reply("prompt").alias("reply"))


def classify_by_extension(files: DataFrame) -> DataFrame:
    """files with doc_type, language, class_error: by extension alone."""
    return files.withColumn("doc_type", F.lit("convention")).withColumn("language", text.fallback_language(F.col("source_path"))).withColumn("class_error", F.lit(None).cast("string"))


def classify_by_model(client: ChatClient):
    """A classifier that shows a model each file's name and head."""

    def run(files: DataFrame) -> DataFrame:
        from kestrion.functions.secrets import head
        from kestrion.operators.planning import parse_classifications

        prompt = F.concat(F.lit("File name: "), text.title(F.col("source_path")), F.lit("\nExtension: "), text.extension(F.col("source_path")), F.lit("\n\n"), head(F.col("content")))
        replies = files.select(F.col("source_path").alias("path"), ask_column(client, CLASSIFY_PROMPT)(prompt).alias("reply"))
        parsed = parse_classifications(replies).withColumnRenamed("path", "source_path").withColumnRenamed("error", "class_error")
        return files.join(parsed, "source_path")

    return run


def socket_address(url: str) -> tuple[str, int] | None:
    """(host, port) of a URL, the scheme's port by default."""
    parts = urlsplit(url if "://" in url else f"http://{url}")
    try:
        return (parts.hostname, parts.port or (443 if parts.scheme == "https" else 80)) if parts.hostname else None
    except ValueError:
        return None


def reachable(url: str, timeout: float = 0.2) -> bool:
    """Whether something accepts connections there."""
    at = socket_address(url)
    if at is None:
        return False
    try:
        socket.create_connection(at, timeout).close()
    except OSError:
        return False
    return True


def cost_estimate(files: int, each: float = 0.0002) -> float:
    return files * each
