"""Telemetry: one JSON line a prompt."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from kestrion.functions import text

MOST_BYTES = 5 * 1024 * 1024
FIELDS = ("ts", "outcome", "reason", "stage", "error", "backend", "router_ms", "embed_ms", "query_ms", "total_ms", "chunks", "tokens")


def lines(records: DataFrame) -> DataFrame:
    """value: the records (any of FIELDS; ts in epoch seconds) as JSON without empty fields, errors cut short."""
    there = [c for c in FIELDS if c in records.columns]
    shaped = {"ts": text.iso8601, "error": text.detail}
    return records.select(F.to_json(F.struct(*(shaped.get(c, lambda x: x)(F.col(c)).alias(c) for c in there))).alias("value"))


def line(record: dict) -> str:
    """One record, made on the driver, in the form of `lines`: it must not fail where Spark does."""
    from datetime import datetime, timezone

    shaped = {k: record[k] for k in FIELDS if record.get(k) is not None}
    if "ts" in shaped:
        shaped["ts"] = datetime.fromtimestamp(shaped["ts"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    if len(shaped.get("error", "")) > 200:
        shaped["error"] = shaped["error"][:200] + "…"
    return json.dumps(shaped, ensure_ascii=False, separators=(",", ":"))


def append(path: str, rendered: list[str], most: int = MOST_BYTES) -> bool:
    """Appends lines to a local log; beyond `most` bytes the log becomes <path>.1 first. False, and nothing raised, if that fails."""
    try:
        os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
        if os.path.exists(path) and os.path.getsize(path) > most:
            os.replace(path, f"{path}.1")
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in rendered)
        os.chmod(path, 0o600)
    except OSError:
        return False
    return True
