"""Whole texts cut into windows of whole lines that an embedder can take."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrion.operators.definitions import disambiguate

MOST_TOKENS = 1500
MOST_CHARS = MOST_TOKENS * 4
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def windows(text: str, label: str) -> list[tuple[str, str, bool]]:
    """(label, content, whether it is the head of a longer line) in order.

    A text within the ceiling is one window. Else lines, ends included, are packed greedily; a line beyond the ceiling stands alone and
    keeps its head only.
    """
    if len(text) <= MOST_CHARS:
        return [(label, text, False)]
    out, held, size = [], [], 0
    for m in _LINE.finditer(text):
        line = m[0]
        if held and size + len(line) > MOST_CHARS:
            out.append(("".join(held), False))
            held, size = [], 0
        if len(line) > MOST_CHARS:
            if held:
                out.append(("".join(held), False))
                held, size = [], 0
            out.append((line[:MOST_CHARS], True))
        else:
            held.append(line)
            size += len(line)
    if held:
        out.append(("".join(held), False))
    return [(name, content, cut) for (name, content), (_, cut) in zip(disambiguate([(label, x) for x, _ in out]), out)]


def window_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_index, label, content, token_est, truncated (whether the window is the head of a longer line) from (keys, label, text)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            texts, labels = batch.column(n + 1).to_pylist(), batch.column(n).to_pylist()
            for low in range(0, len(texts), 256):
                found = [windows(t or "", x or "") for t, x in zip(texts[low : low + 256], labels[low : low + 256])]
                at = pa.array([low + i for i, w in enumerate(found) for _ in w])
                flat = [w for ws in found for w in ws]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(at) for k in range(n)),
                        pa.array([i for ws in found for i in range(len(ws))], pa.int32()),
                        pa.array([w[0] for w in flat], pa.string()),
                        pa.array([w[1] for w in flat], pa.string()),
                        pa.array([-(-len(w[1]) // 4) for w in flat], pa.int32()),
                        pa.array([w[2] for w in flat], pa.bool_()),
                    ],
                    names=[*keys, "chunk_index", "label", "content", "token_est", "truncated"],
                )

    return rows.select(*keys, "label", F.col("text")).mapInArrow(run, f"{fields}, chunk_index int, label string, content string, token_est int, truncated boolean")
