"""Quality rules as a short-circuit cascade.

Every text's words (`[^\\x20\\x09-\\x0D]+`), symbols, repeated lines and repeated 8-word windows are counted, then rules
judge the texts that pass the base rule. A rule's cost and the share that it rejects are estimated on a bounded sample
of texts (`SAMPLE`, first by a hash of the id); rules then run in order of rejections for each second, and each only on
the texts that the earlier ones left. The order decides the time, never a verdict.

One pass, no shuffle of text: the sample is a top-k of ids, then a filtered read.

Defined results: null counts as the empty text, which fails the base rule (under 20 words). Lines are split at \\n only;
a line counts as repeated if it has a word and equals an earlier line. n_repeat_words counts the words that lie in an
8-word window found twice or more in the text. Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import WordHash, rolling, sub_batches, trimmed

#: Fixed values of the contract.
SPACES, SYMBOLS, WINDOW, LEAST_WORDS, REPEAT_SHARE = " \t\n\x0b\x0c\r", "#*$%&|<>", 8, 20, 30
SAMPLE = 512
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


class Text:
    """A text with its counts."""

    def __init__(self, text: str, hashes: WordHash):
        self.text = text
        self.words = [w for w in _SPACE.split(text) if w]
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, SPACES))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(hashes.of(self.words))


def repeated_words(h: np.ndarray) -> int:
    """Words inside windows of `WINDOW` words that occur twice or more."""
    if len(h) <= WINDOW:
        return 0
    windows = rolling(h, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:-WINDOW][twice] += 1
    edge[WINDOW:][twice] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


#: True where a rule rejects. Each sees a text that passed the base rule.
RULES: dict[str, Callable[[Text], bool]] = {
    "mean_word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "repeated_lines": lambda t: t.n_dup_lines > 3 and 100 * t.n_dup_lines > 30 * (t.text.count("\n") + 1),
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "few_letters": lambda t: 10 * sum(any(map(str.isalpha, w)) for w in t.words) < 7 * t.n_words,
    "shouting": lambda t: 2 * sum(w.isupper() for w in t.words if len(w) > 1) > t.n_words,
    "few_distinct_words": lambda t: 10 * len(set(t.words)) < t.n_words and len(set(t.words)) < 100,
}


def base_failed(t: Text) -> bool:
    return t.n_words < LEAST_WORDS or 100 * t.n_repeat_words > REPEAT_SHARE * t.n_words


def plan(texts: list[str], rules: dict[str, Callable] = RULES) -> list[str]:
    """The rules' names by rejections for each second on `texts`, the best first."""
    seen = [t for t in (Text(x or "", WordHash()) for x in texts) if not base_failed(t)]
    rate = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(map(rule, seen))
        rate[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda x: (-rate[x], x))


def judge(docs: DataFrame, order: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`'s columns, the counts, base_failed, kept and the rule that rejected (`base`, a rule, or null)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    order = list(order)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for part, texts in sub_batches(batches, "__text"):
            counts = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
            failed, by = np.zeros(len(texts), bool), [None] * len(texts)
            for i, text in enumerate(texts):
                t = Text(text or "", hashes)
                for k in COUNTS:
                    counts[k][i] = getattr(t, k)
                if base_failed(t):
                    failed[i], by[i] = True, "base"
                else:
                    by[i] = next((name for name in order if RULES[name](t)), None)
            out = part.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *(pa.array(counts[k]) for k in COUNTS), pa.array(failed), pa.array([x is None for x in by]), pa.array(by, pa.string())],
                names=[*out.schema.names, *COUNTS, "base_failed", "kept", "rejected_by"],
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(trimmed(tell), f"{fields}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean, rejected_by string")


def cascade(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The verdicts of all documents, with rules ordered on a sample."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long").distinct()
    texts = [r.text for r in docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").limit(sample).collect()]
    return judge(docs, plan(texts))
