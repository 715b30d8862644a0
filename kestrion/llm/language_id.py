"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 derived from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds) the vectors of all its n-grams,
and a language's prototype bundles its training texts, each scaled to unit length so that a long text weighs no more
than a short one. A text gets the language whose prototype has the largest cosine with it.

Two passes over the corpus, no shuffle of text: the first adds up one partial vector a language and task in a few merging
tasks (languages x dimensions numbers reach the driver from each, whatever the input), the second broadcasts those prototypes.

Defined results: null text, or a text without a letter: `und`, score 0. Ties go to the language first in order. Texts
are read whole. With no labelled text at all, every text is `und`. Repeated rows are predicted alike; columns other
than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import mix64, sub_batches, trimmed

DIMENSIONS = 1024
ORDER = 3
#: Above so many possible n-grams, those present are found by sorting instead of a table.
DENSE = 4_000_000
#: N-gram vectors that are held at a time.
BLOCK = 8192
#: Unit vectors are added as whole multiples of 1 / SCALE, so that the order of addition doesn't matter.
SCALE = 1 << 20
#: Tasks that add up what the corpus's tasks have bundled.
MERGERS = 16
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        known = np.ones(0x110000, bool)
        known[:0x20000] = [chr(i).isalpha() for i in range(0x20000)]
        known[0xE0000:] = False
        _LETTER.append(known)
    return _LETTER[0]


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """One row of +1 and -1 for each code point; code 0 stands for anything between words."""
    words = np.arange(dims // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = mix64(mix64(codes.astype(np.uint64))[:, None] ^ (words[None, :] << np.uint64(40)), 7)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


class Profiler:
    """N-gram counts and bundled vectors of runs of texts."""

    def __init__(self, dims: int = DIMENSIONS, order: int = ORDER):
        if dims % 64:
            raise ValueError("dimensions must be a multiple of 64")
        self.dims, self.order = dims, order

    def grams(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, number of a distinct n-gram) of every n-gram, and the distinct n-grams' letters."""
        lower = [f" {t.lower()} " if t else "  " for t in texts]
        codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
        codes = np.where(_letters()[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep]
        there = np.zeros(0x110000, bool)
        there[codes] = True
        alphabet = np.flatnonzero(there)
        small = np.zeros(0x110000, np.int64)
        small[alphabet] = np.arange(len(alphabet))
        codes, n = small[codes], len(codes) - self.order + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.order), np.int64)
        key, a = np.zeros(n, np.int64), len(alphabet)
        for k in range(self.order):
            key = key * a + codes[k : k + n]
        whole = owner[:n] == owner[self.order - 1 :]
        key, owner = key[whole], owner[:n][whole]
        if a**self.order <= DENSE:
            seen = np.zeros(a**self.order, bool)
            seen[key] = True
            distinct = np.flatnonzero(seen)
            number = np.zeros(a**self.order, np.int64)
            number[distinct] = np.arange(len(distinct))
            ids = number[key]
        else:
            distinct, ids = np.unique(key, return_inverse=True)
        letters = np.stack([alphabet[distinct // a ** (self.order - 1 - k) % a] for k in range(self.order)], axis=1)
        return owner, ids, letters

    def bind(self, letters: np.ndarray) -> np.ndarray:
        """The n-grams' vectors."""
        codes, at = np.unique(letters, return_inverse=True)
        vectors, at = letter_vectors(codes, self.dims), at.reshape(letters.shape)
        out = np.ones((len(letters), self.dims), np.int8)
        for k in range(self.order):
            out *= np.roll(vectors, self.order - 1 - k, axis=1)[at[:, k]]
        return out.astype(np.float32)

    def bundle(self, groups: np.ndarray, ids: np.ndarray, letters: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
        """The sums of the n-gram vectors of each of `n` groups."""
        out, order = np.zeros((n, self.dims), np.float32), None
        if len(letters) > BLOCK:
            order = np.argsort(ids, kind="stable")
            groups, ids, weight = groups[order], ids[order], None if weight is None else weight[order]
        for low in range(0, len(letters), BLOCK):
            part = slice(None) if order is None else slice(*np.searchsorted(ids, (low, low + BLOCK)))
            width = min(BLOCK, len(letters) - low)
            counts = np.bincount(groups[part] * width + ids[part] - low, None if weight is None else weight[part], n * width)
            out += counts.reshape(n, width).astype(np.float32) @ self.bind(letters[low : low + width])
        return out

    def vectors(self, texts: list) -> np.ndarray:
        """One unit vector a text; zeros where it has no letter."""
        owner, ids, letters = self.grams(texts)
        out = self.bundle(owner, ids, letters, len(texts))
        blank = np.ones(len(texts), bool)
        blank[owner[(letters != 0).any(axis=1)[ids]]] = False
        out[blank] = 0
        length = np.linalg.norm(out, axis=1)
        return out / np.maximum(length, 1e-9)[:, None]


def fit_prototypes(rows: DataFrame, dims: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """Prototypes from (text, lang) rows; all of them are read, none without text or language counts."""
    profiler_args = (dims, order)

    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))])

    def merged(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = sorted(sums)
        return pa.RecordBatch.from_pydict({"lang": names, "v": [sums[x] for x in names]}, schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(*profiler_args), {}
        for part, texts in sub_batches(batches, "text"):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            vectors = np.rint(profiler.vectors(texts) * SCALE).astype(np.int64)
            for name in set(langs):
                sums[name] = sums.get(name, 0) + vectors[[x == name for x in langs]].sum(axis=0)
        yield merged(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[name] = sums.get(name, 0) + v.values.to_numpy()
        yield merged(sums)

    layout = "lang string, v array<bigint>"
    parts = rows.select("text", "lang").where("text is not null and lang is not null").mapInArrow(trimmed(partial), layout)
    total: dict[str, np.ndarray] = {}
    for row in parts.repartition(MERGERS).mapInArrow(trimmed(merge), layout).collect():  # MERGERS rows a language, whatever the input
        total[row.lang] = total.get(row.lang, 0) + np.asarray(row.v)
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(total.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), dims: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """`keep`'s columns with lang_pred and score, the cosine with the winning prototype (0 where negative)."""
    names = list(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array([prototypes[x] for x in names], np.float32).reshape(len(names), dims).T))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, (known, matrix) = Profiler(dims, order), shared.value
        for part, texts in sub_batches(batches, "__text"):
            cosine = profiler.vectors(texts) @ matrix
            best = cosine.argmax(axis=1) if known else np.zeros(len(texts), int)
            top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float) if known else np.zeros(len(texts))
            some = (cosine != 0).any(axis=1)
            out = part.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([known[b] if s else "und" for b, s in zip(best, some)], pa.string()), pa.array(np.where(some, top, 0.0), pa.float64())],
                names=[*out.schema.names, "lang_pred", "score"],
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(trimmed(tell), f"{fields}, lang_pred string, score double")


def in_fold(key: str, parts: int, which: int):
    """Whether crc32 of the key's decimal text leaves `which` modulo `parts`; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == which, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those that are not held out."""
    prototypes = fit_prototypes(docs.where(~in_fold("doc_id", 4, 2)))
    return predict(docs.withColumn("held_out", in_fold("doc_id", 4, 2)), prototypes, ("doc_id", "held_out"))
