"""Quality classification by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built, one from text labelled good, one from text labelled bad. A text is cut into
pieces of `PIECE` bytes (so that the dictionaries matter up to its end, not only until its own content fills the
window), each compressed with either. The difference of the two summed sizes, normalised by the text's length, says which
dictionary knows the text better: good text is far shorter under the good one, junk under the bad one, and text that only repeats
itself is short under both. That one value becomes the score through a logistic curve, fitted on labelled texts that the dictionaries have
not seen.

Learning uses a bounded sample: the `sample` labelled texts of each class that come first by a hash of the id, in two
halves, one for dictionaries (a window of `WINDOW` characters of each), one, read whole, for the calibration. Scoring reads every
text whole, in one pass without a shuffle; what is broadcast is two dictionaries and two numbers.

Defined results: null is scored as the empty text. Without any labels every score is 0.5; with one class only, it is
0 or 1 for that class. Repeated rows score alike; of a label given several times the least counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import sub_batches, trimmed
from kestrion.llm.language_id import in_fold

PIECE, WINDOW, DICTIONARY, LEVEL = 256, 4096, 65_536, 3
#: Labelled texts of each class and half.
SAMPLE = 3000
#: Ridge of the calibration.
RIDGE = 0.01


def build_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from pieces of the texts; from little text, the text itself."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on
        return b"".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def difference(self, text: bytes) -> float:
        """(bad - good) / length, 0 for the empty text."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(self.bad.compress(p)) - len(self.good.compress(p)) for p in pieces) / max(len(text), 1)


class Calibration:
    """A logistic curve of one value, by ridge regression."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.std = float(x.mean()), float(x.std()) + 1e-9
        z = self.design(x)
        self.weights = np.zeros(2)
        ridge = np.array([RIDGE, 1e-6])
        for _ in range(60):
            s = self.sigmoid(z @ self.weights)
            step = np.linalg.solve((z * (weight * (s * (1 - s) + 1e-6))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (s - y)) + ridge * self.weights)
            self.weights -= step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -500, 500)))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.std, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.sigmoid(self.design(x) @ self.weights)


class Model:
    """Dictionaries with their calibration, or a constant where a class is missing."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", calibration: Calibration | None = None, constant: float = 0.5):
        self.good, self.bad, self.calibration, self.constant = good, bad, calibration, constant

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.constant)
        if not hasattr(self, "sizes"):
            self.sizes = Sizes(self.good, self.bad)
        return self.calibration.score(np.array([self.sizes.difference(t) for t in texts], float))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "sizes"}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text) and (doc_id, quality); the caller withholds what must not be learned from."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    n = {(r.quality, r.half): r.n for r in known.groupBy("quality", "half").agg(F.count("*").alias("n")).collect()}
    share = {q: n.get((q, 0), 0) + n.get((q, 1), 0) for q in (0, 1)}
    if not n:
        return Model(constant=0.5)
    # a bar on the hash lets about as many pass as are wanted, however many partitions hold them; the first of these are taken
    bar = F.lit(0)
    for (quality, half), size in n.items():
        bar = F.when((F.col("quality") == quality) & (F.col("half") == half), F.lit(int(min(1.0, 1.1 * sample / size) * (1 << 30)))).otherwise(bar)
    some = known.select("doc_id", "quality", "half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).alias("hash")).where(F.col("hash") < bar)
    found = sorted(some.collect(), key=lambda r: (r.hash, r.doc_id))  # about 4.4 x sample rows
    chosen = [r[:3] for q in (0, 1) for h in (0, 1) for r in [r for r in found if (r.quality, r.half) == (q, h)][:sample]]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int, half int")
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0))
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), spare + 1).cast("int") + 1
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where("half = 0").select("doc_id", "quality", F.col("text").substr(start, F.lit(WINDOW)).alias("t")).distinct().orderBy("doc_id").collect():
        texts[r.quality].append(r.t.encode())
    if not all(map(sum, ([len(t) for t in x] for x in texts.values()))):
        return Model(constant=0.5 if all(share.values()) else float(share[1] > 0))
    good, bad = build_dictionary(texts[1]), build_dictionary(texts[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for part, found in sub_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sizes.difference(t.encode()) for t in found], pa.float64())], names=["quality", "x"])

    seen = rows.where("half = 1").select("quality", "text").mapInArrow(trimmed(measure), "quality int, x double").collect()
    seen.sort(key=lambda r: (r.quality, r.x))
    y = np.array([float(r.quality) for r in seen])
    if len(set(y)) < 2:
        return Model(constant=0.5)
    # the sample may hold an equal number of each class; the labels' own shares are what the score is calibrated to
    weight = np.array([share[int(q)] / (y == q).sum() for q in y])
    return Model(good, bad, Calibration(np.array([r.x for r in seen]), y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`'s columns with score (0 to 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in sub_batches(batches, "__text"):
            s = own.scores(texts)
            out = part.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*out.schema.names, "score", "predicted"])

    return docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("__text")).mapInArrow(trimmed(tell), f"{fields}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels that are not held out."""
    model = fit(docs, labels.where(~in_fold("doc_id", 3, 1)))
    return score(docs.withColumn("held_out", in_fold("doc_id", 3, 1)), model, ("doc_id", "held_out"))
