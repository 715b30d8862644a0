"""Near-duplicate documents by weighted minwise signatures from hashed darts.

An element (a shingle of `words` words) of weight w owns a region of width w. Darts fall on it as a Poisson process in
the plane of weight and rank, seeded by the element alone, so that two documents see the same darts where their regions
overlap. A document keeps the darts of rank below t / (total weight), about t = k (ln k + 2) of them however many
elements it has, deals them into k coordinates by a hash of the dart, and keeps the earliest dart of each coordinate. (A
document that left a coordinate empty throws further.) Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity.

Documents that agree in all coordinates of a band are candidates. Exact copies are one class from the start, so that hot
groups of them are reduced before anything is joined. In a band's group of up to `SMALL` classes each meets each. In a
larger one every class meets the `CENTRES` classes that meet the most others (in a family of copies, those nearest to its
middle). What is linked by then is contracted to components, and classes of large groups that lie in different components are
joined on their rarest shingles: sets of the similarity share one of their rarest (1 - similarity) n + 1, and a passage that
many documents share is not among these. So a large family costs a few comparisons a member, and every two classes of large
groups that could be linked either are in one component or have met.
Pairs whose sizes or signatures (four bits of each coordinate) rule the similarity out are told apart inside
the joins; what is left is verified exactly on sets of shingles.

At the default (80 coordinates, 20 bands of 4) a pair of similarity 0.8 is missed with a probability of 6 in 100,000, half of it by
the bands and half by the signatures.

Weights: 1 for each distinct shingle (`binary`, the default, plain Jaccard) or its number of occurrences (`count`). The axis of weights is cut at its doublings,
each interval a region of its own, so that a weight costs its logarithm; `dart_signatures` takes any weights, measured against a power of two.

Defined results: words are what white space separates, lower-cased; a text of fewer than `words` words is one shingle. Null text is alone in its class; so is,
but for exact copies, a text without words. Rows with null ids are left out of all groups (class null, kept). An id at several texts is told
apart by text: each of them has its own class, and rows fall or stay by their text. Repeated rows are copies; one stays. The least doc_id of a component is kept
(of rows that share it the one of the least hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrion.llm.common import WordHash, mix64, rolling, sub_batches, trimmed
from kestrion.llm.components import components
from kestrion.sources.scratch import Scratch

WORDS, THRESHOLD, BANDS, ROWS, SMALL, CENTRES = 5, 0.8, 20, 4, 16, 2
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, words: int, hashes: WordHash) -> np.ndarray:
    """Hashes of all shingles, with repetitions."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes.of(found)
    return rolling(h, words) if len(h) > words else rolling(np.concatenate([h, np.zeros(words - len(h), np.uint64)]), words)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int, base: int = 0) -> np.ndarray:
    """One row of k coordinates for each of n documents from (element, weight, document number); EMPTY rows for those without.

    Weights are measured against 2^base, the same for all documents that are compared: greater ones cost their logarithm, much
    smaller ones cost darts that miss.
    """
    out = np.full((n, k), EMPTY, np.uint64)
    total = np.bincount(owner, weights, n)
    reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    # the axis of weights is cut at 2^base and its doublings, each interval a region with darts of its own
    columns = 1 + np.maximum(np.ceil(np.log2(np.maximum(weights, 1e-300))) - base, 0).astype(np.int64)
    if (columns > 1).any():
        at = np.repeat(np.arange(len(elements)), columns)
        column = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
    else:
        at, column = np.arange(len(elements)), np.zeros(len(elements), np.int64)
    with np.errstate(over="ignore"):
        seed = mix64(elements[at] ^ (column.astype(np.uint64) << np.uint64(1)), 11) if column.any() else mix64(elements, 11)
    breadth = np.exp2(base + np.maximum(column - 1, 0))
    width, doc = (weights[at] - np.where(column > 0, breadth, 0)) / breadth, owner[at]
    while len(seed):
        one = (breadth == 1).all()
        s, d, w, rank, high, wide = seed, doc, width, np.zeros(len(seed)), reach[doc] * breadth, breadth  # ranks by the region's own breadth
        darts = 0
        while len(s):
            s = mix64(s, darts & 0xFF)
            darts += 1
            rank = rank - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            there = rank < high
            s, d, w, rank, high, wide = s[there], d[there], w[there], rank[there], high[there], wide if one else wide[there]
            if not len(s):
                break
            dart = mix64(s, 301)
            inside = slice(None) if (w >= 1).all() else (mix64(s, 302) >> np.uint64(11)).astype(np.float64) / (1 << 53) < w
            packed = ((rank if one else rank / wide)[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart[inside] & np.uint64(0xFFFFFFFF))
            slot = (dart[inside] >> np.uint64(32)) % np.uint64(k)
            np.minimum.at(out.reshape(-1), d[inside] * k + slot.astype(np.int64), packed)
        short = (out == EMPTY).any(axis=1) & (total > 0)
        reach = np.where(short, reach * 2, 0)
        again = short[doc]
        seed, doc, width, breadth = seed[again], doc[again], width[again], breadth[again]
    return out


def signatures(texts: list, words: int, k: int, weighting: str, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Signature rows, and the number of distinct shingles of each text."""
    elements, weights, sizes = [], [], []
    for text in texts:
        h = shingles(text or "", words, hashes)
        h, c = np.unique(h, return_counts=True)
        elements.append(h)
        weights.append(c if weighting == "count" else np.ones(len(h)))
        sizes.append(len(h))
    owner = np.repeat(np.arange(len(texts)), sizes)
    return dart_signatures(np.concatenate(elements), np.concatenate(weights).astype(float), owner, len(texts), k), np.array(sizes, np.int64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates in a 64-bit number."""
    n, k = sig.shape
    wide = np.zeros((n, -(-k // 16) * 16), np.uint64)
    wide[:, :k] = sig & np.uint64(15)
    shifted = wide.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(shifted, axis=2).view(np.int64)


def differing(a: Column, b: Column, k: int) -> Column:
    """In how many coordinates the bits differ."""
    out = F.lit(0)
    for i in range(-(-k // 16)):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(0x1111111111111111)
        out = out + F.bit_count(x)
    return out


def most_differing(k: int, threshold: float) -> int:
    """Four standard deviations beyond the differing coordinates to expect at the threshold; a pair there is missed once in 30,000 times."""
    p = (1 - threshold) * 15 / 16
    return int(np.ceil(k * p + 4 * np.sqrt(k * p * (1 - p))))


def sign(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "binary") -> DataFrame:
    """doc_id, text_key (of the exact text; null for null text), n_shingles, keys (one a band; empty without words), bits (four of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for part, texts in sub_batches(batches, "text", 600_000):
            sig, sizes = signatures(texts, words, bands * rows, weighting, hashes)
            with np.errstate(over="ignore"):
                key = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    key = mix64(key ^ sig.reshape(len(texts), bands, rows)[:, :, r], r)
                key = mix64(key ^ np.arange(bands, dtype=np.uint64), 99)
            keys = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")),
                    pa.array([None if t is None else hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary()),
                    pa.array(sizes),
                    pa.array([k if n else [] for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
                    pa.array(list(nibbles(sig)), pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "keys", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(trimmed(run), "doc_id long, text_key binary, n_shingles long, keys array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, s: the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for part, texts in sub_batches(batches, "text"):
            found = [np.unique(shingles(t or "", words, hashes)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, s array<long>")


def near(n_a, n_b, threshold: float):
    """Whether sizes allow the similarity."""
    return F.least(n_a, n_b) >= F.lit(threshold) * F.greatest(n_a, n_b)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least the threshold, with it."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    similarity = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def classes_of(signed: DataFrame) -> DataFrame:
    """text_key, class_id: the least id of each exact text."""
    return signed.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("class_id"))


def pairs_of(left: DataFrame, right: DataFrame, threshold: float, k: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a key and whose sizes and bits allow the similarity; told apart inside the join."""
    right = right.select("key", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    alike = near(F.col("n"), F.col("n_b"), threshold) & (differing(F.col("bits"), F.col("bits_b"), k) <= most_differing(k, threshold))
    met = left.join(right, "key").where((F.col("id") != F.col("id_b")) & alike)
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def centres_of(members: DataFrame, most: int) -> DataFrame:
    """Up to `most` members of each group, those that meet the most others; Spark limits groups before it shuffles them."""
    order = Window.partitionBy("key").orderBy(F.desc("meets"), "id")
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, n, s, place: each set's rarest shingles, so many that two sets of the similarity share one of them at least."""
    rows = sets.select(F.col("doc_id").alias("id"), F.size("s").alias("n"), F.explode("s").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("r"))
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return ranked.select("id", "n", F.posexplode(F.slice("r", F.lit(1), length)).alias("place", "e")).select("id", "n", "e.s", "place")


def prefix_pairs(rare: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids of `parts` (id, component) in different components that share a rare shingle.

    Without a component each id is one of its own. The first shingle that two sets share leaves at most what stands behind it
    to share; that must reach the overlap that the similarity needs. Components meet first, told apart by the extremes of
    their members, so that those of one component never meet; then their members do, told apart by size and place.
    """
    if "component" not in parts.columns:
        parts = parts.select("id", F.col("id").alias("component"))

    def enough(n_a, n_b, left_a, left_b):
        return F.least(left_a, left_b) >= (n_a + n_b) * F.lit(threshold / (1 + threshold)) - 1e-6

    rare = rare.join(parts, "id").select("s", "component", "id", "n", (F.col("n") - F.col("place")).alias("left"))
    held = rare.groupBy("s", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"))
    other = held.select("s", *(F.col(c).alias(f"{c}_b") for c in ("component", "low", "high", "left")))
    sizes = (F.col("high") >= F.lit(threshold) * F.col("low_b")) & (F.col("high_b") >= F.lit(threshold) * F.col("low"))
    meet = held.join(other, "s").where((F.col("component") < F.col("component_b")) & sizes & enough(F.col("low"), F.col("low_b"), F.col("left"), F.col("left_b")))
    met = meet.select("s", "component", "component_b").join(rare, ["s", "component"])
    met = met.join(rare.select("s", *(F.col(c).alias(f"{c}_b") for c in ("component", "id", "n", "left"))), ["s", "component_b"])
    met = met.where(near(F.col("n"), F.col("n_b"), threshold) & enough(F.col("n"), F.col("n_b"), F.col("left"), F.col("left_b")))
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame, classes: DataFrame, scratch: Scratch, words: int = WORDS, threshold: float = THRESHOLD, k: int = BANDS * ROWS, small: int = SMALL, centres: int = CENTRES) -> DataFrame:
    """Links (a, b) between classes with the components of the verified ones; where groups are large, they need not be verified ones themselves."""
    nulls = signed.where("text_key is null").select("doc_id")
    reps = signed.join(classes.select(F.col("class_id").alias("doc_id")).unionByName(nulls), "doc_id", "left_semi").where("n_shingles > 0")
    reps = scratch.keep(reps.dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "keys", "bits"), "reps")
    members = scratch.keep(reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")), "bands")
    sizes = scratch.keep(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = scratch.keep(members.join(sizes, "key"), "shared")
    grouped = scratch.keep(shared.join(reps.select(F.col("doc_id").alias("id"), "bits"), "id"), "groups")
    scratch.drop(members, sizes, shared)
    few = grouped.where(F.col("size") <= small)
    pairs = scratch.keep(pairs_of(few, few, threshold, k), "pairs")
    many = grouped.where(F.col("size") > small)
    many = scratch.keep(many.join(many.groupBy("id").agg(F.sum("size").alias("meets")), "id").select("key", "id", "n", "bits", "meets"), "many")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(many.select(F.col("id").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    sets = scratch.keep(shingle_sets(texts, words).dropDuplicates(["doc_id"]), "sets")
    found = [scratch.keep(verify(pairs, sets, threshold), "links")]
    scratch.drop(grouped, pairs)
    if not many.isEmpty():
        middle = scratch.keep(centres_of(many, centres), "centres")
        pairs = scratch.keep(pairs_of(many, middle, threshold, k), "pairs")
        found.append(scratch.keep(verify(pairs, sets, threshold), "links"))
        scratch.drop(pairs, middle)
        stars = components(reduce(DataFrame.unionByName, found).select("a", "b"), scratch)
        scratch.drop(*found)
        inside = scratch.keep(many.select("id").distinct(), "inside")
        parts = inside.join(stars.withColumnRenamed("node", "id"), "id", "left")
        parts = scratch.keep(parts.select("id", F.coalesce("component", "id").alias("component")), "parts")
        rare = scratch.keep(prefixes(sets.join(inside.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), threshold), "prefixes")
        pairs = scratch.keep(prefix_pairs(rare, parts, threshold), "pairs")
        found = [stars.select(F.col("node").alias("a"), F.col("component").alias("b")), scratch.keep(verify(pairs, sets, threshold), "links").select("a", "b")]
        scratch.drop(pairs, rare, parts, inside)
    return reduce(DataFrame.unionByName, found).select("a", "b")


def clashes(signed: DataFrame) -> DataFrame:
    """doc_id of the ids that stand at different texts."""
    sides = signed.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("text_key").alias("texts"), F.count("*").alias("n"))
    return sides.where((F.col("a") != F.col("b")) | ((F.col("texts") > 0) & (F.col("texts") < F.col("n")))).select("doc_id")


def with_uid(docs: DataFrame, clash: DataFrame | None, name: str) -> DataFrame:
    """The rows with an id of each (doc_id, text): the doc_id itself, or where it stands at several texts a hash of both."""
    if clash is None:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    several = clash.select(F.col("doc_id").alias("__clash"))
    own = F.xxhash64("doc_id", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")), F.col("text").isNull().cast("int")).bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    met = docs.join(several, F.col("doc_id").cast("long") == F.col("__clash"), "left")
    return met.select(*docs.columns, F.when(F.col("__clash").isNotNull(), own).otherwise(F.col("doc_id").cast("long")).alias(name))


def _grouped(docs: DataFrame, scratch: Scratch, words: int, threshold: float, bands: int, rows: int, weighting: str) -> tuple[DataFrame, DataFrame | None]:
    """uid, doc_id, class_id, component_id, kept of the rows with an id; and the ids that stand at different texts, or None."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(sign(docs, words, bands, rows, weighting), "signed")
    clash = scratch.keep(clashes(signed), "clashes")
    if clash.isEmpty():
        clash, names = None, None
    else:
        named = with_uid(docs, clash, "uid").select(F.col("uid").alias("doc_id"), F.col("doc_id").alias("own"), "text")
        names = scratch.keep(named.select("doc_id", "own").distinct(), "names")
        docs = named.drop("own")
        signed = scratch.keep(sign(docs, words, bands, rows, weighting), "signed")
    classes = scratch.keep(classes_of(signed), "classes")
    joined = scratch.keep(components(links(docs, signed, classes, scratch, words, threshold, bands * rows), scratch), "components")
    out = signed.select("doc_id", "text_key").join(classes, "text_key", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.select(F.col("doc_id").alias("uid"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    if clash is None:
        return out.select("uid", F.col("uid").alias("doc_id"), "class_id", "component_id", (F.col("uid") == F.col("component_id")).alias("kept")), None
    out = scratch.keep(out.join(names.select(F.col("doc_id").alias("uid"), "own"), "uid"), "named")
    class_ids = out.groupBy("class_id").agg(F.min("own").alias("class_own"))
    component_ids = out.groupBy("component_id").agg(F.min("own").alias("component_own"), F.min(F.struct("own", "uid")).alias("first"))
    out = out.join(class_ids, "class_id").join(component_ids, "component_id")
    return out.select("uid", F.col("own").alias("doc_id"), F.col("class_own").alias("class_id"), F.col("component_own").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("kept")), clash


def groups(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "binary") -> DataFrame:
    """doc_id, class_id (least id of the exact text), component_id (least id of the near-duplicates), kept."""
    out, _ = _grouped(docs, Scratch(docs.sparkSession, "minhash"), words, threshold, bands, rows, weighting)
    none = F.lit(None).cast("long")
    unkeyed = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("component_id"), F.lit(True).alias("kept"))
    return out.drop("uid").unionByName(unkeyed)


def dedup(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "binary") -> DataFrame:
    """The documents that stay: one row of each group; rows with null ids stay."""
    scratch = Scratch(docs.sparkSession, "dedup")
    found, clash = _grouped(docs, scratch, words, threshold, bands, rows, weighting)
    found = scratch.keep(found.select("uid", "kept"), "kept")
    gone = found.where("not kept").select(F.col("uid").alias("__uid")).distinct()
    repeated = found.where("kept").groupBy("uid").count().where("count > 1").select(F.col("uid").alias("__uid"))
    out = with_uid(docs, clash, "__uid").join(gone, "__uid", "left_anti")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    once = out.join(repeated, "__uid", "left_semi").dropDuplicates(["__uid"])
    return out.join(repeated, "__uid", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
