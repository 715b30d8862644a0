"""A training-data pipeline over `documents`: quality, language, near-duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kestrion.llm import bpe, language_id, minhash, mixing, quality_classifier
from kestrion.llm.entry import tokenizer_path
from kestrion.sources.scratch import Scratch, clear, used
from kestrion.sources.tables import table

#: A document is in no known language if it scores below this share of what all but LOWEST of its language's training texts reach; `und` always.
LANGUAGE_SHARE, LOWEST = 0.5, 0.001


def _boxed(docs: DataFrame) -> DataFrame:
    """The documents as one column beside their text, so that no column of theirs meets an operator's."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier holds good; it learns from labels outside its held-out fold."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~language_id.in_fold("doc_id", 3, 1)))
    return quality_classifier.score(_boxed(docs), model, ("doc",)).where("predicted = 1").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; how near to its profile is near follows from all training texts of the language."""
    learned = ~language_id.in_fold("doc_id", 4, 2)
    prototypes = language_id.fit_prototypes(docs.where(learned))
    found = Scratch(spark, "language").keep(language_id.predict(_boxed(docs), prototypes, ("doc",)), "found")
    training = found.where("doc.lang = lang_pred").withColumn("doc_id", F.col("doc.doc_id")).where(learned)
    bars = training.groupBy("lang_pred").agg((F.percentile_approx("score", LOWEST, 10_000) * LANGUAGE_SHARE).alias("bar"))  # a row a language
    near = found.where("lang_pred <> 'und'").join(F.broadcast(bars), "lang_pred").where(F.col("score") >= F.col("bar"))
    return near.select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' schedule; files don't keep it, so their places are kept beside them for the last stage."""
    return mixing.interleave(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), n_tokens, digests of ids and decoded text, slot and in_target.

    The places are those that mixing gave: the rows ordered by slot are the mixed stream, and the weights hold as far as
    in_target does. Documents that weren't mixed have no slot.
    """
    mixed = mixing.placed(docs.select("doc_id", "source", "text")).select("__row.doc_id", "__row.text", "slot", "in_target")
    encoded = bpe.encode_decode(mixed, tokenizer_path(), also=("slot", "in_target"))
    return bpe.digest(encoded, "ids", "slot", "in_target")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL expresses none of compression, hyperdimensional profiles and minwise darts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; what a stage kept on its way goes when its output is written, but for the places of the mix."""
    docs, before = table(spark, sf_dir, "documents"), used(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            scratch = Scratch(spark, "pipeline")
            docs = scratch.keep(docs, f"stage{k}")
            places = mixing.places_of(docs)
            clear(spark, [*before, scratch.base, *([places.rpartition("/")[0]] if places else [])])
    return docs
