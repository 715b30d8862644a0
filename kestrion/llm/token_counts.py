"""Token counts of the documents in flat, unindexed token files.

A flat file holds token ids as little-endian numbers of 16 bits (or 32), an end-of-document id after each document, and nothing else.
`write_flat` makes such files through Spark's own text writer (any Hadoop file system): a row's bytes are its tokens, the
line separator is the end-of-document id. `scan` reads them back in blocks of `BLOCK_BYTES`: each block is searched for
separators with one vectorised comparison, and documents that cross blocks are stitched with prefix scans over the blocks'
summaries, a running count of separators and a running maximum of the last one's position. The scans run in two levels (runs of `RUN` blocks, then
the runs), so no window sees more than a file's runs or a run's blocks.

Files up to `WHOLE` bytes are read as values by Spark's `binaryFile`. Longer ones, which that can't hold, are listed by it only and read in ranges of
`RANGE` bytes by tasks, through Arrow's file systems (local folders, HDFS, object stores); the counts are the same.

Flat files know no ids. `count` finds its documents again by their place: a task writes its rows in order into a file of its own (several, where
`spark.sql.files.maxRecordsPerFile` rolls them), so the nth document of partition p is the nth row there. It takes a table, whose
partitions are the same each time that it is read; write other frames first.

Defined results: null and empty texts are documents of 0 tokens. What follows the last separator of a file is a document
that isn't terminated; an empty file has none. A file whose bytes aren't whole tokens is refused, and so is a vocabulary with ids that the width can't
hold, or with the end-of-document id among them. Repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kestrion.llm.common import sub_batches, trimmed
from kestrion.sources.scratch import Scratch

WIDTH, BLOCK_BYTES, RUN = 2, 1 << 20, 1024
WHOLE, RANGE = 1 << 30, 128 << 20


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, to: str, vocabulary: str, pattern: str, end: int, width: int = WIDTH) -> None:
    """Encodes every whole text and writes flat files below `to`; one file a task, or several in its rows' order."""
    if width not in (2, 4) or not 0 <= end < 1 << 8 * width:
        raise ValueError("the end-of-document id must fit the width, 2 or 4 bytes")
    ranks = _encoding(vocabulary, pattern)._mergeable_ranks.values()
    if max(ranks) >= 1 << 8 * width or end in set(ranks):
        raise ValueError(f"the vocabulary's ids don't fit {width} bytes, or one of them is the end-of-document id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(vocabulary, pattern)
        for _, texts in sub_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([np.array(own.encode_ordinary(t or ""), f"<u{width}").tobytes() for t in texts], pa.binary())], names=["tokens"])

    separator = int(end).to_bytes(width, "little").decode("latin-1")
    rows = docs.select("text").mapInArrow(trimmed(encode), "tokens binary").select(F.col("tokens").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").text(to)


def _ends_of_ranges(files: DataFrame, end: int, width: int, block_bytes: int, range_bytes: int) -> DataFrame:
    """file, length, block, ends of files (path, length) that tasks read in ranges of whole blocks."""
    per_range = max(1, range_bytes // block_bytes)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (block_bytes * per_range))))
    ranges = files.select(F.col("path").alias("file"), "length", number.alias("number")).select("file", "length", (F.col("number") * per_range).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with system.open_input_file(place) as f:
                    for block in range(first, min(first + per_range, -(-length // block_bytes))):
                        data = f.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes)
                        ends = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], names=["file", "length", "block", "ends"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "file", "first").mapInArrow(trimmed(read), "file string, length long, block long, ends array<int>")


def scan(spark: SparkSession, path: str, end: int, block_bytes: int = BLOCK_BYTES, run: int = RUN, width: int = WIDTH, whole: int = WHOLE, range_bytes: int = RANGE) -> DataFrame:
    """file, doc_no (from 0 in the file), first_token, n_tokens, terminated."""
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    odd = files.where(F.col("length") % width != 0).select("path").first()
    if odd:
        raise ValueError(f"odd number of bytes: {odd.path}")
    starts = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes).cast("int"))
    blocks = files.where(F.col("length") <= whole).select(F.col("path").alias("file"), "length", "content", F.explode(starts).alias("block"))
    blocks = blocks.select("file", "length", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {block_bytes} + 1, {block_bytes})").alias("bytes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.flatnonzero(np.frombuffer(b.as_buffer(), f"<u{width}") == end).astype(np.int32) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.list_(pa.int32()))], names=["file", "length", "block", "ends"])

    ends = blocks.mapInArrow(trimmed(search), "file string, length long, block long, ends array<int>")
    long = files.where(F.col("length") > whole).select("path", "length")
    if not long.isEmpty():
        ends = ends.unionByName(_ends_of_ranges(long, end, width, block_bytes, range_bytes))
    found = Scratch(spark, "tokens").keep(ends, "ends")
    per_block = block_bytes // width
    first = F.col("block") * per_block
    last = F.when(F.size("ends") > 0, first + F.element_at("ends", -1))
    blocks = found.select("file", "length", "block", "ends", F.floor(F.col("block") / run).alias("run"), F.size("ends").cast("long").alias("n"), last.alias("last"))
    runs = blocks.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("n_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("last_in", F.max("last").over(inner)).join(runs, ["file", "run"])
    blocks = blocks.select("file", "length", "block", "ends", (F.col("n_in") + F.col("n_before")).alias("seen"), F.greatest(F.coalesce("last_in", F.lit(-1)), "last_before").alias("previous"))
    tokens = (F.col("length") / width).cast("long")
    absolute = F.transform("ends", lambda e: e + F.col("block") * per_block)
    is_last = (F.col("block") + 1) * per_block >= tokens
    after_last = F.coalesce(F.try_element_at(absolute, F.lit(-1)), "previous")
    absolute = F.when(is_last & (after_last < tokens - 1), F.concat(absolute, F.array(tokens))).otherwise(absolute)
    docs = blocks.select("file", tokens.alias("all"), "seen", F.concat(F.array("previous"), absolute).alias("at")).where("size(at) > 1")
    docs = docs.select("file", "all", "seen", "at", F.explode(F.sequence(F.lit(1), F.size("at") - 1)).alias("i"))
    here, back = F.expr("at[i]"), F.expr("at[i - 1]")
    return docs.select("file", (F.col("seen") + F.col("i") - 1).alias("doc_no"), (back + 1).alias("first_token"), (here - back - 1).alias("n_tokens"), (here < F.col("all")).alias("terminated"))


def places(docs: DataFrame) -> DataFrame:
    """part, place, doc_id: each row's partition and its place therein."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int64)), pa.array(np.arange(n, n + size)), batch.column(0)], names=["part", "place", "doc_id"])
            n += size

    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(number, "part long, place long, doc_id long")


def place_of_file(name: Column) -> tuple[Column, Column]:
    """The task's number and the place among its files, from the names that Spark gives: part-<task>-<uuid>-c<place>.<ending>."""
    return F.regexp_extract(name, r"part-(\d+)[^/]*$", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)(?:\.[^/]*)?$", 1).try_cast("long")


def count(docs: DataFrame, vocabulary: str, pattern: str, end: int, width: int = WIDTH, **how) -> DataFrame:
    """Writes the documents as flat files and counts them there: doc_id, file (its name), doc_no, first_token, n_tokens, terminated."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "flat")
    to = scratch.path("files")
    write_flat(docs, to, vocabulary, pattern, end, width)
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    part, roll = place_of_file(F.col("file"))
    found = scan(spark, to, end, width=width, **how).withColumn("file", name)
    found = scratch.keep(found.select("file", part.alias("part"), F.coalesce(roll, F.lit(0)).alias("roll"), "doc_no", "first_token", "n_tokens", "terminated"), "found")
    # a task's files are its rows' runs in order: what the earlier ones hold comes before
    files = found.groupBy("part", "roll").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("part").orderBy("roll").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", "roll", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    found = found.join(files, ["part", "roll"]).withColumn("place", F.col("doc_no") + F.col("earlier"))
    return found.join(places(docs), ["part", "place"], "full_outer").select("doc_id", "file", "doc_no", "first_token", "n_tokens", "terminated")
