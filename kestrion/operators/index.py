"""Indexing: from a repository's files to a project's documents and chunks.

One pass of DataFrame steps with a status a file: unchanged files stop at the hash gate; the rest are classified (never shown to a
model if their first bytes look like a secret), decoded, split, searched for secrets chunk by chunk, embedded and written.
A file that fails somewhere keeps what the store has of it; files that are gone from the walk are pruned.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kestrion.functions import models, secrets, text
from kestrion.operators.definitions import ParseError, select_parser
from kestrion.operators.windows import windows
from kestrion.sources.scratch import Scratch
from kestrion.sources.walk import read_files, walk
from kestrion.store import Store

#: Why a file was skipped.
NOTHING, ALL_SECRET, NOT_UTF8 = "produced no chunks", "all chunks dropped as secrets", "not UTF-8"


def changed(walked: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The walked rows whose content_hash isn't stored under the same keys, with state `new` or `changed`."""
    known = stored.select(*keys, F.col("content_hash").alias("__stored"), F.lit(True).alias("__known"))
    out = walked.join(known, keys, "left").where(~F.col("content_hash").eqNullSafe(F.col("__stored")))
    return out.withColumn("state", F.when(F.col("__known"), "changed").otherwise("new")).drop("__stored", "__known")


def disambiguate(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Labels made unique within keys: the nth of a label gets #n from the second on; numbers that would meet another row's own label are passed over."""
    nth = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(order))
    # labels of the form <label>#<n> beside <label>: a group that holds any is numbered as in one pass over its distinct labels
    rows = rows.withColumn("__n", nth)
    base, number = F.regexp_extract("label", r"^(.*)#\d+$", 1), F.regexp_extract("label", r"#(0|[1-9]\d{0,8})$", 1)
    own = rows.where("__n = 1").select(*keys, base.alias("label"), number.alias("__own")).where("__own <> ''")
    own = own.groupBy(*keys, "label").agg(F.sort_array(F.collect_set(F.col("__own").cast("int"))).alias("__taken"))
    rows = rows.join(own, [*keys, "label"], "left")
    # the nth free number: each taken one at or below it moves it up
    moved = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda n, t: F.when((t >= 2) & (t <= n), n + 1).otherwise(n))
    label = F.when(F.col("__n") == 1, F.col("label")).otherwise(F.concat("label", F.lit("#"), moved))
    return rows.withColumn("label", label).drop("__n", "__taken")


def split(files: DataFrame) -> DataFrame:
    """source_path, how (parser or whole), error, chunks (label, content, token_est, chunk_index, truncated) from (source_path, doc_type, language, text)."""
    chunk = pa.struct([("label", pa.string()), ("content", pa.string()), ("token_est", pa.int32()), ("chunk_index", pa.int32()), ("truncated", pa.bool_())])

    def one(path: str, doc_type: str, language: str, source: str) -> tuple[str, str | None, list]:
        name = path.rpartition("/")[2]
        stem, dot, extension = name.rpartition(".")
        parser = select_parser(doc_type, language, extension if dot and stem else "")
        if parser is None:
            return "whole", None, windows(source, name)
        try:
            return "parser", None, [(label, content, False) for label, content in parser(source)]
        except ParseError as error:
            return "parser", f"parse error: {error}", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                found = [one(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                rows = [[{"label": x, "content": c, "token_est": -(-len(c) // 4), "chunk_index": i, "truncated": cut} for i, (x, c, cut) in enumerate(chunks)] for _, _, chunks in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.string()), pa.array(rows, pa.list_(chunk))], names=["source_path", "how", "error", "chunks"])

    layout = "source_path string, how string, error string, chunks array<struct<label:string,content:string,token_est:int,chunk_index:int,truncated:boolean>>"
    return files.select("source_path", "doc_type", "language", "text").mapInArrow(run, layout)


@dataclass
class Report:
    """What a sync did."""

    project: str
    project_id: int = 0
    dry_run: bool = False
    walked: int = 0
    unchanged: int = 0
    classified: int = 0
    would_classify: int = 0
    head_secrets: int = 0
    parsed: int = 0
    whole: int = 0
    windowed: int = 0
    truncated_lines: int = 0
    dropped_secret: int = 0
    chunks: int = 0
    pruned: int = 0
    estimated_cost: float = 0.0
    labels: dict[str, int] = field(default_factory=dict)
    skipped: list[tuple[str, str]] = field(default_factory=list)

    def lines(self) -> list[str]:
        if self.dry_run:
            out = [f"dry run of {self.project}: nothing written", f"files walked: {self.walked}", f"files to classify at most: {self.would_classify}"]
            return out + ([f"estimated cost: ${self.estimated_cost:.4f}"] if self.estimated_cost else [])
        out = [f"project {self.project} ({self.project_id})", f"files walked: {self.walked}, unchanged: {self.unchanged}, classified: {self.classified}"]
        optional = (("files classified by extension for a secret in their head", self.head_secrets), ("files cut into windows", self.windowed), ("lines truncated", self.truncated_lines), ("chunks dropped for secrets", self.dropped_secret))
        out += [f"parsed: {self.parsed}, taken whole: {self.whole}", *(f"{k}: {v}" for k, v in optional if v), f"chunks indexed: {self.chunks}, documents pruned: {self.pruned}"]
        out += [f"  {k}: {v}" for k, v in sorted(self.labels.items())]
        return out + [f"skipped {path}: {reason}" for path, reason in self.skipped]

    def __str__(self) -> str:
        return "\n".join(self.lines()) + "\n"


def project_name(root: str) -> str:
    return os.path.basename(os.path.realpath(root)) or "project"


def process(files: DataFrame, stored: DataFrame, classify: Callable[[DataFrame], DataFrame], embedder, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(one status row a file, one row a chunk to be written) of files (source_path, content, read_error)."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    gated = changed(hashed.where("read_error is null"), stored, ["source_path"])
    guarded = gated.withColumn("head_secret", secrets.head_has_secret(F.col("content")))
    columns = [*guarded.columns, "doc_type", "language", "class_error"]
    classified = scratch.keep(classify(guarded.where("not head_secret")).select(columns).unionByName(models.classify_by_extension(guarded.where("head_secret")).select(columns)), "classified")
    decoded = classified.where("class_error is null").withColumn("text", F.col("content").cast("string")).where(F.is_valid_utf8("text"))
    pieces = split(decoded)
    keep = F.transform("chunks", lambda c: c.withField("secret", secrets.looks_like_secret(c["content"])))
    pieces = scratch.keep(pieces.withColumn("chunks", keep), "pieces")
    facts = classified.select("source_path", "content_hash", "doc_type", "language", "head_secret", "class_error", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    flat = pieces.select("source_path", F.explode("chunks").alias("c")).where("not c.secret").select("source_path", "c.label", "c.content", "c.token_est", "c.chunk_index")
    flat = flat.withColumn("embedding", models.embed_column(embedder)("content")).withColumn("content_hash", text.content_hash(F.col("content")))
    flat = scratch.keep(flat.join(facts.select("source_path", "doc_type", "language"), "source_path"), "chunks")
    failed = flat.groupBy("source_path").agg(F.count_if(F.col("embedding").isNull()).alias("no_vector"), F.count("*").alias("n_chunks"))
    joined = hashed.select("source_path", "read_error").join(facts, "source_path", "left").join(pieces, "source_path", "left").join(failed, "source_path", "left")
    reason = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(F.col("class_error").isNotNull(), F.concat(F.lit("classify error: "), "class_error"))
        .when(~F.col("utf8"), NOT_UTF8)
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("no_vector") > 0, "embed error")
        .when(F.size("chunks") == 0, NOTHING)
        .when(F.col("n_chunks").isNull() & F.col("how").isNotNull(), ALL_SECRET)
    )
    status = F.when(reason.isNotNull(), "skipped").when(F.col("content_hash").isNull(), "unchanged").otherwise("indexed")
    states = joined.select(
        "source_path", "content_hash", "doc_type", "language", "head_secret", "class_error", "how", "error",
        F.coalesce(F.size("chunks"), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.size(F.filter("chunks", lambda c: c["secret"])), F.lit(0)).alias("n_secret"),
        F.coalesce(F.size(F.filter("chunks", lambda c: c["truncated"])), F.lit(0)).alias("n_truncated"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), status.alias("status"), reason.alias("reason"),
    )
    states = scratch.keep(states, "states")
    return states, flat.join(states.where("status = 'indexed'").select("source_path"), "source_path", "left_semi")


def sync(spark: SparkSession, store: Store | None, root: str, name: str | None = None, domain: str | None = None, dry_run: bool = False, classify: Callable[[DataFrame], DataFrame] = models.classify_by_extension, embedder=None, exclude: tuple[str, ...] = (), hosted: bool = False, purge_empty: bool = False) -> Report:
    """Brings a project's documents up to date with a repository.

    A changed file that yields nothing keeps its old rows, unless `purge_empty`.
    """
    files = walk(root, exclude)
    name = name or project_name(root)
    if dry_run:
        return Report(name, dry_run=True, walked=len(files), would_classify=len(files), estimated_cost=models.cost_estimate(len(files)) if hosted else 0.0)
    scratch = Scratch(spark, "sync")
    project_id = store.get_or_create_project(name, os.path.realpath(root))
    if domain:
        store.set_domain(project_id, domain)
    contents = scratch.keep(read_files(spark, files), "contents") if files else spark.createDataFrame([], "source_path string, content binary, read_error string")
    states, chunks = process(contents, store.document_hashes(project_id), classify, embedder or models.StubEmbedder(store.dim), scratch)
    documents = states.where("status = 'indexed'").select("doc_type", "source_path", text.title(F.col("source_path")).alias("title"), "content_hash")
    kept = states.where(~F.coalesce(F.col("reason").isin(NOTHING, ALL_SECRET), F.lit(False))) if purge_empty else states
    pruned = store.replace(project_id, documents, chunks, kept.select("source_path"))
    known = F.col("doc_type").isNotNull()
    sums = states.agg(
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if(known & F.col("class_error").isNull() & ~F.col("head_secret")).alias("classified"),
        F.count_if(F.coalesce("head_secret", F.lit(False))).alias("head_secrets"),
        F.count_if((F.col("how") == "parser") & F.col("error").isNull()).alias("parsed"),
        F.count_if(F.col("how") == "whole").alias("whole"),
        F.count_if((F.col("how") == "whole") & (F.col("n_pieces") > 1)).alias("windowed"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n_truncated", "truncated_lines"), ("n_secret", "dropped_secret"))),
        F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("n_chunks"))), F.lit(0)).alias("chunks"),
    ).first()
    labels = {r.label: r.n for r in states.where(known & F.col("class_error").isNull()).groupBy(F.concat_ws("/", "doc_type", "language").alias("label")).agg(F.count("*").alias("n")).collect()}
    skipped = [(r.source_path, r.reason) for r in states.where("status = 'skipped'").orderBy("source_path").collect()]
    return Report(name, project_id, walked=len(files), pruned=pruned, labels=labels, skipped=skipped, **sums.asDict())
