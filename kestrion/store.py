"""The corpus store: immutable Parquet snapshots behind one pointer.

    <path>/CURRENT.<n>                                   JSON: embedding model and dimension, and which version of each table is current; the greatest n counts
    <path>/projects/v=<version>                          projects
    <path>/<documents|chunks|terms>/project=<id>/v=<version>   rows of one project
    <path>/retrieval_log                                 appended

A change writes new versions, under names of their own, of what it touches and then puts CURRENT.<n + 1> into place, which only one writer can: a
reader sees all of a change or nothing, a lost executor costs a retried task, and a change to one project rewrites that project alone. A
writer that comes second takes the other's state as its base; if the other has touched the same rows, it computes its change anew. Old versions
stay until `vacuum`.

`terms` is the inverted index of the chunks (stemmed), kept with each change: only new chunks are tokenised, and searches read the terms they ask for.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from kestrion.functions import text
from kestrion.operators import search

SCHEMAS = {
    "projects": "project_id long, name string, repo_path string, domain string, created_at timestamp",
    "documents": "document_id long, project_id long, doc_type string, source_path string, title string, content_hash string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id long, document_id long, project_id long, doc_type string, language string, label string, content string, content_hash string, token_est int, chunk_index int, created_at timestamp, embedding array<float>",
    "terms": "chunk_id long, document_id long, project_id long, doc_type string, language string, dl int, col int, pos int, term string",
    "retrieval_log": "prompt_hash string, query_plan string, chunks_returned int, tokens_injected int, created_at timestamp",
}


class StoreError(Exception):
    """Base of the store's errors."""


class IncompatibleEmbedding(StoreError):
    """The store holds vectors of another model or length."""


class Conflict(StoreError):
    """A project's name is taken by another repository."""


class Changed(StoreError):
    """Another writer has changed the same rows in the meantime."""


class DimensionMismatch(StoreError):
    """A vector of a wrong length."""


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str], kept: str = "created_at") -> DataFrame:
    """`old` with the rows of `new` in place of those with equal keys; a replaced row hands on its `kept` column."""
    before = old.select(*keys, F.col(kept).alias("__kept"))
    fresh = new.join(before, keys, "left").withColumn(kept, F.coalesce("__kept", kept)).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)


class Store:
    def __init__(self, spark: SparkSession, path: str, model: str, dim: int):
        if dim <= 0:
            raise StoreError("the embedding's dimension must be positive")
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        state = self.state()
        if state is None:
            self._fs.mkdirs(self._path(self.path))
            self._restrict(self._path(self.path), "700")
            self._put(0, {"model": model, "dim": dim, "projects": "", "documents": {}, "chunks": {}, "terms": {}})
            state = self.state()
        if (state["model"], state["dim"]) != (model, dim):
            raise IncompatibleEmbedding(f"the store holds {state['model']} of {state['dim']} dimensions, not {model} of {dim}")

    def _restrict(self, at, mode: str) -> None:
        """Access for the owner only, where the file system has such a thing."""
        try:
            self._fs.setPermission(at, self.spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))
        except Exception:  # noqa: BLE001 - best effort
            pass

    def _pointers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/CURRENT.*")) or []
        return sorted(int(x) for f in found if (x := f.getPath().getName().partition(".")[2]).isdigit())

    def state(self) -> dict | None:
        """The current state, with its number as `n`."""
        numbers = self._pointers()
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.path}/CURRENT.{numbers[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes())) | {"n": numbers[-1]}
        finally:
            stream.close()

    def _put(self, n: int, state: dict) -> bool:
        """Makes the state current as number n; False if there is one of that number."""
        jvm = self.spark.sparkContext._jvm
        new, to = (self._path(f"{self.path}/{name}") for name in (f"NEXT-{uuid.uuid4().hex}", f"CURRENT.{n}"))
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "n"}, sort_keys=True).encode()))
        out.close()
        self._restrict(new, "600")
        try:
            if self._fs.getUri().getScheme() == "file":  # a hard link is made by one writer only, a local rename by any
                os.link(*(unquote(urlsplit(str(self._fs.makeQualified(p).toUri())).path) for p in (new, to)))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, to, options)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if self._fs.exists(to) and "AlreadyExists" in str(error):
                return False
            raise
        finally:
            self._fs.delete(new, False)

    def _place(self, name: str, version: str, project_id: int | None = None) -> str:
        return f"{self.path}/{name}/" + (f"project={project_id}/" if project_id is not None else "") + f"v={version}"

    def table(self, name: str, project_id: int | None = None, state: dict | None = None) -> DataFrame:
        """The rows of a state, the current one by default; of one project only its files are listed."""
        state = state or self.state()
        if name == "projects":
            paths = [self._place(name, state[name])] if state[name] else []
        else:
            chosen = state[name] if project_id is None else {k: v for k, v in state[name].items() if k == str(project_id)}
            paths = [self._place(name, v, int(k)) for k, v in sorted(chosen.items())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def commit(self, base: dict, projects: DataFrame | None = None, project_id: int | None = None, **tables: DataFrame) -> None:
        """Writes new versions, made from the state `base`, and makes all of them current at once; Changed if another writer was at the same rows."""
        version, key = uuid.uuid4().hex[:16], str(project_id)
        if projects is not None:
            projects.coalesce(1).write.parquet(self._place("projects", version))
        for name, rows in tables.items():
            rows.write.parquet(self._place(name, version, project_id))
        now = base
        while True:
            new = now | {name: now[name] | {key: version} for name in tables} | ({"projects": version} if projects is not None else {})
            if self._put(now["n"] + 1, new):
                return
            now = self.state()
            if projects is not None and now["projects"] != base["projects"] or any(now[x].get(key) != base[x].get(key) for x in tables):
                raise Changed("another writer has changed the same rows")

    def _again(self, change: Callable[[dict], object], tries: int = 20):
        """Makes a change from the current state, again where another writer came first."""
        for left in reversed(range(tries)):
            try:
                return change(self.state())
            except Changed:
                if not left:
                    raise

    def vacuum(self) -> None:
        """Deletes versions that aren't current, and former pointers. No writer may be at work."""
        state = self.state()
        current = {self._place("projects", state["projects"])} | {self._place(n, v, int(k)) for n in ("documents", "chunks", "terms") for k, v in state[n].items()}
        for pattern in ("projects/v=*", "documents/*/v=*", "chunks/*/v=*", "terms/*/v=*"):
            for found in self._fs.globStatus(self._path(f"{self.path}/{pattern}")) or []:
                at = found.getPath()
                if not any(str(at).endswith(c.rpartition(self.path)[2]) for c in current):
                    self._fs.delete(at, True)
        for n in self._pointers()[:-1]:
            self._fs.delete(self._path(f"{self.path}/CURRENT.{n}"), False)

    # projects

    def get_or_create_project(self, name: str, repo_path: str | None = None) -> int:
        """The project's id; a stored path of null fits any, another path is a conflict."""

        def change(state: dict) -> int:
            projects = self.table("projects", state=state)
            found = projects.where(F.col("name") == name).select("project_id", "repo_path").first()
            if found:
                if repo_path and found.repo_path and found.repo_path != repo_path:
                    raise Conflict(f"project {name} belongs to {found.repo_path}")
                return found.project_id
            row = self.spark.createDataFrame([(name, repo_path)], "name string, repo_path string")
            row = row.select(F.xxhash64("name").alias("project_id"), "name", "repo_path", F.lit(None).cast("string").alias("domain"), F.current_timestamp().alias("created_at"))
            self.commit(state, projects=projects.unionByName(row))
            return row.first().project_id

        return self._again(change)

    def set_domain(self, project_id: int, domain: str | None) -> None:
        given = F.when(F.col("project_id") == project_id, F.lit(domain)).otherwise(F.col("domain"))
        self._again(lambda state: self.commit(state, projects=self.table("projects", state=state).withColumn("domain", given)))

    # documents

    def document_hashes(self, project_id: int) -> DataFrame:
        return self.table("documents", project_id).select("source_path", "content_hash")

    def replace(self, project_id: int, documents: DataFrame, chunks: DataFrame, kept: DataFrame | None = None) -> int:
        """Upserts documents (doc_type, source_path, title, content_hash) with all their chunks (source_path, doc_type, language, label, content, content_hash, token_est, chunk_index, embedding).

        With `kept` (source_path), documents of other paths go, chunks with them; the number of those is returned.
        """
        wrong = chunks.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim).select("source_path", F.coalesce(F.size("embedding"), F.lit(0)).alias("n")).first()
        if wrong:
            raise DimensionMismatch(f"{wrong.source_path}: a vector of {wrong.n} dimensions instead of {self.dim}")
        return self._again(lambda state: self._replace(state, project_id, documents, chunks, kept))

    def _replace(self, state: dict, project_id: int, documents: DataFrame, chunks: DataFrame, kept: DataFrame | None) -> int:
        now = F.current_timestamp()
        key = F.xxhash64(F.lit(project_id), "source_path")
        new = documents.select(key.alias("document_id"), F.lit(project_id).alias("project_id"), "doc_type", "source_path", "title", "content_hash", now.alias("created_at"), now.alias("updated_at"))
        old, old_chunks, old_terms = (self.table(x, project_id, state) for x in ("documents", "chunks", "terms"))
        pruned = 0
        if kept is not None:
            kept = kept.select("source_path").distinct()
            gone = old.join(kept, "source_path", "left_anti")
            pruned = gone.join(new.select("source_path"), "source_path", "left_anti").count()
            old = old.join(kept, "source_path", "left_semi").select(*old.columns)
        rows = chunks.select(F.xxhash64(key, "label").alias("chunk_id"), key.alias("document_id"), F.lit(project_id).alias("project_id"), "doc_type", "language", "label", "content", "content_hash", "token_est", "chunk_index", now.alias("created_at"), "embedding")
        documents = upsert_rows(old, new, ["document_id"])
        staying = old.select("document_id").join(new.select("document_id"), "document_id", "left_anti")
        chunks = old_chunks.join(staying, "document_id", "left_semi").select(*old_chunks.columns).unionByName(rows)
        terms = old_terms.join(staying, "document_id", "left_semi").select(*old_terms.columns).unionByName(self._terms(rows))
        self.commit(state, project_id=project_id, documents=documents, chunks=chunks, terms=terms.sort("term", "chunk_id"))
        return pruned

    @staticmethod
    def _terms(chunks: DataFrame) -> DataFrame:
        """The index's rows of chunks; one without a term a chunk, from which the statistics follow."""
        marks = search.token_arrays(chunks).select("chunk_id", *search.FILTERS, "dl", F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("term"))
        rows = search.token_rows(chunks, stem=True).unionByName(marks)
        return rows.join(chunks.select("chunk_id", "document_id"), "chunk_id").select(*(f.partition(" ")[0] for f in SCHEMAS["terms"].split(", ")))

    def prune(self, project_id: int, kept: DataFrame) -> int:
        """Deletes the project's documents whose source_path isn't in `kept`, with their chunks; returns their number."""
        empty_docs = self.table("documents", project_id).limit(0)
        return self.replace(project_id, empty_docs, self.table("chunks", project_id).limit(0).withColumn("source_path", F.lit("")), kept)

    # the retrieval log

    def log_retrieval(self, entries: DataFrame) -> None:
        """Appends (prompt_hash, query_plan, chunks_returned, tokens_injected)."""
        entries.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/retrieval_log")

    def searchable(self) -> DataFrame:
        """All chunks in the form that searches take."""
        return self.table("chunks")

    def index(self) -> search.TermIndex:
        """The index of all chunks."""
        terms = self.table("terms")
        return search.TermIndex(terms.where("term is not null"), search.stats_of(terms.where("term is null")), True)

    def domain_of(self, names: list[str]) -> str | None:
        """The domain of the first of the names that has one."""
        known = {r.folded: r.domain for r in self.table("projects").where("domain is not null").select(text.ascii_lower(F.col("name")).alias("folded"), "domain").collect()}
        fold = str.maketrans(text.UPPER, text.LOWER)
        return next((known[n.translate(fold)] for n in names if n.translate(fold) in known), None)
