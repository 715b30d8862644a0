"""Keyword, vector and hybrid search of a table of chunks for a table of query plans.

Chunks: chunk_id, label, content, project_id, doc_type, language, embedding (array, null where there is none).
Plans: query_id, projects (array of project ids; null or empty: any), doc_types, languages, type_names, topics, embedding.

All operators answer every plan at once. Each arm is cut to its best `TOP_K` chunks of a plan before the blend, statistics of the
keyword arm are over all chunks whatever the filters, ranks are by the score rounded to `DIGITS`, ties by chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from kestrion.functions import text
from kestrion.sources.scratch import Scratch

TOP_K, ALPHA, K1, B, LEAST_IDF, DIGITS = 50, 0.6, 1.2, 0.75, 1e-6, 6
#: Plans whose vectors are broadcast at a time; more are answered in that many at a time.
PLANS_AT_ONCE = 4096


def best(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each plan."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def passes(column: str) -> Column:
    """Whether a chunk's value is in the plan's list of the same name with an `s`; an empty or null list lets all pass."""
    wanted = F.col(f"{column}s")
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.array_contains(wanted, F.col(column)), F.lit(False))


#: Distinct query terms that are looked for in each chunk's token arrays; with more, tokens and terms are joined.
TERMS_AT_ONCE = 1000

FILTERS = ("project_id", "doc_type", "language")

#: Rows of a table of plans, phrases or their terms that are broadcast at most; with more, the rows beside them are dealt over so many tasks a key.
BROADCAST_ROWS, SPREAD = 100_000, 64
#: Rows of wanted terms that a task counts phrases in.
ROWS_A_TASK = 250_000


def few(rows: DataFrame) -> bool:
    """Whether the rows can be broadcast."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def beside(rows: DataFrame, facts: DataFrame, on: list[str], broadcast: bool) -> DataFrame:
    """The rows of chunks joined with facts of a key. No task gets all rows of a frequent key: they stay where they are, or are dealt by chunk as well."""
    if broadcast:
        return rows.join(F.broadcast(facts), on)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)).cast("int")
    parts = facts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__part", part).join(parts, [*on, "__part"]).drop("__part")


def dealt(met: DataFrame) -> DataFrame:
    """Rows dealt by chunk, as many a task whatever the corpus and the session's number of partitions."""
    return met.repartition(met.count() // ROWS_A_TASK + 1, "chunk_id")


def with_filters(plans: DataFrame) -> DataFrame:
    return plans.select("query_id", F.col("projects").alias("project_ids"), "doc_types", "languages")


def filtered(scored: DataFrame, plans: DataFrame) -> DataFrame:
    """The scored rows (with the chunk's facts) that pass their plan's filters."""
    wanted = with_filters(plans)
    out = beside(scored, wanted, ["query_id"], few(wanted))
    for column in FILTERS:
        out = out.where(passes(column))
    return out.select(scored.columns)


def token_arrays(chunks: DataFrame) -> DataFrame:
    """chunk_id, the chunk's facts, t0 and t1 (the tokens of label and content), dl (the number of both)."""
    found = chunks.select("chunk_id", *FILTERS, text.tokens(F.col("label")).alias("t0"), text.tokens(F.col("content")).alias("t1"))
    return found.withColumn("dl", F.coalesce(F.size("t0"), F.lit(0)) + F.coalesce(F.size("t1"), F.lit(0)))


def exploded(arrays: DataFrame, *also: str) -> DataFrame:
    """chunk_id, facts, dl, col, pos, term, and with `t` the tokens of the column."""
    columns = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"t{i}").alias("t")) for i in (0, 1))))
    return arrays.select("chunk_id", *FILTERS, "dl", columns.alias("c")).select("chunk_id", *FILTERS, "dl", "c.col", *(f"c.{x}" for x in also), F.posexplode("c.t").alias("pos", "term"))


def token_rows(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """chunk_id, facts, dl, col, pos, term: the inverted index's rows."""
    rows = exploded(token_arrays(chunks))
    if not stem:
        return rows
    from kestrion.functions.stem import stem_table

    return rows.join(stem_table(rows.select("term").distinct()), "term").drop("term").withColumnRenamed("stem", "term")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    dl = F.coalesce(F.size(text.tokens(F.col("label"))), F.lit(0)) + F.coalesce(F.size(text.tokens(F.col("content"))), F.lit(0))
    return chunks.select(dl.alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def phrase_terms(plans: DataFrame, stem: bool = False) -> DataFrame:
    """query_id, phrase, i, m, term: the terms of each plan's phrases, type names before topics; each phrase counts, equal ones too."""
    phrases = plans.select("query_id", F.posexplode(F.concat(F.coalesce("type_names", F.array().cast("array<string>")), F.coalesce("topics", F.array().cast("array<string>")))).alias("phrase", "words"))
    terms = phrases.select("query_id", "phrase", text.tokens(F.col("words")).alias("t")).withColumn("m", F.size("t"))
    rows = terms.select("query_id", "phrase", "m", F.posexplode("t").alias("i", "term"))
    if not stem:
        return rows
    from kestrion.functions.stem import stem_table

    return rows.join(stem_table(rows.select("term").distinct()), "term").drop("term").withColumnRenamed("stem", "term")


def phrase_hits(met: DataFrame) -> DataFrame:
    """query_id, phrase, chunk_id, tf, dl, facts: adjacent occurrences of each phrase within one column, from token rows beside phrase terms."""
    about = ("chunk_id", "dl", *FILTERS)  # facts of the chunk as keys: strings among aggregates would have to be sorted
    single = met.where("m = 1").groupBy("query_id", "phrase", *about).agg(F.count("*").alias("tf"))
    starts = met.where("m > 1").groupBy("query_id", "phrase", "m", *about, "col", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    several = starts.where("n = m").groupBy("query_id", "phrase", *about).agg(F.count("*").alias("tf"))
    return single.unionByName(several)


#: Distinct phrases that are looked for as they are while tokens are read.
PHRASES_AT_ONCE = 64


def few_phrases(terms: DataFrame) -> dict[tuple[str, ...], list[tuple[int, int]]] | None:
    """(query_id, phrase) by the phrases' terms, or None where they are too many."""
    rows = terms.select("query_id", "phrase", "i", "term").limit(TERMS_AT_ONCE + 1).collect()
    if len(rows) > TERMS_AT_ONCE:
        return None
    phrases: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for r in rows:
        phrases.setdefault((r.query_id, r.phrase), []).append((r.i, r.term))
    out: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for key, parts in phrases.items():
        out.setdefault(tuple(term for _, term in sorted(parts)), []).append(key)
    return out if len(out) <= PHRASES_AT_ONCE else None


def occurrences(arrays: DataFrame, phrases: list[tuple[list[str], ...]]) -> DataFrame:
    """chunk_id, facts, dl, number (of the phrase), tf of phrases, each a list of forms by place: a token that begins a phrase is told while it is
    read, so that nothing else is shuffled."""
    rows = exploded(arrays, "t").where(F.col("term").isin(sorted({form for p in phrases for form in p[0]})))
    begins = []
    for number, phrase in enumerate(phrases):
        fits = F.col("term").isin(phrase[0])
        for k, forms in enumerate(phrase[1:], 1):
            fits = fits & F.get("t", F.col("pos") + k).isin(forms)
        begins.append(F.when(fits, F.lit(number)))
    about = ("chunk_id", *FILTERS, "dl")
    rows = rows.select(*about, F.explode(F.array(*begins)).alias("number")).where("number is not null")  # within generated code, which filters on arrays would leave
    return rows.groupBy(*about, "number").agg(F.count("*").alias("tf"))


def few_terms(terms: DataFrame) -> list[str] | None:
    """The distinct terms, or None where they are too many to name."""
    found = [r.term for r in terms.select("term").distinct().limit(TERMS_AT_ONCE + 1).collect()]
    return found if len(found) <= TERMS_AT_ONCE else None


def stats_of(lengths: DataFrame) -> DataFrame:
    """One row, n and avgdl, from one row a chunk."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


#: Stems whose forms are looked for by their beginnings; with more, all words are kept.
STEMS_AT_ONCE = 64


def beginning(stems: list[str]) -> Column:
    """Whether a term may have one of the stems: stemming changes a word from the stem's last letter on only."""
    out = F.lit(len(stems) > STEMS_AT_ONCE)
    for x in sorted({s[:-1] for s in stems[: STEMS_AT_ONCE + 1]}):
        out = out | F.startswith(F.col("term"), F.lit(x))
    return out


def found_phrases(chunks: DataFrame, plans: DataFrame, stem: bool) -> tuple[DataFrame, DataFrame]:
    """The hits of phrase_hits, and the corpus statistics; both from one pass over the chunks, the statistics observed on its way."""
    spark = chunks.sparkSession
    scratch, seen, terms = Scratch(spark, "search"), Observation(), phrase_terms(plans, stem)
    arrays = token_arrays(chunks).observe(seen, F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    phrases, wanted, forms_of = few_phrases(terms), few_terms(terms), None
    if stem:
        from kestrion.functions.stem import stem_table

        # of distinct words those of wanted stems, then only tokens of these forms
        words = exploded(token_arrays(chunks)).where(beginning(wanted) if wanted is not None else F.lit(True)).select("term").distinct()
        forms = stem_table(words)
        forms = scratch.keep(forms if wanted is None else forms.where(F.col("stem").isin(wanted)), "forms")
        rows = forms.limit(TERMS_AT_ONCE + 1).collect()
        wanted = [r.term for r in rows] if len(rows) <= TERMS_AT_ONCE else None
        forms_of = {s: [r.term for r in rows if r.stem == s] for s in {r.stem for r in rows}}
        terms = terms.withColumnRenamed("term", "stem").join(forms, "stem").drop("stem")
    if phrases is not None and wanted is not None:
        asked = {p: keys for p, keys in phrases.items() if forms_of is None or all(x in forms_of for x in p)}
        shapes = [tuple(forms_of[x] if stem else [x] for x in p) for p in asked]
        numbers = spark.createDataFrame([(*key, number) for number, keys in enumerate(asked.values()) for key in keys], "query_id long, phrase int, number int")
        if not asked:
            nothing = chunks.select("chunk_id", F.lit(0).alias("dl"), *FILTERS).limit(0)
            return nothing.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("phrase"), F.lit(0).cast("long").alias("tf"), "*"), stats_of(nothing)
        hits = scratch.keep(occurrences(arrays, shapes), "hits").join(F.broadcast(numbers), "number").drop("number")  # TERMS_AT_ONCE rows at most
    else:
        rows = exploded(arrays) if wanted is None else exploded(arrays).where(F.col("term").isin(wanted))
        rows = scratch.keep(rows, "met")
        hits = scratch.keep(phrase_hits(dealt(beside(rows, terms, ["term"], few(terms)))), "hits")
    return hits, spark.createDataFrame([(seen.get["n"], seen.get["avgdl"])], "n long, avgdl double")


class TermIndex:
    """Token rows and statistics kept as tables, so that a search reads the terms it asks for and tokenises nothing.

    Rows lie in segments: files of whole chunks, of about `SEGMENT` bytes of text each, sorted by term and chunk. A segment is made by one task
    from its chunks, so that a task's memory follows from `SEGMENT`, not from the corpus, and no tokens are shuffled. A search prunes row groups
    and pages by term.
    """

    SEGMENT = 8 << 20
    #: Values that the Parquet reader tells one by one in a filter; of longer lists it takes the ends only.
    VALUES_AT_ONCE = 10

    def __init__(self, rows: DataFrame, stats: DataFrame, stem: bool):
        self.rows, self.stats, self.stem = rows, stats, stem

    @classmethod
    def build(cls, chunks: DataFrame, path: str, stem: bool = False) -> TermIndex:
        spark, seen = chunks.sparkSession, Observation()
        chunks = chunks.select("chunk_id", "label", "content", *FILTERS)
        size = chunks.agg(F.sum(F.coalesce(F.octet_length("label"), F.lit(0)) + F.coalesce(F.octet_length("content"), F.lit(0))).alias("n")).first().n or 0
        n = size // cls.SEGMENT + 1
        arrays = token_arrays(chunks if stem else chunks.repartition(n, "chunk_id"))
        if stem:
            stats = stats_of(arrays).first()
            rows = token_rows(chunks, stem).repartition(n, "chunk_id")
        else:
            rows = exploded(arrays.observe(seen, F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
        rows.sortWithinPartitions("term", "chunk_id", "col", "pos").write.mode("overwrite").parquet(f"{path}/rows")
        found = (stats.n, stats.avgdl) if stem else (seen.get["n"], seen.get["avgdl"])
        spark.createDataFrame([(*found, stem)], "n long, avgdl double, stem boolean").write.mode("overwrite").parquet(f"{path}/stats")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark, path: str) -> TermIndex:
        stats = spark.read.parquet(f"{path}/stats")
        return cls(spark.read.parquet(f"{path}/rows"), stats.select("n", "avgdl"), stats.first().stem)

    def of(self, terms: DataFrame) -> DataFrame:
        """The rows of the terms; pruned by them if they are few."""
        wanted = few_terms(terms)
        if wanted is None:
            return self.rows
        wanted, out = sorted(wanted), F.lit(False)
        for low in range(0, len(wanted), self.VALUES_AT_ONCE):
            out = out | F.col("term").isin(wanted[low : low + self.VALUES_AT_ONCE])
        return self.rows.where(F.col("term").isin(wanted)).where(out)  # the first is told from a hash set


def scored_chunks(chunks: DataFrame, plans: DataFrame, stem: bool = False, index: TermIndex | None = None) -> DataFrame:
    """query_id, chunk_id, facts, bm25 for all chunks with a hit; from the index where there is one."""
    terms = phrase_terms(plans, index.stem if index else stem)
    small = few(terms)
    if index:
        met = beside(index.of(terms), terms, ["term"], small)
        hits, stats = Scratch(chunks.sparkSession, "search").keep(phrase_hits(dealt(met)), "hits"), index.stats
    else:
        hits, stats = found_phrases(chunks, plans, stem)
    found = hits.groupBy("query_id", "phrase").agg(F.count("*").alias("n_p"))
    idf = F.log((F.col("n") - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = beside(hits, found, ["query_id", "phrase"], small).join(F.broadcast(stats))  # one row
    return scored.groupBy("query_id", "chunk_id", *FILTERS).agg(F.round(F.sum(weight), DIGITS).alias("bm25"))


def bm25_scores(chunks: DataFrame, plans: DataFrame, stem: bool = False, index: TermIndex | None = None) -> DataFrame:
    """query_id, chunk_id, bm25 for all chunks with a hit."""
    return scored_chunks(chunks, plans, stem, index).select("query_id", "chunk_id", "bm25")


def bm25_search(chunks: DataFrame, plans: DataFrame, k: int = TOP_K, stem: bool = False, index: TermIndex | None = None) -> DataFrame:
    """query_id, chunk_id, bm25: the keyword arm. Plans without type names and topics find nothing."""
    return best(filtered(scored_chunks(chunks, plans, stem, index), plans).select("query_id", "chunk_id", "bm25"), "bm25", k)


def cosine_scores(chunks: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """The vector arm for bounded queries (query_id, vector, projects, doc_types, languages): each task keeps its own k best of a query."""
    spark = chunks.sparkSession
    names = [q[0] for q in queries]
    matrix = np.array([q[1] for q in queries], float)
    wanted = [[set(x) if x else None for x in q[2:]] for q in queries]
    shared = spark.sparkContext.broadcast((names, matrix / np.linalg.norm(matrix, axis=1)[:, None], wanted))
    dims = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, wanted = shared.value
        kept: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(1))
            if pa.compute.any(pa.compute.not_equal(lengths, dims)).as_py():
                raise ValueError(f"a chunk's vector has not the plan's {dims} dimensions")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            norm = np.linalg.norm(x, axis=1)
            chunk = batch.column(0).to_numpy()
            facts = [batch.column(c).dictionary_encode() for c in (2, 3, 4)]
            facts = [(f.dictionary.to_pylist(), pa.compute.fill_null(f.indices, -1).to_numpy(zero_copy_only=False)) for f in facts]
            scores = np.round(x / np.where(norm > 0, norm, 1)[:, None] @ unit.T, DIGITS) + 0.0
            for q, lists in enumerate(wanted):
                ok = norm > 0
                for (values, codes), allowed in zip(facts, lists):
                    if allowed is not None:
                        ok = ok & np.array([*(v in allowed for v in values), False], bool)[codes]  # null is code -1
                s, c = np.concatenate([kept[q][0], scores[ok, q]]), np.concatenate([kept[q][1], chunk[ok]])
                if len(s) > k:
                    near = s >= -np.partition(-s, k - 1)[k - 1]
                    s, c = s[near], c[near]
                top = np.lexsort((c, -s))[:k]
                kept[q] = (s[top], c[top])
        for q, (s, c) in zip(ids, kept):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(c), pa.array(s)], names=["query_id", "chunk_id", "cosine"])

    rows = chunks.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), *FILTERS)
    return rows.mapInArrow(run, "query_id long, chunk_id long, cosine double")


def cosine_search(chunks: DataFrame, plans: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, chunk_id, cosine: the vector arm, by exact comparison with every chunk that has a vector of a length above 0."""
    rows, out, batch = plans.where("embedding is not null").select("query_id", "embedding", "projects", "doc_types", "languages"), None, []
    for row in [*rows.toLocalIterator(), None]:
        if row is not None and any(row.embedding):
            batch.append((row.query_id, row.embedding, row.projects, row.doc_types, row.languages))
        if batch and (row is None or len(batch) == PLANS_AT_ONCE):
            part, batch = cosine_scores(chunks, batch, k), []
            out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, cosine double")
    return best(out, "cosine", k)


def merge(bm25: DataFrame, cosine: DataFrame, alpha: float = ALPHA, k: int = TOP_K) -> DataFrame:
    """query_id, chunk_id, bm25, cosine, bm25_norm, final: the blend of both arms; what an arm didn't return counts 0 there."""
    both = bm25.join(cosine, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    norm = F.when(top > 0, F.col("bm25") / top).otherwise(0.0)
    both = both.withColumn("bm25_norm", F.round(norm, DIGITS))
    return best(both.withColumn("final", F.round(alpha * norm + (1 - alpha) * F.col("cosine"), DIGITS)), "final", k)


def hybrid_once(chunks: DataFrame, plans: DataFrame, alpha: float = ALPHA, k: int = TOP_K, stem: bool = False, index: TermIndex | None = None) -> DataFrame:
    return merge(bm25_search(chunks, plans, k, stem, index), cosine_search(chunks, plans, k), alpha, k)


def hybrid_search(chunks: DataFrame, plans: DataFrame, alpha: float = ALPHA, k: int = TOP_K, stem: bool = False, index: TermIndex | None = None) -> DataFrame:
    """The blend, with `relaxed`; plans that find nothing and filter by document type or language are answered without these two filters.

    Both ways are taken in one pass over the chunks, as two plans with ids of their own: query_id times two, one more where relaxed.
    """
    scratch = Scratch(chunks.sparkSession, "search")
    nothing = F.array().cast("array<string>")
    narrow = plans.where("size(doc_types) > 0 or size(languages) > 0").withColumn("doc_types", nothing).withColumn("languages", nothing)
    both = plans.withColumn("query_id", F.col("query_id") * 2).unionByName(narrow.withColumn("query_id", F.col("query_id") * 2 + 1))
    scored = scored_chunks(chunks, plans, stem, index)
    scored = scored.select(F.explode(F.array(F.col("query_id") * 2, F.col("query_id") * 2 + 1)).alias("query_id"), "chunk_id", *FILTERS, "bm25")
    keywords = best(filtered(scored, both).select("query_id", "chunk_id", "bm25"), "bm25", k)
    out = scratch.keep(merge(keywords, cosine_search(chunks, both, k), alpha, k), "both")  # at most k rows a plan and way
    relaxed = F.pmod("query_id", F.lit(2)) == 1
    strict = out.where(~relaxed)
    loose = out.where(relaxed).join(strict.select((F.col("query_id") + 1).alias("query_id")).distinct(), "query_id", "left_anti")
    id_of = F.floor(F.col("query_id") / 2).cast("long").alias("query_id")
    rest = ("chunk_id", "bm25", "cosine", "bm25_norm", "final")
    return strict.select(id_of, *rest, F.lit(False).alias("relaxed")).unionByName(loose.select(id_of, *rest, F.lit(True).alias("relaxed")))


def resolve_projects(plans: DataFrame, projects: DataFrame) -> DataFrame:
    """Plans with project names replaced by ids: case-insensitive in ASCII, unknown names dropped (so all unknown: no filter)."""
    names = plans.select("query_id", F.explode("projects").alias("name")).select("query_id", text.ascii_lower(F.col("name")).alias("folded"))
    known = projects.select("project_id", text.ascii_lower(F.col("name")).alias("folded"))
    ids = names.join(known, "folded").groupBy("query_id").agg(F.sort_array(F.collect_set("project_id")).alias("__ids"))
    return plans.join(ids, "query_id", "left").withColumn("projects", F.coalesce("__ids", F.array().cast(ids.schema["__ids"].dataType))).drop("__ids")
