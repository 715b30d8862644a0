"""The driver's tables seen as a corpus: projects, documents, chunks, plans; in Spark and, for comparison, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kestrion.functions import text
from kestrion.sources.tables import table

#: Document types by the last digit of a source's name: the tables have none of their own.
TYPE_DIGITS = (("contract", "012"), ("plan", "345"), ("convention", "67"))
DOC_TYPES, LANGUAGES = ("contract", "plan", "convention", "meta"), ("en", "de", "fr", "es")
#: (project, domain, place in the registry); src names in a case of their own, some without a domain.
PROJECTS = tuple((f"src{i}", {0: "software", 3: "physics", 5: "software", 7: "botany"}.get(i)) for i in range(20))

#: query_id, projects (names), type_names, topics, doc_types, languages, vec_id of the prompt's vector.
PLANS = (
    (1, [], ["thand"], ["of the", "ering"], [], [], 7),
    (2, [], ["The"], ["is it", "and"], [], ["en"], 11),
    (3, ["SRC0", "src3"], [], ["que la", "de la", "que"], ["contract", "plan"], ["fr", "es"], 23),
    (4, [], [], ["für", "sch"], [], ["xx"], 42),
    (5, ["nosuch"], [], [], [], [], 99),
    (6, ["src1", "nosuch"], ["zzzzqq"], ["ción", "Éaux"], ["meta"], [], 5),
    (7, [], ["the", "the"], [], ["none"], [], 64),
)
PLAN_SCHEMA = "query_id long, projects array<string>, type_names array<string>, topics array<string>, doc_types array<string>, languages array<string>, vec_id long"


def doc_type():
    digit = F.substring("source", -1, 1)
    out = None
    for name, digits in TYPE_DIGITS:
        out = F.when(digit.isin(*digits), name) if out is None else out.when(digit.isin(*digits), name)
    return out.otherwise("meta")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One chunk a document, with the embedding of the same number where there is one."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("doc-"), "doc_id").alias("label"),
        F.col("text").alias("content"),
        F.col("source").alias("project_id"),
        doc_type().alias("doc_type"),
        F.col("lang").alias("language"),
    )
    if not vectors:
        return d.withColumn("embedding", F.lit(None).cast("array<float>"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return d.join(e, "chunk_id", "left")


def projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n, d) for n, d in PROJECTS], "project_id string, name string, domain string")


def plans(spark: SparkSession, sf_dir: str, *ids: int) -> DataFrame:
    """The plans (all, or those of the ids) with project names and the prompts' vectors."""
    p = spark.createDataFrame([x for x in PLANS if not ids or x[0] in ids], PLAN_SCHEMA)
    return p.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def plans_sql(*ids: int) -> str:
    rows = ", ".join(f"({q}, {', '.join(map(sql_list, lists))}, {vec})" for q, *lists, vec in PLANS if not ids or q in ids)
    return f"plans AS (SELECT * FROM (VALUES {rows}) AS p(query_id, projects, type_names, topics, doc_types, languages, vec_id))"


def projects_sql() -> str:
    rows = ", ".join(f"('{n}', {f"'{d}'" if d else 'NULL'})" for n, d in PROJECTS)
    return f"projects AS (SELECT * FROM (VALUES {rows}) AS r(name, domain))"


def doc_type_sql(source: str = "source") -> str:
    whens = " ".join(f"WHEN right({source}, 1) IN ({', '.join(repr(c) for c in digits)}) THEN '{name}'" for name, digits in TYPE_DIGITS)
    return f"CASE {whens} ELSE 'meta' END"


CHUNKS_SQL = f"""chunks AS (
  SELECT d.doc_id AS chunk_id, 'doc-' || d.doc_id AS label, d.text AS content, d.source AS project_id, {doc_type_sql("d.source")} AS doc_type,
         d.lang AS language, e.embedding::DOUBLE[] AS embedding, ceil(length(d.text) / 4.0)::INTEGER AS token_est
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

TOKENS_SQL = """columns_of AS (
  SELECT chunk_id, 0 AS col, regexp_extract_all(strip_accents(lower(label)), '[\\p{L}\\p{N}]+') AS t FROM chunks
  UNION ALL SELECT chunk_id, 1, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') FROM chunks),
lengths AS (SELECT chunk_id, sum(len(t)) AS dl FROM columns_of GROUP BY chunk_id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
places AS (SELECT chunk_id, col, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM columns_of)"""

#: From plans to the keyword arm's scores of all chunks (bm25_all) and both arms after filters, cut to 50 (arm_b, arm_c).
SEARCH_SQL = """phrases AS (
  SELECT query_id, generate_subscripts(w, 1) AS phrase, unnest(w) AS words FROM (SELECT query_id, list_concat(type_names, topics) AS w FROM plans)),
parts AS (SELECT query_id, phrase, regexp_extract_all(strip_accents(lower(words)), '[\\p{L}\\p{N}]+') AS t FROM phrases),
terms AS (SELECT query_id, phrase, len(t) AS m, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM parts),
starts AS (
  SELECT query_id, phrase, chunk_id, col, pos - i AS start FROM places JOIN terms USING (term)
  GROUP BY query_id, phrase, m, chunk_id, col, pos - i HAVING count(*) = any_value(m)),
hits AS (SELECT query_id, phrase, chunk_id, count(*) AS tf FROM starts GROUP BY query_id, phrase, chunk_id),
found AS (SELECT query_id, phrase, count(*) AS n_p FROM hits GROUP BY query_id, phrase),
bm25_all AS (
  SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
  FROM (SELECT *, CASE WHEN ln((n - n_p + 0.5) / (n_p + 0.5)) > 0 THEN ln((n - n_p + 0.5) / (n_p + 0.5)) ELSE 1e-6 END AS idf
        FROM hits JOIN found USING (query_id, phrase) JOIN lengths USING (chunk_id) CROSS JOIN stats) x
  GROUP BY query_id, chunk_id),
wanted AS (
  SELECT query_id, vec_id, doc_types, languages,
         (SELECT list(r.name) FROM projects r WHERE list_contains([lower(x) for x in p.projects], lower(r.name))) AS ids
  FROM plans p),
allowed AS (
  SELECT w.query_id, w.vec_id, c.chunk_id, c.embedding FROM wanted w JOIN chunks c
  ON (w.ids IS NULL OR list_contains(w.ids, c.project_id)) AND (len(w.doc_types) = 0 OR list_contains(w.doc_types, c.doc_type))
     AND (len(w.languages) = 0 OR list_contains(w.languages, c.language))),
arm_b AS (
  SELECT query_id, chunk_id, bm25 FROM bm25_all JOIN allowed USING (query_id, chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) <= 50),
arm_c AS (
  SELECT query_id, chunk_id, cosine FROM (
    SELECT a.query_id, a.chunk_id, round(list_cosine_similarity(a.embedding, e.embedding::DOUBLE[]), 6) AS cosine
    FROM allowed a JOIN embeddings e ON e.vec_id = a.vec_id WHERE a.embedding IS NOT NULL) y
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) <= 50)"""


def blend_sql(alpha: float, name: str = "blend", suffix: str = "") -> str:
    return f"""joined{suffix} AS (
  SELECT query_id, chunk_id, coalesce(bm25, 0.0)::DOUBLE AS bm25, coalesce(cosine, 0.0)::DOUBLE AS cosine FROM arm_b{suffix} FULL JOIN arm_c{suffix} USING (query_id, chunk_id)),
normed{suffix} AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0.0 END AS norm FROM joined{suffix}),
{name} AS (
  SELECT query_id, chunk_id, bm25, cosine, round(norm, 6)::DOUBLE AS bm25_norm, final FROM
    (SELECT *, round({alpha}::DOUBLE * norm + (1 - {alpha}::DOUBLE) * cosine, 6) AS final FROM normed{suffix}) z
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) <= 50)"""


def search_sql(*ids: int, plans: str | None = None) -> str:
    """WITH clauses up to both arms."""
    return ",\n".join(["WITH " + projects_sql(), plans or plans_sql(*ids), CHUNKS_SQL, TOKENS_SQL, SEARCH_SQL])
