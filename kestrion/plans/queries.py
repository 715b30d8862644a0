"""The registered queries of the retrieval engine, over whole tables, each beside its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kestrion.functions import secrets, text
from kestrion.operators import assemble, planning, search
from kestrion.plans import corpus
from kestrion.plans.corpus import CHUNKS_SQL, TOKENS_SQL, blend_sql, doc_type_sql, plans_sql, projects_sql, search_sql
from kestrion.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def resolved(spark: SparkSession, sf_dir: str, *ids: int) -> DataFrame:
    return search.resolve_projects(corpus.plans(spark, sf_dir, *ids), corpus.projects(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, ceil(length(text) / 4.0)::INTEGER AS token_est FROM documents")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("token_est"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def stored(spark, sf_dir) -> DataFrame:
    """An earlier state of the corpus: the labelled documents, with an older text where they are labelled toxic."""
    old = table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id")
    return old.select("doc_id", text.content_hash(F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))).alias("content_hash"))


STORED_SQL = "stored AS (SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN text || ' (old)' ELSE text END) AS content_hash FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {STORED_SQL} SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM documents d LEFT JOIN stored s USING (doc_id) WHERE sha256(d.text) IS DISTINCT FROM s.content_hash")
def hash_gate_changed(spark, sf_dir):
    from kestrion.operators.index import changed

    walked = documents(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return changed(walked, stored(spark, sf_dir), ["doc_id"]).select("doc_id", "state")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def prune_orphans(spark, sf_dir):
    kept = table(spark, sf_dir, "labels").where("quality = 1")
    return documents(spark, sf_dir).select("doc_id").join(kept, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def prune_keep(spark, sf_dir):
    kept = table(spark, sf_dir, "labels").where("quality = 1")
    return documents(spark, sf_dir).select("doc_id").join(kept, "doc_id", "left_semi")


@query(f"WITH {STORED_SQL} SELECT doc_id, coalesce(n.h, s.content_hash) AS content_hash, CASE WHEN s.doc_id IS NULL THEN 2 ELSE 1 END AS created_at, CASE WHEN n.h IS NULL OR n.h = s.content_hash THEN 1 ELSE 2 END AS updated_at FROM (SELECT doc_id, sha256(text) AS h FROM documents) n FULL JOIN stored s USING (doc_id)")
def document_upsert(spark, sf_dir):
    from kestrion.operators.index import changed
    from kestrion.store import upsert_rows

    old = stored(spark, sf_dir).select("doc_id", "content_hash", F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    walked = documents(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    new = changed(walked, old, ["doc_id"]).select("doc_id", "content_hash", F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
    return upsert_rows(old, new, ["doc_id"])


@query("SELECT conv_id, turn, CASE WHEN k = 1 THEN role ELSE role || '#' || k END AS label FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) x")
def label_disambiguate(spark, sf_dir):
    from kestrion.operators.index import disambiguate

    return disambiguate(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("label")), ["conv_id"], "turn").select("conv_id", "turn", "label")


#: Lines of long texts are walked one by one: w is the window that a line falls into, n its length, size what the window holds by then.
WINDOW_SQL = r"""WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents WHERE length(text) > 6000) x),
sized AS (SELECT doc_id, i, length(line) AS n FROM lines),
walk AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS i, 0 AS w, 0::BIGINT AS size, true AS closed FROM sized
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN k.closed OR l.n > 6000 OR k.size + l.n > 6000 THEN k.w + 1 ELSE k.w END,
         CASE WHEN k.closed OR l.n > 6000 OR k.size + l.n > 6000 THEN l.n ELSE k.size + l.n END, l.n > 6000
  FROM walk k JOIN sized l ON l.doc_id = k.doc_id AND l.i = k.i + 1),
windows AS (
  SELECT doc_id, w, string_agg(left(line, 6000), '' ORDER BY i) AS content, bool_or(length(line) > 6000) AS truncated FROM walk JOIN lines USING (doc_id, i) GROUP BY doc_id, w
  UNION ALL SELECT doc_id, 1, coalesce(text, ''), false FROM documents WHERE coalesce(length(text), 0) <= 6000)
SELECT doc_id, (w - 1)::INTEGER AS chunk_index, 'doc-' || doc_id || CASE WHEN w > 1 THEN '#' || w ELSE '' END AS label, ceil(length(content) / 4.0)::INTEGER AS token_est, truncated, sha256(content) AS content_hash FROM windows"""


@query(WINDOW_SQL)
def window_chunks(spark, sf_dir):
    from kestrion.operators.windows import window_documents

    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("label"), "text")
    return window_documents(rows, ["doc_id"]).select("doc_id", "chunk_index", "label", "token_est", "truncated", text.content_hash(F.col("content")).alias("content_hash"))


SECRET_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in (x.replace("'", "''") for x in secrets.PATTERNS.values()))


@query(f"SELECT doc_id FROM documents WHERE NOT ({SECRET_SQL})")
def secret_scan_drop(spark, sf_dir):
    return documents(spark, sf_dir).where(~secrets.looks_like_secret(F.col("text"))).select("doc_id")


@query(f"SELECT source, count(*) FILTER (WHERE {SECRET_SQL}) AS n_secret, count(*) AS n FROM documents GROUP BY source")
def secret_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.count_if(secrets.looks_like_secret(F.col("text"))).alias("n_secret"), F.count("*").alias("n"))


#: Ends of file names, dealt over the documents by id.
ENDINGS = (".proto", ".go", ".rs", ".md", ".RS", ".tar.go", ".txt", "", ".")


@query(f"""SELECT doc_id, CASE lower(regexp_extract(name, '^.+[.]([^.]*)$', 1)) WHEN 'proto' THEN 'proto' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language, 'convention' AS doc_type
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'f' || doc_id END || list_extract({corpus.sql_list(ENDINGS)}, doc_id % {len(ENDINGS)} + 1) AS name FROM documents) x""")
def ext_fallback_classify(spark, sf_dir):
    """Of file names with every ending, some with nothing before it."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("a.dir/"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("f"), "doc_id")), ending)
    return documents(spark, sf_dir).select("doc_id", text.fallback_language(path).alias("language"), F.lit("convention").alias("doc_type"))


@query(f"SELECT {doc_type_sql()} || '/' || lang AS label, count(*) AS n FROM documents GROUP BY 1")
def label_histogram(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.concat_ws("/", corpus.doc_type(), "lang").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS_SQL}, {TOKENS_SQL} SELECT chunk_id, dl::BIGINT AS dl FROM lengths")
def tokenize_counts(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir, vectors=False)
    return c.select("chunk_id", (F.size(text.tokens(F.col("label"))) + F.size(text.tokens(F.col("content")))).cast("long").alias("dl"))


@query(f"WITH {CHUNKS_SQL}, {TOKENS_SQL} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM places GROUP BY term")
def term_df(spark, sf_dir):
    rows = search.token_rows(corpus.chunks(spark, sf_dir, vectors=False))
    return rows.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {CHUNKS_SQL}, {TOKENS_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(corpus.chunks(spark, sf_dir, vectors=False)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(search_sql(1, 2) + " SELECT * FROM arm_b")
def bm25_topk(spark, sf_dir):
    return search.bm25_search(corpus.chunks(spark, sf_dir, vectors=False), resolved(spark, sf_dir, 1, 2))


@query(search_sql() + " SELECT query_id, phrase - 1 AS phrase, chunk_id, tf FROM hits")
def bm25_phrase(spark, sf_dir):
    hits, _ = search.found_phrases(corpus.chunks(spark, sf_dir, vectors=False), resolved(spark, sf_dir), stem=False)
    return hits.select("query_id", "phrase", "chunk_id", "tf")


@query(search_sql(3, 6) + " SELECT * FROM arm_b")
def bm25_filtered(spark, sf_dir):
    return search.bm25_search(corpus.chunks(spark, sf_dir, vectors=False), resolved(spark, sf_dir, 3, 6))


@query(search_sql() + " SELECT * FROM arm_b")
def bm25_indexed(spark, sf_dir):
    """From a written index of terms."""
    from kestrion.sources.scratch import Scratch

    c = corpus.chunks(spark, sf_dir, vectors=False)
    return search.bm25_search(c, resolved(spark, sf_dir), index=search.TermIndex.build(c, Scratch(spark, "terms").path("index")))


@query()
def bm25_porter(spark, sf_dir):
    """With stemmed terms; checked against the standard library's SQLite in tests."""
    return search.bm25_search(corpus.chunks(spark, sf_dir, vectors=False), resolved(spark, sf_dir, 1, 2), stem=True)


@query(search_sql(1, 5) + " SELECT * FROM arm_c")
def cosine_topk(spark, sf_dir):
    return search.cosine_search(corpus.chunks(spark, sf_dir), resolved(spark, sf_dir, 1, 5))


@query(search_sql(2, 3, 6) + " SELECT * FROM arm_c")
def cosine_filtered(spark, sf_dir):
    return search.cosine_search(corpus.chunks(spark, sf_dir), resolved(spark, sf_dir, 2, 3, 6))


def hybrid(alpha: float):
    def run(spark, sf_dir):
        return search.hybrid_once(corpus.chunks(spark, sf_dir), resolved(spark, sf_dir), alpha)

    return run


for _name, _alpha in (("hybrid_merge", 0.6), ("hybrid_alpha0", 0.0), ("hybrid_alpha1", 1.0)):
    QUERIES[_name], SQL[_name] = hybrid(_alpha), search_sql() + ",\n" + blend_sql(_alpha) + " SELECT * FROM blend"

_RELAXED = search_sql(plans=plans_sql().replace("plans AS (", "all_plans AS (", 1) + ", plans AS (SELECT query_id * 2 + relaxed AS query_id, projects, type_names, topics, CASE WHEN relaxed = 1 THEN []::VARCHAR[] ELSE doc_types END AS doc_types, CASE WHEN relaxed = 1 THEN []::VARCHAR[] ELSE languages END AS languages, vec_id FROM all_plans CROSS JOIN (VALUES (0), (1)) r(relaxed) WHERE relaxed = 0 OR len(doc_types) > 0 OR len(languages) > 0)")
HYBRID_SQL = _RELAXED + ",\n" + blend_sql(0.6, "twice") + """,
blend AS (SELECT query_id // 2 AS query_id, chunk_id, bm25, cosine, bm25_norm, final, query_id % 2 = 1 AS relaxed FROM twice
          WHERE query_id % 2 = 0 OR query_id - 1 NOT IN (SELECT query_id FROM twice))"""


@query(HYBRID_SQL + " SELECT * FROM blend")
def batch_hybrid(spark, sf_dir):
    return search.hybrid_search(corpus.chunks(spark, sf_dir), resolved(spark, sf_dir))


@query(HYBRID_SQL + " SELECT * FROM blend WHERE relaxed")
def hybrid_filter_fallback(spark, sf_dir):
    return batch_hybrid(spark, sf_dir).where("relaxed")


@query(f"WITH {projects_sql()}, {plans_sql()} SELECT query_id, coalesce((SELECT list_sort(list(r.name)) FROM projects r WHERE list_contains([lower(x) for x in p.projects], lower(r.name))), []) AS ids FROM plans p")
def hybrid_project_degrade(spark, sf_dir):
    return resolved(spark, sf_dir).select("query_id", F.col("projects").alias("ids"))


def selection(spark, sf_dir) -> DataFrame:
    hits = batch_hybrid(spark, sf_dir).join(corpus.chunks(spark, sf_dir, vectors=False).select("chunk_id", text.token_estimate(F.col("content")).alias("token_est")), "chunk_id")
    return assemble.select_within_budget(hits)


SELECTION_SQL = HYBRID_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
placed AS (SELECT b.query_id, b.chunk_id, b.final, c.token_est::BIGINT AS token_est, row_number() OVER (PARTITION BY b.query_id ORDER BY b.final DESC, b.chunk_id) AS k FROM blend b JOIN chunks c USING (chunk_id)),
walk AS (
  SELECT query_id, 0::BIGINT AS k, NULL::BIGINT AS chunk_id, 0::BIGINT AS token_est, 0::BIGINT AS used, 0::BIGINT AS place, false AS taken FROM placed WHERE k = 1
  UNION ALL
  SELECT w.query_id, p.k, p.chunk_id, p.token_est, CASE WHEN p.final >= 0.15 AND w.used + p.token_est <= 10000 THEN w.used + p.token_est ELSE w.used END,
         CASE WHEN p.final >= 0.15 AND w.used + p.token_est <= 10000 THEN w.place + 1 ELSE w.place END, p.final >= 0.15 AND w.used + p.token_est <= 10000
  FROM walk w JOIN placed p ON p.query_id = w.query_id AND p.k = w.k + 1),
selected AS (SELECT query_id, place, chunk_id, token_est, max(used) OVER (PARTITION BY query_id) AS tokens_used, used FROM walk WHERE taken)"""


@query(SELECTION_SQL + " SELECT query_id, place, chunk_id, token_est, tokens_used FROM selected")
def budget_select(spark, sf_dir):
    return selection(spark, sf_dir)


@query(SELECTION_SQL + " SELECT query_id, place, chunk_id, token_est, tokens_used, used AS cumulative_tokens FROM selected")
def cumulative_tokens(spark, sf_dir):
    return assemble.cumulative_tokens(selection(spark, sf_dir))


@query(HYBRID_SQL + " SELECT query_id, chunk_id, final FROM blend WHERE final >= 0.15")
def min_score_gate(spark, sf_dir):
    return batch_hybrid(spark, sf_dir).where(F.col("final") >= assemble.MIN_SCORE).select("query_id", "chunk_id", "final")


DOMAIN_SQL = """named AS (SELECT query_id, unnest(projects) AS name, generate_subscripts(projects, 1) AS pos FROM {plans}),
domains AS (SELECT p.query_id, min_by(r.domain, n.pos) AS domain FROM {plans} p LEFT JOIN named n USING (query_id) LEFT JOIN projects r ON lower(r.name) = lower(n.name) AND r.domain IS NOT NULL GROUP BY p.query_id)"""


@query(f"WITH {projects_sql()}, {plans_sql()}, {DOMAIN_SQL.format(plans='plans')} SELECT query_id, coalesce((SELECT any_value(d2.domain) FROM (SELECT n.query_id, min_by(r.domain, n.pos) AS domain FROM named n JOIN projects r ON lower(r.name) = lower(n.name) WHERE r.domain IS NOT NULL GROUP BY n.query_id) d2 WHERE d2.query_id = domains.query_id) || '-context', 'context') AS tag FROM domains")
def resolve_domain_tag(spark, sf_dir):
    found = assemble.resolve_domains(corpus.plans(spark, sf_dir), corpus.projects(spark))
    return found.select("query_id", assemble.tag_of(F.col("domain")).alias("tag"))


@query(SELECTION_SQL + """,
sections AS (SELECT s.query_id, s.place, '## ' || c.label || ' [' || c.doc_type || ']' || chr(10) || c.content || chr(10) AS section FROM selected s JOIN chunks c USING (chunk_id))
SELECT query_id, '<context>' || chr(10) || string_agg(section, chr(10) ORDER BY place) || '</context>' || chr(10) AS block FROM sections GROUP BY query_id""")
def render_block(spark, sf_dir):
    rows = selection(spark, sf_dir).join(corpus.chunks(spark, sf_dir, vectors=False), "chunk_id")
    return assemble.render(rows)


#: What a careless planner may answer, dealt over the conversations: known and unknown labels in any case, with white space of several kinds.
SAID_TYPES = ("\tplan\n", "Contract", " META\u00a0", "conventions", "", "pl an", "\u2003convention", "plan")
SAID_LANGUAGES = ("go\n", "RUST ", "klingon", "\r\nproto", "Ünknown", "\u3000markdown", "scala\x0b", "Go")
BLANKS = " \t\n\x0b\x0c\r\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def said(values: tuple[str, ...], by: int):
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.element_at(F.array(*map(F.lit, values)), ((F.col("conv_id") * by + F.col("turn") + i) % len(values) + 1).cast("int")))


def said_sql(values: tuple[str, ...], by: int, domain: tuple[str, ...]) -> str:
    cleaned = f"[lower(trim(list_extract({corpus.sql_list(values)}, (conv_id * {by} + turn + i) % {len(values)} + 1), '{BLANKS}')) for i in [0, 1, 2]]"
    return f"[x for x in {cleaned} if list_contains({corpus.sql_list(domain)}, x)]"


@query(f"SELECT conv_id, turn, {said_sql(SAID_TYPES, 1, planning.DOC_TYPES)} AS doc_types, {said_sql(SAID_LANGUAGES, 3, planning.LANGUAGES)} AS languages FROM conversations")
def plan_sanitize(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", said(SAID_TYPES, 1).alias("doc_types"), said(SAID_LANGUAGES, 3).alias("languages"))
    return planning.sanitize(raw)


@query(f"WITH {plans_sql()} SELECT query_id, projects, type_names, CASE WHEN query_id IN (1, 4) THEN ['given'] ELSE topics END AS topics, CASE WHEN query_id = 4 THEN ['plan'] ELSE doc_types END AS doc_types, languages FROM plans")
def plan_overrides(spark, sf_dir):
    o = spark.createDataFrame([(1, [], [], ["given"], [], []), (4, [], [], ["given"], ["plan"], [])], "query_id long, projects array<string>, type_names array<string>, topics array<string>, doc_types array<string>, languages array<string>")
    return planning.override(corpus.plans(spark, sf_dir).drop("embedding"), o)


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.skip') IS NULL AS no_skip, count(*) AS n FROM events GROUP BY 1, 2, 3")
def event_props(spark, sf_dir):
    """Properties out of JSON text, one that is there and one that isn't."""
    e = table(spark, sf_dir, "events")
    k, skip = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.skip")
    return e.groupBy("event_type", k.alias("k"), skip.isNull().alias("no_skip")).agg(F.count("*").alias("n"))
