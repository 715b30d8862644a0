"""Search semantics on small corpora."""

from __future__ import annotations

import pytest

from kestrion.operators import assemble, search

CHUNKS = "chunk_id long, label string, content string, project_id string, doc_type string, language string, embedding array<float>"
PLANS = "query_id long, projects array<string>, type_names array<string>, topics array<string>, doc_types array<string>, languages array<string>, embedding array<float>"
HITS = "query_id long, chunk_id long, final double, token_est long"


def plan(query_id=1, projects=(), types=(), topics=(), doc_types=(), languages=(), vector=None):
    return (query_id, list(projects), list(types), list(topics), list(doc_types), list(languages), vector)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "message BuildRequest", "a build request with tags", "a", "contract", "proto", [1.0, 0.0]),
        (2, "message BuildResponse", "the answer to a build", "a", "contract", "proto", [0.0, 1.0]),
        (3, "fn widget", "une café élève widget widget", "b", "plan", "rust", [-1.0, 0.0]),
        (4, "empty", "", "b", "meta", "unknown", None),
        (5, "zero", "nothing near", "c", "meta", "go", [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_no_keywords_leave_the_vector_arm(spark, chunks):
    plans = spark.createDataFrame([plan(vector=[1.0, 0.0])], PLANS)
    assert not search.bm25_search(chunks, plans).count()
    hits = search.hybrid_once(chunks, plans)
    assert found(hits, "chunk_id", "cosine") == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert all(r.bm25_norm == 0 for r in hits.collect())


def test_phrases_need_adjacency_within_one_column(spark, chunks):
    plans = spark.createDataFrame([plan(topics=["build request"]), plan(2, topics=["request build"]), plan(3, topics=["BuildRequest a"]), plan(4, topics=["CAFE eleve"]), plan(5, topics=["..."])], PLANS)
    assert found(search.bm25_search(chunks, plans), "query_id", "chunk_id") == [(1, 1), (4, 3)]


def test_equal_phrases_count_twice_and_statistics_ignore_filters(spark, chunks):
    plans = spark.createDataFrame([plan(topics=["widget"]), plan(2, topics=["widget", "widget"]), plan(3, topics=["widget"], languages=["rust"])], PLANS)
    scores = dict(found(search.bm25_search(chunks, plans), "query_id", "bm25"))
    assert abs(scores[2] - 2 * scores[1]) < 2e-6 and scores[3] == scores[1]


def test_common_terms_keep_the_least_weight(spark):
    rows = [(i, "x", "same words", "a", "plan", "go", None) for i in range(4)]
    plans = spark.createDataFrame([plan(topics=["same"])], PLANS)
    scores = search.bm25_scores(spark.createDataFrame(rows, CHUNKS), plans).collect()
    assert len(scores) == 4 and all(0 < r.bm25 <= 2e-6 for r in scores)


def test_filters_and_their_fallback(spark, chunks):
    plans = [
        plan(1, topics=["widget"], languages=["go"], vector=[1.0, 0.0]),
        plan(2, topics=["widget"], doc_types=["convention"], vector=[1.0, 0.0]),
        plan(3, projects=["b"], topics=["build"], languages=["helm"], vector=[1.0, 0.0]),
        plan(4, projects=["zz"], topics=["build"], vector=[1.0, 0.0]),
    ]
    hits = search.hybrid_search(chunks, spark.createDataFrame(plans, PLANS))
    by = {q: {(r.chunk_id, r.relaxed) for r in hits.collect() if r.query_id == q} for q in (1, 2, 3, 4)}
    assert by[1] == {(c, True) for c in (1, 2, 3)} and by[2] == by[1]
    assert by[3] == {(3, True)} and by[4] == set()


def test_unknown_projects_are_no_filter(spark):
    plans = spark.createDataFrame([plan(1, projects=["Alpha", "nope"]), plan(2, projects=["nope"]), plan(3), plan(4, projects=["É"])], PLANS)
    projects = spark.createDataFrame([("1", "ALPHA"), ("2", "é")], "project_id string, name string")
    assert {r.query_id: r.projects for r in search.resolve_projects(plans, projects).collect()} == {1: ["1"], 2: [], 3: [], 4: []}


def test_each_arm_is_cut_before_the_blend(spark):
    bm25 = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.5)], "query_id long, chunk_id long, bm25 double")
    cosine = spark.createDataFrame([(1, 3, 0.9), (1, 1, 0.5)], "query_id long, chunk_id long, cosine double")
    assert found(search.merge(bm25, cosine, 0.6), "chunk_id", "final") == [(1, 0.8), (2, 0.3), (3, 0.36)]
    zero = bm25.selectExpr("query_id", "chunk_id", "0.0D AS bm25")
    assert found(search.merge(zero, cosine, 0.6, 1), "chunk_id", "final") == [(3, 0.36)]


def test_cosine_rejects_other_dimensions(spark, chunks):
    plans = spark.createDataFrame([plan(vector=[1.0, 0.0, 0.0])], PLANS)
    with pytest.raises(Exception, match="dimensions"):
        search.cosine_search(chunks, plans).collect()


@pytest.mark.parametrize(
    ("hits", "budget", "ids", "used"),
    [
        ([(1, 0.9, 9000), (2, 0.8, 100), (3, 0.7, 50)], 200, [2, 3], 150),
        ([(1, 0.9, 100), (2, 0.8, 100)], 200, [1, 2], 200),
        ([(1, 0.9, 100), (2, 0.8, 101)], 200, [1], 100),
        ([(1, 0.15, 10), (2, 0.149, 10)], 200, [1], 10),
        ([(1, 0.9, 2**32 - 1), (2, 0.5, 1)], 200, [2], 1),
        ([(2, 0.5, 1), (1, 0.5, 1)], 1, [1], 1),
        ([(1, 0.9, 300)], 200, [], None),
    ],
)
def test_budget(spark, hits, budget, ids, used):
    got = assemble.select_within_budget(spark.createDataFrame([(1, *h) for h in hits], HITS), budget).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ids and all(r.tokens_used == used for r in got)


def test_render_and_tags(spark):
    rows = spark.createDataFrame([(1, 2, "B", "plan", "two"), (1, 1, "A", "contract", "one")], "query_id long, place int, label string, doc_type string, content string")
    assert assemble.render(rows, "t").first().block == "<t>\n## A [contract]\none\n\n## B [plan]\ntwo\n</t>\n"
    plans = spark.createDataFrame([plan(1, ["X", "two", "one"]), plan(2, ["none"]), plan(3)], PLANS)
    projects = spark.createDataFrame([("ONE", "d1"), ("Two", "d2"), ("x", None)], "name string, domain string")
    got = assemble.resolve_domains(plans, projects)
    assert dict(found(got.select("query_id", assemble.tag_of(got.domain, "dflt").alias("tag")), "query_id", "tag")) == {1: "d2-context", 2: "dflt", 3: "dflt"}


def test_index_tasks_are_bounded_whatever_the_term(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"doc-{i}", "the same word in all chunks, the same again", "a", "plan", "go", None) for i in range(400)]
    corpus, plans = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([plan(types=["the"], topics=["same word"])], PLANS)
    monkeypatch.setattr(search.TermIndex, "SEGMENT", 2000, raising=False)
    monkeypatch.setattr(search, "ROWS_A_TASK", 200, raising=False)
    index = search.TermIndex.build(corpus, str(tmp_path / "i"))
    per_file = index.rows.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("c")).collect()
    assert sum(r.n for r in per_file) == 400 * 11 and max(r.n for r in per_file) <= 1000  # segments of some 40 chunks
    assert sum(r.c for r in per_file) == 400  # whole chunks
    met, count = [], search.phrase_hits
    monkeypatch.setattr(search, "phrase_hits", lambda rows: met.append(rows) or count(rows))
    assert search.bm25_scores(corpus, plans, index=index).count() == 400
    shares = [r["count"] for r in met[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 400 * 5 and max(shares) <= 600  # terms: the, the; same, same; word


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("stem", [False, True])
def test_the_index_finds_what_the_texts_hold(spark, chunks, tmp_path, monkeypatch, most, stem):
    plans = [plan(1, types=["message BuildRequest"], topics=["a build", "widget", "widget"]), plan(2, ["b"], topics=["widget widget", "CAFE eleve"], languages=["rust"]), plan(3, topics=["none of it"]), plan(4)]
    plans += [plan(9, topics=[f"w{i}" for i in range(15)] + ["zero", "answer to", "the"])]  # more terms than a filter tells one by one
    plans = spark.createDataFrame(plans, PLANS)
    want = found(search.bm25_search(chunks, plans, stem=stem), "query_id", "chunk_id", "bm25")
    monkeypatch.setattr(search, "BROADCAST_ROWS", most, raising=False)
    monkeypatch.setattr(search.TermIndex, "SEGMENT", 40, raising=False)
    index = search.TermIndex.build(chunks, str(tmp_path / "i"), stem)
    assert index.stats.first().n == 5
    assert found(search.bm25_search(chunks, plans, index=index), "query_id", "chunk_id", "bm25") == want and len(want) > 5
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 3)
    assert found(search.bm25_search(chunks, plans, index=index), "query_id", "chunk_id", "bm25") == want
    assert found(search.bm25_search(chunks, plans, stem=stem), "query_id", "chunk_id", "bm25") == want


def test_an_index_of_nothing_finds_nothing(spark, chunks, tmp_path):
    index = search.TermIndex.build(chunks.limit(0), str(tmp_path / "i"))
    plans = spark.createDataFrame([plan(topics=["widget", "a build"])], PLANS)
    assert index.stats.first().n == 0 and search.bm25_search(chunks, plans, index=index).collect() == []
