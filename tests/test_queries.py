"""Every registered query beside its SQL, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kestrion.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 9) if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_are_lossless(spark, data):
    from kestrion.operators.windows import MOST_CHARS, window_documents

    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = window_documents(docs.selectExpr("doc_id", "'d' AS label", "text"), ["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc: dict = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.chunk_index)):
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.content) <= MOST_CHARS and r.token_est == -(-len(r.content) // 4)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        assert [p.label for p in parts] == ["d"] + [f"d#{i}" for i in range(2, len(parts) + 1)]
        if not any(p.truncated for p in parts):
            assert "".join(p.content for p in parts) == texts[doc_id]


def test_porter_arm_against_sqlite(spark, data):
    import sqlite3

    from kestrion.operators import search
    from kestrion.plans import corpus

    chunks = corpus.chunks(spark, data, vectors=False)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(label, content, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, label, content) VALUES (?, ?, ?)", [(r.chunk_id + 1, r.label, r.content) for r in chunks.collect()])
    want = dict(con.execute("SELECT rowid - 1, -rank FROM f WHERE f MATCH '\"the edoned\" OR \"anding\" OR \"running\"'"))
    plans = spark.createDataFrame([(1, [], [], ["the edoned", "anding", "running"], [], [])], "query_id long, projects array<string>, type_names array<string>, topics array<string>, doc_types array<string>, languages array<string>")
    got = {r.chunk_id: r.bm25 for r in search.bm25_scores(chunks, plans, stem=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
