"""The pipeline's stages, one after the other and on odd input."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from kestrion.llm import mixing
from kestrion.sources.scratch import used
from tests.llm.test_operators import DOCS


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == columns, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert sorted(r.doc_id for r in last.collect()) == sorted(ids)
    whole = driver.queries()["pipeline"](spark, data)
    assert {(r.doc_id, r.ids_sha256) for r in whole.collect()} == {(r.doc_id, r.ids_sha256) for r in last.collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, data, k):
    rows = [(1, None, None, None, None, 0.5), (2, "", "en", "a", 0, 0.5), (3, "same words", "en", "b", 2, None), (3, "same words", "en", "b", 2, None), (None, "no id", "en", "c", 3, 1.0)]
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (spark.createDataFrame(rows, DOCS + ", score double"), spark.createDataFrame([], DOCS)):
        out = stage(spark, docs, data)
        assert out.count() <= docs.count() and (k == 4 or out.columns == docs.columns)


def test_the_mix_reaches_the_last_rows(spark, data):
    """Ordered by slot, the last stage's rows meet the target weights, which the sources' own shares are far from."""
    block, blocks = mixing.BLOCK_CHARS, {"a": 40, "b": 8, "c": 8}
    text = "some words of it " * (block // 4 // 17)
    rows = [(i, text, "en", s, 0) for i, s in enumerate(s for s, n in blocks.items() for _ in range(4 * n))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    last = corpus_pipeline.token_ids(spark, corpus_pipeline.mix(spark, docs, data), data)
    source, found = {r[0]: r[3] for r in rows}, sorted((r.slot, r.doc_id, r.in_target, r.n_tokens) for r in last.collect())
    expected = {r.doc_id: (r.slot, r.in_target) for r in mixing.schedule(docs).collect()}
    assert {d: (slot, t) for slot, d, t, _ in found} == expected and len(found) == len(rows)
    assert [t for *_, t, _ in found] == sorted((t for *_, t, _ in found), reverse=True)
    total = sum(n**mixing.TEMPERATURE for n in blocks.values())
    weight = {s: n**mixing.TEMPERATURE / total for s, n in blocks.items()}
    slots = {s: {slot for slot, d, t, _ in found if t and source[d] == s} for s in blocks}
    end = 1 + max(max(x, default=0) for x in slots.values())
    assert end >= 8
    for s in blocks:
        assert all(sum(slot < now for slot in slots[s]) < weight[s] * now + 1.1 for now in range(1, end + 1)), s
    first = [source[d] for _, d, t, _ in found if t]
    assert all(abs(first.count(s) / len(first) - weight[s]) < 0.05 for s in blocks) and abs(weight["a"] - 40 / 56) > 0.1


def test_the_last_stage_takes_the_places_from_the_mix(spark, data, tmp_path):
    """Other weights in the mix are other slots at the end, through files in any order too; without the mix there are none."""
    text = "some words of it " * 2000
    rows = [(i, f"{i} {text}", "en", "abc"[i % 3], 0) for i in range(60)]
    rows += [(7, "same id, other text", "en", "a", 0), (8, "", "en", "b", 0), (8, None, "en", "c", 0), (None, "no id", "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def places(out):
        return sorted((str(r.doc_id), r.slot, r.in_target) for r in out.collect())

    found = []
    for k, weights in enumerate((None, {"a": 9, "b": 1, "c": 1})):
        mixing.interleave(docs, weights=weights).repartition(2).write.parquet(path := f"{tmp_path}/{k}")
        found.append(places(corpus_pipeline.token_ids(spark, spark.read.parquet(path), data)))
        assert found[k] == places(mixing.schedule(docs, weights=weights))
    assert found[0] != found[1]
    assert {x[1:] for x in places(corpus_pipeline.token_ids(spark, docs, data))} == {(None, False)}


def test_rows_alike_have_one_place(spark):
    """No row is lost or repeated for it, one in another source has its own, and a document that came later has none."""
    rows = [(1, "x" * 50_000, "en", "a", 0)] * 5 + [(1, "x" * 50_000, "en", "c", 0)] + [(None, None, "en", None, 0)] * 3 + [(2, "y", "en", "b", 0)]
    mixed = mixing.interleave(spark.createDataFrame(rows, DOCS))
    found = mixing.placed(mixed.unionByName(spark.createDataFrame([(3, "later", "en", "a", 0)], DOCS)), mixing.places_of(mixed)).select("__row.doc_id", "__row.source", "slot").collect()
    assert len(found) == 11 and len({tuple(r) for r in found}) == 5 and len({r.slot for r in found}) == 5 and [r.doc_id for r in found if r.slot is None] == [3]


def test_run_hands_the_places_on(spark, data, monkeypatch):
    """What the mix decided outlives the clearing between stages; the pipeline without its mix tells no slots."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {(r.doc_id, r.slot, r.in_target) for r in corpus_pipeline.run(spark, data).collect()}
    assert found == {(r.doc_id, r.slot, r.in_target) for r in mixing.schedule(docs).collect()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("no mix", lambda spark, docs, sf_dir: docs), corpus_pipeline.STAGES[1]])
    assert {r.slot for r in corpus_pipeline.run(spark, data).collect()} == {None}


def test_language_stage_drops_unlearned_languages_only(spark, data):
    """Texts in scripts that no profile has seen go; clean texts in learned languages stay, short ones too."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    strange = ["Καλημέρα κόσμε πώς είσαι σήμερα το πρωί", "Съешь же ещё этих мягких французских булок", "天地玄黃 宇宙洪荒 日月盈昃", "zq xj vk wqx jzq qxv kzj xwq zvq jxk"]
    more = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), data).collect()}
    clean = [r.doc_id for r in docs.collect() if r.lang and len((r.text or "").split()) >= 5]
    assert not any(10**9 + i in kept for i in range(len(strange)))
    assert sum(i in kept for i in clean) >= 0.995 * len(clean)


def test_run_leaves_only_its_last_tables(spark, data):
    before = set(used(spark))
    corpus_pipeline.run(spark, data)
    left = [b.rpartition("/")[2].rpartition("-")[0] for b in used(spark) if b not in before]
    assert left.count("pipeline") == 1 and "minhash" not in left and "dedup" not in left


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {name.partition("_")[0] for name in driver.queries()}
