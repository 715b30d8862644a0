"""The operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kestrion.llm import bpe, embedding_dedup, entry, html_extract, language_id, minhash, mixing, oracles, quality_classifier, quality_rules, token_counts, url_filter
from kestrion.llm.common import WordHash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, kept boolean, block long, `key` string, n long, label string, slot string, chunk int, __text string, predicted int, held_out string"


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"wort{i % 977} und" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "de", "a", 1), (4, long, "de", None, 1), (5, "same words here", "en", "b", 2), (5, "same words here", "en", "b", 2), (6, "same words here", None, "b", 2), (None, "no id at all", "en", "c", 3), (7, "123 456 !!!", "en", "c", 3), (8, "\n\n  \n", "en", "c", 3), (9, "日本語 текст ελληνικά <|endoftext|> İ x", "en", "c", 3)]
    tail = (0.5, True, 1, "k", 2, "l", "s", 3, "t", 1, "h")
    return spark.createDataFrame([r + tail for r in rows], DOCS + EXTRA)


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


# 1. near-duplicate documents


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_groups(texts):
    def shingle(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingle(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] and texts[i] is not None or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return components_of(len(texts), links)


def family(seed, n, edits):
    """A base and copies of it with random word edits."""
    r = random.Random(seed)
    base = [f"w{seed}x{r.randrange(10_000)}" for _ in range(150)]
    out = [" ".join(base)]
    for i in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits)):
            copy[r.randrange(len(copy))] = f"e{i}y{r.randrange(1000)}"
        out.append(" ".join(copy))
    return out


def test_minhash_groups(spark):
    texts = family(1, 70, 8) + family(2, 5, 3) + family(3, 40, 1) + ["a b c", "A  b c", "", "", None, None, "x"] + [f"alone {i} " + " ".join(f"z{i}q{j}" for j in range(30)) for i in range(20)]
    found = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(brute_groups(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def adjoining(seed, n=40):
    """Two large families whose middles are far apart, and a member of each that are near to each other."""
    base = [f"w{seed}x{i}" for i in range(300)]

    def edited(places, mark):
        return " ".join(f"{w}{mark}" if i in places else w for i, w in enumerate(base))

    other = {20 * i + 7 for i in range(12)}  # six edits of 300 words keep 0.8, seven don't
    places = sorted(other)
    base_b = [f"{w}v" if i in other else w for i, w in enumerate(base)]
    near_a, near_b = edited(set(places[:3]), "v"), edited(set(places[:9]), "v")
    own = [9 + 7 * i for i in range(n)]
    copies_a = [edited({i}, "a") for i in own]
    copies_b = [" ".join(f"{w}b" if i == k else w for i, w in enumerate(base_b)) for k in own]
    return [" ".join(base), *copies_a, near_a, " ".join(base_b), *copies_b, near_b]


def test_minhash_joins_adjoining_families(spark):
    texts = [t for seed in range(8) for t in adjoining(seed)]
    found = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    expected = brute_groups(texts)
    assert len(set(expected)) == 8 and found == dict(enumerate(expected))


@pytest.mark.parametrize("small", [2, 16, 100_000])
def test_minhash_bridges_at_any_size(spark, small):
    """Families that one pair joins: no size of group that is compared at once may lose it."""
    texts = [t for seed in range(20, 26) for t in adjoining(seed, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    scratch = minhash.Scratch(spark, "bridges")
    signed = scratch.keep(minhash.sign(docs), "signed")
    pairs = minhash.links(docs, signed, scratch.keep(minhash.classes_of(signed), "classes"), scratch, small=small)
    parts = {r.node: r.component for r in minhash.components(pairs, scratch).collect()}
    expected = brute_groups(texts)
    assert len(set(expected)) == 6 and {i: parts.get(i, i) for i in range(len(texts))} == dict(enumerate(expected))


def test_minhash_ids_at_several_texts(spark):
    """Rows go by their text where an id stands at several."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (4, None), (4, c), (5, None), (2, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.groups(df).collect()
    assert len(found) == len(rows) and {r.component_id for r in found if r.doc_id == 3} == {1}
    assert Counter((r.doc_id, r.text) for r in minhash.dedup(df).collect()) == Counter([(1, a), (1, b), (4, c), (4, None), (5, None)])


def test_minhash_on_documents(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    found = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    groups = brute_groups([r.text for r in rows])
    assert found == {r.doc_id: rows[g].doc_id for r, g in zip(rows, groups)}
    assert minhash.dedup(docs).count() == len(set(groups))


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(5)
    elements = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.uniform(0, 3, 60), r.uniform(0, 3, 60)
    a[:10], b[50:] = 0, 0
    both = np.concatenate([elements[a > 0], elements[b > 0]])
    owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sig = minhash.dart_signatures(both, np.concatenate([a[a > 0], b[b > 0]]), owner, 2, 4000)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig != minhash.EMPTY).all() and abs((sig[0] == sig[1]).mean() - truth) < 0.03


@pytest.mark.parametrize("scale, base", [(1e-3, -12), (1e-3, -8), (1.0, 0), (1e3, 0), (1e3, 8)])
def test_darts_at_any_scale(scale, base):
    import time

    r = np.random.default_rng(7)
    elements = r.integers(0, 2**63, 80).astype(np.uint64)
    a, b = scale * r.uniform(0.1, 3, 80), scale * r.uniform(0.1, 3, 80)
    a[:8], b[72:] = 0, 0
    both = np.concatenate([elements[a > 0], elements[b > 0]])
    owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    began = time.perf_counter()
    sig = minhash.dart_signatures(both, np.concatenate([a[a > 0], b[b > 0]]), owner, 2, 4000, base)
    assert time.perf_counter() - began < 20
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig != minhash.EMPTY).all() and abs((sig[0] == sig[1]).mean() - truth) < 0.03


def test_minhash_counts_as_weights():
    h = WordHash()
    text = "a b c d e f g h " + "x y z w v " * 50
    plain, _ = minhash.signatures([text, text + "x y z w v"], 5, 400, "binary", h)
    counted, sizes = minhash.signatures([text, text + "x y z w v"], 5, 400, "count", h)
    assert (plain[0] == plain[1]).all() and 0.9 < (counted[0] == counted[1]).mean() < 1 and sizes[0] == sizes[1]


def test_differing_coordinates(spark):
    r = np.random.default_rng(2)
    sig = r.integers(0, 2**63, (6, 80)).astype(np.uint64)
    sig[3, :70] = sig[2, :70]
    bits = minhash.nibbles(sig).tolist()
    df = spark.createDataFrame([(i, j, bits[i], bits[j]) for i in range(6) for j in range(6)], "i int, j int, a array<long>, b array<long>")
    for row in df.select("i", "j", minhash.differing(df.a, df.b, 80).alias("d")).collect():
        assert row.d == sum((int(x) ^ int(y)) & 15 != 0 for x, y in zip(sig[row.i], sig[row.j]))


def test_prefix_pairs_lose_nothing(spark):
    r = random.Random(4)
    pool = list(range(60))
    sets = [sorted(r.sample(pool, r.randrange(8, 14))) for _ in range(120)]
    sets += [sorted(set(s) ^ {r.choice(pool)}) for s in sets]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, s array<long>")
    rare = minhash.prefixes(df, 0.8)
    pairs = minhash.prefix_pairs(rare, df.selectExpr("doc_id AS id"), 0.8)
    found = {(p.a, p.b) for p in minhash.verify(pairs, df, 0.8).collect()}
    assert found == {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}


def test_minhash_odd(spark, odd):
    found = minhash.groups(odd).collect()
    by = {r.doc_id: r.component_id for r in found}
    assert len(found) == odd.count() and by[4] == 3 and by[6] == 5 and by[1] == 1 and by[None] is None and len(set(by.values())) == 8
    kept = minhash.dedup(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert minhash.groups(odd.limit(0)).count() == 0 and minhash.dedup(odd.limit(0)).count() == 0


# 2. token counts


def test_token_counts_round_trip(spark, docs):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = token_counts._encoding(path, pattern)
    found = token_counts.count(docs, path, pattern, 50256).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.collect()} and len(found) == docs.count()
    by_file: dict = {}
    for r in sorted(found, key=lambda r: (r.file, r.doc_no)):
        assert r.doc_no == len(by_file.setdefault(r.file, [])) and r.terminated
        by_file[r.file].append(r)
    for rows in by_file.values():
        assert all(b.first_token == a.first_token + a.n_tokens + 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("block", [2, 4, 6, 64])
def test_token_scan_blocks(spark, tmp_path, block):
    r = np.random.default_rng(block)
    texts = {"part-0": r.integers(0, 4, 200), "part-1": np.array([3, 3, 1]), "part-2": np.array([1, 1]), "part-3": np.array([], int), "part-4": np.array([3])}
    want = []
    for name, tokens in texts.items():
        (tmp_path / name).write_bytes(tokens.astype("<u2").tobytes())
        ends = [*np.flatnonzero(tokens == 3)]
        if len(tokens) and tokens[-1] != 3:
            ends.append(len(tokens))
        want += [(name, i, int(a) + 1, int(b - a) - 1, bool(b < len(tokens))) for i, (a, b) in enumerate(zip([-1, *ends], ends))]
    for whole, range_bytes in ((1 << 30, 1), (6, 8), (1, 1000)):  # all files whole, long ones in ranges, all in ranges
        found = token_counts.scan(spark, str(tmp_path), 3, block, run=3, whole=whole, range_bytes=range_bytes).collect()
        assert sorted((x.file.rpartition("/")[2], x.doc_no, x.first_token, x.n_tokens, x.terminated) for x in found) == sorted(want)


def test_token_counts_of_rolled_files(spark, docs, data):
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
    table = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in token_counts.count(table, *args).collect()}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        found = token_counts.count(table, *args, width=4, whole=4000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert {r.doc_id: r.n_tokens for r in found} == want and len({(r.file, r.doc_no) for r in found}) == len(found) == len(want)
    assert len({r.file for r in found}) >= len(want) / 7


def test_token_file_names(spark):
    names = ["x/part-00003-1f2e-c012-c4de-aaaa-c77777777777-c005.txt", "part-00000-aaaa-c000", "file:/part-9/part-00012-c1c1c1c1-c0.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [tuple(r) for r in df.select(*token_counts.place_of_file(df.n)).collect()] == [(3, 5), (0, 0), (12, 0)]


def test_token_widths(docs, tmp_path):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for end, width in ((70_000, 2), (5, 2), (50256, 3)):
        with pytest.raises(ValueError):
            token_counts.write_flat(docs, str(tmp_path / "x"), path, pattern, end, width)


def test_token_counts_odd(spark, odd, tmp_path):
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
    found = token_counts.count(odd, *args).collect()
    assert len(found) == odd.count() and sum(r.n_tokens == 0 for r in found) == 2
    assert token_counts.count(odd.limit(0), *args).count() == 0
    (tmp_path / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number"):
        token_counts.scan(spark, str(tmp_path), 3).collect()


# 3. mixing


@pytest.mark.parametrize("seed", range(6))
def test_frame_keeps_every_prefix_within_a_block(seed):
    r = random.Random(seed)
    slots = mixing.shares({f"s{i}": r.random() ** 3 for i in range(r.randrange(1, 20))}, 256)
    frame = mixing.edf_frame(slots)
    assert sum(slots.values()) == 256 and sorted(x[2] for x in frame) == list(range(256))
    done = Counter()
    for name, k, slot, release, deadline in sorted(frame, key=lambda x: x[2]):
        assert k == done[name] and release <= slot < deadline
        done[name] += 1
        assert all(abs(done[s] - c * (slot + 1) / 256) < 1 for s, c in slots.items())


@pytest.mark.parametrize("block_chars, run_blocks, runs", [(500, 64, 4096), (3000, 2, 3), (64_000, 1, 2)])
def test_mixed_documents_keep_the_weights(spark, docs, monkeypatch, block_chars, run_blocks, runs):
    """In every prefix of slots each source's characters are within a block and the documents reaching over it of weight x time."""
    monkeypatch.setattr(mixing, "RUN_BLOCKS", run_blocks)
    monkeypatch.setattr(mixing, "RUNS", runs)
    rows = mixing.schedule(docs, block_chars=block_chars).collect()
    total = Counter()
    for r in rows:
        total[r.source] += len(r.text or "")
    slots = mixing.shares({f"s{k}": max(n, 1) ** mixing.TEMPERATURE for k, n in total.items()}, mixing.FRAME)
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r.source, {}).setdefault(r.block, []).append(len(r.text or ""))
    for source, blocks in by_source.items():
        longest, done = max(max(x) for x in blocks.values()), 0
        for j in range(max(blocks) + 1):  # a block starts where it should, but for the last document before it
            assert j * block_chars <= done < j * block_chars + longest + block_chars or j not in blocks
            done += sum(blocks.get(j, []))
        assert sum(map(sum, blocks.values())) == total[source]
    end = 1 + max(r.slot for r in rows if r.in_target)
    done = Counter()
    at: dict = {}
    for r in rows:
        at.setdefault(r.slot, []).append(r)
    for slot in range(end):
        for r in at.get(slot, []):
            done[r.source] += len(r.text or "")
        for source in total:
            longest = max(map(max, by_source[source].values()))
            assert abs(done[source] - slots[f"s{source}"] / mixing.FRAME * (slot + 1) * block_chars) < block_chars + longest


def test_schedule(spark, docs):
    found = mixing.schedule(docs, block_chars=500).collect()
    assert len(found) == docs.count() and all(r.release <= r.slot < r.deadline for r in found)
    used = {(r.slot): (r.source, r.block) for r in found}
    assert len(set(used.values())) == len(used)
    only = mixing.schedule(docs, weights={"src0": 3, "src1": 1, "gone": 5}, block_chars=500, frame=16).collect()
    assert {r.source for r in only if r.slot is not None} == {"src0", "src1"} and len(only) == len(found)
    assert Counter(r.doc_id for r in mixing.interleave(docs).collect()) == Counter(r.doc_id for r in found)


def test_mixing_odd(spark, odd):
    found = mixing.schedule(odd)
    assert found.count() == odd.count() and mixing.schedule(odd.limit(0)).count() == 0 and len(set(found.columns)) == len(found.columns)
    out = mixing.interleave(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


# 4. languages


def test_language_held_out_accuracy(spark, docs):
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.collect() if found[r.doc_id].held_out]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in found.values())


def test_profiles_are_sums_of_bound_letters():
    p = language_id.Profiler(64, 3)
    text = "Ab, ab"
    letters = {c: language_id.letter_vectors(np.array([ord(c) if c != " " else 0]), 64)[0].astype(int) for c in "ab "}
    total = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in (" ab", "ab ", "b a", " ab", "ab "))
    assert np.allclose(p.vectors([text])[0], total / np.linalg.norm(total), atol=1e-6)
    many = ["".join(map(chr, range(0x4E00 + 50 * i, 0x4E00 + 50 * i + 300))) for i in range(40)]
    assert np.allclose(p.vectors(many)[7], p.vectors([many[7]])[0], atol=1e-5)


def test_language_odd(spark, odd):
    found = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[7].lang_pred == found[8].lang_pred == "und" and found[1].score == 0
    assert found[3].lang_pred == "de" and found[None].held_out
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}


# 5. quality classifier


def test_quality_held_out_accuracy(spark, docs, labels):
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [r for r in labels.collect() if found[r.doc_id].held_out]
    assert len(found) == docs.count() and sum(found[r.doc_id].predicted == r.quality for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_quality_score_is_the_difference_alone(spark, docs, labels):
    """Every score is the calibrated difference of sizes that plain calls of the library give; held-out texts rank by it."""
    model = quality_classifier.fit(docs, labels.where(~language_id.in_fold("doc_id", 3, 1)))
    plain = [quality_classifier.zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=quality_classifier.zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    rows, score = docs.collect(), {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    difference = {}
    for r in rows:
        raw = (r.text or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + quality_classifier.PIECE])) for i in range(0, len(raw), quality_classifier.PIECE)) for c in plain)
        difference[r.doc_id] = (bad - good) / max(len(raw), 1)
    by_score = sorted(difference, key=lambda i: (difference[i], score[i]))
    assert all(score[a] <= score[b] + 1e-12 for a, b in zip(by_score, by_score[1:]))
    held = [(difference[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good, bad = [x for x, q in held if q == 1], [x for x, q in held if q == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality_odd(spark, odd, labels):
    found = quality_classifier.classify(odd, labels).collect()
    assert len(found) == odd.count()
    none = labels.limit(0)
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    good = spark.createDataFrame([(i, 1, None) for i in learned] + [(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(odd, good).collect()} == {1.0}
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0


# 6. BPE


def brute_bpe(texts):
    t = bpe.tokenizer(entry.tokenizer_path())
    out = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def digests(df):
    return Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df).collect())


def test_bpe_equals_the_library(spark, docs, odd):
    path = entry.tokenizer_path()
    assert digests(bpe.encode_decode(docs, path, chunk_chars=20_000)) == brute_bpe([r.text for r in docs.collect()])
    assert digests(bpe.encode_decode(odd, path, chunk_chars=50)) == brute_bpe([r.text for r in odd.collect()])
    assert bpe.encode_decode(odd.limit(0), path).count() == 0
    assert digests(bpe.encode_decode(odd.where("doc_id in (1, 2)"), path)) == brute_bpe([None, ""])


def test_bpe_forgets_words_and_deals_any_shares(spark, docs, monkeypatch):
    path = entry.tokenizer_path()
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    few = docs.limit(40)
    want = brute_bpe([r.text for r in few.collect()])
    for shares in (1, 3, 200):
        assert digests(bpe.encode_decode(few, path, chunk_chars=5_000, shares=shares)) == want


def test_bpe_packing():
    r = np.random.default_rng(6)
    for numbers in ([], [0], [127, 128, 16383, 16384, 2**32 - 1], r.integers(0, 2**21, 1000), r.integers(0, 100, 50)):
        assert bpe.unpack(bpe.pack(np.array(numbers, np.int64))).tolist() == list(numbers) == bpe.unpack_ids(bpe.pack_ids(np.array(numbers, np.int64))).tolist()


def test_bpe_words_of_any_characters():
    t, r = bpe.tokenizer(entry.tokenizer_path()), random.Random(3)
    kinds = [list(map(chr, range(0, 0x250))) + list("́̈  ΣσςİıK日😀٠²"), list(map(chr, range(32, 127))) + list("\n\t'_éÉßſ")]
    texts = ["".join(r.choice(k) for _ in range(50)) for k in kinds for _ in range(400)] + ["a<|endoftext|>b", "it's I'LL 'Re 's", "<|startoftext|>"]
    for text in texts:
        ids = [i for w in bpe.split_words(text) for i in t.encode(w, add_special_tokens=False).ids]
        assert ids == t.encode(text, add_special_tokens=False).ids, repr(text)


# 7. quality rules


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 20 or 100 * len(marked) > 30 * n


def test_quality_rule_counts(spark, docs, odd):
    for table in (docs, odd):
        texts = Counter((r.doc_id, *brute_counts(r.text)) for r in table.collect())
        found = quality_rules.cascade(table).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == texts
        assert not any(r.base_failed and r.kept for r in found) and all((r.rejected_by is None) == r.kept for r in found)
    assert quality_rules.cascade(odd.limit(0)).count() == 0


def test_rule_order_never_decides(spark, docs):
    orders = [list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    a, b = ({r.doc_id: r.kept for r in quality_rules.judge(docs, o).collect()} for o in orders)
    assert a == b and sorted(quality_rules.plan(["word " * 30])) == sorted(quality_rules.RULES)


# 8. embeddings


def brute_vectors(vectors):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    x = [np.array(v, np.float32).astype(float) if sound(v) else None for v in vectors]
    links = [(i, j) for i in range(len(x)) for j in range(i) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.95]
    degree = Counter(k for link in links for k in link)
    return {i: (degree[i], c) for i, c in enumerate(components_of(len(x), links))}


@pytest.mark.parametrize("chunk", [3, 8192])
def test_embedding_links(spark, chunk):
    r = np.random.default_rng(8)
    base = r.standard_normal((25, 12))
    noisy = [b + r.standard_normal(12) * r.uniform(0, 0.35) for b in base for _ in range(5)]
    vectors = [list(map(float, v * r.uniform(0.1, 9))) for v in [*base, *noisy, *noisy[:10]]]
    vectors += [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [3.0], vectors[0], vectors[0]]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, id string, copies int").repartition(3)
    found = embedding_dedup.near_duplicates(df, chunk=chunk).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_embedding_planted_links(spark):
    """Thousands of links in 64 dimensions, among them pairs at the border, between vectors that lie at random."""
    r = np.random.default_rng(64)
    base = r.standard_normal((900, 64))
    rows = [base, *(b + r.standard_normal((n, 64)) * np.linalg.norm(b) / 8 * r.uniform(0.05, 0.36) for b, n in zip(base[:60], r.integers(5, 60, 60)))]
    x = np.concatenate(rows)
    vectors = [v.tolist() for v in x * r.uniform(0.1, 9, (len(x), 1))]
    want = brute_vectors(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(4)
    for grid, chunk in ((2, 8192), (3, 100)):
        found = embedding_dedup.near_duplicates(df, grid=grid, chunk=chunk).collect()
        assert {v.vec_id: (v.n_links, v.component_id) for v in found} == want
    assert sum(n for n, _ in want.values()) > 4000


def test_embedding_doubles(spark):
    """Doubles are compared as doubles: cosines a hair beside the border, and components beyond single precision."""
    r = np.random.default_rng(3)
    a = r.standard_normal(64)
    a /= np.linalg.norm(a)
    side = r.standard_normal(64)
    side -= side @ a * a
    side /= np.linalg.norm(side)
    c = [0.95 + 3e-10, 0.95 - 3e-10]
    vectors = [a, *(x * a + np.sqrt(1 - x * x) * side for x in c), a * 1e300, a * 1e-300]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert {v.vec_id: v.n_links for v in embedding_dedup.near_duplicates(df).collect()} == {0: 3, 1: 4, 2: 1, 3: 3, 4: 3}


def test_trie_prunes_and_loses_nothing():
    r = np.random.default_rng(9)
    x = r.standard_normal((1500, 64))
    x[700:720] = x[:20] + 0.02 * r.standard_normal((20, 64))
    turned = embedding_dedup.unit(x) @ embedding_dedup.rotation(64)
    left = 0
    for s, radius in zip(embedding_dedup.splits(64, 4), embedding_dedup.radii(64, 4, 0.95)):
        a, b = embedding_dedup.Trie(turned[:, s], radius / 2, 8).within(turned[:, s], radius)
        left += (a < b).sum()
        distance = ((turned[:, None, s] - turned[None, :, s]) ** 2).sum(axis=2)
        near = np.argwhere(distance <= radius**2)
        assert set(map(tuple, near.tolist())) <= set(zip(a.tolist(), b.tolist()))
    assert left < 0.05 * 1500 * 1499 / 2


def test_embedding_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = sorted(df.collect())
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute_vectors([r.embedding for r in rows])
    assert found == {rows[i].vec_id: (n, rows[c].vec_id) for i, (n, c) in want.items()}


def test_embedding_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, None), (2, [1.0]), (2, [1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in found) == [(0, 0, True), (1, 0, True), (2, 1, True), (2, 1, True)]


# 9. URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


URLS = [None, "", "no scheme", "http://A.EXAMPLE.com/en/7?x=://", "http://com/en/", "https://xcom/en/1", "ftp://u.com", "http://b.net/de/8#f", "http://example.net/de/81", "http://q.example.org/es/", "http://ÉA.org/es/x", "://x.com/en/é", "http://a.com?/en/", "http://example.com/en/6"]


def test_urls_and_rules(spark, data):
    urls = URLS + [r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, None, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, host string")
    for r in url_filter.judge(df).collect():
        host, path, rule = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule[0] if rule else None, rule[1] if rule else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_rules_are_those_of_the_contract(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filter.RULES) == rules and len(url_filter.RULES) == len(rules)
    urls = {"http://com/en/": "com/en/", "http://example.com/en/6": "com/en/", "http://example.com/en/7": "example.com/en/7", "http://a.net/de/1": "net/de/", "http://example.net/de/7": "net/de/", "http://sub.example.net/de/81": "example.net/de/8", "http://example.net/fr/8": None, "http://q.org/es/": "org/es/"}
    rows = [(i, url, None) for i, url in enumerate(urls)]
    want = {i: (rule, rules.get(rule, "allow")) for i, rule in enumerate(urls.values())}
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[3:] for r in con.execute(oracles.SQL["op9_url_filter"]).fetchall()} == want


def test_links_spread_trust_and_distrust(spark):
    def page(i, host, *to):
        return i, f"http://{host}/fr/{i}", "".join(f'<p><A class=x HREF="//{t}/y">t</a>' for t in to)

    rows = [(1, "http://bad.com/en/1", "<a href='http://other.org/'>"), page(2, "farm.org", "bad.com", "bad.com"), page(3, "fan.org", "farm.org"), page(4, "clean.org", "good.org"), (5, "http://example.com/en/7", '<a href="https://liked.org/">'), page(6, "liked.org"), page(7, "bad.com"), page(8, "other.org")]
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[4] for r in con.execute(oracles.SQL["op9_url_filter"]).fetchall()} == found


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_queries_match_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = con.execute(oracles.SQL[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_spread_is_personalised_pagerank(spark):
    from kestrion.sources.scratch import Scratch

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1)]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((4, 4))
    for s, t, n in edges:
        m[names.index(t), names.index(s)] = n / sum(e[2] for e in edges if e[0] == s)
    seed = np.array([0.25, 0.75, 0, 0])
    rank = seed * 0.15
    for _ in range(15):
        rank = seed * 0.15 + 0.85 * m @ rank
    found = url_filter.spread(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 0.25), ("b", 0.75)], "host string, mass double"), Scratch(spark, "t"))
    got = {r.host: r.reached for r in found.collect()}
    assert all(abs(got.get(n, 0) - (rank - seed * 0.15)[i]) < 1e-9 for i, n in enumerate(names))


# 10. HTML


def test_html_pages(spark, data):
    import html as entities

    for r in html_extract.extract(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies and more cookies on this site</div><main><article><header><h2>Head &amp; line</h2></header>
<p>First <b>bold</b>  text<br>goes on &lt;here&gt;.<p>Second paragraph without an end tag <script>var x = "<p>no</p>";</script>
<aside>Related things that nobody wants to read at all</aside><ul><li>item one<li>item two</ul><form><p>Mail us</p><input></form><p hidden>gone</p>
<blockquote>Quoted</blockquote><div id="comments"><p>Great post, thank you so much for it</p></div></article></main><footer>&copy; nobody</footer></body></html>"""


def test_html_structure():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst bold text goes on <here>.\n\nSecond paragraph without an end tag\n\nitem one\n\nitem two\n\nQuoted"


def test_html_without_marks():
    menu = "".join(f'<div><a href="/{i}">Entry {i}</a></div>' for i in range(12))
    body = "".join(f"<p>{'A sentence of some length follows here. ' * 6}{i}</p>" for i in range(5))
    text = html_extract.main_text(f"<body><div>{menu}</div><div>{body}</div></body>")
    assert "Entry" not in text and text.count("\n\n") == 4


@pytest.mark.parametrize("html", [None, "", "<", "<!--", "<p", "</div></p>", "<script>", "&#0;&bogus;", "<![CDATA[x]]>", "<a b='", "<p>" * 5000])
def test_html_odd(html):
    assert isinstance(html_extract.main_text(html), str)


LONG = f"<p>{'Some long enough paragraph of text that goes on and on. ' * 4}</p>"
TEXT = ("Some long enough paragraph of text that goes on and on. " * 4).strip()


@pytest.mark.parametrize(
    "html, blocks",
    [
        (f'<div id="page" class="has-sidebar"><nav><a href=x>Menu</a></nav><article><h1>T</h1>{LONG}<p>short</p></article></div><footer>a footer of some length too</footer>', ["T", TEXT, "short"]),
        (f'<div class="layout sidebar-right"><article><h1>T</h1>{LONG}</article></div>', ["T", TEXT]),
        (f'<article><h1>T</h1>{LONG}<section class="social-science">{LONG}</section><div class="ad">BUY THIS NOW</div></article>', ["T", TEXT, TEXT]),
        (f'<body><div class="site-header">Site</div><div id="content"><h1>Title</h1><div>{LONG}</div><div><p>short</p></div><div>{LONG}</div></div><div class="site-footer">Copyright and more</div><section class="comments">{LONG}</section></body>', ["Title", TEXT, "short", TEXT]),
        (f'<form id="aspnetForm"><div class="cookie-notice">{"We use cookies. " * 9}</div><main><h1>T</h1>{LONG}</main></form>', ["T", TEXT]),
        (f'<article><h1>T</h1>{LONG}<section id="comments"><article class="comment">{LONG}</article></section></article>', ["T", TEXT]),
        (f'<article><h1>T</h1>{LONG}{LONG}</article><div class="related"><article><a href=z>Other story</a></article></div>', ["T", TEXT, TEXT]),
        (f"<main><article><h1>T</h1>{LONG}</article><div>By a writer</div></main>", ["T", TEXT]),
        ("<nav><a href=x>Home</a> words that are text</nav>", []),
    ],
)
def test_html_regions(html, blocks):
    assert html_extract.main_text(html) == "\n\n".join(blocks)


@pytest.mark.parametrize("change", [lambda v: np.ones(len(v)), lambda v: -v, lambda v: np.random.default_rng(len(v)).random(len(v))])
def test_html_ratio_decides(data, monkeypatch, change):
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table(f"{data}/pages.parquet")["html"].to_pylist() if h]
    before = [html_extract.main_text(h) for h in pages]
    monkeypatch.setattr(html_extract, "smoothed", change)
    assert sum(html_extract.main_text(h) == b for h, b in zip(pages, before)) <= 0.02 * len(pages)


def test_html_smoothing():
    v = np.array([0, 3.0, 0, 5, 1, 0, 0, 0, 2])
    k = [np.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 2 else 0 for i in range(9) for j in range(9)]
    k = np.array(k).reshape(9, 9)
    assert np.allclose(html_extract.smoothed(v), np.where(v > 0, k @ v / np.maximum(k @ (v > 0), 1e-9), 0))


@pytest.mark.parametrize("head, tail", [("<div>", "</div>"), ("<b><span>", "</i>"), ("<article><p>a<b>", "</p></b>"), ("<li>", "</ul>")])
def test_html_deep(head, tail):
    import time

    began = time.perf_counter()
    assert "hello" in html_extract.main_text(head * 100_000 + "hello" + tail * 100_000)
    assert time.perf_counter() - began < 60


def test_html_empty_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert html_extract.extract(pages.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, "u", "plain &amp; text")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(nulls).collect()) == [("", 0), ("plain & text", 12)]
