"""BPE encoding and decoding with a table of distinct words.

1. Texts are split into words (the tokenizer's own pre-tokens, lower-cased). Runs of whole texts of about `CHUNK`
   characters become chunks; a chunk holds each distinct word once, and its texts as numbers into that list.
2. The table of distinct words is dealt over tasks by a hash of the word; a chunk sends each share its words as one
   compressed row. So all chunks' copies of a word meet in one task, which encodes the word once (of more than `REMEMBERED` words,
   once each time it has to forget). A word is at most one entry a chunk, however often it occurs, so no word is hot, and rows grow with the chunks alone.
3. Ids come back to their chunk by place and are laid out in the order of the texts. Decoding looks every id up in the
   id-to-piece table, a broadcast whose size the vocabulary fixes, and joins the pieces.

Texts are never shuffled, only word numbers; a chunk, the largest thing a task holds, is bounded unless one text is longer.

Defined results: null and empty texts have no ids and decode to the empty text. The strings of special tokens inside a
text become special ids, as the library has it. Repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import release, sub_batches, trimmed
from kestrion.sources.scratch import Scratch

CHUNK = 6_500_000
#: Shares of the table of distinct words, whatever the session's partitions: a chunk sends one row to each. More of them suit larger vocabularies.
SHARES = 64
#: Distinct words that a task remembers; beyond, it forgets them and encodes those that come again once more.
REMEMBERED = 1_000_000
#: The fixed pattern by which the tokenizer splits; `_` and digits beyond \\d are told apart below.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+")
#: Texts of these characters only are split by _SPLIT just as by the tokenizer; others word by word by the library itself.
_PLAIN = re.compile(r"[\x20-\x5e\x60-\x7e\n\t\rÀ-ÖØ-öø-įı-ſ]*\Z")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_OTHER = re.compile(r"[^ \n\t\r]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_words(text: str) -> list[str]:
    """Pieces whose encodings, one after the other, are the encoding of the text.

    Text beyond the plain Latin characters is cut at white space only, and the library splits and normalises the rest.
    """
    if _PLAIN.match(text) and not _SPECIAL.search(text):
        return _SPLIT.findall(text.lower())
    return [w for x in _OTHER.findall(text) for w in (_SPLIT.findall(x.lower()) if _PLAIN.match(x) and not _SPECIAL.search(x) else [x])]


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of seven bits: first all lowest, each marked if more follow, then the next of those marked."""
    rest, planes = numbers.astype(np.uint32, copy=False), []
    while True:
        more = rest > 127
        planes.append((rest.astype(np.uint8) & 127 | more.astype(np.uint8) << 7).tobytes())
        rest = rest[more] >> 7
        if not len(rest):
            return len(numbers).to_bytes(8, "little") + zstandard.compress(b"".join(planes), 5)


def unpack(blob: bytes) -> np.ndarray:
    raw, n = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8), int.from_bytes(blob[:8], "little")
    out, at, shift, start = np.zeros(n, np.uint32), slice(None), 0, 0
    while n:
        plane = raw[start : start + n]
        out[at] += (plane & 127).astype(np.uint32) << np.uint32(shift)
        marked = np.flatnonzero(plane > 127)
        at = marked if isinstance(at, slice) else at[marked]
        start, n, shift = start + n, len(marked), shift + 7
    return out


def pack_ids(ids: np.ndarray) -> bytes:
    """Token ids, compressed, in the least width that holds them; neighbours repeat, so they stay whole."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + zstandard.compress(ids.astype(f"<u{width}").tobytes(), 5)


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), f"<u{blob[0]}").astype("<u4")


def split_chunks(docs: DataFrame, shares: int, chunk_chars: int = CHUNK, also: tuple[str, ...] = ()) -> DataFrame:
    """chunk, doc_ids, counts (words of each text), places (the texts' words as numbers), share_of, words, and a list of each of the columns `also`.

    A chunk's distinct words are numbered by falling frequency; share_of tells by number to which of the table's `shares` a
    word belongs (a hash of the word), words has each share's words in order of their numbers.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        words: dict[str, int] = {}
        ids, counts, places, size = [], [], [], 0
        others: list[list] = [[] for _ in also]

        def made() -> pa.RecordBatch:
            flat = np.concatenate(places)
            places.clear()
            rank = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int32)
            number[rank] = np.arange(len(words))
            known = list(words)
            share_of = np.fromiter([xxhash.xxh3_64_intdigest(w.encode()) % shares for w in known], np.int64, len(known))[rank]
            dealt: list[list[str]] = [[] for _ in range(shares)]
            for at, share in zip(rank.tolist(), share_of.tolist()):
                dealt[share].append(known[at])
            blobs = [zstandard.compress("\n".join(x).encode(), 5) if x else None for x in dealt]
            return pa.RecordBatch.from_arrays(
                [pa.array([base + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([pack(number[flat])], pa.binary()), pa.array([pack(share_of)], pa.binary()), pa.array([blobs], pa.list_(pa.binary())), *(pa.array([x], pa.list_(t)) for x, t in zip(others, types))],
                names=["chunk", "doc_ids", "counts", "places", "share_of", "words", *also],
            )

        for part, texts in sub_batches(batches, "text"):
            more = [part.column(part.schema.get_field_index(c)) for c in also]
            types = [c.type for c in more]
            for doc_id, text, *values in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, *(c.to_pylist() for c in more)):
                if ids and size + len(text or "") > chunk_chars:
                    yield made()
                    n += 1
                    words.clear()
                    ids, counts, places, size = [], [], [], 0
                    others = [[] for _ in also]
                found = split_words(text or "")
                places.append(np.fromiter([words.setdefault(w, len(words)) for w in found], np.int32, len(found)))
                ids.append(doc_id)
                for x, value in zip(others, values):
                    x.append(value)
                counts.append(len(found))
                size += len(text or "")
        if ids:
            yield made()

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    fields = "".join(f", `{c}` array<{kept.schema[c].dataType.simpleString()}>" for c in also)
    return kept.mapInArrow(trimmed(split), f"chunk long, doc_ids array<long>, counts array<int>, places binary, share_of binary, words array<binary>{fields}")


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """(chunk, share, words) to (chunk, share, counts and ids of the words); a share's words meet in one task and are encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for blob in batch.column(2):
                words = zstandard.decompress(blob.as_py()).decode().split("\n")
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in words if w not in known]
                for low in range(0, len(new), 5000):
                    part = new[low : low + 5000]
                    known.update(zip(part, (e.ids for e in tokenizer(path).encode_batch(part, add_special_tokens=False))))
                ids = [known[w] for w in words]
                out.append((pack(np.array([len(x) for x in ids])), pack_ids(np.fromiter(chain.from_iterable(ids), np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["chunk", "share", "counts", "ids"])

    return rows.mapInArrow(trimmed(encode), "chunk long, share int, counts binary, ids binary")


def piece_table(path: str) -> np.ndarray:
    """Pieces by id; the vocabulary bounds its size."""
    t = tokenizer(path)
    out = np.full(t.get_vocab_size(with_added_tokens=True), "", object)
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = piece
    return out


def assemble(chunks: DataFrame, encoded: DataFrame, path: str, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded, and the columns `also`."""
    pieces = chunks.sparkSession.sparkContext.broadcast(piece_table(path))

    def lay_out(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        release()
        by_share = np.argsort(rows["share"].to_numpy())
        counts, ids = (np.concatenate([np.zeros(0, "<u4"), *(read(rows[c][int(i)].as_py()) for i in by_share)]) for c, read in (("counts", unpack), ("ids", unpack_ids)))
        types = [chunk[c].type.value_type for c in also]
        made = [pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string()), **{c: pa.array([], t) for c, t in zip(also, types)}})]
        for doc_ids, sizes, places, share_of, *others in zip(*(chunk[c].to_pylist() for c in ("doc_ids", "counts", "places", "share_of", *also))):
            order = np.argsort(unpack(share_of), kind="stable")  # numbers in the order in which the shares list them
            per_word, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            per_word[order], start[order] = counts, np.cumsum(counts, dtype=np.int64) - counts
            texts = [" ".join(pieces.value[ids[a : a + n]]) for a, n in zip(start.tolist(), per_word.tolist())]
            at, numbers = 0, unpack(places)
            for low in range(0, len(doc_ids), 200):  # a few texts at a time become columns, so that nothing is held twice
                out_ids, out_text = [], []
                for n in sizes[low : low + 200]:
                    mine = numbers[at : at + n].astype(np.int64)
                    at += n
                    each = per_word[mine]
                    shift = np.repeat(start[mine] - (np.cumsum(each) - each), each)
                    out_ids.append(ids[shift + np.arange(len(shift))].tobytes())
                    out_text.append(" ".join([t for t in map(texts.__getitem__, mine.tolist()) if t]))
                more = {c: pa.array(x[low : low + 200], t) for c, x, t in zip(also, others, types)}
                made.append(pa.table({"doc_id": pa.array(doc_ids[low : low + 200], pa.int64()), "ids": pa.array(out_ids, pa.binary()), "decoded": pa.array(out_text, pa.string()), **more}))
        return pa.concat_tables(made)

    fields = "".join(f", `{c}` {chunks.schema[c].dataType.elementType.simpleString()}" for c in also)
    joined = chunks.select("chunk", "doc_ids", "counts", "places", "share_of", *also).groupBy("chunk").cogroup(encoded.groupBy("chunk"))
    return joined.applyInArrow(lay_out, f"doc_id long, ids binary, decoded string{fields}")


def encode_decode(docs: DataFrame, path: str, chunk_chars: int = CHUNK, also: tuple[str, ...] = (), shares: int = SHARES) -> DataFrame:
    """doc_id, ids, decoded of every document, and its columns `also`."""
    spark = docs.sparkSession
    chunks = Scratch(spark, "bpe").keep(split_chunks(docs, shares, chunk_chars, also), "chunks")
    rows = chunks.select("chunk", F.posexplode("words").alias("share", "words")).where("words is not null")
    return assemble(chunks, encode_words(rows.repartition(min(shares, int(spark.conf.get("spark.sql.shuffle.partitions"))), "share"), path), path, also)


def digest(encoded: DataFrame, *also: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns `also`."""
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *also)
