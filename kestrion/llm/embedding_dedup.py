"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie sqrt(2 - 2 c) apart. After a random rotation the coordinates are split into `BLOCKS` blocks;
if two vectors are within that distance, their squared distance within some block of d of the D dimensions is at most
d / D of the squared distance. So a range join in each block, under its share of the budget, loses no pair.

The range join has two levels. Spark deals vectors by a grid over the block's first coordinates, whose cells are as wide as the block's
radius: only neighbouring cells meet (two coordinates, more where vectors are so many that cells stay full). A cell's vectors are dealt into chunks
of at most about `CHUNK` (so a hot cell is many small tasks), and pairs of chunks meet in a task. There a trie over up to `DEPTH` of the block's coordinates
is descended level by level, each node with the bounds of its vectors in that coordinate, as long as the distance to the bounds so far
is within the budget (`Trie`); what is left, far below a hundredth of the pairs of vectors that lie at random, is checked in the whole block, taken in the first block
that finds it, and verified with the exact cosine in double precision. Tasks return counts and a forest of links for their vectors, never pairs.

Equal vectors are one class from the start, counted by their number. What reaches the driver is the number of vectors in each
occupied cell: the grid bounds it (unit vectors have coordinates from -1 to 1), however many vectors there are.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length
don't link. Components keep the column's own precision, single or double (others are read as double). n_links counts other rows, copies too. Rows
with a null vec_id are kept, with no links. Of repeated vec_ids each row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from kestrion.llm.common import trimmed
from kestrion.llm.components import components, union_find
from kestrion.sources.scratch import Scratch

THRESHOLD, BLOCKS, GRID, CHUNK = 0.95, 4, 2, 8192
#: Coordinates of the trie, its cells by radius, vectors that descend it together, and what share of pairs makes whole products cheaper than single ones.
DEPTH, FINE, TOGETHER, DENSE = 8, 2, 64, 0.05
#: Room for rounding in the block filter; the verification is exact.
SLACK = 1e-6


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cells(block: np.ndarray, radius: float, grid: int) -> np.ndarray:
    """One row of `grid` cell numbers (0 where the block has fewer dimensions) for each row of a block."""
    out = np.zeros((len(block), grid), np.int64)
    got = np.floor(block[:, :grid] / radius).astype(np.int64)
    out[:, : got.shape[1]] = got
    return out


def splits(dims: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def radii(dims: int, blocks: int, threshold: float) -> list[float]:
    budget = 2 - 2 * threshold
    return [float(np.sqrt(budget * (s.stop - s.start) / dims) + SLACK) for s in splits(dims, blocks)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def grid_for(vectors: int, chunk: int) -> int:
    """Coordinates of the grid: as many as leave a chunk's worth of vectors to a cell of a six-fold split, at least GRID."""
    grid = GRID
    while grid < 6 and chunk * 6 ** (grid + 1) <= vectors:
        grid += 1
    return grid


def place(vectors: DataFrame, threshold: float, blocks: int, grid: int) -> DataFrame:
    """id, copies, v, dims, block, cell for each vector and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                x = part.column(2).flatten().to_numpy().astype(float).reshape(-1, dims)
                x = unit(x) @ rotation(int(dims))
                for b, (s, r) in enumerate(zip(splits(int(dims), blocks), radii(int(dims), blocks, threshold))):
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(list(cells(x[:, s], r, grid)), pa.list_(pa.int64()))], names=["id", "copies", "v", "dims", "block", "cell"])

    return vectors.select("id", "copies", "v").mapInArrow(trimmed(run), f"id long, copies long, v {vectors.schema['v'].dataType.simpleString()}, dims int, block int, cell array<long>")


def cell_plan(counts: list, chunk: int, grid: int) -> tuple[list, list]:
    """(dims, block, cell, number of chunks, first chunk) of each cell, and (first, number, first, number) of the chunks of cells that meet.

    Both are bounded by the grid, whatever the number of vectors.
    """
    n_chunks = {(r.dims, r.block, tuple(r.cell)): -(-r.n // chunk) for r in counts}
    first, total = {}, 0
    for key in sorted(n_chunks):
        first[key], total = total, total + n_chunks[key]
    steps = [s for s in np.ndindex(*[3] * grid) if s >= (1,) * grid]  # this cell and half of its neighbours
    pairs = []
    for dims, block, cell in sorted(n_chunks):
        own = (dims, block, cell)
        for step in steps:
            other = (dims, block, tuple(c + int(s) - 1 for c, s in zip(cell, step)))
            if other in n_chunks:
                pairs.append((first[own], n_chunks[own], first[other], n_chunks[other]))
    return [(d, b, list(c), n_chunks[d, b, c], first[d, b, c]) for d, b, c in sorted(n_chunks)], pairs


def meetings(pairs: DataFrame) -> DataFrame:
    """chunk, i, j, side of every two chunks i, j that meet: side 0 and 1, or 2 where a chunk meets itself."""

    def each(first: str, number: str) -> Column:
        return F.explode(F.sequence(F.col(first), F.col(first) + F.col(number) - 1))

    both = pairs.select("*", each("fa", "na").alias("i")).select("*", each("fb", "nb").alias("j")).where("fa <> fb or i <= j")
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("chunk"), F.lit(2).alias("side"))))
    sides = sides.otherwise(F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side"))))
    return both.select("i", "j", F.explode(sides).alias("s")).select("s.chunk", "i", "j", "s.side")


class Trie:
    """Rows sorted by their cells of width `width` in the first coordinates; a node is a run of rows that share cells so far."""

    def __init__(self, rows: np.ndarray, width: float, depth: int):
        code = np.floor(rows[:, :depth] / width).astype(np.int32)
        self.order = np.lexsort(code.T[::-1])
        code, rows = code[self.order], rows[self.order]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        self.levels, starts = [], []
        for k in range(depth):
            new[1:] |= code[1:, k] != code[:-1, k]
            start = np.flatnonzero(new)
            starts.append(start)
            self.levels.append((np.minimum.reduceat(rows[:, k], start), np.maximum.reduceat(rows[:, k], start)))
        starts.append(np.arange(len(rows)))  # the rows themselves
        edges = [np.append(np.searchsorted(below, above), len(below)) for above, below in zip(starts, starts[1:])]
        self.first, self.number = [e[:-1] for e in edges], [np.diff(e) for e in edges]

    def within(self, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (of `rows`, of the trie's rows) whose bounds are within the radius in the trie's coordinates."""
        budget, n = radius**2, len(self.levels[0][0])
        at, node, spent = np.repeat(np.arange(len(rows)), n), np.tile(np.arange(n), len(rows)), np.zeros(n * len(rows))
        for k, ((low, high), first, number) in enumerate(zip(self.levels, self.first, self.number)):
            x = rows[at, k]
            spent = spent + np.maximum(np.maximum(low[node] - x, x - high[node]), 0) ** 2
            near = np.flatnonzero(spent <= budget)
            at, node, spent = at[near], node[near], spent[near]
            times = number[node]
            ends = np.cumsum(times)
            at, spent, node = np.repeat(at, times), np.repeat(spent, times), np.repeat(first[node] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        return at, self.order[node]


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows i of a with rows j of b; of all of them at once where they are a good part of it."""
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536))])


def compare(left: np.ndarray, right: np.ndarray, same: bool, block: int, threshold: float, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows that this block is the first to find, a few rows at a time; with `same`, each pair once."""
    if not len(left) or not len(right):
        return
    dims = left.shape[1]
    turn, parts, reach = rotation(dims), splits(dims, blocks), radii(dims, blocks, threshold)
    ra, rb = unit(left) @ turn, unit(right) @ turn
    squares = [((ra[:, p] ** 2).sum(axis=1), (rb[:, p] ** 2).sum(axis=1)) for p in parts]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    if not all((x > 1e-150).all() and (x < 1e150).all() for x in norms):  # squares that overflow or vanish
        left, right = unit(left), unit(right)
        norms = np.ones(len(left)), np.ones(len(right))
    depth = min(DEPTH, parts[block].stop - parts[block].start)
    trie = Trie(rb[:, parts[block]], reach[block] / FINE, depth)

    def close(k: int, s: slice, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return squares[k][0][s][x] + squares[k][1][y] - 2 * dots(ra[s, parts[k]], rb[:, parts[k]], x, y) <= reach[k] ** 2

    for low in range(0, len(left), TOGETHER):
        s = slice(low, low + TOGETHER)
        x, y = trie.within(ra[s, parts[block]], reach[block])
        if same:
            later = y > x + low
            x, y = x[later], y[later]
        here = close(block, s, x, y)
        x, y = x[here], y[here]
        for k in range(block):
            if len(x):
                again = close(k, s, x, y)
                x, y = x[~again], y[~again]
        if len(x):
            linked = dots(left[s], right, x, y) / (norms[0][s][x] * norms[1][y]) >= threshold
            if linked.any():
                yield x[linked] + low, y[linked]


def join(placed: DataFrame, counts: list, threshold: float, blocks: int, grid: int, chunk: int) -> DataFrame:
    """id, n, root: links found in a task, and the least vector that they join the id to there."""
    spark = placed.sparkSession
    per_cell, pairs = cell_plan(counts, chunk, grid)
    dealt = placed.join(F.broadcast(spark.createDataFrame(per_cell, "dims int, block int, cell array<long>, chunks long, first long")), ["dims", "block", "cell"])
    dealt = dealt.withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("id", "block"), "chunks"))
    meet = meetings(spark.createDataFrame(pairs, "fa long, na long, fb long, nb long"))
    dealt = dealt.join(meet, "chunk").select("i", "j", "side", "block", "id", "copies", "v")

    def run(rows: pa.Table) -> pa.Table:
        ids, copies, side = (rows[c].to_numpy() for c in ("id", "copies", "side"))
        v = rows["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), -1)
        order = np.lexsort((ids, side))
        ids, copies, side, v = ids[order], copies[order], side[order], v[order]
        same = bool((side == 2).all())
        cut = len(ids) if same else int((side == 0).sum())
        n = np.zeros(len(ids), np.int64)
        shift = 0 if same else cut
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in compare(v[:cut], v[shift:], same, int(rows["block"][0].as_py()), threshold, blocks):
            np.add.at(n, x, copies[y + shift])
            np.add.at(n, y + shift, copies[x])
            forest = union_find(ids[x], ids[y + shift])
            a.append(forest[0])
            b.append(forest[1])
        node, root = union_find(np.concatenate(a), np.concatenate(b))
        top = dict(zip(node.tolist(), root.tolist()))
        some = n > 0
        return pa.table({"id": ids[some], "n": n[some], "root": np.array([top.get(i, i) for i in ids[some].tolist()], np.int64)}, pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return dealt.groupBy("i", "j").applyInArrow(run, "id long, n long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, grid: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    first = rows.where("key is not null").groupBy("key").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    vectors = scratch.keep(first, "vectors")
    classes = vectors.select("key", "id", "copies")
    grid = grid or grid_for(vectors.count(), chunk)
    placed = scratch.keep(place(vectors, threshold, blocks, grid), "placed")
    counts = placed.groupBy("dims", "block", "cell").agg(F.count("*").alias("n")).collect()
    out = rows.select("vec_id", "key").join(classes, "key", "left") if counts else rows.select("vec_id", "key", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copies"))
    if counts:
        found = scratch.keep(join(placed, counts, threshold, blocks, grid, chunk), "found")
        linked = scratch.keep(found.groupBy("id").agg(F.sum("n").alias("n")), "linked")
        parts = scratch.keep(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch), "components")
        out = out.join(linked, "id", "left").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component"))
    links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
