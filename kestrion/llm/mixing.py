"""Mixing sources to target weights with Pfair scheduling.

Each source's documents lie in a line, ordered by a hash of the id, and block j holds those that begin in its j-th `block_chars` characters.
Source s with weight w runs its block j in the window from floor(j / w), its release, to ceil((j + 1) / w), its deadline; in every slot the
released block with the earliest deadline runs. At every moment each source is then less than one block away from weight x time, and so
are its characters, but for what the last document reaches over its block. A document longer than a block leaves those that it reaches over
without documents, so that later ones are not late.

Where a document begins is a running sum of characters in three levels, so that no window sees more than a bounded part of a source: the
hash cuts a source into runs of about `RUN_BLOCKS` blocks, runs into `RUNS` groups; groups, runs and documents are summed up each within the level above.
Ids and lengths are what is shuffled for it, unless the caller keeps more columns.

Weights are rounded to `frame`ths (each source at least one), which makes the schedule periodic: one frame is simulated
on the driver (frame x log sources steps, whatever the input) and the slot of any block follows from its number. So all
that is gathered is one row a source, and all that is broadcast one row a slot of the frame.

No document is lost or repeated: when a source runs out, its slots stay empty and the others' order goes on. `in_target`
marks the slots before the first source ran out, up to which the weights hold.

Weights: given by source (sources not named, or with weight 0, get no slot), or in proportion to characters to the power
`temperature` (1: as they are; 0: all alike). Defined results: null is a source of its own; null text has no characters;
documents without an id are hashed by their text; ties of the hash go by id, then length. An empty table gives an
empty schedule. More than `MOST_SOURCES` sources are refused with an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from kestrion.sources.scratch import Scratch

BLOCK_CHARS, TEMPERATURE, FRAME = 64_000, 0.7, 1024
#: Blocks to a run of documents, runs to a group of runs.
RUN_BLOCKS, RUNS = 64, 4096
#: Sources beyond which the per-source table is refused; it is gathered and broadcast.
MOST_SOURCES = 65_536
_NAME = "coalesce(concat('s', source), 'null')"
#: What a document is known again by; rows alike in all of it have one place, the first of theirs.
_KEY = {"__source": "source", "__id": "doc_id", "__chars": "length(text)", "__hash": "xxhash64(text)"}
#: In the metadata of columns: the path of their documents' places.
LINK = "mixing.places"


def shares(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Whole slots of a frame by largest remainder, at least one each."""
    names = sorted(k for k, w in weights.items() if w > 0)
    if len(names) > frame:
        raise ValueError("a frame needs a slot for every source")
    total, free = sum(weights[k] for k in names), frame - len(names)
    exact = {k: weights[k] / total * free for k in names}
    out = {k: 1 + int(exact[k]) for k in names}
    for k in sorted(names, key=lambda k: (int(exact[k]) - exact[k], k))[: frame - sum(out.values())]:
        out[k] += 1
    return out


def edf_frame(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block in the frame, slot, release, deadline) of one frame by earliest deadline first."""
    frame, out, ready = sum(slots.values()), [], []
    released = [(0, name, 0) for name in sorted(slots)]
    heapq.heapify(released)
    for now in range(frame):
        while released and released[0][0] <= now:
            _, name, k = heapq.heappop(released)
            heapq.heappush(ready, (-(-(k + 1) * frame // slots[name]), name, k))
        deadline, name, k = heapq.heappop(ready)
        out.append((name, k, now, k * frame // slots[name], deadline))
        if k + 1 < slots[name]:
            heapq.heappush(released, ((k + 1) * frame // slots[name], name, k + 1))
    return out


ADDED = ("block", "release", "deadline", "slot", "in_target")


def lined_up(docs: DataFrame, per_source: DataFrame, block_chars: int) -> DataFrame:
    """The rows, their columns by number (__c0, ...), with __name, the source's columns, and __at, the characters of the source before the row."""
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    facts = (F.expr(_NAME).alias("__name"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__n"), F.pmod(hashed, F.lit(1 << 40)).alias("__h"), F.col("doc_id").alias("__id"))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), *facts).join(F.broadcast(per_source), "__name", "left")
    # a run is an interval of hashes, so that runs in order hold the documents in order
    rows = rows.withColumn("__run", F.floor(F.col("__h") / F.lit(1 << 40) * F.greatest(F.lit(1), F.ceil(F.col("__blocks") / RUN_BLOCKS))))
    sums = rows.groupBy("__name", "__run").agg(F.sum("__n").alias("chars")).withColumn("group", F.floor(F.col("__run") / RUNS))
    sums = Scratch(docs.sparkSession, "mixing").keep(sums, "runs")
    groups = sums.groupBy("__name", "group").agg(F.sum("chars").alias("chars"))

    def before(column: str, order: str, *keys: str):
        return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = groups.select("__name", "group", before("chars", "group", "__name").alias("earlier"))
    runs = sums.select("__name", "group", "__run", before("chars", "__run", "__name", "group").alias("inside")).join(groups, ["__name", "group"])
    runs = runs.select("__name", "__run", (F.col("inside") + F.col("earlier")).alias("__start"))
    order = Window.partitionBy("__name", "__run").orderBy("__h", "__id", "__n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    return rows.join(runs, ["__name", "__run"]).withColumn("__at", F.col("__start") + F.col("__in"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_chars: int = BLOCK_CHARS, frame: int = FRAME) -> DataFrame:
    """The documents with block, release, deadline, slot (null where the source has no weight) and in_target.

    Columns of the documents with these names give way to them.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.expr(_NAME).alias("name")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    blocks = {r.name: max(1, -(-r.chars // block_chars)) for r in sizes}
    if weights is None:
        target = {r.name: max(r.chars, 1) ** temperature for r in sizes}
    else:
        target = {n: float(w) for k, w in weights.items() if (n := "null" if k is None else f"s{k}") in blocks}
    active = sum(w > 0 for w in target.values())
    while frame < 8 * active:
        frame *= 2
    slots = shares(target, frame) if active else {}
    table = edf_frame(slots) if slots else []
    at = {(name, k): slot for name, k, slot, _, _ in table}
    first_gap = min((blocks[n] // c * frame + at[n, blocks[n] % c] for n, c in slots.items()), default=0)
    per_source = spark.createDataFrame([(n, b, slots.get(n)) for n, b in sorted(blocks.items())], "__name string, __blocks long, __slots int")
    per_slot = spark.createDataFrame(table, "__name string, __k int, __slot int, __release int, __deadline int")
    out = lined_up(docs, per_source, block_chars).withColumn("block", F.floor(F.col("__at") / block_chars)).withColumn("__k", F.pmod("block", "__slots").cast("int"))
    out = out.join(F.broadcast(per_slot), ["__name", "__k"], "left")
    base = F.floor(F.col("block") / F.col("__slots")) * frame
    return out.select(
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED),
        "block",
        *((base + F.col(f"__{x}")).cast("long").alias(x) for x in ("release", "deadline", "slot")),
        F.coalesce(base + F.col("__slot") < first_gap, F.lit(False)).alias("in_target"),
    )


def places_of(docs: DataFrame) -> str | None:
    """Where the places lie that `interleave` gave these documents; None if they don't come from it."""
    return next((f.metadata[LINK] for f in docs.schema if LINK in f.metadata), None)


def placed(docs: DataFrame, places: str | None = None) -> DataFrame:
    """Each document as __row, with the slot and in_target that `interleave` gave it; null and false if it gave none.

    Nothing is scheduled here: the places are those that the documents' schema names, whatever happened to their order.
    """
    places = places or places_of(docs)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *(F.expr(e).alias(k) for k, e in _KEY.items()))
    if places is None:
        return rows.select("__row", F.lit(None).cast("long").alias("slot"), F.lit(False).alias("in_target"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in _KEY]
    found = rows.alias("d").join(docs.sparkSession.read.parquet(places).alias("p"), same, "left")
    return found.select("__row", "slot", F.coalesce("in_target", F.lit(False)).alias("in_target"))


def interleave(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves in the schedule's order (those without a slot last), range-partitioned by it.

    Files and shuffles don't keep an order; so each document's place is written to a table too, whose path goes with the
    columns' metadata (Spark's Parquet files keep it), and `placed` tells it again.
    """
    scratch, keys = Scratch(docs.sparkSession, "places"), [F.expr(e).alias(k) for k, e in _KEY.items()]
    slots = schedule(docs.select("doc_id", "source", "text", *keys), **how).groupBy(*_KEY)
    places = scratch.paths[id(scratch.keep(slots.agg(F.min("slot").alias("slot"), F.max("in_target").alias("in_target")), "places"))][0]
    order = [F.col("slot").asc_nulls_last(), F.xxhash64("__row.doc_id", F.lit(3))]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = placed(docs, places).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return out.select(*(F.col(f"__row.`{f.name}`").alias(f.name, metadata=f.metadata | {LINK: places}) for f in docs.schema))
