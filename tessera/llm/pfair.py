"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in a fixed pseudo-random order, form blocks of ``block_rows``. Block k of a source of weight w
is released at slot floor(k / w) and due at ceil((k + 1) / w); earliest-deadline-first picks one released block per slot,
so at every slot each source's share differs from its target by less than one block. Weights are exact: given ones are
read as the decimals they are written as and brought to whole units, so the schedule repeats after as many slots as there
are units (or ends before): one period is simulated, and every block's slot follows from it in closed form. When a
source runs out, the others go on in a new phase with their weights scaled up; there are at most as many phases as
sources, and no document is dropped or repeated. Without given weights, sources weigh whole thousandths of the sum of
the square roots of their sizes, at least one.

What the driver sees is one count per source. Up to ``broadcast_sources`` the phases are a small table that is broadcast.
With more sources, where phases would grow with their square, releases and deadlines are kept in virtual time, which runs
faster as sources run out, so that one pass schedules all blocks; it is written to the shared folder in parts and joined.
Both take time in proportion to the blocks at most. A source of any size is ranked through many hash ranges, so a hot
source never meets in one task.

Defined cases: null sources form one source of their own, the empty name; null ids are ordered first within their hash
range; ties of the hash are settled by the id, repeated rows among themselves; an empty table gives an empty result;
where weights are given, sources without one, or of weight 0, follow when all others have run out, in equal parts; a
negative weight is an error; extra columns are carried by ``mixed`` and ignored by ``schedule``.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir

BLOCK_ROWS = 32
BROADCAST_SOURCES = 1000
ROWS_PER_RANGE = 2000
WRITTEN_AT_ONCE = 1 << 20


def units_of(weights: dict[str, float]) -> dict[str, int]:
    """Whole units in the exact proportions of the weights; zero stays zero."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights must not be negative")
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


def default_units(sizes: dict[str, int]) -> dict[str, int]:
    total = sum(math.sqrt(n) for n in sizes.values())
    return {s: max(1, round(1000 * math.sqrt(n) / total)) for s, n in sizes.items()}


def period(units: dict[str, int], left: dict[str, int] | None = None) -> tuple[dict[str, list[int]], int]:
    """Slots of each source's blocks, by earliest deadline first among released blocks, and their number: one period,
    or less if a source has no more blocks before its end."""
    length = sum(units.values())
    waiting = [(0, -(-length // u), s, 0) for s, u in units.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in units}
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        _, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if left is not None and k + 1 == left[s]:
            return out, slot + 1
        if (k := k + 1) < units[s]:
            heapq.heappush(waiting, (k * length // units[s], -(-(k + 1) * length // units[s]), s, k))
    return out, length


def phases(blocks: dict[str, int], units: dict[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, units, period, slots within the period) until all blocks are placed."""
    done, start, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - done[s] for s, n in blocks.items() if done[s] < n}:
        active = {s: units[s] for s in left if units[s] > 0} or dict.fromkeys(left, 1)
        places, length = period(active, left)
        ends = []
        for s in active:
            u, last = len(places[s]), left[s] - 1
            if u:  # a source that has no slot so far can't be the first to end
                ends.append(last // u * length + places[s][last % u] + 1 if length == sum(active.values()) else length)
        end = min(ends)
        for s in active:
            u = len(places[s])
            n = end // length * u + sum(p < end % length for p in places[s])
            if n:
                out.append((s, done[s], done[s] + n, start, u, length, places[s]))
                done[s] += n
        start += end
    return out


def one_pass(blocks: dict[str, int], units: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) of every slot, for any number of sources, in virtual time: it advances each slot by one over the
    weights of the sources that have blocks, so releases k / w and deadlines (k + 1) / w need no new phase."""
    for wave in (
        {s: u for s, u in units.items() if u > 0 and blocks[s]},
        {s: 1 for s, u in units.items() if u <= 0 and blocks[s]},
    ):
        total, now = sum(wave.values()), 0.0
        waiting = [(0.0, 1 / u, s, 0) for s, u in wave.items()]
        heapq.heapify(waiting)
        ready: list[tuple[float, str, int]] = []
        while waiting or ready:
            while waiting and (waiting[0][0] <= now + 1e-9 / total or not ready):
                _, due, s, k = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, k))
            _, s, k = heapq.heappop(ready)
            yield s, k
            now += 1 / total
            if (k := k + 1) < blocks[s]:
                heapq.heappush(waiting, (k / wave[s], (k + 1) / wave[s], s, k))
            else:
                total -= wave[s]
                if not total:
                    break


def _written(spark: SparkSession, plan: Iterator[tuple[str, int]]) -> DataFrame:
    """The schedule as a table (_source, block, slot) in the shared folder, written in parts."""
    import pandas as pd  # only where there are very many sources

    path, part, slot = f"{shared_dir(spark)}/schedule-{uuid.uuid4().hex}", [], 0
    schema = "_source string, block long, slot long"

    def flush() -> None:
        frame = pd.DataFrame(part, columns=["_source", "block", "slot"])
        spark.createDataFrame(frame, schema).write.mode("append").parquet(path)
        part.clear()

    for slot, (s, k) in enumerate(plan):
        part.append((s, k, slot))
        if len(part) >= WRITTEN_AT_ONCE:
            flush()
    if part or not slot:
        flush()
    return spark.read.schema(schema).parquet(path)


def _ranked(docs: DataFrame, n_rows: int, id_col: str, source_col: str, carried: list) -> DataFrame:
    """_id, _source, _rank of every row: its place in its source's order, by the hash of the id."""
    bits = max(1, math.ceil(math.log2(max(2, n_rows / ROWS_PER_RANGE))))
    rows = docs.select(
        *carried, F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), F.xxhash64(F.col(id_col)).alias("_h")
    ).withColumn("_range", F.shiftrightunsigned(F.col("_h"), 64 - bits))
    counts = rows.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_source", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_source", "_range").orderBy("_h", "_id")
    numbered = rows.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(before, ["_source", "_range"]).withColumn("_rank", F.col("_before") + F.col("_in"))


def _scheduled(docs, weights, block_rows, broadcast_sources, id_col, source_col, carried) -> DataFrame:
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sizes = {r[0]: int(r[1]) for r in docs.groupBy(source.alias("s")).count().collect()}
    units = default_units(sizes) if weights is None else units_of({s: weights.get(s, 0) for s in sizes})
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    ranked = _ranked(docs, sum(sizes.values()), id_col, source_col, carried).withColumn("block", F.floor(F.col("_rank") / block_rows))
    names = [c for c in ranked.columns if c == "_row"]
    if len(sizes) > broadcast_sources:
        table = _written(spark, one_pass(blocks, units)).withColumnRenamed("_source", "_s").withColumnRenamed("block", "_b")
        met, slot = ranked.join(table, (F.col("_source") == F.col("_s")) & (F.col("block") == F.col("_b"))), F.col("slot")
    else:
        plan = phases(blocks, units)
        table = spark.createDataFrame(plan, "_s string, _first long, _end long, _slot0 long, _units long, _period long, _places array<int>")
        # one row for each phase and source that is left: broadcast_sources squared at most
        met = ranked.join(F.broadcast(table), (F.col("_source") == F.col("_s")) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_end")))
        k = F.col("block") - F.col("_first")
        slot = F.col("_slot0") + F.floor(k / F.col("_units")) * F.col("_period") + F.get(F.col("_places"), (k % F.col("_units")).cast("int"))
    return met.select(*names, F.col("_id"), F.col("_source").alias("_name"), "block", slot.cast("long").alias("slot"), (F.col("_rank") % block_rows).cast("int").alias("_nth"))


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    broadcast_sources: int = BROADCAST_SOURCES,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, block, slot, position of every row; position orders the mix."""
    out = _scheduled(docs, weights, block_rows, broadcast_sources, id_col, source_col, [])
    position = F.col("slot") * block_rows + F.col("_nth")
    return out.select(F.col("_id").alias("doc_id"), F.col("_name").alias("source"), "block", "slot", position.alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """docs with all their columns, in the order of the mix: range-partitioned by position and sorted."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = _scheduled(
        docs, weights, block_rows, options.get("broadcast_sources", BROADCAST_SOURCES),
        options.get("id_col", "doc_id"), options.get("source_col", "source"), [row],
    )
    ordered = out.repartitionByRange("slot", "_nth").sortWithinPartitions("slot", "_nth")
    return ordered.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
