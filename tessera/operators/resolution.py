"""Entity resolution: ranked keys, transitive identifiers, weighted similarity, routing and decisions."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import (
    categorical_match,
    composite_score,
    date_proximity,
    map_text,
    ordered_distinct,
    stable_golden_key,
    string_similarity,
    value_proximity,
)
from tessera.operators.relational import newest

NAME_KEY = "normalised_name"
#: Shares that the records of a type are dealt into where all its pairs are scored.
TILES = 64
#: What pairs can reach at most, where the best counterpart is looked for band by band.
BANDS = (0.9, 0.8, 0.65)
ROWS_PER_FILE = 250_000


def ranked_keys(candidates: DataFrame, entity: str, ranked: list[str]) -> DataFrame:
    """First known key of each record, in rank order, and what it resolves to.

    A key is kept unless it is a name that only one row holds. Confidence: 1.00, for names 0.95, without a key 0.00.
    Group figures are aggregated and joined back, so a key that many rows share never meets in one task.
    """
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ranked])
    keyed = candidates.withColumn("exact_key", F.coalesce(*ranked)).withColumn("exact_key_type", kind)
    groups = keyed.where("exact_key is not null").groupBy("exact_key_type", "exact_key").agg(
        F.count(F.lit(1)).alias("match_row_count"), F.countDistinct("source_system").alias("match_source_count")
    )
    met = keyed.join(groups, ["exact_key_type", "exact_key"], "left")
    kept = F.col("exact_key").isNotNull() & ~((F.col("exact_key_type") == NAME_KEY) & (F.col("match_row_count") == 1))
    return met.select(
        *candidates.columns, "exact_key_type", "exact_key",
        F.coalesce("match_row_count", F.lit(0)).alias("match_row_count"), F.coalesce("match_source_count", F.lit(0)).alias("match_source_count"),
        F.when(kept, stable_golden_key(entity, F.concat_ws("|", "exact_key_type", "exact_key"))).alias("golden_key"),
        F.when(~kept, 0.0).when(F.col("exact_key_type") == NAME_KEY, 0.95).otherwise(1.0).alias("confidence"),
        (~kept).alias("is_pending_probabilistic"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only on a local master, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-er-")
    return base.rstrip("/")


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """df cut from its lineage by a table in the shared folder, of that many files at most."""
    path = f"{shared_folder(df.sparkSession)}/er-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(record, component) over record-identifier edges: least label by alternating minima, until nothing moves.

    A lower label goes to the record that the old label names too, so whole trees are hooked; labels only fall, so rounds
    end by themselves.
    """
    pairs = written(edges.select("record", "identifier").where("record is not null and identifier is not null").distinct())
    files = max(1, -(-pairs.count() // ROWS_PER_FILE))  # rounds over few records cost little
    labels = written(pairs.groupBy("record").agg(F.min("record").alias("label")), files)
    while True:
        by_id = pairs.join(labels, "record").groupBy("identifier").agg(F.min("label").alias("least"))
        near = pairs.join(by_id, "identifier").groupBy("record").agg(F.min("least").alias("least"))
        own = written(labels.join(near, "record").select("record", F.col("label").alias("old"), F.least("label", "least").alias("l")), files)
        given = own.where("l < old").groupBy(F.col("old").alias("_root")).agg(F.min("l").alias("_given"))
        hooked = written(own.join(given, own["record"] == given["_root"], "left").select("record", "old", F.least("l", "_given").alias("l")), files)
        up = hooked.select(F.col("record").alias("_r"), F.col("l").alias("_l"))
        step = written(hooked.join(up, hooked["l"] == up["_r"]).select("record", "old", F.least("l", "_l").alias("label")), files)
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("record", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def transitive(records: DataFrame, entity: str, ranked: list[str], record: str = "record") -> DataFrame:
    """Records that share any identifier, over any chain, as one cluster; its key is the least value of its best rank, with
    the identifier's name, so that equal values of two kinds of identifier don't give two clusters one key.

    Records without an identifier stay unresolved.
    """
    parts = [
        records.where(F.col(c).isNotNull()).select(F.col(record).alias("record"), F.concat_ws("|", F.lit(c), F.col(c)).alias("identifier"), F.lit(i).alias("rank"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(ranked)
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    comp = components(edges)
    ids = edges.join(comp, "record")
    best = ids.groupBy("component").agg(F.min(F.struct("rank", "value")).alias("best"))
    stats = records.withColumnRenamed(record, "record").join(comp, "record").groupBy("component").agg(
        F.count(F.lit(1)).alias("match_row_count"), F.countDistinct("source_system").alias("match_source_count")
    )
    key = comp.join(best, "component").join(stats, "component").select(
        "record", "component", F.element_at(F.array(*[F.lit(c) for c in ranked]), F.col("best.rank") + 1).alias("exact_key_type"),
        F.col("best.value").alias("exact_key"), "match_row_count", "match_source_count",
    )
    out = records.withColumnRenamed(record, "record").join(key, "record", "left")
    return out.withColumn("golden_key", F.when(F.col("exact_key").isNotNull(), stable_golden_key(entity, F.concat_ws("|", "exact_key_type", "exact_key"))))


def tier_label(prefixed: str) -> Column:
    return F.when(F.col("exact_key_type") == prefixed, "tier_0").when(F.col("golden_key").isNotNull(), "tier_1").otherwise("tier_2")


@dataclass
class Scoring:
    """Weights and bands of one entity type."""

    name: float = 0.5
    sector: float = 0.2
    date: float = 0.15
    value: float = 0.15
    auto: float = 0.85
    review: float = 0.65
    days: float = 365.0
    share: float = 0.25
    blocks: list[str] = field(default_factory=list)


_COMPARED = ["entity_type", "source_system", "source_id", "name", "sector", "day", "value"]
_RECORD = ["entity_type", "source_system", "source_id"]


def _score(met: DataFrame, similarity: Column, config: Scoring, same_source: bool, keys: list[str]) -> DataFrame:
    """Scores of the pairs in met (columns l_ and r_), by keys of the left side; no pair of one source, or of one id."""
    apart = F.col("l_source_system") != F.col("r_source_system")
    if same_source:
        apart = apart | (F.col("l_source_id") != F.col("r_source_id"))
    score = composite_score([
        (similarity, config.name),
        (categorical_match(F.col("l_sector"), F.col("r_sector")), config.sector),
        (date_proximity(F.col("l_day"), F.col("r_day"), config.days), config.date),
        (value_proximity(F.col("l_value"), F.col("r_value"), config.share), config.value),
    ])
    scored = met.where(apart).select(*[F.col(f"l_{c}").alias(c) for c in keys], F.col("r_source_system").alias("matched_system"), F.col("r_source_id").alias("matched_id"), score.alias("score"))
    return scored.where("score is not null")


def _first(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The highest score, then the least system, then the least id: one aggregate instead of a window over all pairs."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "matched_system", "matched_id")).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, "b.matched_system", "b.matched_id", (-F.col("b.s")).alias("score"))


def _tiled(left: DataFrame, right: DataFrame, key: str, on: Column | None = None) -> DataFrame:
    """All pairs of a type that meet ``on``, one share of the left side in a task, dealt by the key."""
    dealt = left.withColumn("l_tile", F.pmod(F.xxhash64(key), F.lit(TILES)).cast("int")).repartition(TILES, "l_tile", "l_entity_type")
    every = right.withColumn("r_tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))).repartition(TILES, "r_tile", "r_entity_type")
    met = (F.col("l_tile") == F.col("r_tile")) & (F.col("l_entity_type") == F.col("r_entity_type"))
    return dealt.join(every, met if on is None else met & on)


def _letters(name: str) -> Column:
    """The characters of a name, each with how often it came before, as a set of 128 bits in two numbers.

    Replacing a character changes two of these bits at most, adding or removing one changes one.
    """
    chars = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    bits = F.transform(chars, lambda c, i: F.pmod(F.ascii(c) + (i + 1 - F.array_position(chars, c)) * 53, F.lit(128)).cast("int"))

    def added(half: Column, bit: Column, inside: Column) -> Column:
        return F.when(inside, half.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64))).otherwise(half)

    none = F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    return F.aggregate(bits, none, lambda a, bit: F.struct(added(a["low"], bit, bit < 64).alias("low"), added(a["high"], bit, bit >= 64).alias("high")))


def _least_edits() -> Column:
    """How many edits lie between two names at least, by their lengths and letters: each changes the length by one and one bit, or two bits."""
    longer = F.abs(F.col("l_length") - F.col("r_length"))
    low, high = (F.bit_count(F.col(f"l_letters.{half}").bitwiseXOR(F.col(f"r_letters.{half}"))) for half in ("low", "high"))
    return F.greatest(longer, (low + high + longer) / 2)


def candidate_pairs(pending: DataFrame, config: Scoring, same_source: bool = False) -> DataFrame:
    """Best counterpart of every pending record: entity_type, source_system, source_id, name, sector, day, value.

    Pairs are of one type and different sources (or different ids where ``same_source``). The result is that of scoring
    every pair of a type, but pairs that can't win are not made. Records alike in all that is scored are compared as one.
    They meet those of equal name, sector and day first, then of equal name and sector; then names are compared, each
    distinct one once, and their records meet in bands of what a pair can reach at most: a name loses its weight by the
    share of letters to be edited, another sector loses the sector's weight. A record goes on only while its best score so
    far doesn't exceed that. A missing value, or day beside a known one, only lowers these bounds; records without a name,
    sector or day meet all others of their type.

    ``blocks`` are expressions that a pair must share one of; with these, only such pairs are scored.
    """
    if config.blocks:
        keys = F.array_distinct(F.array_compact(F.array(*[F.expr(b).cast("string") for b in config.blocks])))
        marked = pending.withColumn("block", F.explode(keys))
        left, right = (marked.select(*[F.col(c).alias(f"{p}_{c}") for c in _COMPARED], F.col("block").alias(f"{p}_block")) for p in "lr")
        met = left.join(right, (F.col("l_block") == F.col("r_block")) & (F.col("l_entity_type") == F.col("r_entity_type")))
        return _first(_score(met, string_similarity(F.col("l_name"), F.col("r_name")), config, same_source, _RECORD), _RECORD)

    rows = pending.select(*_COMPARED)
    alike = [c for c in _COMPARED if same_source or c != "source_id"]
    least = rows.distinct() if same_source else rows.groupBy(*alike).agg(F.min(F.struct("source_id")).alias("_least")).select("*", "_least.source_id").drop("_least")
    profiles = written(least.withColumn("profile", F.monotonically_increasing_id()))
    keyed = profiles.withColumn("kind", F.upper(F.trim("sector"))).withColumn("date", F.col("day").cast("date"))
    keyed = keyed.withColumn("blank", F.col("name").isNull() | F.col("kind").isNull() | F.col("date").isNull())
    left, right = (keyed.select(*[F.col(c).alias(f"{p}_{c}") for c in keyed.columns]) for p in "lr")
    blanks = keyed.where("blank").limit(1).count()

    total = config.name + config.sector + config.date + config.value
    other_day = 1 - config.date / total / config.days
    other_sector = 1 - config.sector / total
    other_name = F.greatest(1 - F.lit(config.name / total) / (F.length("l_name") + 1), F.lit(other_sector))

    def best_of(met: DataFrame, similarity: Column) -> DataFrame:
        return _first(_score(met, similarity, config, same_source, ["profile"]), ["profile"])

    def reaches(bound: Column) -> Column:
        return F.col("score").isNull() | (F.col("score") <= bound + 1e-9)

    def within(bound: Column, upper: float | None, lower: float) -> Column:
        inside = reaches(bound) & (bound >= lower)
        return inside if upper is None else inside & (bound < upper)

    def undecided(best: DataFrame, bound: Column) -> DataFrame:
        """Left records, with their best score, that the pairs left might still reach."""
        held = best.select(F.col("profile").alias("l_profile"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
        return left.where("not l_blank").join(held, "l_profile", "left").where(reaches(bound))

    def equal(*columns: str) -> Column:
        on = F.col("l_entity_type") == F.col("r_entity_type")
        for c in columns:
            on = on & (F.col(f"l_{c}") == F.col(f"r_{c}"))
        return on

    known = right.where("not r_blank")
    best = best_of(left.where("not l_blank").join(known, equal("name", "kind", "date")), F.lit(1.0))
    if blanks:
        similarity = string_similarity(F.col("l_name"), F.col("r_name"))
        blank = _tiled(left.where("l_blank"), right, "l_profile").unionByName(_tiled(left.where("not l_blank"), right.where("r_blank"), "l_profile"))
        best = _first(best.unionByName(best_of(blank, similarity)), ["profile"])
    best = written(best)
    rest = undecided(best, F.lit(other_day)).drop("score")
    met = rest.join(known, equal("name", "kind") & (F.col("l_date") != F.col("r_date")))
    best = written(_first(best.unionByName(best_of(met, F.lit(1.0))), ["profile"]))

    names = known.select("r_entity_type", "r_name").distinct().repartition(TILES, "r_name")
    names = written(names.withColumn("r_length", F.length("r_name")).withColumn("r_letters", _letters("r_name")))
    measured = names.select(*[F.col(c).alias(c.replace("r_", "l_", 1)) for c in names.columns])
    for upper, lower in zip([None, *BANDS], [*BANDS, -1.0]):
        rest = written(undecided(best, other_name if upper is None else F.lit(upper)))
        if not rest.limit(1).count():
            break
        share = (1 - F.greatest(F.min(F.coalesce("score", F.lit(0.0))), F.lit(lower))) * total + 1e-9
        wanted = rest.groupBy("l_entity_type", "l_name").agg(share.alias("_share")).join(measured, ["l_entity_type", "l_name"])
        longest = F.greatest("l_length", "r_length", F.lit(1))
        room = F.col("_share") * longest
        may = config.name * _least_edits() <= room
        near = _tiled(wanted, names, "l_name", may)
        # The conditions end up in one join, in any order: without F.when every two names would be compared letter by letter.
        near = near.withColumn("_edits", F.when(may, F.levenshtein("l_name", "r_name"))).where(config.name * F.col("_edits") <= room)
        near = near.select("l_entity_type", "l_name", F.col("r_name").alias("_name"), "_edits", (1.0 - F.col("_edits") / longest).alias("_similarity"))
        near = written(near)  # compared once for both joins below, in code small enough to be compiled
        bound = 1 - config.name / total * (1 - F.col("_similarity"))
        held = rest.join(near, ["l_entity_type", "l_name"])

        on = equal() & (F.col("_name") == F.col("r_name"))
        met = held.where(within(bound, upper, lower) & (F.col("_edits") > 0)).drop("score").join(known, on & equal("kind"))
        if other_sector >= lower - 1e-9:
            far = held.where(within(bound - config.sector / total, upper, lower)).drop("score")
            met = met.unionByName(far.join(known, on & (F.col("l_kind") != F.col("r_kind"))))
        best = written(_first(best.unionByName(best_of(met, F.col("_similarity"))), ["profile"]))

    won = profiles.join(best, "profile").select(*[F.col(c).alias(f"_{c}") for c in alike], "matched_system", "matched_id", "score")
    on = F.lit(True)
    for c in alike:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return _first(rows.join(won, on), _RECORD)


def route(pending: DataFrame, pairs: DataFrame, config: Scoring) -> DataFrame:
    """auto above the upper bound, review from the lower one, else reject; records without a counterpart are rejected."""
    keys = ["entity_type", "source_system", "source_id"]
    met = pending.select(*keys).join(pairs, keys, "left")
    band = F.when(F.col("score") > config.auto, "auto").when(F.col("score") >= config.review, "review").otherwise("reject")
    here, there = F.concat_ws(":", "source_system", "source_id"), F.concat_ws(":", "matched_system", "matched_id")
    key = F.md5(F.concat_ws("|", F.col("entity_type"), F.least(here, there), F.greatest(here, there)))
    return met.withColumn("route", band).withColumn("auto_key", F.when(F.col("route") == "auto", key))


def latest_decisions(log: DataFrame, low: str, high: str, at: str, ties: list[str]) -> DataFrame:
    """The latest decision on each unordered pair."""
    paired = log.withColumn("pair_low", F.least(low, high)).withColumn("pair_high", F.greatest(low, high))
    return newest(paired, ["pair_low", "pair_high"], [at, *ties])


def review_queue(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs in the review band with their latest decision, pending without one. decisions: pair_low, pair_high, decision."""
    here, there = F.concat_ws(":", "source_system", "source_id"), F.concat_ws(":", "matched_system", "matched_id")
    band = routed.where("route = 'review'").withColumn("pair_low", F.least(here, there)).withColumn("pair_high", F.greatest(here, there))
    out = band.join(decisions.select("pair_low", "pair_high", "decision"), ["pair_low", "pair_high"], "left")
    return out.withColumn("status", F.coalesce("decision", F.lit("pending")))


def identity_union(resolved: DataFrame, alias: str, source_id: str) -> DataFrame:
    """Per golden key: its aliases as a sorted array, and the least id of each source as JSON text."""
    aliases = resolved.where("golden_key is not null").groupBy("golden_key").agg(ordered_distinct(alias).alias("aliases"))
    ids = resolved.where("golden_key is not null").groupBy("golden_key", "source_system").agg(F.min(source_id).cast("string").alias("id"))
    return aliases.join(ids.groupBy("golden_key").agg(map_text("source_system", "id").alias("source_ids")), "golden_key")


def external_lookup(resolved: DataFrame, external: str) -> DataFrame:
    """Lowest golden key of each external id."""
    known = resolved.where(F.col(external).isNotNull() & F.col("golden_key").isNotNull())
    return known.groupBy(external).agg(F.min("golden_key").alias("golden_key"))


def precision_recall(resolved: DataFrame, labels: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """One row: golden keys that mix true ids, true ids that are split over keys, labelled records without a key."""
    met = labels.join(resolved.select(*keys, "golden_key"), keys, "left")
    mixed = met.where("golden_key is not null").groupBy("golden_key").agg(F.countDistinct(truth).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("mixed_keys"))
    split = met.where("golden_key is not null").groupBy(truth).agg(F.countDistinct("golden_key").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("split_ids"))
    gaps = met.where("golden_key is null").agg(F.count(F.lit(1)).alias("gaps"))
    return mixed.crossJoin(split).crossJoin(gaps)


def unresolved(resolved: dict[str, DataFrame]) -> DataFrame:
    """Records of every entity that got no key."""
    out = None
    for entity, df in resolved.items():
        part = df.where("golden_key is null").select(F.lit(entity).alias("entity"), "source_system", F.col("source_record_id").cast("string").alias("source_record_id"))
        out = part if out is None else out.unionByName(part)
    return out


def pending_set(resolved: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Records of every entity that exact keys left pending, with the columns that candidates are scored on."""
    out = None
    for entity, df in resolved.items():
        part = df.where("is_pending_probabilistic").select(F.lit(entity).alias("entity_type"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def live_overlay(queue: DataFrame, log: DataFrame) -> DataFrame:
    """A materialised review queue with the decisions logged since: the latest one on each unordered pair of a type.

    queue: entity_type, source_system, source_id, matched_system, matched_id; log: entity_type, low, high, decision,
    reviewed_at, with low and high as system:id.
    """
    here, there = F.concat_ws(":", "source_system", "source_id"), F.concat_ws(":", "matched_system", "matched_id")
    paired = queue.drop("decision", "status").withColumn("pair_low", F.least(here, there)).withColumn("pair_high", F.greatest(here, there))
    sides = log.withColumn("pair_low", F.least("low", "high")).withColumn("pair_high", F.greatest("low", "high"))
    latest = newest(sides.select("entity_type", "pair_low", "pair_high", "decision", "reviewed_at"), ["entity_type", "pair_low", "pair_high"], ["reviewed_at", "decision"])
    out = paired.join(latest, ["entity_type", "pair_low", "pair_high"], "left")
    return out.withColumn("status", F.when(F.col("decision").isNull(), "pending_review").otherwise("reviewed"))


def convergence_faults(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Identifiers that two clusters share; none once labels have settled."""
    return edges.join(comp, "record").groupBy("identifier").agg(F.countDistinct("component").alias("n")).where("n > 1")


def name_groups(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(column)))
