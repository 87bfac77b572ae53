"""Near-duplicate documents by fast similarity sketching, banding and verification on full shingle sets.

Sketch: in round i every shingle is hashed to one bin and a value; a bin takes the smallest value of the first round
that reaches it. Rounds go on until every coordinate is filled, and after as many rounds as coordinates each further
round fills one bin from all shingles, so filling is certain and coordinates agree with the concentration of full
MinHash. Rows with the same shingle set collapse to one representative first. Bands of coordinates bring
representatives into buckets. Every representative is tested against the centre of one bucket, the one that meets most
others, then against the centres of the buckets that these links leave apart; what is then still apart is compared group
by group, each member outside the largest component with all of it, in blocks of bounded size that give one link per
component and never a row per pair. Single tests pass a sketch estimate set seven standard errors below the threshold
first; every link is confirmed on the whole sets of both texts. Components follow by distributed label propagation.

With 32 bands of 4 coordinates a pair at the threshold of 0.75 is missed with probability 5e-6.

Defined cases: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle
form one shingle; rows with the same set always share a component, whatever their number; rows that repeat an id share
its component, and each of their texts links on its own; rows with a null id have a null component and stay; an empty table gives an empty result; extra columns
are ignored by ``near_groups`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, worker_cache
from tessera.llm.components import connected_components

WORDS = 5
THRESHOLD = 75  # hundredths
COORDINATES, ROWS = 128, 4
LEFT_BLOCK, RIGHT_BLOCK = 192, 192
SALTS = 8
CACHE = 300_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SEEDS = np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _ODD[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache("word hashes", CACHE)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return mix(np.array([(h * _ODD[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += mix(h[i : len(h) - n + 1 + i] + _ODD[i]) * _ODD[i]
    return np.unique(mix(out))


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of 32 bits of a non-empty set of 64-bit hashes."""
    shift = np.uint64(64 - (t.bit_length() - 1))
    out, filled = np.zeros(t, np.uint32), np.zeros(t, bool)
    for i in range(2 * t):
        v = mix(items ^ _SEEDS[i])
        if i < t:
            v = np.sort(v)
            bins = (v >> shift).astype(np.int64)
            first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            first = first[~filled[bins[first]]]
            got, low = bins[first], v[first]
        else:
            if filled[i - t]:
                continue
            got, low = np.array([i - t]), v.min(keepdims=True)
        out[got] = (mix(low + np.uint64(i)) >> np.uint64(32)).astype(np.uint32)
        filled[got] = True
        if filled.all():
            break
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, d1, d2, sk = [], [], [], []
        for text in b.column("text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            d1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            d2.append(int(mix(s ^ _ODD[2]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            sk.append(sketch(s).tobytes() if len(s) else None)
        columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each band of each sketch."""
    bands = COORDINATES // ROWS
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3]
    for b in batches:
        ids = b.column("id").to_numpy()
        if not len(ids):
            continue
        c = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(len(ids), bands, ROWS).astype(np.uint64)
        key = np.zeros((len(ids), bands), np.uint64) + salt
        for r in range(ROWS):
            key = mix(key ^ (c[:, :, r] * _ODD[1]))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, bands))], names=["key", "id"])


def _alike(threshold: int):
    """Keeps pairs whose sketches agree as sets at the threshold do, within seven standard errors."""
    p = threshold / 100
    least = COORDINATES * (p - 7 * (p * (1 - p) / COORDINATES) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column("sa").to_pylist()), np.uint32).reshape(n, COORDINATES)
            y = np.frombuffer(b"".join(b.column("sb").to_pylist()), np.uint32).reshape(n, COORDINATES)
            keep = (x == y).sum(axis=1) >= least
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            keep = []
            for ta, tb in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                if last[0] != ta:
                    last = (ta, shingles(ta))
                x, y = last[1], shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links_of_blocks(threshold: int):
    """Links between two blocks of one group by one product of incidence matrices: per left document, one for each component."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            x = [shingles(t) for t in left.column("text").to_pylist()]
            y = [shingles(t) for t in right.column("text2").to_pylist()]
            xi, yi = left.column("id").to_numpy(), right.column("id2").to_numpy()
            xc, yc = left.column("c").to_numpy(), right.column("c2").to_numpy()
            nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            both = np.zeros((len(x), len(y)), np.float32)
            every = np.unique(np.concatenate(x))
            step = 4096
            for at in range(0, len(every), step):  # columns by blocks, so memory stays bounded
                some = every[at : at + step]
                both += _incidence(x, some) @ _incidence(y, some).T
            union = nx[:, None] + ny[None, :] - both
            linked = (100 * both >= threshold * union) & (xc[:, None] != yc[None, :])
            for i in np.flatnonzero(linked.any(axis=1)):
                hits = np.flatnonzero(linked[i])
                _, first = np.unique(yc[hits], return_index=True)
                found += [(int(xi[i]), int(yi[j])) for j in hits[first]]
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return run


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, items in enumerate(sets):
        part = items[np.searchsorted(items, columns[0]) : np.searchsorted(items, columns[-1], side="right")]
        at = np.searchsorted(columns, part)
        out[row, at[columns[at] == part]] = 1.0
    return out


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _met(rows: DataFrame, by_key: DataFrame) -> DataFrame:
    """rows with the one row of their key: keys that very many rows share are dealt to several tasks."""
    spread = by_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["key", "_salt"]).drop("_salt")


def _apart(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, centre, c) of the buckets whose members lie in more than one component."""
    mixed = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return materialise(_met(rows, mixed), "apart")


def _verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    met = pairs.join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    likely = met.select("a", "b", "sa", "sb").mapInArrow(_alike(threshold), "a long, b long")
    with_b = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return materialise(with_a.select("a", "b", "ta", "tb").mapInArrow(_confirmed(threshold), "a long, b long"), "links")


def _block_links(rows: DataFrame, comp: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links that single tests left open. Each bucket has a main component, the largest; every member outside it meets
    all of that component and all that stand beside it, block by block."""
    # figures of a component or group are written before they meet its rows, so that both sides of these joins are plain
    # shuffles, which adaptive execution splits where a key is hot
    sizes = materialise(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("component", "c"), "sizes")
    sized = rows.join(sizes, "c", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    main = sized.groupBy("key").agg(F.max_by(F.struct("c", "size"), F.struct(F.col("size"), -F.col("c"))).alias("m"))
    main = main.select("key", F.col("m.c").alias("main"), F.col("m.size").alias("main_size"))
    out = materialise(_met(rows, main).where("c <> main").select("main", "main_size", "id", "c").distinct(), "outside")
    mains = materialise(out.select("main", "main_size").distinct(), "mains")
    inside = comp.join(mains, comp["component"] == mains["main"]).select("main", "id", F.col("component").alias("c"))
    alone = mains.where("main_size = 1").select("main", F.col("main").alias("id"), F.col("main").alias("c"))  # in no link so far
    out = out.drop("main_size")
    right = out.unionByName(inside).unionByName(alone)
    counts = materialise(
        out.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / LEFT_BLOCK).cast("int").alias("nl")).join(
            right.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / RIGHT_BLOCK).cast("int").alias("nr")), "main"
        ),
        "counts",
    )
    spread = F.xxhash64("id")
    text = texts.select("id", "text")
    lefts = out.join(counts, "main").select("main", "id", "c", F.pmod(spread, "nl").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r")).join(text, "id")
    rights = right.join(counts, "main").select("main", "id", "c", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), F.pmod(spread, "nr").cast("int").alias("r")).join(text, "id")
    # new names, as both sides stem from the same tables
    other = rights.select(*[F.col(c).alias(f"{c}2") for c in ("main", "l", "r", "id", "c", "text")])
    return materialise(lefts.groupBy("main", "l", "r").cogroup(other.groupBy("main2", "l2", "r2")).applyInArrow(_links_of_blocks(threshold), "a long, b long"), "links")


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; threshold in hundredths."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(rows.mapInArrow(_sketched, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"), "sketches")
    known = sketched.where("sketch is not null and doc_id is not null")
    classes = known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"))
    reps = materialise(classes, "classes")  # an id that names two texts stands for both
    # rows of one class, and rows that repeat an id with another text, hang together before any comparison
    same = known.select("doc_id", "d1", "d2", "n_shingles").join(reps.select("d1", "d2", "n_shingles", "id"), ["d1", "d2", "n_shingles"])
    named = materialise(same.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")

    bands = reps.select("id", "sketch").mapInArrow(_bands, "key long, id long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(_met(bands, shared), "buckets")
    fame = met.groupBy("id").agg(F.sum("n").alias("fame"))
    famed = met.join(fame, "id")
    centres = famed.groupBy("key").agg(F.max_by("id", F.struct(F.col("fame"), -F.col("id"))).alias("centre"), F.max("fame").alias("best"))
    members = materialise(_met(famed, centres).select("key", "id", "n", "centre", "best"), "members")
    named_rows = rows.select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("_digest"))
    texts = materialise(named_rows.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "_digest"]).drop("_digest"), "texts")
    discard(met)

    # one test for every document: the centre of the bucket whose centre meets most others
    nearest = members.where("id <> centre").groupBy("id").agg(F.max_by("centre", F.struct(F.col("best"), -F.col("centre"))).alias("centre"))
    first = _verify(_pairs(nearest.select(F.col("id").alias("a"), F.col("centre").alias("b"))), reps, texts, threshold)
    comp = connected_components(first)
    # then the centres of all buckets that this leaves apart
    left = _apart(_labelled(members.select("key", "id", "n", "centre"), comp))
    second = _verify(_pairs(left.select(F.col("centre").alias("a"), F.col("id").alias("b"))), reps, texts, threshold)
    links = first.unionByName(second)
    comp = connected_components(links)
    # then whole groups, for what is still apart; a bucket of two has had its one test
    rest = _apart(_labelled(left.where("n > 2").select("key", "id", "n", "centre"), comp))
    last = _block_links(rest, comp, texts, threshold)
    final = connected_components(links.unionByName(last).unionByName(named))
    for old in (members, left, rest, texts, reps, named, first, second, last):
        discard(old)
    out = sketched.select("doc_id", "n_shingles").join(final.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group left, all columns; rows with a null id stay."""
    gone = near_groups(docs, threshold, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    names = docs.columns
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    left = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
