"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine verification, connected components.

Equal vectors of one label collapse to one class first, so groups of copies cost nothing further. Each of several tables
hashes a class by the signs of random projections; classes of one label, length and hash form a bucket, and every pair
within it is verified by the exact cosine in double precision, block against block, so a large bucket is split over tasks
and no task holds more than two blocks. Bits grow with the logarithm of the largest label, so that buckets stay small,
and tables with the bits, so that a pair at the threshold is missed with probability 1e-6 at most. Buckets are made of
ids; vectors join the blocks once these are known, and only where a bucket has two members.

A pair that several tables bring together belongs to the first of them, as its hashes tell, so every link is counted
once without gathering pairs: a block gives each vector its number of links there and one link for each step of a
spanning forest, so results grow with the rows of the blocks and never with their pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stand
alone, as do rows with a null label; equal vectors of one label always link; vectors of different lengths never link;
rows that repeat an id count as separate rows for links and share a component only by links; rows with a null id link, take their
component from the others and are never kept while one of them has an id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise
from tessera.llm.components import connected_components

BUCKET = 64
THRESHOLD = 0.93
BLOCK = 1024
SLACK = 1e-9
_HASHED = "class long, label string, w long, v binary, codes binary"
_UNIT = ["b1", "b2", "lo", "hi"]


def _hashed(tables: int, bits: int, seed: int):
    """Vectors packed, with the hash of every table."""
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.array(d, np.float64) for d in b.column("d").to_pylist()]
            codes: list[bytes] = [b""] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for n in np.unique(lengths):
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, int(n)]).standard_normal((int(n), tables * bits))
                some = np.flatnonzero(lengths == n)
                x = np.stack([vectors[i] for i in some])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ planes[n] >= 0).reshape(len(some), tables, bits)
                code = (signs @ (1 << np.arange(bits))).astype(np.int32)
                for i, c in zip(some, code, strict=True):
                    codes[i] = c.tobytes()
            packed = pa.array([_packed(v) for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("label"), b.column("w"), packed, pa.array(codes, pa.binary())], names=["class", "label", "w", "v", "codes"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, label, length, table, code) for each table."""
    for b in batches:
        if not b.num_rows:
            continue
        code = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int32).reshape(b.num_rows, -1)
        size = np.array([len(v) - 1 if v[:1] == b"8" else 2 * (len(v) - 1) for v in b.column("v").to_pylist()], np.int64)
        tables = code.shape[1]
        each = pa.array(np.repeat(np.arange(b.num_rows), tables))
        columns = [b.column("class").take(each), b.column("label").take(each), pa.array(np.repeat(size, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), pa.array(code.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "label", "size", "t", "code"])


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors over their norms, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(packed: list[bytes]) -> np.ndarray:
    wide = packed[0][:1] == b"8"
    if any(p[:1] != packed[0][:1] for p in packed):
        return np.stack([_unpacked(p) for p in packed])
    return np.frombuffer(b"".join([p[1:] for p in packed]), np.float64 if wide else np.float32).reshape(len(packed), -1).astype(np.float64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """One link for each step of a spanning forest of a symmetric matrix of links."""
    seen = ~linked.any(axis=1)
    out: list[tuple[int, int]] = []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start] = True
        waiting = [start]
        while waiting:
            u = waiting.pop()
            new = np.flatnonzero(linked[u] & ~seen).tolist()
            seen[new] = True
            out += [(u, v) for v in new]
            waiting += new
    return out


def _near(threshold: float):
    """Links within units, one block by itself (side 0 alone) or two blocks met: (a, null, number of rows that a links
    with there) and (a, b, null) for a spanning forest. Only pairs that belong to the unit's table count."""

    def one(ids: np.ndarray, side: np.ndarray, w: np.ndarray, t: int, packed: list[bytes], codes: np.ndarray) -> list[tuple]:
        alone = bool((side == side[0]).all())
        if alone and side[0]:
            return []
        x = unit(_vectors(packed))
        linked = x @ x.T
        close = np.argwhere(np.abs(linked - threshold) <= SLACK)
        linked = linked >= threshold
        for i, j in close:  # sums in one order for both directions
            linked[i, j] = (x[min(i, j)] * x[max(i, j)]).sum() >= threshold
        np.fill_diagonal(linked, False)
        if not alone:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return []
        for earlier in range(t):
            linked &= codes[:, None, earlier] != codes[None, :, earlier]
        n = linked @ w
        out = [(int(ids[i]), None, int(n[i])) for i in np.flatnonzero(n)]
        return out + [(int(ids[u]), int(ids[v]), None) for u, v in forest(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = None  # the unit that the last batch left open

        def close() -> list[tuple]:
            columns = [np.concatenate([k[c] for k in kept]) for c in range(3)]
            t, packed = int(kept[0][3]), [v for k in kept for v in k[4]]
            codes = np.frombuffer(b"".join([c for k in kept for c in k[5]]), np.int32).reshape(len(packed), -1)
            kept.clear()
            return one(*columns, t, packed, codes) if len(packed) > 1 else []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _UNIT])
            ids, side, w, t = (b.column(c).to_numpy() for c in ("class", "side", "w", "t"))
            packed, codes = b.column("v").to_pylist(), b.column("codes").to_pylist()
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            found: list[tuple] = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if kept and tuple(key[:, i]) != held:
                    found += close()
                kept.append((ids[i:j], side[i:j], w[i:j], t[i], packed[i:j], codes[i:j]))
                held = tuple(key[:, i])
            if found:
                yield told(found)
        if kept and (found := close()):
            yield told(found)

    return run


def tables_for(threshold: float, bits: int, missed: float = 1e-6) -> int:
    """Tables by which a pair at the threshold is missed with at most that probability."""
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(missed) / math.log(1 - agree))) if agree < 1 else 1


def class_links(classes: DataFrame, threshold: float, bits: int, seed: int = 11) -> DataFrame:
    """(a, null, n) and (a, b, null): rows that class a links with outside itself, in parts to be added up, and links
    that connect what is connected. classes: class, label, w (rows), d."""
    hashed = materialise(classes.select("class", "label", "w", "d").mapInArrow(_hashed(tables_for(threshold, bits), bits, seed), _HASHED), "vectors")
    keys = hashed.mapInArrow(_keys, "class long, label string, size long, t int, code int")
    name = ["label", "size", "t", "code"]
    # 128 bits name a bucket, so that no two fall together
    placed = materialise(keys.select("class", "t", F.xxhash64(*name).alias("b1"), F.xxhash64(F.lit(1), *reversed(name)).alias("b2")), "buckets")
    sizes = materialise(placed.groupBy("b1", "b2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "sizes")
    rows = placed.join(sizes, ["b1", "b2"]).withColumn("k", F.pmod(F.xxhash64("class"), F.col("nb")).cast("int"))
    # block k meets every block r >= k as the first side, and every l < k as the second
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "b1", "b2", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), "class", "t", (F.col("o") < F.col("k")).cast("int").alias("side")
    )
    whole = dealt.join(hashed.select("class", "w", "v", "codes"), "class")
    out = materialise(whole.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_near(threshold), "a long, b long, n long"), "vector-links")
    for done in (hashed, placed, sizes):
        discard(done)
    return out


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, bits: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("d"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("d").isNotNull() & (F.size("d") > 0) & finite & F.exists("d", lambda x: x != 0)
    # zeros of either sign are one value; the text of a double names it exactly
    digest = F.sha2(F.concat_ws(",", F.transform("d", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    marked = rows.withColumn("digest", F.when(F.coalesce(usable, F.lit(False)), digest))
    groups = marked.where("digest is not null").groupBy("label", "digest").agg(
        F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("d").alias("d")
    )
    # numbered once written, so a number is one class and no other
    classes = materialise(groups.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    if bits is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        bits = min(30, max(2, math.ceil(math.log2(largest / BUCKET))))
    found = class_links(classes, threshold, bits)
    counted = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("near")).withColumnRenamed("a", "class")
    links = found.where("b is not null").select("a", "b")
    comp = connected_components(links).withColumnRenamed("id", "class")
    homed = classes.join(comp, "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = materialise(homed.groupBy("component").agg(F.min("least").alias("component_id")), "vector-components")
    told = materialise(
        homed.join(names, "component").join(counted, "class", "left").select(
            "label", "digest", "component_id", (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_links")
        ),
        "vector-figures",
    )
    for done in (found, classes, names):
        discard(done)
    # both sides are plain shuffles, which adaptive execution splits where very many rows are equal
    known = marked.where("digest is not null").join(told, ["label", "digest"])
    alone = marked.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _packed(d: list[float]) -> bytes:
    """Four bytes a component where these hold it exactly, else eight."""
    wide = np.array(d, np.float64)
    with np.errstate(over="ignore"):
        slim = wide.astype(np.float32)
    return b"4" + slim.tobytes() if (slim == wide).all() else b"8" + wide.tobytes()


def _unpacked(p: bytes) -> np.ndarray:
    return np.frombuffer(p[1:], np.float64 if p[:1] == b"8" else np.float32).astype(np.float64)
