"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Ids and digests are written once, so texts are hashed once. Pass one maps every hash to a cell, 64 for each row, and
counts rows per cell: numbers of eight bytes, combined before the shuffle, are all that moves. Cells that two or more
rows hit are folded into a Bloom bitmap of 16 bits for each row, in segments of 4 KB. Pass two probes every row against
the bitmap: rows whose bit is clear have no equal and pass straight through; only possibly repeated rows shuffle, as (id,
digest) pairs, to be grouped exactly by digest.

The bitmap grows with the rows at every size. Up to ``broadcast_bytes`` it is broadcast, and rows don't move for the
probe; beyond, rows meet its segments in a join, which adaptive execution splits where a segment is hot. The filter never
decides equality, so false positives cost a shuffle and change nothing.

Defined cases: a null text counts as empty; equal texts are those identical after lower-casing A-Z only; an empty table
gives an empty result; of equal texts the largest id stays; rows with a null id count in ``group_size`` and are kept
only when every row of the group lacks an id; rows that repeat the kept id are all marked kept (``deduplicate`` leaves
one of them, any, as they are equal in id and text). Extra columns are ignored by ``exact_groups`` and carried by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialise

SEGMENT_BITS = 32768
BROADCAST_BYTES = 64 << 20


def _digested(docs: DataFrame, digest: Column, id_col: str, carried: list) -> DataFrame:
    return docs.select(*carried, F.col(id_col).alias("doc_id"), F.unhex(digest).alias("_sha"))


def normal_digest(text_col: str) -> Column:
    return F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)


def filter_bits(n_rows: int) -> int:
    return 1 << max(15, math.ceil(math.log2(max(n_rows, 1) * 16)))


def repeated_filter(rows: DataFrame, n_rows: int) -> DataFrame:
    """Pass one: (segment, bits) of the Bloom bitmap over cells that at least two of the digests ``rows._sha`` hit."""
    cells, bits = 4 * filter_bits(n_rows), filter_bits(n_rows)
    hit = rows.select(F.xxhash64("_sha").bitwiseAND(F.lit(cells - 1)).alias("_cell")).groupBy("_cell").count()
    twice = hit.where("count >= 2").select(F.col("_cell").bitwiseAND(F.lit(bits - 1)).alias("_bit"))
    return twice.groupBy(F.floor(F.col("_bit") / SEGMENT_BITS).alias("_segment")).agg(
        F.bitmap_construct_agg(F.col("_bit") % SEGMENT_BITS).alias("_bits")
    )


def _probed(rows: DataFrame, bloom: DataFrame, n_rows: int, broadcast_bytes: int) -> DataFrame:
    """Pass two: rows with ``_maybe``, false only where no other row can be equal."""
    bits = filter_bits(n_rows)
    bit = F.xxhash64("_sha").bitwiseAND(F.lit(bits - 1))
    placed = rows.withColumn("_segment", F.floor(bit / SEGMENT_BITS)).withColumn("_at", (bit % SEGMENT_BITS).cast("int"))
    # its size is checked: one bit in eight bytes, whatever the texts
    joined = placed.join(F.broadcast(bloom) if bits // 8 <= broadcast_bytes else bloom.hint("merge"), "_segment", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _at % 8) & 1") == 1
    return joined.withColumn("_byte", byte).withColumn("_maybe", F.coalesce(is_set, F.lit(False))).drop("_segment", "_at", "_bits", "_byte")


def _grouped(maybe: DataFrame) -> DataFrame:
    """Possibly repeated rows with keep_id and group_size. Groups are combined and written before they meet the rows, so
    both sides of the join are plain shuffles, which adaptive execution splits where a group is hot."""
    groups = materialise(maybe.groupBy("_sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return maybe.join(groups, "_sha")


def _split(rows: DataFrame, narrow: DataFrame, n_rows: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    bloom = materialise(repeated_filter(narrow, n_rows), "bloom")
    probed = _probed(rows, bloom, n_rows, broadcast_bytes)
    return probed.where(~F.col("_maybe")).drop("_maybe"), probed.where("_maybe").drop("_maybe")


def split_by_digest(docs: DataFrame, digest: Column, id_col: str, carried: list, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows without an equal, possibly repeated rows), both with carried columns, doc_id and the digest as ``_sha``."""
    n_rows = docs.count()
    return _split(_digested(docs, digest, id_col, carried), _digested(docs, digest, id_col, []), n_rows, broadcast_bytes)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(_digested(docs, normal_digest(text_col), id_col, []), "digests")
    single, maybe = _split(rows, rows, rows.count(), broadcast_bytes)
    alone = single.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = alone.unionByName(_grouped(maybe))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row of each group of equal texts, the largest id's, and all columns.

    Rows without an equal pass straight through, text and all; only possibly repeated rows shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    single, maybe = split_by_digest(docs, normal_digest(text_col), id_col, [row], broadcast_bytes)
    narrow = maybe.select("doc_id", "_sha")
    best = materialise(narrow.groupBy("_sha").agg(F.max("doc_id").alias("_keep")), "groups")
    kept = maybe.join(best, "_sha").where(F.col("doc_id").eqNullSafe(F.col("_keep")))
    once = kept.dropDuplicates(["_sha"])
    rows = single.select("_row").unionByName(once.select("_row"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
