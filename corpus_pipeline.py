"""A corpus pipeline over documents: quality, exact and near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bin_slack, exact_dedup, minhash_fss, pfair, quality_nbsvm
from tessera.llm.common import id_crc, materialise, table
from tessera.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go. It learns from the labelled documents among docs."""
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"), where=id_crc() % 3 != 1)
    return quality_nbsvm.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the smallest doc_id stays."""
    return minhash_fss.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources at their target weights: the order of the files, by their
    numbers, and of the rows in them."""
    return pfair.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of at most 4096 tokens, stretch by stretch in the order of the mix, so a
    prefix of the sequences holds the sources at their target weights."""
    file = docs.metadataColumn("_metadata")
    number = F.regexp_extract(file["file_name"], "part-([0-9]+)", 1).cast("long")
    return bin_slack.pack_in_order(docs, tokenizer_file("word_bpe_49k.json"), F.coalesce(number, F.lit(0)), file["row_index"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("pack", pack),
]

#: A trained model, sketches and a vocabulary decide rows here; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
