"""Helpers that the operators of this subpackage share.

Tables are read through Spark only, so any store that Spark can open works. Intermediate results are cut from their
lineage by writing Parquet below ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a
re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets one temporary folder of this
    process; a cluster is refused, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "folder" not in _local:
            _local["folder"] = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        found = _local["folder"]
    return found.rstrip("/")


_local: dict[str, str] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the fast built-in path."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, ASCII_UPPER, ASCII_LOWER)
    )


_caches: dict[str, dict] = {}


def worker_cache(name: str, limit: int) -> dict:
    """A dictionary that a Python worker keeps between tasks, emptied at its limit. A worker holds one at a time: asking
    for one empties those of other names, as workers outlive the operator they first served."""
    for other in [n for n in _caches if n != name]:
        _caches.pop(other).clear()
    cache = _caches.setdefault(name, {})
    if len(cache) > limit:
        cache.clear()
    return cache
