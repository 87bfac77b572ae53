"""Sources and sinks: seeds, delivered files, published tables; tables, views and append-only targets."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.relational import anti
from tessera.sources import codecs


def seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def deliveries(spark: SparkSession, path: str, max_bytes: int = codecs.Limits.payload_bytes) -> DataFrame:
    """Delivered files as path, length, content; files over the limit come without content.

    Two scans: the limit on the length is pushed into the one that reads contents, and the other reads none.
    """
    raw = spark.read.format("binaryFile").load(path)
    small = raw.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = raw.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _text(value: object) -> str:
    """Values that JSON has no form for: bytes in base64, others as their text."""
    return base64.b64encode(value).decode() if isinstance(value, bytes) else str(value)


def decode(files: DataFrame, fields: list[codecs.Field], form: str, compressed: bool = False, limits: codecs.Limits = codecs.Limits()) -> DataFrame:
    """One row per record: path, locator, payload (typed row as JSON text), fault; a file that fails has one faulty row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = {"jsonl": codecs.parse_json_lines, "csv": codecs.parse_csv}[form]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    if content is None:
                        raise codecs.DecodeError("PAYLOAD_TOO_LARGE")
                    data = codecs.gunzip(bytes(content), limits) if compressed else bytes(content)
                    rows = [(path, at, None if row is None else json.dumps(row, default=_text, sort_keys=True), fault) for at, row, fault in parse(data, fields)]
                except codecs.DecodeError as e:
                    rows = [(path, e.locator or "file", None, e.code)]
                yield pd.DataFrame(rows, columns=["path", "locator", "payload", "fault"])

    if form not in ("jsonl", "csv"):
        raise ValueError(f"unknown form {form!r}")
    return files.select("path", "content").mapInPandas(run, "path string, locator string, payload string, fault string")


def typed_rows(decoded: DataFrame, fields: list[codecs.Field]) -> DataFrame:
    """Columns of the declared fields from decoded payloads."""
    kinds = {"int64": "bigint", "boolean": "boolean", "date": "date", "utc_instant": "timestamp", "local_datetime": "timestamp"}
    out = decoded.where("fault is null")
    for f in fields:
        kind = f"decimal({f.precision},{f.scale})" if f.kind == "decimal" else kinds.get(f.kind, "string")
        value = F.get_json_object("payload", f"$.{f.name}")
        out = out.withColumn(f.name, F.unbase64(value) if f.kind == "binary" else value.cast(kind))
    return out.drop("payload", "fault")


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def store_raw(files: DataFrame, target: str) -> None:
    """Content-addressed copies, written once: rows whose digest the target holds are left out."""
    rows = files.where("content is not null").withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])
    spark = files.sparkSession
    try:
        held = spark.read.parquet(target).select("digest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    if held is not None:
        rows = anti(rows, held, ["digest"])
    rows.select("digest", "length", "content").write.mode("append").parquet(target)


def save_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def save_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the Parquet target lacks; appending the same rows again adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    try:
        held = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    (fresh if held is None else anti(fresh, held, keys)).write.mode("append").parquet(path)
