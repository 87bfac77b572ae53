"""Scalar functions of the declared estate, as Column -> Column, null-safe where the estate is.

Every function compiles to built-in expressions, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logical type tokens of declarations and the Spark types they mean; any other token is a compile error.
TYPE_TOKENS = {"int": "int", "float": "double", "numeric": "decimal(28,6)", "date": "date", "string": "string", "boolean": "boolean"}


def type_of(token: str) -> str:
    if token not in TYPE_TOKENS:
        raise ValueError(f"unknown type token {token!r}")
    return TYPE_TOKENS[token]


def safe_cast(column: Column, token: str) -> Column:
    """Typed value, or null where the text doesn't hold one. Dates must be whole; ints may carry a fraction of zeros."""
    kind = type_of(token)
    text = F.trim(column.cast("string"))
    if kind == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
    if kind == "int":
        return F.round(text.try_cast("decimal(28,6)")).try_cast("int")
    return text.try_cast(kind)


def json_cast(column: Column) -> Column:
    return F.try_parse_json(column)


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def regexp_contains(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def regexp_first(column: Column, pattern: str) -> Column:
    """First group of the first match, null without a match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, 1))


def normalise_name(column: Column) -> Column:
    """Upper case, letters and digits alone; blank becomes null."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(column.cast("string"))), "[^A-Z0-9]", ""), F.lit(""))


def normalise_prefixed_id(column: Column, prefix: str) -> Column:
    """PREFIX-digits where the stripped text begins so (what follows is dropped), else the upper-cased text.

    Characters other than capitals and digits go before upper-casing, so lower-case letters are lost, as declared.
    """
    bare = F.upper(F.regexp_replace(F.trim(column.cast("string")), "[^A-Z0-9]", ""))
    digits = F.regexp_extract(bare, f"^{prefix}([0-9]+)", 1)
    return F.when(bare.rlike(f"^{prefix}[0-9]+"), F.concat(F.lit(f"{prefix}-"), digits)).otherwise(F.upper(F.trim(column.cast("string"))))


def hash_hex(column: Column) -> Column:
    return F.md5(column.cast("string"))


def stable_golden_key(entity: str, column: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{entity}|"), F.coalesce(column.cast("string"), F.lit(""))))


def surrogate_key(*columns: Column) -> Column:
    """md5 over the columns' texts joined by dashes; nulls have a text of their own."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("_null_")) for c in columns]))


def vault_hash(*columns: Column) -> Column:
    """Upper-case md5 over upper-cased, trimmed texts; nulls and blanks are alike."""
    parts = [F.coalesce(F.nullif(F.upper(F.trim(c.cast("string"))), F.lit("")), F.lit("^^")) for c in columns]
    return F.upper(F.md5(F.concat_ws("~", *parts)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a text, lower-case hex, from two nested digests."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def to_json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def safe_divide(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def date_key(column: Column) -> Column:
    return F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)


def date_trunc(unit: str, column: Column) -> Column:
    return F.date_trunc(unit, column).cast("date")


def date_series(first: Column, last: Column) -> Column:
    """Every date of the closed interval, as rows."""
    return F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day")))


def date_diff_days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def string_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest))


def categorical_match(a: Column, b: Column) -> Column:
    same = F.upper(F.trim(a)) == F.upper(F.trim(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(same, 1.0).otherwise(0.0))


def date_proximity(a: Column, b: Column, tolerance: Column | float) -> Column:
    """Linear decay to zero at the tolerance in days."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.datediff(a, b)) / tolerance)


def value_proximity(a: Column, b: Column, tolerance: Column | float) -> Column:
    """One where both are zero, else linear decay of the difference relative to the larger value."""
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / (size * tolerance))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a == 0) & (b == 0), 1.0).otherwise(near))


def composite_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are known, weights renormalised; null if none is."""
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return top / F.nullif(weight, F.lit(0.0))


def map_text(key: str, value: str) -> Column:
    """Aggregate: {key: value} as JSON text with keys in order."""
    entries = F.array_sort(F.collect_set(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return F.to_json(F.map_from_entries(entries))


def ordered_distinct(column: str) -> Column:
    """Aggregate: distinct non-null values as a sorted array."""
    return F.array_sort(F.collect_set(F.col(column)))


def joined_distinct(column: str, separator: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(column))), separator)


def json_text(column: Column, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def parse_utc_instant(column: Column) -> Column:
    exact = column.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$")
    return F.when(exact, F.try_to_timestamp(column))


def age_seconds(instant: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(instant)


def poison_timestamp() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp")
