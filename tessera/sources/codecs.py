"""Strict decoding of delivered bytes: what is not exactly in form is an error with a stable locator.

A whole file is one record, so files decode in parallel; limits bound what one of them may take. Lenient readers (Spark's
own CSV and JSON) accept repeated keys, mixed line ends and trailing data, so they serve only as a fast path for data
that is already trusted.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
import zlib
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from zoneinfo import ZoneInfo


class DecodeError(ValueError):
    """code names the fault; the message never holds a value of the data."""

    def __init__(self, code: str, locator: str = ""):
        super().__init__(f"{code} {locator}".strip())
        self.code, self.locator = code, locator


@dataclass(frozen=True)
class Limits:
    payload_bytes: int = 16 * 1024 * 1024
    expanded_bytes: int = 64 * 1024 * 1024
    ratio: int = 10


@dataclass(frozen=True)
class Field:
    """A declared column. kind: utf8_string, int64, decimal, boolean, date, utc_instant, local_datetime, binary."""

    name: str
    kind: str
    nullable: bool = False
    precision: int = 38
    scale: int = 0
    zone: str = "UTC"


def gunzip(data: bytes, limits: Limits = Limits()) -> bytes:
    """One gzip member and nothing after it, within the size and ratio limits."""
    if len(data) > limits.payload_bytes:
        raise DecodeError("PAYLOAD_TOO_LARGE")
    bound = min(limits.expanded_bytes, limits.ratio * max(1, len(data)))
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data, bound + 1)
    except zlib.error:
        raise DecodeError("GZIP_INVALID") from None
    if len(out) > bound:
        raise DecodeError("EXPANSION_LIMIT")
    if not d.eof:
        raise DecodeError("GZIP_TRUNCATED")
    if d.unused_data:
        raise DecodeError("GZIP_TRAILING_DATA")
    return out


def text_lines(data: bytes) -> list[str]:
    """Lines of UTF-8 text with one kind of line end, the last one included."""
    if data.startswith(b"\xef\xbb\xbf"):
        raise DecodeError("BOM_NOT_ALLOWED")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DecodeError("UTF8_INVALID", f"byte:{e.start}") from None
    pairs = text.count("\r\n")
    if text.count("\r") > pairs or 0 < pairs < text.count("\n"):
        raise DecodeError("MIXED_NEWLINES")
    if not text:
        return []
    if not text.endswith("\n"):
        raise DecodeError("FINAL_NEWLINE_MISSING")
    return text[:-1].replace("\r\n", "\n").rstrip("\r").split("\n")


def _object(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise DecodeError("DUPLICATE_KEY")
        out[k] = v
    return out


def _no_constant(_: str) -> None:
    raise DecodeError("NUMBER_NOT_FINITE")


def parse_json_lines(data: bytes, fields: list[Field]) -> list[tuple[str, dict | None, str | None]]:
    """(locator, typed row or None, fault code or None) of every line; numbers stay exact."""
    known, out = {f.name for f in fields}, []
    for i, line in enumerate(text_lines(data), 1):
        at = f"line:{i}"
        if not line.strip():
            raise DecodeError("BLANK_LINE", at)
        try:
            row = json.loads(line, object_pairs_hook=_object, parse_float=Decimal, parse_constant=_no_constant)
        except DecodeError as e:
            raise DecodeError(e.code, at) from None
        except json.JSONDecodeError:
            raise DecodeError("JSON_INVALID", at) from None
        if not isinstance(row, dict):
            raise DecodeError("NOT_AN_OBJECT", at)
        if set(row) - known:
            raise DecodeError("UNKNOWN_FIELD", at)
        out.append((at, *_typed(row, fields, json_values=True)))
    return out


def parse_csv(data: bytes, fields: list[Field], delimiter: str = ",", quote: str = '"', escape: str = "\\") -> list[tuple[str, dict | None, str | None]]:
    """As parse_json_lines, for CSV with a header that is a prefix of the declared columns; locators are bytes.

    Unquoted empty cells are null, quoted ones empty text.
    """
    if len({delimiter, quote, escape}) < 3 or any(len(c) != 1 for c in (delimiter, quote, escape)):
        raise DecodeError("DIALECT_INVALID")
    text_lines(data)
    records = _records(data.decode("utf-8").replace("\r\n", "\n"), delimiter, quote, escape, 1 if b"\r\n" in data else 0)
    if not records:
        raise DecodeError("HEADER_MISSING")
    header = [c for c, _ in records[0][1]]
    names = [f.name for f in fields]
    if header != names[: len(header)]:
        raise DecodeError("HEADER_MISMATCH")
    if any(not f.nullable for f in fields[len(header) :]):
        raise DecodeError("COLUMN_MISSING")
    out = []
    for at, cells in records[1:]:
        locator = f"byte:{at}"
        if len(cells) != len(header):
            out.append((locator, None, "CELL_COUNT"))
            continue
        row = {n: None if not quoted and c == "" else c for n, (c, quoted) in zip(header, cells, strict=True)}
        out.append((locator, *_typed(row, fields, json_values=False)))
    return out


def _records(text: str, delimiter: str, quote: str, escape: str, extra: int) -> list[tuple[int, list[tuple[str, bool]]]]:
    out, row, cell, quoted, inside = [], [], [], False, False
    start, byte, i = 0, 0, 0
    while i < len(text):
        c = text[i]
        width = len(c.encode()) + (extra if c == "\n" else 0)
        if inside:
            if c == escape and i + 1 < len(text):
                cell.append(text[i + 1])
                width += len(text[i + 1].encode())
                i += 1
            elif c == quote:
                inside = False
            else:
                cell.append(c)
        elif c == quote and not cell and not quoted:
            inside = quoted = True
        elif c in (delimiter, "\n"):
            row.append(("".join(cell), quoted))
            cell, quoted = [], False
            if c == "\n":
                out.append((start, row))
                row, start = [], byte + width
        elif quoted or c == quote:
            raise DecodeError("QUOTE_INVALID", f"byte:{byte}")
        else:
            cell.append(c)
        byte += width
        i += 1
    if inside:
        raise DecodeError("QUOTE_OPEN", f"byte:{start}")
    return out


def _typed(row: dict, fields: list[Field], json_values: bool) -> tuple[dict | None, str | None]:
    out = {}
    for f in fields:
        value = row.get(f.name)
        if value is None:
            if not f.nullable:
                return None, "NULL_NOT_ALLOWED"
            out[f.name] = None
            continue
        try:
            out[f.name] = coerce(value, f, json_values)
        except DecodeError as e:
            return None, e.code
    return out, None


_INT = re.compile(r"0|-?[1-9][0-9]*\Z")
_DECIMAL = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?\Z")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\Z")
_LOCAL = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?\Z")


def coerce(value: object, f: Field, json_values: bool = False) -> object:
    """The typed value of a cell in its one allowed form."""
    if f.kind == "utf8_string":
        if not isinstance(value, str):
            raise DecodeError("TYPE_MISMATCH")
        return value
    if f.kind == "boolean":
        if json_values and isinstance(value, bool):
            return value
        if not json_values and value in ("true", "false"):
            return value == "true"
        raise DecodeError("BOOLEAN_INVALID")
    if f.kind == "int64":
        if isinstance(value, bool) or (json_values and not isinstance(value, int)):
            raise DecodeError("INT_INVALID")
        text = str(value)
        if not _INT.fullmatch(text) or not -(2**63) <= int(text) < 2**63:
            raise DecodeError("INT_INVALID")
        return int(text)
    if f.kind == "decimal":
        text = str(value) if not isinstance(value, bool) else ""
        try:
            number = Decimal(text) if _DECIMAL.fullmatch(text) else None
        except InvalidOperation:
            number = None
        if number is None:
            raise DecodeError("DECIMAL_INVALID")
        exponent = -number.as_tuple().exponent
        if exponent > f.scale or len(number.as_tuple().digits) - exponent > f.precision - f.scale:
            raise DecodeError("DECIMAL_PRECISION")
        return number
    if not isinstance(value, str):
        raise DecodeError("TYPE_MISMATCH")
    try:
        if f.kind == "date" and _DATE.fullmatch(value):
            return dt.date.fromisoformat(value)
        if f.kind == "utc_instant" and _INSTANT.fullmatch(value):
            return dt.datetime.fromisoformat(value)
        if f.kind == "local_datetime" and _LOCAL.fullmatch(value):
            return _local(dt.datetime.fromisoformat(value), f.zone)
        if f.kind == "binary":
            return _bytes(value)
    except DecodeError:
        raise
    except ValueError:
        pass
    raise DecodeError(f"{f.kind.upper()}_INVALID")


def _local(value: dt.datetime, zone: str) -> dt.datetime:
    """A wall-clock time that exists exactly once in its zone."""
    z = ZoneInfo(zone)
    early, late = value.replace(tzinfo=z, fold=0), value.replace(tzinfo=z, fold=1)
    if early.astimezone(dt.UTC).astimezone(z).replace(tzinfo=None) != value:
        raise DecodeError("LOCAL_TIME_GAP")
    if early.utcoffset() != late.utcoffset():
        raise DecodeError("LOCAL_TIME_FOLD")
    return early


def _bytes(value: str) -> bytes:
    raw = base64.urlsafe_b64decode(value + "=" * (-len(value) % 4))
    if base64.urlsafe_b64encode(raw).rstrip(b"=").decode() != value:
        raise DecodeError("BINARY_INVALID")
    return raw
