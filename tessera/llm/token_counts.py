"""Token counts of sections, by offsets: every document is encoded once and whole.

A byte-level vocabulary loses nothing, so the lengths of its tokens give every token's span of characters by one running
sum. Spans meet the sections of their document by an interval join on sorted bounds. A token that crosses a boundary
goes to the section that holds most of its characters, and to the earlier one of equals; a token that is part of a
character covers that character. So the counts of a document's sections always add up to its tokens.

Sections are lines by default, each with its line end; ``sections`` gives other ones: a column of the (sorted)
character positions at which sections of a row begin after the first, e.g. the ends of concatenated fields.

Defined cases: null texts count as empty; an empty text has one empty section without tokens; bounds that are null,
outside the text or out of order are ignored; repeated rows are counted each; an empty table gives an empty result;
extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_encoders: dict = {}


class OffsetEncoder:
    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
            starts, ends = of_byte[starts], of_byte[ends - 1] + 1
        return starts, ends


def encoder(rank_file: str, pattern: str) -> OffsetEncoder:
    key = (rank_file, pattern)
    if key not in _encoders:
        _encoders[key] = OffsetEncoder(rank_file, pattern)
    return _encoders[key]


def line_bounds(text: str) -> np.ndarray:
    """Where lines begin after the first."""
    out, at = [], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([x for x in out if x < len(text)], np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of each section, the latter where they are counted."""
    edges = np.concatenate([[0], bounds, [size]])
    n = len(bounds) + 1
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right")
    owner = first.copy()
    across = np.flatnonzero(last > first)
    for t in across:
        some = np.arange(first[t], last[t] + 1)
        held = np.minimum(edges[some + 1], ends[t]) - np.maximum(edges[some], starts[t])
        owner[t] = some[np.argmax(held)]
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n)


def _counted(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            given = b.column("bounds").to_pylist() if "bounds" in b.schema.names else [None] * b.num_rows
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text, at in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), given, strict=True):
                text = text or ""
                size = len(text)
                if "bounds" in b.schema.names:
                    known = [x for x in at or [] if x is not None and 0 < x < size]
                    bounds = np.unique(np.array([x for i, x in enumerate(known) if x >= max(known[: i + 1])], np.int64))
                else:
                    bounds = line_bounds(text)
                tokens, crossing = attribute(*enc.spans(text), bounds, size)
                edges = [0, *bounds.tolist(), size]
                for column, values in zip(columns, ([doc_id] * len(tokens), range(len(tokens)), edges[:-1], edges[1:], tokens.tolist(), crossing.tolist()), strict=True):
                    column += values
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def section_tokens(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections: str | None = None
) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (characters), n_tokens, n_crossing."""
    more = [] if sections is None else [F.col(sections).cast("array<long>").alias("bounds")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    schema = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
    return rows.mapInArrow(_counted(rank_file, pattern), schema)
