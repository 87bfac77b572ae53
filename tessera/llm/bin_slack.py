"""Packing by minimum bin slack over the histogram of piece lengths.

Tokenising cuts documents into pieces of at most ``capacity`` tokens and numbers the pieces of each length, by
partition first and then across partitions, so no group of equal lengths meets in one task. What the planner sees is the
count of pieces per length: ``capacity`` rows at most, whatever the size of the corpus. Per bin it seeds with the longest
length left, and a bitset subset-sum program over the available lengths finds the fullest feasible combination, which
is removed as often as the counts allow. The plan is a list of rank ranges per length (bounded by the capacity too), by
which every piece finds its sequence and offset from its own rank, without any further exchange of texts.

``pack`` plans over the whole corpus, for the fewest sequences. ``pack_in_order`` keeps an order of the rows, such as a
mix of sources: rows are taken in stretches of ``stretch_rows`` consecutive ones, each planned by itself in one task from
ids and lengths alone, and sequences are numbered by stretch, so a prefix of the sequences is a prefix of the order up to
one stretch; each stretch may leave one sequence short.

Defined cases: a null text counts as empty and takes one token, the end id; an empty table gives an empty result; equal
lengths are interchangeable, so ties are settled by partition and row order; repeated rows are separate documents;
extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, worker_cache

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000
STRETCH_ROWS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Controls that str.split() takes as white space and the vocabulary's own pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Punctuation that may follow a word of letters.
_TAIL = ".,;:!?"
_encoders: dict = {}


class WordEncoder:
    """ids of a text as little-endian 32-bit bytes, by words: the vocabulary never merges across white space.

    New words of letters alone are encoded many at a time, as one text, and told apart by the ids that end a word;
    punctuation after letters is encoded apart from them, as the vocabulary's pattern does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.path = path
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_letters(self, words: list[str]) -> None:
        """Fills in words of Latin letters alone."""
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
                self.words.update((w, raw[x:y]) for w, x, y in zip(some, at, at[1:], strict=False))
            else:
                self.words.update(zip(some, self._encode(some), strict=True))

    def _learn(self, new: set[str]) -> None:
        letters, parted, other = set(), [], []
        for w in new:
            stem = w.rstrip(_TAIL)
            if stem.isalpha() and len(stem) < 64 and _is_latin(stem):
                letters.add(stem)
                if len(stem) < len(w):
                    parted.append((w, stem, w[len(stem) :]))
            else:
                other.append(w)
        self._encode_letters(list(letters.difference(self.words)))
        tails = list({t for _, _, t in parted}.difference(self.words))
        other += tails
        self.words.update(zip(other, self._encode(other), strict=True))
        self.words.update((w, self.words[stem] + self.words[tail]) for w, stem, tail in parted)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 256):
            some = [t.lower() if _is_latin(t) else t for t in texts[i : i + 256]]
            split = [None if _ODD.search(t) else t.split() for t in some]
            self.words = worker_cache(f"word ids {self.path}", CACHE_WORDS)
            self._learn({w for words in split if words for w in words}.difference(self.words))
            get = self.words.__getitem__
            for text, words in zip(some, split, strict=True):
                yield self._encode([text])[0] if words is None else b"".join(map(get, words))


def _is_latin(text: str) -> bool:
    """Latin-1 only: lower-casing and normalisation are then the same here as in the vocabulary's library."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int, ordered: bool = False):
    """Pieces of documents, numbered by length within this task; or, if ordered, with the row's stretch and place in it."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            places = zip(batch.column("stretch").to_pylist(), batch.column("nth").to_pylist(), strict=True) if ordered else None
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts), strict=True):
                ids += end
                total = len(ids) // 4
                stretch, nth = next(places) if ordered else (part, None)
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), stretch, nth if ordered else int(seen[length]))
                    seen[length] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if ordered else pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room, by bitset subset-sum over lengths."""
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | (reach << length)) & full
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            at -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges (length, first rank, end rank, first sequence, copies per sequence, offset) that pack all pieces."""
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    for seed in sorted(left, reverse=True):
        while left.get(seed, 0) > 0:
            left[seed] -= 1
            chosen = fullest({k: v for k, v in left.items() if v > 0}, capacity - seed)
            left[seed] += 1
            chosen[seed] = chosen.get(seed, 0) + 1
            times = min(left[k] // m for k, m in chosen.items())
            offset = 0
            for length, m in sorted(chosen.items(), reverse=True):
                out.append((length, used[length], used[length] + m * times, sequence, m, offset))
                used[length] += m * times
                left[length] -= m * times
                offset += m * length
            sequence += times
    return out


def _place(ranges: list[tuple[int, int, int, int, int, int]], capacity: int):
    table = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    key = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + b.column("_before").to_numpy()
            found = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - found[:, 1]
            sequence = found[:, 3] + nth // found[:, 4]
            offset = found[:, 5] + nth % found[:, 4] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [b.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(rows.mapInArrow(_cut(tokenizer_path, capacity, end_id), PIECES), "pieces")
    by_part = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = pieces.join(before, ["_part", "length"])
    return placed.mapInArrow(_place(plan(counts, capacity), capacity), PACKED)


def _stretch(capacity: int):
    """One stretch: its pieces, in order, planned and placed."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_rank", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = t.column("length").to_numpy()
        rank = np.zeros(len(length), np.int64)  # of a piece among those of its length
        order = np.argsort(length, kind="stable")
        size, first, count = np.unique(length[order], return_index=True, return_counts=True)
        rank[order] = np.arange(len(length)) - np.repeat(first, count)
        batch = t.combine_chunks().to_batches()[0].drop_columns(["_rank"]).append_column("_rank", pa.array(rank)).append_column("_before", pa.array(np.zeros(len(rank), np.int64)))
        placed = next(_place(plan(dict(zip(size.tolist(), count.tolist(), strict=True)), capacity), capacity)(iter([batch])))
        number = pa.array(placed.column("sequence_id").to_numpy() + (t.column("_part")[0].as_py() << 24))
        return pa.Table.from_batches([placed]).set_column(5, "sequence_id", number)

    return run


def pack_in_order(
    docs: DataFrame, tokenizer_path: str, file_number: Column, row_number: Column, stretch_rows: int = STRETCH_ROWS,
    capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """As pack, with sequence_id in the order of the rows: by file_number, then row_number (from 0) within the file."""
    stretch = F.shiftleft(file_number.cast("long"), 22) + F.floor(row_number / stretch_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), stretch.alias("stretch"), row_number.cast("long").alias("nth"))
    pieces = rows.mapInArrow(_cut(tokenizer_path, capacity, end_id, True), PIECES.replace("_part int", "_part long"))
    return pieces.groupBy("_part").applyInArrow(_stretch(capacity), PACKED)
