"""Removal of repeated byte strings, by suffix arrays sorted in two stages.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document of smaller id or earlier in
the same one. Texts equal as a whole collapse first. In what is left, the smallest hash among the 32-byte strings of
every window of ``length`` bytes is an anchor; equal windows have equal anchors at equal places, so only anchors that
occur again, with the windows they stand for, can matter. These windows, cut out as regions, meet by anchor, equal
regions once. Each part of the anchors builds the suffix array of its regions: suffixes smaller than their successors
are sorted directly, by their bytes, the others are induced from them by one scan over the buckets of first bytes.
Common prefixes of neighbours then show which windows are equal; all but the earliest are removed.

Parts have a bounded share of the anchors and regions, combined before they are sent: of an anchor that a batch holds
more than once, one goes to its part and the places stay with the batch's own task, as that it occurs again is known
already; of equal regions only the earliest goes, as the others are known to be removed. So a passage that a third of all
documents holds costs its parts one anchor and one region per batch, and only its ends, whose surroundings differ, keep
one region per document. A document is known by its id and a hash of its text (32 bits, as only rows that repeat an id
need it; 64 for rows without one).

Defined cases: null texts count as empty; texts shorter than ``length`` keep everything; rows with a null id come
before all others; rows that repeat both id and text are one document, with one result each; rows that repeat an id
with another text are ordered by a hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.common import materialise

LENGTH, GRAM = 100, 32
ANCHORS_PER_PART = 400_000
REGIONS_PER_PART = 20_000
_END = 511
_BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_B = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor, in order; gram is a power of two.

    A window's anchor is the leftmost of the smallest hashes (by their upper bits), so runs of windows share one. Long
    texts are taken by blocks of windows.
    """
    parts = [_block_anchors(data[i : i + _BLOCK + length - 1], i, length, gram) for i in range(0, max(0, len(data) - length + 1), _BLOCK)]
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_anchors(data: np.ndarray, begin: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, _B
    while n < gram:
        h = h[:-n] * np.uint64(power) + h[n:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        n *= 2
    h = _mix(h)
    width = length - gram + 1
    low, n = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while n * 2 <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if width > n:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    at = (low[start] & _PLACE).astype(np.int64)
    return h[at], at + begin, start + begin, np.r_[start[1:], len(low)] - 1 + begin


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [len(a.tobytes()).to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True) for a in arrays]


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def _rows(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(ends[1:] > ends[:-1]):
        some = order[ends[p] : ends[p + 1]]
        yield int(p), [c[some] for c in columns]


def _emit_anchors(parts: int, length: int, gram: int):
    """Anchors to their parts, once a batch. Those that a batch holds twice are repeated for sure: their places go, as
    packs of three, to a group of this task's own, and the part gets the hash without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parts + TaskContext.get().partitionId()
        for b in batches:
            hashes, places, sizes = [], [], []
            for text in b.column("text").to_pylist():
                h, at, _, _ = anchors(np.frombuffer(text.encode(), np.uint8), length, gram)
                hashes.append(h)
                places.append(at)
                sizes.append(len(h))
            if not sum(sizes):
                continue
            h, at = np.concatenate(hashes), np.concatenate(places)
            doc, uid = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("doc", "uid"))
            _, first, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[which] > 1)
            sent = np.where(count > 1, -1, at[first])
            found = list(_rows((h[first] % np.uint64(parts)).astype(np.int64), parts, [h[first], doc[first], uid[first], sent]))
            if len(again):
                found.append((own, [doc[again], uid[again], at[again]]))
            arrays = [pa.array([p for p, _ in found], pa.int32()), pa.array([_pack(*c) for _, c in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "blobs"])

    return run


def _again(t: pa.Table) -> pa.Table:
    """(doc, uid, position) of the anchors of a part that occur more than once; what a task knew already passes."""
    blobs = t.column("blobs").to_pylist()
    known = [b for b in blobs if len(b) == 3]
    columns = [[_unpack(b[i], np.int64) for b in known] for i in range(3)]
    asked = [b for b in blobs if len(b) == 4]
    if asked:
        h = np.concatenate([_unpack(b[0], np.uint64) for b in asked])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        rest = [np.concatenate([_unpack(b[i], np.int64) for b in asked])[twice] for i in (1, 2, 3)]
        placed = rest[2] >= 0
        for c, x in zip(columns, rest, strict=True):
            c.append(x[placed])
    return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("doc", "uid", "at"), columns, strict=True)})


def _emit_regions(parts: int, length: int, gram: int):
    """Regions around repeated anchors, the earliest of equal ones to their part; the spans of the others, known to go,
    as packs of four, to a group of this task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parts + TaskContext.get().partitionId()
        for b in batches:
            keys, docs, uids, starts, windows, texts = [], [], [], [], [], []
            for doc, uid, text, hit in zip(*(b.column(c).to_pylist() for c in ("doc", "uid", "text", "at")), strict=True):
                raw = text.encode()
                h, at, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
                for i in np.flatnonzero(np.isin(at, hit)).tolist():
                    x, n = int(first[i]), int(last[i] - first[i]) + 1
                    keys.append(int(h[i]))
                    docs.append(doc)
                    uids.append(uid)
                    starts.append(x)
                    windows.append(n)
                    texts.append(raw[x : x + n + length - 1])
            if not keys:
                continue
            key, doc, uid, start, n = np.array(keys, np.uint64), np.array(docs, np.int64), np.array(uids, np.int64), np.array(starts, np.int64), np.array(windows, np.int64)
            order = np.lexsort((start, uid, doc))
            seen: dict[bytes, int] = {}
            full = np.zeros(len(key), bool)
            for i in order.tolist():
                if seen.setdefault(texts[i], i) == i:
                    full[i] = True
            one = np.flatnonzero(full)
            part = (_mix(key[one]) % np.uint64(parts)).astype(np.int64)
            found = []
            for p, (rows,) in _rows(part, parts, [one]):
                body = np.frombuffer(b"".join([texts[i] for i in rows]), np.uint8)
                found.append((p, _pack(doc[rows], uid[rows], start[rows], n[rows], body)))
            if not full.all():
                more = ~full
                found.append((own, _pack(doc[more], uid[more], start[more], start[more] + n[more] + length - 1)))
            arrays = [pa.array([p for p, _ in found], pa.int32()), pa.array([c for _, c in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "blobs"])

    return run


def _words(codes: np.ndarray, depth: int) -> np.ndarray:
    """Seven codes of nine bits from every position on, as one number; past the end, the end."""
    padded = np.concatenate([codes.astype(np.uint64), np.full(depth + 16, _END, np.uint64)])
    word = np.zeros(len(codes) + depth + 9, np.uint64)
    for i in range(7):
        word = (word << np.uint64(9)) | padded[i : i + len(word)]
    return word


def _next(marked: np.ndarray) -> np.ndarray:
    """The first marked place from every place on."""
    return np.minimum.accumulate(np.where(marked, np.arange(len(marked)), len(marked))[::-1])[::-1]


def sort_suffixes(codes: np.ndarray, wanted: np.ndarray, depth: int, word: np.ndarray | None = None) -> np.ndarray:
    """Wanted positions of codes (0 ends a region, the end is above all codes) in the order of their suffixes, exact to depth.

    Two stages. A suffix is of the first kind if it is smaller than its successor; these are sorted directly. Scanning
    the buckets of first codes upwards, every sorted suffix puts the one that starts just before it, if of the other
    kind, next in its own bucket; runs of one code follow wave by wave. With wanted positions, the suffixes up to the
    next of the first kind are sorted too, as the scan starts from those.
    """
    size = len(codes)
    word = _words(codes, depth) if word is None else word
    step = np.sign(np.diff(codes.astype(np.int32), append=_END))
    upward = step[_next(step != 0)] > 0
    # from every wanted position up to the first upward one
    stop = _next(upward)[wanted]
    cover = np.bincount(wanted, minlength=size + 1) - np.bincount(stop + 1, minlength=size + 1)
    needed = np.cumsum(cover[:-1]) > 0
    direct = np.flatnonzero(needed & upward)
    order = _sort_by_words(direct, word, -(-depth // 7))
    induced = needed & ~upward

    first_code = codes[order]
    bounds = np.searchsorted(first_code, np.arange(int(codes.max(initial=0)) + 2))
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for c in range(len(bounds) - 1):
        wave = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (codes[before] == c)]
        bucket.append(order[bounds[c] : bounds[c + 1]])
        all_of_c = np.concatenate(bucket)
        out.append(all_of_c)
        before = all_of_c[all_of_c > 0] - 1
        before = before[induced[before] & (codes[before] > c)]
        if len(before):
            to = codes[before]
            by = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])
            for x, group in zip(cuts, np.split(before[by], cuts[1:]), strict=True):
                waiting.setdefault(int(to[by][x]), []).append(group)
    sorted_all = np.concatenate(out) if out else np.zeros(0, np.int64)
    mine = np.zeros(size, bool)
    mine[wanted] = True
    return sorted_all[mine[sorted_all]]


def _sort_by_words(at: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """Positions by words of seven codes each; only groups that a word tells apart are sorted again."""
    order = at[np.argsort(word[at], kind="stable")]
    if not len(order):
        return order
    key = word[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))  # a group is known by its first place
    for w in range(1, words):
        tie = group[1:] == group[:-1]
        open_ = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])
        if not len(open_):
            break
        own = group[open_]
        key = word[order[open_] + 7 * w]
        head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        number = np.cumsum(np.r_[False, own[1:] != own[:-1]])
        apart = np.zeros(len(head), bool)
        apart[number[key != key[head][number]]] = True
        some = np.flatnonzero(apart[number])
        if not len(some):
            continue
        places, key, own = open_[some], key[some], own[some]
        by = np.lexsort((key, own))
        order[places] = order[places][by]
        key, own = key[by], own[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        group[places] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
    return order


def equal_windows(texts: np.ndarray, sizes: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, region, offset) of every window of every region: windows of one class are equal. texts: regions joined."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(len(texts) + len(sizes), np.int16)
    place = np.arange(len(texts)) + np.repeat(np.arange(len(sizes)), sizes)
    codes[place] = texts.astype(np.int16) + 1
    region = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(region)) - np.repeat(np.cumsum(windows) - windows, windows)
    base = begin[:-1] + np.arange(len(sizes))
    wanted = base[region] + offset
    word = _words(codes, length)
    order = sort_suffixes(codes, wanted, length, word)
    common = np.ones(max(0, len(order) - 1), bool)  # whether neighbours share a prefix of length bytes
    for i in range(0, length, 7):
        live = np.flatnonzero(common)
        if not len(live):
            break
        spare = np.uint64(9 * max(0, i + 7 - length))  # bits of the last word that lie beyond the prefix
        common[live] = (word[order[live] + i] >> spare) == (word[order[live + 1] + i] >> spare)
    number = np.cumsum(np.r_[True, ~common]) if len(order) else np.zeros(0, np.int64)
    which = np.searchsorted(base, order, side="right") - 1
    return number, which, order - base[which]


def _find(length: int):
    """(doc, uid, s, e): spans to remove, of the regions of a part, and those that a task knew already."""

    def run(t: pa.Table) -> pa.Table:
        blobs = t.column("blobs").to_pylist()
        known = [b for b in blobs if len(b) == 4]
        out = [[_unpack(b[i], np.int64) for b in known] for i in range(4)]
        blobs = [b for b in blobs if len(b) == 5]
        if blobs:
            for c, x in zip(out, _later(blobs, length), strict=True):
                c.append(x)
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("doc", "uid", "s", "e"), out, strict=True)})

    return run


def _later(blobs: list[list[bytes]], length: int) -> list[np.ndarray]:
    """doc, uid, start and end of all spans of windows that also start earlier."""
    doc, uid, start, n = (np.concatenate([_unpack(b[i], np.int64) for b in blobs]) for i in range(4))
    body = np.concatenate([_unpack(b[4], np.uint8) for b in blobs])
    # equal regions of several batches: the earliest stays to be sorted
    begin = np.concatenate([[0], np.cumsum(n + length - 1)])
    raw = body.tobytes()
    seen: set[bytes] = set()
    full = np.zeros(len(n), bool)
    for i in np.lexsort((start, uid, doc)).tolist():
        piece = raw[begin[i] : begin[i + 1]]
        if piece not in seen:
            seen.add(piece)
            full[i] = True
    more = np.flatnonzero(~full)
    out = [[doc[more]], [uid[more]], [start[more]], [start[more] + n[more] + length - 1]]
    some = np.flatnonzero(full)
    keep = np.repeat(full, n + length - 1)
    number, region, offset = equal_windows(body[keep], n[some] + length - 1, n[some], length)
    region = some[region]
    by = np.lexsort((start[region] + offset, uid[region], doc[region], number))
    number, region, offset = number[by], region[by], offset[by]
    later = np.r_[False, number[1:] == number[:-1]] if len(number) else np.zeros(0, bool)
    region, offset = region[later], offset[later]
    by = np.lexsort((offset, region))
    region, offset = region[by], offset[by]
    if len(region):  # runs of windows
        cut = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (offset[1:] != offset[:-1] + 1)])
        stop = np.r_[cut[1:], len(region)] - 1
        at = region[cut]
        for c, x in zip(out, (doc[at], uid[at], start[at] + offset[cut], start[at] + offset[stop] + length), strict=True):
            c.append(x)
    return [np.concatenate(c) for c in out]


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns: list[list] = [[] for _ in range(5)]
        for doc_id, text, spans, extra in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans", "rows")), strict=True):
            raw = text.encode()
            kept, at, removed, runs, open_end = [], 0, 0, 0, -1
            for span in sorted((x["s"], x["e"]) for x in spans or []):
                if span[0] > open_end:
                    kept.append(raw[at : span[0]])
                    runs += 1
                    removed += span[1] - span[0]
                else:
                    removed += max(0, span[1] - open_end)
                open_end = max(open_end, span[1])
                at = open_end
            kept.append(raw[at:])
            values = (doc_id, len(raw), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest())
            for c, x in zip(columns, values, strict=True):
                c += [x] * extra
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parted = exact_dedup.split_by_digest(rows, F.sha2("text", 256), "doc_id", [F.col("text")])
    single, maybe = (part.withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha") for part in parted)
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    narrow = maybe.select(order.alias("doc"), "doc_id", "text_sha256", F.octet_length("text").cast("long").alias("n_bytes"))
    groups = narrow.groupBy("text_sha256").agg(F.min("doc").alias("doc"))
    counted = narrow.groupBy("text_sha256", "doc", "n_bytes").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).cast("int").alias("rows"))
    firsts = counted.join(groups, ["text_sha256", "doc"])
    later = counted.join(groups, ["text_sha256", "doc"], "left_anti")
    reps = maybe.withColumn("doc", order).join(firsts.select("text_sha256", "doc", "rows"), ["text_sha256", "doc"]).dropDuplicates(["text_sha256"])
    uid = F.when(F.col("doc_id").isNull(), F.xxhash64("text_sha256")).otherwise(F.hash("text_sha256").cast("long")).alias("uid")
    key, columns = ["doc", "uid"], ["doc_id", "doc", "text", "text_sha256", "rows"]
    base = single.withColumn("doc", order).withColumn("rows", F.lit(1)).select(uid, *columns).unionByName(reps.select(uid, *columns))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, size // (ANCHORS_PER_PART * (length - gram) // 2))
    emitted = base.select(*key, "text").mapInArrow(_emit_anchors(parts, length, gram), "part int, blobs array<binary>")
    again = emitted.groupBy("part").applyInArrow(_again, "doc long, uid long, at long")
    hits = materialise(again.groupBy(*key).agg(F.collect_list("at").alias("at")), "repeated-anchors")  # a document's own
    wide = materialise(base.join(hits, key), "documents-with-repeats")
    n_hits = hits.agg(F.sum(F.size("at"))).first()[0] or 0
    cut = wide.select(*key, "text", "at").mapInArrow(_emit_regions(max(8, n_hits // REGIONS_PER_PART), length, gram), "part int, blobs array<binary>")
    found = cut.groupBy("part").applyInArrow(_find(length), "doc long, uid long, s long, e long")
    spans = found.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = wide.select(*key, "doc_id", "text", "rows").join(spans, key, "left").select("doc_id", "text", "spans", "rows").mapInArrow(_remaining, schema)
    whole = base.select(*key, "doc_id", "rows", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text_sha256").alias("kept_sha256"))
    untouched = whole.join(hits.select(*key), key, "left_anti").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    none = F.lit(0).cast("long")
    gone = F.col("n_bytes") >= length
    copies = later.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(none).alias("n_removed"), F.when(gone, none + 1).otherwise(none).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("text_sha256")).alias("kept_sha256"),
    )
    return touched.unionByName(untouched.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256")).unionByName(copies)
