"""Subword lattice likelihood of documents.

Tokens are words and one end per document. A word's probability is the sum over every path through its lattice: arcs are
the pieces of an existing vocabulary and one arc for the whole word where the training documents hold it. A forward
recursion in log space sums all segmentations.

Piece weights: a vocabulary of log probabilities gives them as they are; one whose scores are ranks gives rank r the
Zipf weight 1 / (10 + r). Every piece that can occur within a word counts, of any length (pieces with a blank inside
can't). These given weights keep a fixed share, ``GIVEN``, in every class and at every size of the corpus; the rest is
fitted to the distinct training words of the class by ``steps`` of expectation-maximisation, for which a backward
recursion gives expected piece counts. With no steps the given weights stand alone. Word arcs carry discounted counts,
(count - d) / N, and the discount, d V / N, is the share of the subword paths, so probabilities of all words sum to one.
Documents are a mixture over classes seen in training (their languages, the ``max_classes`` most frequent ones and one
for all others): the marginal probability of a text sums over classes as well; a text's own class is no input.

Counts never meet in one place: every batch of documents sends its distinct words, with counts, to parts by hash; a part
merges them, and sends each batch the word scores it asked for, in the batch's own order. Parts grow with the square
root of the documents, as distinct words do, so that messages stay fewer than words. The driver sees the number of
tokens and types per class and at most one count per class and vocabulary piece.

Defined cases: null texts count as empty, which has one token, the end; without training documents every count is zero,
scores come from subword paths alone, and the base score is that of N = V = 0; an empty table gives an empty result;
repeated rows are scored alike, null ids and classes included; words of any length are scored whole, in logarithms
throughout, long ones one by one (their expected counts are taken by stretches); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

MAX_CLASSES = 63
BATCH_CHARS = 12_000_000
ROOTS_PER_PART = 6  # documents to the power of a half, for each part
EM_STEPS = 3
GIVEN = 0.1
LONG = 256  # bytes from which words are scored one by one
ELSEWHERE = 0.05  # share of a class's unknown words that the corpus as a whole knows
LOG10 = math.log(10.0)


def _pack(array: np.ndarray) -> bytes:
    raw = array.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_bytes(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unpack_bytes(blob), kind)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, then the end as an empty word."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(b"")
    return out


@dataclass
class Pieces:
    """Vocabulary pieces as bytes, the word start as a blank, with log weights; found by length and hash."""

    keys: np.ndarray
    ids: np.ndarray
    logp: np.ndarray
    lengths: list[int]

    def find(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ids[at], -1)


_BASE = np.uint64(0x100000001B3)


def _hash(piece: bytes) -> int:
    h = len(piece)
    for b in piece:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def load_pieces(model_file: str) -> Pieces:
    """Pieces of a sentencepiece vocabulary with the weights that its scores give; bytes as a last resort."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranks = all(float(model.get_score(i)).is_integer() for i in own)
    weight: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
    for i in own:
        raw = model.id_to_piece(i).replace("\u2581", " ").encode("utf-8")
        if raw.rfind(b" ") <= 0:
            weight[raw] = weight.get(raw, 0.0) + (1.0 / (10.0 - model.get_score(i)) if ranks else math.exp(model.get_score(i)))
    names = sorted(weight)
    p = np.array([weight[n] for n in names])
    keys = np.array([_hash(n) for n in names], np.uint64)
    order = np.argsort(keys)
    return Pieces(keys[order], order.astype(np.int64), np.log(p / p.sum()), sorted(set(map(len, names))))


def _arcs(codes: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece ids or -1) of every span of words of one length; codes: one row of bytes + 1 per word."""
    n, known = codes.shape[1], set(pieces.lengths)
    for i in range(n):
        h = None
        for j in range(i + 1, min(n, i + pieces.lengths[-1]) + 1):
            size = np.uint64(j - i)
            if h is None:
                h = np.zeros(len(codes), np.uint64)
            h = h * _BASE + codes[:, j - 1]
            if j - i not in known:
                continue
            # the length is folded in as the hash's start value, times the base to the power of the length
            start = np.uint64((int(size) * pow(int(_BASE), int(size), 1 << 64)) & 0xFFFFFFFFFFFFFFFF)
            yield i, j, pieces.find(h + start)


def forward(words: list[bytes], pieces: Pieces, logp: np.ndarray, totals: np.ndarray | None = None) -> np.ndarray:
    """Log marginal probability of each word over all its segmentations, a row for each row of piece weights logp.

    With totals, of logp's shape, adds the expected count of every piece, each word taken once.
    """
    out = np.full((len(logp), len(words)), -np.inf)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(lengths > LONG):
        out[:, i] = _forward_long(words[i], pieces, logp)
        if totals is not None:  # by stretches, as if each were a word's inside
            inner = [words[i][k : k + LONG] for k in range(0, len(words[i]), LONG)]
            forward(inner, pieces, logp, totals)
    for length in np.unique(lengths[lengths <= LONG]):
        every = np.flatnonzero(lengths == length)
        n = int(length) + 1
        step = max(1, 2_000_000 // (n * len(pieces.lengths) * len(logp)))
        for k in range(0, len(every), step):
            some = every[k : k + step]
            raw = b"".join([b" " + words[i] for i in some])
            codes = np.frombuffer(raw, np.uint8).reshape(len(some), n).astype(np.uint64) + np.uint64(1)
            alpha = np.full((n + 1, len(logp), len(some)), -np.inf)
            alpha[0] = 0.0
            arcs = []
            for i, j, ids in _arcs(codes, pieces):
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    weight = logp[:, ids[hit]]
                    alpha[j][:, hit] = np.logaddexp(alpha[j][:, hit], alpha[i][:, hit] + weight)
                    if totals is not None:
                        arcs.append((i, j, hit, ids[hit], weight))
            out[:, some] = alpha[n]
            if totals is None:
                continue
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0.0
            for i, j, hit, _, weight in sorted(arcs, key=lambda a: -a[1]):
                beta[i][:, hit] = np.logaddexp(beta[i][:, hit], beta[j][:, hit] + weight)
            for i, j, hit, got, weight in arcs:
                share = np.exp(alpha[i][:, hit] + weight + beta[j][:, hit] - alpha[n][:, hit])
                for z, x in enumerate(share):
                    totals[z] += np.bincount(got, x, minlength=totals.shape[1])
    return out


def _forward_long(word: bytes, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """The same sum for one long word: hits of every piece length at once, then one running sum over places."""
    codes = np.frombuffer(b" " + word, np.uint8).astype(np.uint64) + np.uint64(1)
    n, ends, h = len(codes), [], np.zeros(len(codes), np.uint64)
    for size in range(1, min(n, pieces.lengths[-1]) + 1):
        h = h[: n - size + 1] * _BASE + codes[size - 1 :]
        if size in pieces.lengths:
            start = np.uint64((size * pow(int(_BASE), size, 1 << 64)) & 0xFFFFFFFFFFFFFFFF)
            ids = pieces.find(h + start)
            at = np.flatnonzero(ids >= 0)
            ends.append(np.stack([at + size, at, ids[at]], axis=1))
    arcs = np.concatenate(ends)
    arcs = arcs[np.argsort(arcs[:, 0], kind="stable")]
    cuts = np.searchsorted(arcs[:, 0], np.arange(n + 2))
    alpha = np.full((n + 1, len(logp)), -np.inf)
    alpha[0] = 0.0
    for j in range(1, n + 1):
        some = arcs[cuts[j] : cuts[j + 1]]
        if len(some):
            into = alpha[some[:, 1]] + logp[:, some[:, 2]].T
            top = into.max(axis=0)
            alpha[j] = top + np.log(np.exp(into - top).sum(axis=0))
    return alpha[n]


def _collect(parts: int, classes: list[str | None], model_classes: int):
    """Batches of documents: their term counts as one row, their distinct words with training counts as a row per part."""
    place = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, nth = TaskContext.get().partitionId(), 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal nth
            batch = (part_id << 24) + nth
            nth += 1
            vocabulary: dict[bytes, int] = {}
            coded = []
            for _, words, _, _ in rows:
                for w in set(words).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                coded.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            size = len(vocabulary)
            counts = np.zeros((size, model_classes), np.int64)
            sizes, ids, tfs = [], [], []
            for (_, _, train, c), code in zip(rows, coded, strict=True):
                term, tf = np.unique(code, return_counts=True)
                if train:
                    counts[term, c] += tf
                sizes.append(len(term))
                ids.append(np.diff(term, prepend=0))
                tfs.append(tf)
            names = list(vocabulary)
            to = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in names), np.int64, size)
            order = np.argsort(to, kind="stable")
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            ends = np.searchsorted(to[order], np.arange(parts + 1))
            kinds, owners, blobs, more = [0], [-1], [_pack(np.array([(-1 if r[0] is None else r[0]) for r in rows], np.int64))], []
            nulls = np.array([r[0] is None for r in rows], np.uint8)
            train = np.array([r[2] for r in rows], np.uint8)
            head = [_pack(x) for x in (nulls, train, np.array(sizes, np.int32), np.concatenate(ids).astype(np.int32), np.concatenate(tfs).astype(np.int32), rank.astype(np.int32))]
            more.append(head)
            for p in range(parts):
                mine = order[ends[p] : ends[p + 1]]
                if len(mine):
                    kinds.append(1)
                    owners.append(p)
                    blobs.append(_pack_bytes(b"\n".join([names[i] for i in mine])))
                    more.append([_pack(counts[mine].astype(np.int32))])
            n = len(kinds)
            columns = [pa.array(kinds, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array(owners, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "batch", "part", "blob", "more"])

        rows, chars = [], 0
        for b in batches:
            for doc_id, text, train, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "train", "class")), strict=True):
                rows.append((doc_id, words_of(text), train, place.get(c, len(classes))))
                chars += len(text or "")
                if chars > BATCH_CHARS:
                    yield flush(rows)
                    rows, chars = [], 0
        if rows:
            yield flush(rows)

    return run


def _merge(classes: int):
    """One part: its words, their counts per class, and what each batch asked for."""

    def run(t: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        asked, counted = [], []
        for blob, more in zip(t.column("blob").to_pylist(), t.column("more").to_pylist(), strict=True):
            words = _unpack_bytes(blob).split(b"\n")
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
            asked.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            counted.append(_unpack(more[0], np.int32).reshape(-1, classes))
        counts = np.zeros((len(ids), classes), np.int64)
        for a, c in zip(asked, counted, strict=True):
            counts[a] += c  # words of one batch are distinct
        total = counts.sum(axis=1)
        words = list(ids)
        stats = np.concatenate([counts.sum(axis=0), (counts > 0).sum(axis=0), [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()]]).astype(np.int64)
        batches = np.array(t.column("batch").to_pylist(), np.int64)
        sizes = np.array([len(a) for a in asked], np.int64)
        row = {
            "part": [t.column("part")[0].as_py()],
            "words": [_pack_bytes(b"\n".join(words))],
            "counts": [_pack(counts)],
            "batches": [_pack(batches)],
            "sizes": [_pack(sizes)],
            "asked": [_pack(np.concatenate(asked))],
            "stats": [stats.tolist()],
        }
        return pa.table(row, schema=pa.schema([("part", pa.int32())] + [(k, pa.binary()) for k in ("words", "counts", "batches", "sizes", "asked")] + [("stats", pa.list_(pa.int64()))]))

    return run


def _expected(model_file: str, classes: int, logp: np.ndarray):
    """Expected piece counts over the words of each class, every distinct word once: (class, piece, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, totals = load_pieces(model_file), np.zeros_like(logp)
        for b in batches:
            for names, blob in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                words = _unpack_bytes(names).split(b"\n")
                counts = _unpack(blob, np.int64).reshape(-1, classes)
                for z in range(classes):
                    forward([words[i] for i in np.flatnonzero(counts[:, z] > 0)], pieces, logp[z : z + 1], totals[z : z + 1])
        z, at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(at, pa.int32()), pa.array(totals[z, at])], names=["z", "piece", "x"])

    return run


def _fit_pieces(merged: DataFrame, model_file: str, classes: int, steps: int) -> np.ndarray:
    """Log piece weights per class: the given ones, then steps of expectation-maximisation for all but their share."""
    given = np.exp(load_pieces(model_file).logp)
    logp = np.tile(np.log(given), (classes, 1))
    for _ in range(steps):
        found = merged.select("words", "counts").mapInArrow(_expected(model_file, classes, logp), "z int, piece int, x double")
        gained = np.zeros_like(logp)
        # at most one row per class and vocabulary piece, however large the corpus
        for z, piece, x in found.groupBy("z", "piece").agg(F.sum("x")).collect():
            gained[z, piece] = x
        total = gained.sum(axis=1, keepdims=True)
        logp = np.log(np.where(total > 0, GIVEN * given + (1 - GIVEN) * gained / np.maximum(total, 1e-300), given))
    return logp


def word_scores(counts: np.ndarray, sub: np.ndarray, tokens: np.ndarray, types: np.ndarray, discount: float) -> np.ndarray:
    """Log probability of words (rows) in each class, from their counts and their lattice sums (a row for each class).

    types: distinct words of each class, and at the end of all. Everything stays in logarithms.
    """
    total = counts.sum(axis=1)
    n, v = tokens.sum(), types[-1]
    mean = np.logaddexp.reduce(sub, axis=0) - math.log(len(sub))
    with np.errstate(divide="ignore"):
        whole = np.logaddexp(np.log(np.maximum(total - discount, 0.0) / n), math.log(discount * v / n) + mean) if n else mean
        out = np.empty(counts.shape)
        for z in range(counts.shape[1]):
            nz, vz = tokens[z], types[z]
            back = np.logaddexp(math.log(1 - ELSEWHERE) + sub[z], math.log(ELSEWHERE) + whole)
            out[:, z] = np.logaddexp(np.log(np.maximum(counts[:, z] - discount, 0.0) / nz), math.log(discount * vz / nz) + back) if nz else whole
    return out


def _replies(model_file: str, classes: int, logp: np.ndarray, tokens: np.ndarray, types: np.ndarray, discount: float):
    """For every word a batch asked a part for: its count, and its log10 probability in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_file)
        for b in batches:
            for row in b.to_pylist():
                words = _unpack_bytes(row["words"]).split(b"\n")
                counts = _unpack(row["counts"], np.int64).reshape(-1, classes)
                each = (word_scores(counts, forward(words, pieces, logp), tokens, types, discount) / LOG10).astype(np.float32)
                asked = _unpack(row["asked"], np.int32)
                ids = _unpack(row["batches"], np.int64)
                ends = np.cumsum(_unpack(row["sizes"], np.int64))
                out = [np.split(x[asked], ends[:-1]) for x in (counts.sum(axis=1).astype(np.int32), each)]
                arrays = [pa.array(ids), pa.array([row["part"]] * len(ids), pa.int32()), pa.array([_pack(x) for x in out[0]], pa.binary()), pa.array([_pack(x) for x in out[1]], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["batch", "part", "counts", "scores"])

    return run


def _score(classes: int, prior: np.ndarray, n_train: int, v_train: int):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.argsort(np.array(replies.column("part").to_pylist()))
        counts = np.concatenate([_unpack(replies.column("counts")[int(i)].as_py(), np.int32) for i in order])
        scores = np.concatenate([_unpack(replies.column("scores")[int(i)].as_py(), np.float32).reshape(-1, classes) for i in order]).astype(np.float64)
        log_count = np.log10(counts + 1.0)
        cols: list[list] = [[] for _ in range(6)]
        for blob, more in zip(docs.column("blob").to_pylist(), docs.column("more").to_pylist(), strict=True):
            ids = _unpack(blob, np.int64)
            nulls, train = _unpack(more[0], np.uint8), _unpack(more[1], np.uint8)
            sizes, delta, tf, rank = (_unpack(m, np.int32) for m in more[2:])
            at = 0
            for doc_id, null, used, size in zip(ids.tolist(), nulls.tolist(), train.tolist(), sizes.tolist(), strict=True):
                term = rank[np.cumsum(delta[at : at + size])]
                f = tf[at : at + size].astype(np.float64)
                at += size
                tokens = int(f.sum())
                by_class = prior + f @ scores[term]
                top = by_class.max()
                marginal = top + math.log10(np.power(10.0, by_class - top).sum())
                base = float(f @ log_count[term]) - tokens * math.log10(n_train + v_train + 1)
                values = (None if null else doc_id, not used, tokens, int(f @ (counts[term] > 0)), base, marginal)
                for c, x in zip(cols, values, strict=True):
                    c.append(x)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def score(
    docs: DataFrame,
    train: F.Column,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = "lang",
    max_classes: int = MAX_CLASSES,
    steps: int = EM_STEPS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from rows where train."""
    kind = F.lit(None).cast("string") if class_col is None else F.col(class_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), kind.alias("class")
    )
    found = rows.where("train and class is not null").groupBy("class").count().orderBy(F.desc("count"), "class").limit(max_classes).collect()
    classes = [r[0] for r in found]
    n_rows = rows.count()
    k = len(classes) + 1
    parts = max(8, math.isqrt(n_rows) // ROOTS_PER_PART)
    collected = materialise(
        rows.mapInArrow(_collect(parts, classes, k), "kind int, batch long, part int, blob binary, more array<binary>"), "lattice-batches"
    )
    merged = materialise(
        collected.where("kind = 1").select("batch", "part", "blob", "more").groupBy("part").applyInArrow(
            _merge(k),
            "part int, words binary, counts binary, batches binary, sizes binary, asked binary, stats array<long>",
        ),
        "lattice-words",
    )
    stats = merged.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x")).collect()
    stat = np.zeros(2 * k + 4, np.int64)
    for i, x in stats:
        stat[i] = x
    n_train, v_train, once, twice = (int(x) for x in stat[2 * k :])
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    tokens, types = stat[:k].astype(float), np.append(stat[k : 2 * k], v_train).astype(float)
    logp = _fit_pieces(merged, model_file, k, steps if n_train else 0)
    replies = merged.select("part", "words", "counts", "batches", "sizes", "asked").mapInArrow(
        _replies(model_file, k, logp, tokens, types, discount), "batch long, part int, counts binary, scores binary"
    )
    share = (tokens + 1) / (tokens + 1).sum()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    heads = collected.where("kind = 0").select("batch", "blob", "more")
    out = heads.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_score(k, np.log10(share), n_train, v_train), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
