"""Quality classification by naive-Bayes support vectors.

A text's features are indicators of n-grams, in three views: words, lower-cased with their punctuation (one and two in a
row); three-character n-grams, blanks for white space; and word forms, where every word is written as classes of characters, with
its punctuation as it stands, and marked where it repeats the word before (one to three in a row). A further indicator
tells that a line occurs again. All are hashed, whole words and whole texts. Indicators that fewer than ``least``
labelled rows hold are no evidence and count nothing. The others are scaled by the log ratio of their smoothed counts in
the two classes and by the square root of their view's size in the text, and a linear hinge-loss model is fitted on them
by dual coordinate descent. Margins become scores through a logistic curve fitted on held-back folds.

The model learns from at most ``max_labelled`` labelled rows, those of the smallest xxhash64 of the id, then the id, and
of these only as many as hold ``max_slots`` features together, so the driver's memory is bounded however long texts are:
both are parameters, and the only thing that is not taken over all data. Scores cover every whole text.

Defined cases: null texts count as empty; empty texts have no features and score by the bias; labels that are null or
not 0/1 are ignored; repeated label rows of one document count once, and a document with both labels counts as 0; rows
that repeat a labelled id teach once, the least of their features; with no labels, or labels of one class only, every
score is the smoothed share of that class (0.5 without any); an empty table gives an empty result; extra columns are
ignored by ``score`` and carried by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, id_crc, materialise, worker_cache
from tessera.llm.linear_svm import fit_dual, fit_sigmoid, sigmoid

WORD_SLOTS, FORM_SLOTS, CHAR_SLOTS = 1 << 18, 1 << 18, 1 << 16
BUCKETS = WORD_SLOTS + FORM_SLOTS + CHAR_SLOTS
VIEWS = np.array([0, WORD_SLOTS, WORD_SLOTS + FORM_SLOTS, BUCKETS])
MAX_LABELLED = 4_000
MAX_SLOTS = 4_000_000
LEAST = 3
CACHE = 300_000
_RUN = re.compile(r"a+|A+|0+|(.)\1{2,}")
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_AGAIN = WORD_SLOTS + FORM_SLOTS - 1


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


_CLASSES = _Classes()


def word_form(word: str) -> str:
    return _RUN.sub(lambda m: m[0][0] if m[1] is None else m[0][:3], word.translate(_CLASSES))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def features(text: str) -> np.ndarray:
    """Sorted distinct feature slots of a text: words, forms, characters, each view in its own range."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    low = " ".join(words).lower()
    known = worker_cache("words of the quality model", CACHE)
    for w in set(words).difference(known):
        known[w] = (xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(word_form(w).encode("utf-8", "surrogatepass")))
    both = np.array([known[w] for w in words], np.uint64)
    h, form = both[:, 0], both[:, 1].copy()
    form[1:][h[1:] == h[:-1]] += np.uint64(1)  # a word that repeats the one before
    word = np.concatenate([_mix(h), _mix(h[:-1] * _STEP + h[1:])]) % np.uint64(WORD_SLOTS)
    two = form[:-1] * _STEP + form[1:]
    forms = np.concatenate([_mix(form), _mix(two), _mix(two[:-1] * _STEP + form[2:])]) % np.uint64(FORM_SLOTS - 1)
    raw = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars = _mix((raw[:-2] * _STEP + raw[1:-1]) * _STEP + raw[2:]) % np.uint64(CHAR_SLOTS)
    lines = [x for x in text.split("\n") if x.strip()]
    again = [_AGAIN] if len(set(lines)) < len(lines) else []
    return np.concatenate([_distinct(word, 0), _distinct(forms, 1), np.array(again, np.int32), _distinct(chars, 2)])


def _distinct(slots: np.ndarray, view: int) -> np.ndarray:
    """Sorted distinct slots in the range of their view."""
    slots = np.sort(slots.astype(np.int32))
    return slots[np.r_[True, slots[1:] != slots[:-1]]] + np.int32(VIEWS[view])


def values(slots: np.ndarray) -> np.ndarray:
    """What an indicator counts: one over the square root of its view's size in the text."""
    sizes = np.diff(np.searchsorted(slots, VIEWS))
    return np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32)


def _fit(rows: list[np.ndarray], labels: np.ndarray, c: float, least: int) -> tuple[np.ndarray, float]:
    up, down = np.ones(BUCKETS), np.ones(BUCKETS)
    for slots, label in zip(rows, labels, strict=True):
        (up if label > 0 else down)[slots] += 1
    n_up = max(1, int((labels > 0).sum()))
    n_down = max(1, int((labels <= 0).sum()))
    ratio = np.log((up / (n_up + 1)) / (down / (n_down + 1))).astype(np.float32)
    ratio[up + down < 2 + least] = 0.0  # hardly ever seen: no evidence
    examples = []
    for slots in rows:
        weight = ratio[slots] * values(slots)
        some = np.flatnonzero(weight)
        examples.append((slots[some].astype(np.intp), weight[some]))
    cost = np.where(labels > 0, c * len(labels) / (2 * n_up), c * len(labels) / (2 * n_down))
    w, bias = fit_dual(examples, labels, BUCKETS, cost)
    return w * ratio, bias


def _margins(w: np.ndarray, bias: float, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([float(w[s] @ values(s)) + bias for s in rows])


@dataclass
class Fitted:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    held: np.ndarray  # slots that count as evidence

    def score(self, slots: np.ndarray) -> float:
        slots = slots[self.held[slots]]
        margin = float(self.weights[slots] @ values(slots)) + self.bias
        return float(sigmoid(self.slope * margin + self.shift))


def train(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, c: float = 1.0, folds: int = 3, least: int = LEAST) -> Fitted:
    """rows: slots of each labelled text, of those in ``held``."""
    up = int((labels > 0).sum())
    if up in (0, len(labels)):
        share = (up + 1) / (len(labels) + 2)
        return Fitted(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), held)
    margins = np.zeros(len(labels))
    fold = np.arange(len(labels)) % folds
    for k in range(folds):
        part = np.flatnonzero(fold != k)
        w, bias = _fit([rows[i] for i in part], labels[part], c, least)
        rest = np.flatnonzero(fold == k)
        margins[rest] = _margins(w, bias, [rows[i] for i in rest])
    slope, shift = fit_sigmoid(margins, labels)
    w, bias = _fit(rows, labels, c, least)
    return Fitted(w.astype(np.float32), float(bias), slope, shift, held)


def labelled_sample(labels: DataFrame, label_col: str, where: Column, max_labelled: int) -> DataFrame:
    """At most max_labelled rows (doc_id, label) of known labels, by the smallest xxhash64 of the id, then the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).where(where)
    one = known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t or "") for t in b.column("text").to_pylist()]
        arrays = [b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "slots"])


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many rows of a part hold each slot."""
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column("slots").to_pylist():
            n[np.frombuffer(x, np.int32)] += 1
    slot = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[slot])], names=["slot", "n"])


def _only(held: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(x := np.frombuffer(v, np.int32))[held[x]].tobytes() for v in b.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(kept, pa.binary())], names=["doc_id", "label", "slots"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", where: Column | None = None,
    max_labelled: int = MAX_LABELLED, max_slots: int = MAX_SLOTS, least: int = LEAST,
) -> Fitted:
    """Fit on the labelled documents among those that ``where`` (over doc_id) admits."""
    sample = labelled_sample(labels, label_col, F.lit(True) if where is None else where, max_labelled)
    # max_labelled rows of two numbers: small enough to broadcast by that bound
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(sample), "doc_id")
    made = rows.select("doc_id", "label", "text").mapInArrow(_slots_of, "doc_id long, label int, slots binary")
    once = materialise(made.groupBy("doc_id", "label").agg(F.min("slots").alias("slots")), "labelled-slots")
    # evidence is counted where the rows are; of slots that too few rows hold, none travels
    counts = once.mapInArrow(_held_by, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    held = np.zeros(BUCKETS, bool)
    held[counts.select("slot").toArrow().column("slot").to_numpy()] = True
    sizes = once.select("doc_id", (F.length("slots") / 4).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over max_labelled rows at most
    some = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= max_slots).select("doc_id")
    got = once.join(F.broadcast(some), "doc_id").mapInArrow(_only(held), "doc_id long, label int, slots binary").toArrow()
    discard(once)
    ids, found, y = (got.column(c).to_pylist() for c in ("doc_id", "slots", "label"))
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    return train([np.frombuffer(found[i], np.int32) for i in order], np.array([y[i] for i in order]), held, least=least)


def _scored(model: Fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(features(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Fitted, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from rows whose id's crc32 mod 3 is not 1, scores all."""
    model = fit(docs, labels, where=id_crc() % 3 != 1)
    held = id_crc() % 3 == 1
    return score(docs, model, threshold).select("doc_id", held.alias("held_out"), "score", "predicted")


def _kept(model: Fitted, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(features(t or "")) >= threshold for t in b.column(text_at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Fitted, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    return docs.mapInArrow(_kept(model, threshold, docs.columns.index(text_col)), docs.schema)
