"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

A text is judged by its units: words, lower-cased, letters and digits alone, and runs of words of one or two characters
joined, so an insult spelled with blanks or marks between its letters is still one unit. The kernel between two units
counts common subsequences of three characters, each weighed by a decay for every character its two spans cover, so
gaps and inserted characters lower a match and don't end it; it is normalised and squared, which is a kernel again and
keeps many faint matches from adding up to one. Landmarks are units that set the classes apart in the labelled
documents beyond chance, some of their copies with inserted characters, frequent harmless units and, after each round,
the harmless ones that came closest; the Nyström map sends a unit to the span of the landmarks, where a linear model is
fitted under the squared hinge loss, by Newton steps.

Labels are given by document, and the sentences of a document carry its label: so every round scores all units of all
labelled documents; harmless ones near the boundary join the examples, and so does the strongest unit of each toxic
document. Toxic examples are joined by copies with letters and digits inserted at every place, so that the model learns
the gaps that an insult may have; the logistic curve of the scores is fitted on documents and on fresh copies. A text
scores by its strongest unit.

The model learns from at most ``max_labelled`` labelled rows; ``max_units`` bounds the first examples, to which the rounds
add from all labelled documents; both are parameters. Scores cover every unit of every whole text; units longer than 24
characters are scored by overlapping windows. Units whose kernel with every toxic landmark is provably under ``NEAR``
get the margin of a harmless example without further sums; that is part of the model, in fitting and scoring alike.

Defined cases: null texts count as empty; texts without units score by the curve at the lowest margin; labels that are
null or not 0/1 are ignored; repeated label rows of one document count once, the smaller label holding; with no labels,
or labels of one class, every score is that class's smoothed share; ties between units are settled by the unit; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, id_crc, materialise, worker_cache
from tessera.llm.linear_svm import fit_primal, fit_sigmoid, sigmoid
from tessera.llm.quality_nbsvm import labelled_sample

MAX_LABELLED = 20_000
MAX_UNITS = 40_000
TOXIC_LANDMARKS, COPIED_LANDMARKS, CLEAN_LANDMARKS = 40, 20, 60
CORE = 25  # units whose every place gets copies with inserted characters
DECAY = 0.8
POWER = 2
NEAR, FAR = 0.4, -1.0  # a kernel below NEAR with every toxic landmark gives the margin FAR
LONGEST = 24
CACHE = 400_000
ROUNDS = 4
COST = 2.0
TOP = 4  # units of each labelled document that a round looks at
HARD = -0.5  # margin from which a harmless unit joins the examples
PRECISE = 0.8  # least share of toxic documents among those that hold a telling unit
SURE = 4.0  # a unit tells the classes apart if its log-likelihood gain beats chance among all units by this much
INSERTED = "abcdefghijklmnopqrstuvwxyz0123456789"
_JUNK = re.compile(r"[\W_]+")
_SHORT = re.compile(r"(?<!\S)\S{1,2}(?:[^\S\n]+\S{1,2}(?!\S))+")


def _windows(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def units_of(text: str) -> set[str]:
    """Distinct units of a text, three characters at least."""
    low = text.lower()
    words = set(low.split())
    out = {w for w in words if w.isalnum()}
    out.update(_JUNK.sub("", w) for w in words.difference(out))
    # runs of very short words: the whole run, as one unit
    for m in _SHORT.finditer(low):
        joined = _JUNK.sub("", m[0])
        if len(joined) >= 3:
            out.add(joined)
    return {w for u in out if len(u) >= 3 for w in _windows(u)}


def _alphabet(units: list[str]) -> np.ndarray:
    return np.unique(np.array([ord(c) for u in units for c in u], np.int32))


def _spans(n: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of every subsequence of three characters of a unit of n, and its weight."""
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    some = (i < j) & (j < k)
    i, j, k = i[some], j[some], k[some]
    return i, j, k, decay ** (k - i + 1.0)


def _coded(units: list[str], alphabet: np.ndarray, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of units of one length, their subsequences' codes, 0 for characters off the alphabet, and weights)."""
    size = len(alphabet) + 1
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(lengths[lengths >= 3]):
        i, j, k, weight = _spans(int(n), decay)
        every = np.flatnonzero(lengths == n)
        step = max(1, 400_000 // len(i))
        for at in range(0, len(every), step):
            some = every[at : at + step]
            raw = np.frombuffer("".join([units[x] for x in some]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(some), n)
            place = np.minimum(np.searchsorted(alphabet, raw), len(alphabet) - 1)
            known = np.where(alphabet[place] == raw, place + 1, 0)
            x, y, z = known[:, i], known[:, j], known[:, k]
            code = (x * size + y) * size + z
            code[(x == 0) | (y == 0) | (z == 0)] = 0
            yield some, code, weight


class Index:
    """Landmarks by their subsequences, for kernels of many units against them."""

    def __init__(self, landmarks: list[str], decay: float = DECAY):
        self.decay, self.alphabet = decay, _alphabet(landmarks)
        found = list(_coded(landmarks, self.alphabet, decay))
        codes = np.unique(np.concatenate([c.ravel() for _, c, _ in found]))
        self.column = np.full((len(self.alphabet) + 1) ** 3, -1, np.int32)
        self.column[codes] = np.arange(len(codes))
        self.right = np.zeros((len(landmarks), len(codes)))
        for some, code, weight in found:
            for row, line in zip(some, code, strict=True):
                self.right[row] += np.bincount(self.column[line], weight, minlength=len(codes))

    def kernel(self, units: list[str], kind=np.float64) -> np.ndarray:
        """Kernels of units with all landmarks; kind: of the numbers in its sums."""
        size, out = self.right.shape[1], np.zeros((len(units), len(self.right)), kind)
        right = np.ascontiguousarray(self.right.T, kind)
        for some, code, weight in _coded(units, self.alphabet, self.decay):
            for at in range(0, len(some), 128):
                got = self.column[code[at : at + 128]]
                got[code[at : at + 128] == 0] = -1
                row, where = np.nonzero(got >= 0)
                left = np.bincount(row * size + got[row, where], weight[where], minlength=len(got) * size)
                out[some[at : at + 128]] = left.reshape(len(got), size).astype(kind, copy=False) @ right
        return out


def kernel(units: list[str], landmarks: list[str], decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of length three between units and landmarks, not normalised."""
    return Index(landmarks, decay).kernel(units)


def self_kernel(units: list[str], decay: float = DECAY) -> np.ndarray:
    out = np.zeros(len(units), np.float32)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(lengths):
        every = np.flatnonzero(lengths == n)
        power = np.arange(n)[None, :] - np.arange(n)[:, None]
        scan = np.where(power >= 0, decay ** np.maximum(power, 0), 0.0).astype(np.float32)
        for k in range(0, len(every), 8192):
            some = every[k : k + 8192]
            code = np.array([[ord(c) for c in units[i]] for i in some], np.int32)
            one = np.zeros((len(some), n), np.float32)
            two = np.zeros((len(some), n), np.float32)
            total = np.zeros(len(some), np.float32)
            for i in range(n):
                hit = (code[:, i, None] == code).astype(np.float32)
                total += decay * decay * (hit[:, 1:] * two[:, :-1]).sum(axis=1)
                add = np.zeros((len(some), n), np.float32)
                add[:, 1:] = decay * decay * hit[:, 1:] * one[:, :-1]
                two = decay * two + add @ scan
                one = decay * one + (decay * decay * hit) @ scan
            out[some] = total
    return np.maximum(out, 1e-12)


@dataclass
class Model:
    """A fitted model: weights beta over the squared normalised kernels with the landmarks, and bounds that spare most
    units the sums. groups: for each toxic landmark and its copies, the largest weight of every subsequence."""

    index: Index
    norms: np.ndarray
    beta: np.ndarray
    bias: float
    groups: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    floor: float = 0.0  # margin of a text without units

    def _near(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of units whose kernel with some toxic landmark may reach NEAR, and their norms. A norm is at least that
        of the subsequences taken one by one, so most units are told off before their own norm is summed."""
        found, norms = [np.zeros(0, np.int64)], [np.zeros(0)]
        table = self.groups.max(axis=1) if self.groups.shape[1] else None
        for some, code, weight in _coded(units, self.index.alphabet, DECAY) if table is not None else ():
            got = self.index.column[code]  # -1, the last row of groups, is zero
            weight = weight.astype(np.float32)
            raw = table[got] @ weight
            hot = np.flatnonzero(raw >= NEAR * np.sqrt((weight * weight).sum()))
            if not len(hot):
                continue
            norm = np.sqrt(self_kernel([units[i] for i in some[hot]]))
            hot, norm = hot[raw[hot] >= NEAR * norm], norm[raw[hot] >= NEAR * norm]
            for at in range(0, len(hot), 1024):
                part, own = hot[at : at + 1024], norm[at : at + 1024]
                bound = np.zeros((len(part), self.groups.shape[1]), np.float32)
                for t in range(len(weight)):
                    bound += weight[t] * self.groups[got[part, t]]
                keep = bound.max(axis=1) >= NEAR * own
                found.append(some[part[keep]])
                norms.append(own[keep])
        return np.concatenate(found), np.concatenate(norms)

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), FAR if len(self.beta) else 0.0)
        if units and len(self.beta):
            near, norm = self._near(units)
            if len(near):
                k = self.index.kernel([units[i] for i in near]) / (norm[:, None] * self.norms[None, :])
                out[near] = np.maximum(k, 0.0) ** POWER @ self.beta + self.bias
        return out

    def curve(self, margin: float) -> float:
        return float(sigmoid(self.slope * squash(margin) + self.shift))


def squash(margin):
    """Margins beyond one count by their logarithm, so that a mislabelled document can't flatten the curve."""
    return np.where(np.asarray(margin) > 1, 1 + 0.25 * np.log(np.maximum(margin, 1)), margin)


def constant(share: float) -> Model:
    none = np.zeros(0)
    return Model(Index(["aaa"]), none, none, 0.0, np.zeros((2, 0), np.float32), 1.0, float(np.log(share / (1 - share))))


def strongest(model: Model, texts: list[str | None], top: int = 1) -> list[list[tuple[float, str]]]:
    """The top (margin, unit) of each text, strongest first; one entry of the floor for a text without units."""
    stamp = zlib.crc32(model.beta.tobytes())
    out = []
    for i in range(0, len(texts), 128):
        found = [units_of(t or "") for t in texts[i : i + 128]]
        known = worker_cache(f"margins {stamp}", CACHE)
        new = list(set().union(*found).difference(known))
        known.update(zip(new, model.margins(new).tolist(), strict=True))
        for units in found:
            if not units:
                out.append([(model.floor, "")])
            elif top == 1:
                best = max(map(known.__getitem__, units))
                out.append([(best, min(u for u in units if known[u] == best))])
            else:
                out.append(sorted(((known[u], u) for u in units), key=lambda x: (-x[0], x[1]))[:top])
    return out


def _gapped(unit: str, seed: int, each: int = 1) -> list[str]:
    """Copies of a unit with a character inserted at every inner place, ``each`` times, and some with two."""
    rng = np.random.default_rng(seed)
    out = []
    for at in list(range(1, len(unit))) * each:
        out.append(unit[:at] + INSERTED[rng.integers(len(INSERTED))] + unit[at:])
    for _ in range(2 * each):
        chars = list(unit)
        for at in sorted(rng.integers(1, len(unit), 2).tolist(), reverse=True):
            chars.insert(at, INSERTED[rng.integers(len(INSERTED))])
        out.append("".join(chars))
    return out


def _solve(landmarks: dict[str, int], units: list[str], labels: np.ndarray, cost: np.ndarray) -> Model:
    """Nyström features of units over landmarks (with their group, -1 for harmless ones), and the linear model on them."""
    names = list(landmarks)
    index, norms = Index(names), np.sqrt(self_kernel(names))

    def sharp(some: list[str]) -> np.ndarray:
        return np.maximum(index.kernel(some, np.float32) / (np.sqrt(self_kernel(some))[:, None] * norms[None, :]), 0.0) ** POWER

    gram = sharp(names)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    root32 = root.astype(np.float32)
    features = np.empty((len(units), len(names)), np.float32)  # filled by blocks, to spare the driver's memory
    for i in range(0, len(units), 2048):
        features[i : i + 2048] = sharp(units[i : i + 2048]).astype(np.float32) @ root32
    w, bias = fit_primal(features, labels, cost)
    group = np.array([landmarks[n] for n in names])
    scaled = index.right / norms[:, None]
    bounds = [scaled[group == g].max(axis=0) for g in range(group.max(initial=-1) + 1)]
    table = np.zeros((index.right.shape[1] + 1, len(bounds)), np.float32)
    if bounds:
        table[:-1] = np.stack(bounds, axis=1)
    return Model(index, norms, root @ w, float(bias), table, floor=FAR)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of each document, once each, with its label."""
    for b in batches:
        units, label = [], []
        for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            found = units_of(text or "")
            units += found
            label += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(label, pa.int32())], names=["unit", "label"])


def _best(model: Model, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = strongest(model, b.column("text").to_pylist(), top)
            best = pa.array([x[0][0] for x in found], pa.float64())
            near = [[(m, u) for m, u in x if u and m > HARD] for x in found]
            units = pa.array([[u for _, u in x] for x in near], pa.list_(pa.string()))
            margins = pa.array([[m for m, _ in x] for x in near], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("label"), best, units, margins], names=["label", "margin", "units", "margins"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", where: Column | None = None,
    max_labelled: int = MAX_LABELLED, max_units: int = MAX_UNITS,
) -> Model:
    """Fit on the labelled documents among those that ``where`` (over doc_id) admits."""
    sample = labelled_sample(labels, label_col, F.lit(True) if where is None else where, max_labelled)
    # max_labelled rows of two numbers: small enough to broadcast by that bound
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"])
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    up, down = sizes.get(1, 0), sizes.get(0, 0)
    if not up or not down:
        return constant((up + 1) / (up + down + 2))
    counted = materialise(
        rows.mapInArrow(_units, "unit string, label int").groupBy("unit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "units"
    )
    share = up / (up + down)
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    gain = t * F.log((t + 0.01) / n / share) + c * F.log((c + 0.01) / n / (1 - share))
    least = float(np.log(max(2, counted.count())) + SURE)
    told = counted.withColumn("g", gain).where((t / n >= PRECISE) & (F.col("g") > least)).orderBy(F.desc("g"), "unit").limit(max_units // 4).collect()
    plain = counted.where("t <= c").orderBy(F.desc("c"), "unit").limit(max_units // 8).collect()
    plain += counted.where("t = 0").orderBy(F.xxhash64("unit"), "unit").limit(max_units // 2).collect()
    discard(counted)
    if not told or not plain:
        return constant((up + 1) / (up + down + 2))
    weight = {r["unit"]: float(r["t"]) for r in told}
    against = {r["unit"]: float(r["c"]) for r in plain}
    toxic = list(weight)
    landmarks = {u: i for i, u in enumerate(toxic[:TOXIC_LANDMARKS])}
    for i, u in enumerate(toxic[:COPIED_LANDMARKS]):
        for g in _gapped(u, 1000 + i)[::2]:
            landmarks.setdefault(g, i)
    for u in list(against)[:CLEAN_LANDMARKS]:
        landmarks.setdefault(u, -1)
    core = sorted(weight.values())[-min(len(weight), CORE)]
    for _ in range(ROUNDS):
        positives = sorted(set(weight).difference(against))
        copies = [
            (g, weight[u] / 2) for i, u in enumerate(positives) for g in _gapped(u, i, 6 if weight[u] >= core else 1) if g not in against
        ]
        negatives = sorted(against)
        units = positives + [g for g, _ in copies] + negatives
        y = np.array([1] * (len(units) - len(negatives)) + [0] * len(negatives))
        seen = np.sqrt([weight[u] for u in positives] + [w for _, w in copies] + [against[u] for u in negatives])
        cost = COST * seen * np.where(y > 0, seen[y == 0].sum() / seen[y > 0].sum(), 1.0)
        model = _solve(landmarks, units, y, cost)
        found = rows.mapInArrow(_best(model, TOP), "label int, margin double, units array<string>, margins array<double>").collect()
        close: dict[str, float] = {}
        for r in found:
            if r["label"] == 0:
                for u, m in zip(r["units"], r["margins"], strict=True):
                    against[u] = against.get(u, 0.0) + 1.0
                    close[u] = close.get(u, 0.0) + m - HARD
        for u in sorted(close, key=lambda u: (-close[u], u))[:CLEAN_LANDMARKS]:
            landmarks.setdefault(u, -1)
        for r in found:
            if r["label"] == 1 and r["units"] and r["margin"] > 1 and (u := r["units"][0]) not in against:
                weight.setdefault(u, 1.0)
    margins, y = np.array([r["margin"] for r in found]), np.array([r["label"] for r in found])
    fresh = model.margins([g for i, u in enumerate(sorted(u for u in weight if weight[u] >= core)) for g in _gapped(u, 5000 + i)])[:up]
    model.slope, model.shift = fit_sigmoid(squash(np.concatenate([margins, fresh])), np.concatenate([y, np.ones(len(fresh), int)]))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.curve(x[0][0]) for x in strongest(model, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from rows whose id's crc32 mod 3 is not 1, scores all."""
    model = fit(docs, labels, where=id_crc() % 3 != 1)
    held = id_crc() % 3 == 1
    return score(docs, model, threshold).select("doc_id", held.alias("held_out"), "score", "predicted")
