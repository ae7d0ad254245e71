"""Reading level of each document (problem 7).

Interpolated n-gram models (one to three words) are trained on graded passages, for each border between levels one on the
passages below it and one on those above; the weights of interpolation are those under which held-out passages are likeliest
(expectation-maximisation over the folds). Every word of a document gets its surprisal under all models. The distribution of the
differences over the whole document, for each border its mean, spread and quantiles (QUANTILES), is brought to one number by a
discriminant of these, and isotonic regression maps the number monotonically to the probability of lying above the border. Discriminant
and regression are fitted on passages that the models had not seen (cross-fitting), and so is the choice of how much of the
distribution enters: the mean, mean and spread, or all, whichever tells passages of a left-out fold best (on a tie, the less).
The level is the lowest plus the number of borders that are more likely passed than not.

The training set is small and fixed; at most MAX_SAMPLES graded passages are used, the ones with the smallest ids, and the
models go to the executors with the code. Documents are read once and never shuffled; a worker looks up a text it has just scored.

Defined results: null and blank documents get no level. A document without any word gets the lowest level. Without graded
passages of two levels or more every document gets the one level there is, or 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.llm.memo import Memo

#: Bound of the training set.
MAX_SAMPLES = 20_000
#: Weights of three-word, two-word, one-word and equal probabilities before they are fitted, and rounds of fitting.
WEIGHTS, ROUNDS = (0.3, 0.35, 0.33, 0.02), 30
FOLDS = 5
#: Quantiles of the differences over a document.
QUANTILES = (0.1, 0.5, 0.9)

_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[.,;:?!]")


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers, and the marks that shape sentences; characters that show nothing are left out."""
    if not text.isascii():
        text = _HIDDEN.sub("", text).replace("’", "'")
    return _WORD.findall(text.lower())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of least squares (pool adjacent violators): its positions and its values."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    value, weight, end = [], [], []
    for i, v in enumerate(y):
        value.append(v)
        weight.append(1.0)
        end.append(i)
        while len(value) > 1 and value[-2] >= value[-1]:
            w = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
            weight[-2:] = [w]
            end.pop(-2)
    start = [0, *(e + 1 for e in end[:-1])]
    # Between blocks the function is drawn straight, so that equal numbers always give equal values.
    at = np.array([p for s, e in zip(start, end) for p in (x[s], x[e])])
    return at, np.repeat(value, 2)


class NgramModels:
    """Several interpolated models over one vocabulary, evaluated together."""

    def __init__(self, groups: list[list[list[str]]]):
        """groups: the tokenized texts of each model."""
        words = Counter(w for texts in groups for t in texts for w in t)
        self.ids = {w: i + 1 for i, w in enumerate(sorted(words))}  # 0: unknown
        self.size = v = len(self.ids) + 1
        n = len(groups)
        encoded = [[self.encode([t])[0] for t in texts] for texts in groups]
        self.base = np.zeros((v, n), dtype=np.float32)
        self.weights = np.array(WEIGHTS)
        for m, texts in enumerate(encoded):
            flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
            count = np.bincount(flat, minlength=v)
            self.base[:, m] = count / max(1, count.sum())
        self.tables = []
        for order in (2, 3):
            grams = [np.concatenate([self._grams(t, order) for t in texts]) if texts else np.zeros(0, dtype=np.int64) for texts in encoded]
            every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.int64)
            table = np.zeros((len(every) + 1, n), dtype=np.float32)  # the last row: not met
            for m, g in enumerate(grams):
                seen, count = np.unique(g, return_counts=True)
                history, inverse = np.unique(seen // v, return_inverse=True)
                total = np.bincount(inverse, weights=count, minlength=len(history))
                table[np.searchsorted(every, seen), m] = count / total[inverse]
            self.tables.append((every, table))

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        get = self.ids.get
        return [np.array([get(w, 0) for w in t], dtype=np.int64) for t in texts]

    def _grams(self, ids: np.ndarray, order: int) -> np.ndarray:
        """Keys of the n-grams that end at each word from the order-th on."""
        v = self.size
        return ids[:-1] * v + ids[1:] if order == 2 else (ids[:-2] * v + ids[1:-1]) * v + ids[2:]

    def found(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each order from one word to three, the row of each word in that order's table; the last row where nothing was met."""
        out = [ids]
        for order, (every, _) in zip((2, 3), self.tables):
            at = np.full(len(ids), len(every))
            if len(every) and len(ids) >= order:
                grams = self._grams(ids, order)
                place = np.minimum(np.searchsorted(every, grams), len(every) - 1)
                at[order - 1 :] = np.where(every[place] == grams, place, len(every))
            out.append(at)
        return out

    def surprisals(self, ids: np.ndarray) -> np.ndarray:
        """-log2 p of each word under each model; ids: one text, or texts behind one another with two unknown words before each."""
        one, two, three = self.found(ids)
        w = self.weights.astype(np.float32)
        p = w[2] * self.base[one] + w[3] / self.size
        p += w[1] * self.tables[0][1][two]
        p += w[0] * self.tables[1][1][three]
        return -np.log2(p)

    def parts(self, ids: np.ndarray, model: int) -> np.ndarray:
        """The probabilities of each word by three words, two, one, and equal ones, under a model."""
        one, two, three = self.found(ids)
        return np.stack([self.tables[1][1][three, model], self.tables[0][1][two, model], self.base[one, model], np.full(len(ids), 1 / self.size, np.float32)], 1)


def fit_weights(parts: np.ndarray) -> np.ndarray:
    """The weights of interpolation under which held-out words are likeliest."""
    w = np.array(WEIGHTS)
    for _ in range(ROUNDS if len(parts) else 0):
        share = parts * w
        w = np.maximum((share / share.sum(1, keepdims=True)).mean(0), 1e-4)
        w /= w.sum()
    return w


class Discriminant:
    """The direction in which two sets of rows differ most beside their spread (Fisher's), with a ridge, in the first `used` columns."""

    def __init__(self, x: np.ndarray, above: np.ndarray, used: int):
        self.used, x = used, x[:, :used]
        self.middle, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = (x - self.middle) / self.spread
        sides = [z[above == s] for s in (True, False)]
        within = sum((s - s.mean(0)).T @ (s - s.mean(0)) for s in sides) / len(z)
        self.direction = np.linalg.solve(within + 0.1 * np.eye(x.shape[1]), sides[0].mean(0) - sides[1].mean(0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x[:, : self.used] - self.middle) / self.spread @ self.direction


def best_columns(x: np.ndarray, above: np.ndarray, fold: np.ndarray) -> int:
    """How many columns tell the rows of left-out folds best, by the logarithm of the probability given to the truth."""
    loss = {}
    for used in (1, 2, x.shape[1]):
        given = []
        for f in np.unique(fold):
            rest = fold != f
            if len(set(above[rest].tolist())) == 2:
                side = Discriminant(x[rest], above[rest], used)
                p = np.clip(np.interp(side(x[~rest]), *isotonic(side(x[rest]), above[rest])), 0.01, 0.99)
                given.append(np.log(np.where(above[~rest], p, 1 - p)).sum())
        loss[used] = -round(sum(given), 6)
    return min(loss, key=lambda used: (loss[used], used))


class LevelModel:
    def __init__(self, samples: list[tuple[str, int]]):
        texts, levels = [tokens(t) for t, _ in samples], np.array([n for _, n in samples], dtype=int)
        self.levels = sorted(set(levels.tolist()))
        self.lowest = self.levels[0] if self.levels else 1
        self.borders = self.levels[1:]
        if not self.borders:
            return
        fold = np.arange(len(texts)) % FOLDS
        folds = [f for f in range(FOLDS) if (fold == f).any() and len(set(levels[fold != f].tolist())) > 1]
        models = {f: self._train([t for t, x in zip(texts, fold) if x != f], levels[fold != f]) for f in folds}
        parts = [np.zeros((0, 4), np.float32)]
        for f, model in models.items():
            for ids, level in zip(model.encode([t for t, x in zip(texts, fold) if x == f]), levels[fold == f]):
                # A passage is held out from the models of its own side of each border.
                parts += [model.parts(ids, 2 * i + int(level >= border)) for i, border in enumerate(self.borders) if len(ids)]
        self.weights = fit_weights(np.concatenate(parts))
        held = np.zeros((len(texts), len(self.borders), 2 + len(QUANTILES)))
        for f, model in models.items():
            model.weights = self.weights
            held[fold == f] = self._shapes(model, [t for t, x in zip(texts, fold) if x == f])
        self.sides = [Discriminant(held[:, b], levels >= border, best_columns(held[:, b], levels >= border, fold)) for b, border in enumerate(self.borders)]
        self.curves = [isotonic(side(held[:, b]), levels >= border) for b, (side, border) in enumerate(zip(self.sides, self.borders))]
        self.models = self._train(texts, levels)
        self.models.weights = self.weights
        self.held_out = float((self._levels(self._above(held)) == levels).mean())

    def _train(self, texts: list[list[str]], levels: np.ndarray) -> NgramModels:
        sides = [side for b in self.borders for side in (levels < b, levels >= b)]
        return NgramModels([[t for t, s in zip(texts, side) if s] for side in sides])

    @staticmethod
    def _shapes(models: NgramModels, texts: list[list[str]]) -> np.ndarray:
        """[text, border, (mean, spread, quantiles)] over each whole text of the surprisal below a border less the one above it."""
        n = len(models.base[0]) // 2
        out = np.zeros((len(texts), n, 2 + len(QUANTILES)))
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum():
            return out
        parts = []
        for ids in models.encode(texts):
            parts += [np.zeros(2, dtype=np.int64), ids]
        s = models.surprisals(np.concatenate(parts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        starts = np.cumsum(lengths) - lengths
        diff = (s[:, 0::2] - s[:, 1::2])[np.arange(len(owner)) + 2 * (owner + 1)].astype(np.float64)
        some, size = lengths > 0, np.maximum(lengths, 1)
        for b in range(n):
            d = diff[:, b]
            mean = np.bincount(owner, weights=d, minlength=len(texts)) / size
            out[:, b, 0] = mean
            out[:, b, 1] = np.sqrt(np.maximum(np.bincount(owner, weights=d * d, minlength=len(texts)) / size - mean**2, 0))
            ranked = d[np.lexsort((d, owner))]
            for q, share in enumerate(QUANTILES):
                out[some, b, 2 + q] = ranked[starts[some] + (share * (lengths[some] - 1)).astype(np.int64)]
        return out

    def _above(self, shapes: np.ndarray) -> np.ndarray:
        """The probability of lying above each border."""
        return np.stack([np.interp(side(shapes[:, b]), x, y) for b, (side, (x, y)) in enumerate(zip(self.sides, self.curves))], 1)

    def _levels(self, above: np.ndarray) -> np.ndarray:
        return np.array(self.levels)[(above >= 0.5).sum(1)]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The level of each text, and its difficulty: the expected level according to the curves."""
        if not self.borders:
            return np.full(len(texts), self.lowest), np.full(len(texts), float(self.lowest))
        words = [tokens(t) for t in texts]
        above = self._above(self._shapes(self.models, words))
        empty = np.array([not any(x[0].isalnum() for x in w) for w in words], dtype=bool)
        steps = np.diff(self.levels)
        level = np.where(empty, self.lowest, self._levels(above)) if len(texts) else np.zeros(0, dtype=int)
        return level, np.where(empty, self.lowest, self.lowest + above @ steps)


def train(graded: DataFrame, text_col: str = "passage", level_col: str = "level", id_col: str = "sample_id") -> LevelModel:
    rows = graded.where(F.col(text_col).isNotNull() & F.col(level_col).isNotNull()).orderBy(id_col).limit(MAX_SAMPLES)
    return LevelModel([(r[0], int(r[1])) for r in rows.select(text_col, level_col).collect()])


def reading_levels(df: DataFrame, model: LevelModel, id_col: str = "rec_id", text_col: str = "passage") -> DataFrame:
    """(id, level INT, difficulty DOUBLE) of every row whose text is neither null nor blank."""
    kind = dict(df.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Memo()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            here = {t: seen[t] for t in dict.fromkeys(texts) if t in seen}
            fresh = [t for t in dict.fromkeys(texts) if t not in here]
            for at in range(0, len(fresh), 500):
                part = fresh[at : at + 500]
                for t, level, difficulty in zip(part, *(x.tolist() for x in model.score(part))):
                    here[t] = seen[t] = (level, difficulty)
            got = [here[t] for t in texts]
            levels, difficulty = pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), levels, difficulty], [id_col, "level", "difficulty"])

    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\s\p{Z}\p{C}]")
    rows = df.where(~blank).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(score, f"`{id_col}` {kind}, level INT, difficulty DOUBLE")
