"""Toxicity: a subsequence string kernel SVM over words, with Nyström landmarks, trained on labelled texts.

The kernel counts common subsequences of three characters that lie within a span of seven, each occurrence weighing
DECAY ** span, over the root of the strings' own summed squared weights. A gap or an inserted character only lowers a
weight, so "lo.s-er" and "loxser" stay near "loser". A text is a bag of words (lower-cased; look-alike digits and signs
read as letters; runs of single characters joined), and toxic if one of its words is. Training is multi-instance: first
the strings (words and their character 5-grams) that most tell toxic from clean training texts point out a toxic word
in each toxic text; they and frequent clean words are the landmarks. A linear SVM on the Nyström features K(x, L)
K(L, L)^-1/2 learns toxic words against clean ones, then the highest scoring word of each text is chosen anew, some
rounds. Being linear in the kernel, the result is one weight for each triple of characters. Two logistic
fits on training texts, on a text's highest margin and on its second and the number of words above 0, give the score.

The training texts are a sample of at most `sample` labelled rows (by a hash of the id, toxic and clean halves apart).
Null and empty texts have no word and take the score of a text with the lowest margin. Without labels of both kinds
every score is 0. One row out for each row in; repeated rows are repeated; null ids are kept. Whole texts are read when they
are scored, very long words in overlapping parts; training reads the first _LONGEST_WORD characters of a word. A labelled id
that repeats counts once, with its smallest text and its highest label. Ties between strings, words and margins go by the
string. A column of the input that has the score's name is replaced by it; others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, crc_mod, sample_by_id, slices, table

SAMPLE = 2000  # of each class
DECAY, SPAN = 0.7, 7
LANDMARKS = 160
# Bounds of the fit, whatever the sample: strings that may become witnesses, frequent and other clean words, toxic words.
_STRINGS, _FREQUENT, _RARE, _TOXIC = 5000, 2000, 3000, 3000
ROUNDS = 3
THRESHOLD = 0.7
_ALPHABET = 64
_CACHE = 250_000
_LONGEST_WORD = 48
_LOOKALIKE = dict(zip("013457@$!", "oieastasi", strict=True))
_SINGLES = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")
_TRIPLES = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def words_of(text: str) -> list[str]:
    """Lower-cased words; runs of three or more single characters are one word."""
    text = text.lower()
    out = text.split()
    if out and sum(len(w) == 1 for w in out) >= 3:
        out += ["".join(m[0].split()) for m in _SINGLES.finditer(text)]
    return out


class _Codes(dict):
    """0 for what isn't a letter and matches nothing; letters of a to z have 1 to 26, others 27 to 63 by their number."""

    def __missing__(self, number: int) -> int:
        c = _LOOKALIKE.get(chr(number), chr(number))
        self[number] = ord(c) - 96 if "a" <= c <= "z" else 27 + number % 37 if c.isalpha() else 0
        return self[number]


_CODES = _Codes()


def _windows(word: str) -> list[bytes]:
    """Codes of a word's characters; a very long word is read in overlapping parts."""
    codes = word.translate(_CODES).encode("latin-1").strip(b"\0")
    step = _LONGEST_WORD - SPAN
    return [codes[i : i + _LONGEST_WORD] for i in range(0, max(1, len(codes) - SPAN), step)] if len(codes) > _LONGEST_WORD else [codes]


def _grid(parts: list[bytes]) -> np.ndarray:
    width = max([SPAN, *map(len, parts)]) + SPAN
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width).astype(np.int32)


def _occurrences(grid: np.ndarray):
    """For each gap pattern the triples' numbers (0: none) at all places, and the weight."""
    n = grid.shape[1] - SPAN + 1
    for j, k in _TRIPLES:
        a, b, c = grid[:, :n], grid[:, j : j + n], grid[:, k : k + n]
        yield np.where((a > 0) & (b > 0) & (c > 0), (a * _ALPHABET + b) * _ALPHABET + c, 0), DECAY ** (k + 1)


def phi(words: list[str], columns: np.ndarray) -> np.ndarray:
    """The kernel's feature vectors of words (their first _LONGEST_WORD characters): occurrence weights by triple, over the
    root of the summed squares. columns: the place of each triple in the result, or -1."""
    out = np.zeros((len(words), int(columns.max()) + 1))
    grid = _grid([_windows(w)[0] for w in words])
    norm = np.zeros(len(words))
    for codes, weight in _occurrences(grid):
        norm += weight * weight * (codes > 0).sum(1)
        at = np.where(codes > 0, columns[codes], -1)
        rows, places = np.nonzero(at >= 0)
        np.add.at(out, (rows, at[rows, places]), weight)
    return out / np.sqrt(np.maximum(norm, 1e-9))[:, None]


def _columns(words: list[str]) -> np.ndarray:
    """Places for all triples of these words."""
    there = np.zeros(_ALPHABET**3, bool)
    for codes, _ in _occurrences(_grid([_windows(w)[0] for w in words])):
        there[codes] = True
    there[0] = False
    return np.where(there, np.cumsum(there) - 1, -1)


class Model:
    """Weights by triple, and the logistic fit. Margins of words are kept, bounded in number."""

    def __init__(self, weights: np.ndarray | None, bias: float, logistic: tuple[np.ndarray, np.ndarray] | None = None):
        self.weights, self.bias, self.logistic, self.known = weights, bias, logistic, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [_windows(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        flat = [p for own in parts for p in own]
        out = np.full(len(words), self.bias)
        lengths = np.array([len(p) for p in flat])
        for low, high in ((3, 6), (6, 8), (8, 10), (10, 13), (13, 17), (17, 24), (24, 1 << 30)):
            own = np.flatnonzero((lengths >= low) & (lengths < high))
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                grid = _grid([flat[i] for i in some])
                total, norm = np.zeros(len(some)), np.zeros(len(some))
                for codes, weight in _occurrences(grid):
                    total += weight * self.weights[codes].sum(1)
                    norm += weight * weight * (codes > 0).sum(1)
                got = self.bias + np.divide(total, np.sqrt(norm), out=np.zeros_like(total), where=norm > 0)
                np.maximum.at(out, owner[some], got)
        return out

    def look_up(self, texts: list[list[str]]) -> None:
        if len(self.known) > _CACHE:  # only between slices: what a slice looks up stays until it is scored
            self.known.clear()
        new = list({w for words in texts for w in words if w not in self.known})
        if new:
            self.known.update(zip(new, self.margins(new).tolist(), strict=True))

    def features(self, words: list[str]) -> tuple[float, float, float]:
        """The two highest margins of different words (each from -1.5 to 1), and the log of the number of words above 0."""
        if not words:
            return -1.5, -1.5, 0.0
        known = self.known
        best = sorted(known[w] for w in set(words))[-2:]
        return min(1.0, max(best[-1], -1.5)), min(1.0, max(best[0], -1.5)), math.log1p(sum(known[w] > 0 for w in words)) if best[-1] > 0 else 0.0

    def score_of(self, x: np.ndarray) -> np.ndarray:
        """The larger of two logistic fits: on the highest margin, and on the second and the number of words."""
        ones = np.ones((len(x), 1))
        z = np.maximum(np.hstack([x[:, :1], ones]) @ self.logistic[0], np.hstack([x[:, 1:], ones]) @ self.logistic[1])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        bags = [words_of(t) for t in texts]
        self.look_up(bags)
        x = np.array([self.features(b) for b in bags]).reshape(-1, 3)
        return self.score_of(x)


def _strings(words: set[str]) -> set[str]:
    return {g for w in words for g in (w, *(w[i : i + 5] for i in range(len(w) - 4))) if len(g) >= 3}


def _witnesses(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """A few strings (words and character 5-grams) that nearly only toxic texts hold; each next one is in the most texts
    that hold fewer than three of those before."""
    bags = [_strings(words) for words in toxic]
    inside = Counter(s for b in bags for s in b)
    least = 2 if len(toxic) < 200 else 3
    inside = {s: n for s, n in inside.items() if n >= least}
    outside = Counter()
    for words in clean:
        outside.update(inside.keys() & _strings(words))
    odds = {s: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((outside[s] + 0.5) / (len(clean) + 1)) for s, n in inside.items()}
    holds: dict[str, list[int]] = {s: [] for s in sorted(odds, key=lambda s: (-odds[s], s)) if odds[s] > 2 and outside[s] <= inside[s] / 20}
    for i, b in enumerate(bags):
        for s in b & holds.keys():
            holds[s].append(i)
    holds = {s: np.array(own) for s, own in sorted(holds.items(), key=lambda x: (-len(x[1]), -len(x[0]), x[0]))[:_STRINGS]}
    need, chosen = np.full(len(toxic), 3), []
    while holds and len(chosen) < most:
        s = max(holds, key=lambda s: ((need[holds[s]] > 0).sum(), len(s), s))
        if (need[holds[s]] > 0).sum() < least:
            break
        need[holds[s]] -= 1
        chosen.append(s)
        holds = {t: own for t, own in holds.items() if t not in s and s not in t and (need[own] > 0).sum() >= least}
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps; the last column of x is the bias, which isn't shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6

    def loss(w):
        return 0.5 * w @ ridge @ w + cost * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        own = slack > 0
        gradient = ridge @ w - 2 * cost * (x[own].T @ (weight * y * slack)[own])
        step = np.linalg.solve(ridge + 2 * cost * (x[own].T * weight[own]) @ x[own], gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of features, none below 0 (those that would be are left out), and last the constant."""
    own = list(range(x.shape[1]))
    while True:
        w = np.zeros(len(own))
        z = x[:, own]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
            w += np.clip(step, -5, 5)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[own] = w
            return out
        own.pop(int(w[:-1].argmin()))


def fit(texts: list[str], labels: list[int]) -> Model:
    bags = [words_of(t) for t in texts]
    sets = [set(b) for b in bags]
    toxic = [s for s, y in zip(sets, labels, strict=True) if y]
    clean = [s for s, y in zip(sets, labels, strict=True) if not y]
    if not toxic or not clean:
        return Model(None, 0.0)
    chosen = _witnesses(toxic, clean, LANDMARKS // 2)
    common = Counter(w for s in clean for w in s if len(w) >= 3)
    frequent = sorted(common, key=lambda w: (-common[w], w))
    half = LANDMARKS // 4
    landmarks = chosen + frequent[:half] + frequent[half :: max(1, len(frequent) // half)][:half]
    columns = _columns(landmarks)
    triples = np.flatnonzero(columns >= 0)
    land = phi(landmarks, columns)
    values, basis = np.linalg.eigh(land @ land.T)
    root = (basis / np.sqrt(np.maximum(values, 1e-2))) @ basis.T

    def features(words):
        return np.concatenate([np.concatenate([phi(words[i : i + 512], columns) @ land.T @ root for i in range(0, len(words), 512)]), np.ones((len(words), 1))], 1)

    rng = np.random.default_rng(7)
    witness = [{w for w in s if w not in common and any(c in w for c in chosen)} for s in toxic]
    rare = sorted(common)
    negative = set(frequent[:_FREQUENT]) | {rare[i] for i in rng.choice(len(rare), min(_RARE, len(rare)), replace=False)}
    model = Model(None, 0.0)
    for _ in range(ROUNDS):
        # each toxic text has one vote, shared by its witnesses
        votes = Counter()
        for own in witness:
            for w in own:
                votes[w] += 1 / len(own)
        pos, neg = [w for w, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:_TOXIC]], sorted(negative)
        if not pos:
            return Model(None, 0.0)
        weight = np.array([max(0.2, votes[w]) for w in pos])
        weight = np.concatenate([weight / weight.sum(), np.full(len(neg), 1 / len(neg))]) * 2000
        w = _svm(features(pos + neg), np.array([1.0] * len(pos) + [-1.0] * len(neg)), weight)
        weights = np.zeros(_ALPHABET**3)
        weights[triples] = (root @ w[:-1]) @ land
        model = Model(weights, float(w[-1]))
        model.look_up(sets)
        # the highest scoring words of each text: of toxic ones witnesses, of clean ones counterexamples
        for k, s in enumerate(toxic):
            top = max((w for w in s if w not in common), key=lambda v: (model.known[v], v), default=None)
            witness[k] = {w for w in witness[k] if model.known[w] > -1} | ({top} if top and model.known[top] > -0.5 else set())
        negative |= {t for s in clean if (t := max(s, key=lambda v: (model.known[v], v), default=None)) and model.known[t] > -1}
    model.look_up(sets)
    x, y = np.array([model.features(b) for b in bags]), np.array(labels, float)
    ones = np.ones((len(x), 1))
    model.logistic = tuple(_logistic(np.hstack([own, ones]), y) for own in (x[:, :1], x[:, 1:]))
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """From at most about `sample` labelled texts of each class."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [sample_by_id(marked.filter(F.col("y") == y), "id", sample) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    # at most 2 * sample ids: bounded by the parameter
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    # rows that repeat an id give one text, so that no more texts than ids come to the driver
    rows = own.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: r.id)
    return fit([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns, with the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c != score_col]
    schema = docs.drop(score_col).schema.add(score_col, "double")

    def run(batches):
        for batch in slices(batches, 64):
            got = sent.value.scores(as_strings(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(got, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    out = score(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
