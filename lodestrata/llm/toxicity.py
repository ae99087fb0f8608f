"""Toxicity by a support vector machine over a gapped string kernel, with Nystroem landmarks.

The kernel of two words sums, over all strings of four letters, the products of their weights as subsequences: each
step may skip one character, and a skip multiplies the weight by DECAY, so that an inserted character costs little.
The kernel of two segments (sentences, cut after 24 words) is the sum over their words, and runs of single letters are
one word. Landmarks are words and word beginnings: those that labelled positives prefer, and common ones. Segments are
mapped by K_nm K_mm^(-1/2) and separated by a linear SVM. The label belongs to a document, of which few segments may be
to blame: training repeats with, of each positive document, the segments that score highest.

For scoring, the machine's weights are folded back into one number for each four-letter string, which gives the same
margins without comparing with each landmark. A document's score is a logistic function of its two highest margins.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hashed_sample, with_mapped, written

#: Labelled documents that are learned from: this many with label 1, and twice as many with label 0.
POSITIVES = 600
#: Bytes of a text above which it is not learned from.
TEXT_BYTES = 1 << 16
LANDMARKS, COMMON, LEADS = 48, 24, 300
DECAY = 0.9
SEGMENT_WORDS = 24
ROUNDS = 4
PENALTY = 1e-3
#: Characters that are scored at once.
BLOCK = 1 << 19

GAPS = list(product((1, 2), repeat=3))
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_TOP = 0x250


def _codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 to 26 for a letter without its accents, 27 to 31 for other letters, else 0; white space; ends."""
    code, space, end = np.zeros(_TOP + 5, np.int32), np.zeros(_TOP + 5, bool), np.zeros(_TOP + 5, bool)
    for cp in range(_TOP):
        c = _LEET.get(chr(cp), unicodedata.normalize("NFD", chr(cp).lower())[0])
        if "a" <= c <= "z":
            code[cp] = ord(c) - 96
        elif c.isalpha():
            code[cp] = 27 + cp % 5
        space[cp] = chr(cp).isspace()
        end[cp] = chr(cp) in ".!?"
    code[_TOP:] = 27 + np.arange(5)
    return code, space, end


_CODE, _SPACE, _END = _codes()


class _Fold(dict):
    def __missing__(self, point: int) -> str:
        code = int(_CODE[min(point, _TOP)])
        self[point] = found = chr(96 + code) if 0 < code < 27 else " "
        return found


_FOLD = _Fold()
_ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(n, _ODD, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


class Batch:
    """Texts as one array of letters, with their words and segments, and the occurrences of known four-letter strings."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        points = np.where(points < _TOP, points, _TOP + points % 5)
        self.codes = _CODE[points]
        space = _SPACE[points]
        before = np.concatenate(([True], space[:-1]))
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(space & ~before)
        self.starts = starts
        single = (ends - starts == 1) & (self.codes[starts] > 0)
        near = (starts[1:] - ends[:-1] == 1) & (points[ends[:-1]] != 10)
        follows = np.concatenate(([False], single[1:] & single[:-1] & near)) if len(starts) else np.zeros(0, bool)
        #: For each word its number, or that of the first of its run of single letters.
        self.words = np.maximum.accumulate(np.where(follows, 0, np.arange(len(starts)))) if len(starts) else np.zeros(0, np.int64)
        stop = _END[points[ends - 1]] | (points[ends] == 10)
        stop &= ~np.concatenate((follows[1:], [False])) if len(starts) else stop
        new = np.concatenate(([True], stop[:-1])) if len(starts) else np.zeros(0, bool)
        sentence = np.cumsum(new) - 1
        place = np.arange(len(starts)) - np.flatnonzero(new)[sentence]
        self.segments = np.cumsum(new | ((place % SEGMENT_WORDS == 0) & ~follows)) - 1
        self.ends = ends
        first = np.flatnonzero(np.diff(self.segments, prepend=-1))
        self.documents = np.searchsorted(np.cumsum(sizes), starts[first], "right")

    def once(self, place: np.ndarray) -> np.ndarray:
        """Which of these words, by their places, are the first alike in their segments; a word that is repeated within a
        segment counts once."""
        words = np.unique(place)
        powers = _powers_to(len(self.codes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes.astype(np.uint64) * powers[:-1], dtype=np.uint64)))
        # alike if equal after shifting to one place: the sum times the power that is missing to the end of the texts
        marks = (sums[self.ends[words]] - sums[self.starts[words]]) * powers[len(self.codes) - self.starts[words]]
        _, first = np.unique(np.stack((self.segments[words].astype(np.uint64), marks), axis=1), axis=0, return_index=True)
        keep = np.zeros(len(self.starts), bool)
        keep[words[first]] = True
        return keep[place] | (self.words[place] != place)

    def occurrences(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each occurrence within a word of a string whose entry in known is not -1: word's place, entry, weight."""
        c, n = self.codes, len(self.codes)
        pairs = {g: c[: n - g] * 32 + c[g:] for g in (1, 2)}
        place, entry, weight = [], [], []
        for a, b, d in GAPS:
            m = n - a - b - d
            if m <= 0:
                continue
            got = known[pairs[a][:m] * 1024 + pairs[d][a + b : a + b + m]]
            at = np.flatnonzero(got >= 0)
            w, v = np.searchsorted(self.starts, at, "right") - 1, np.searchsorted(self.starts, at + a + b + d, "right") - 1
            same = self.words[w] == self.words[v]
            place.append(w[same])
            entry.append(got[at[same]])
            weight.append(np.full(int(same.sum()), DECAY ** (a + b + d - 3)))
        if not place:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = np.concatenate(place), np.concatenate(entry), np.concatenate(weight)
        once = self.once(found[0])
        return found[0][once], found[1][once], found[2][once]


def features(word: str) -> dict[int, float]:
    """A word's explicit kernel features: the number of each four-letter subsequence, and its weight."""
    c = _CODE[[min(ord(x), _TOP) for x in word]].tolist()
    found: Counter[int] = Counter()
    for i in range(len(c)):
        for a, b, d in GAPS:
            if i + a + b + d < len(c):
                four = (c[i], c[i + a], c[i + a + b], c[i + a + b + d])
                if all(four):
                    found[((four[0] * 32 + four[1]) * 32 + four[2]) * 32 + four[3]] += DECAY ** (a + b + d - 3)
    return dict(found)


class ToxicityModel:
    """known: index of each four-letter string or -1; weights: one for each index; the logistic function's parameters."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float, logistic: np.ndarray, landmarks: list[str]):
        self.known, self.weights, self.bias, self.logistic, self.landmarks = known, weights, bias, logistic, landmarks

    def margins(self, texts: list[str]) -> np.ndarray:
        """The two highest margins of each text's segments; a text without words has the machine's bias twice."""
        out = np.full((len(texts), 2), self.bias)
        block, size = [], 0
        for k, t in enumerate(texts):
            block.append(k)
            size += len(t)
            if size >= BLOCK or k == len(texts) - 1:
                out[block] = self._margins([texts[i] for i in block])
                block, size = [], 0
        return out

    def _margins(self, texts: list[str]) -> np.ndarray:
        batch, out = Batch(texts), np.full((len(texts), 2), self.bias)
        if not len(batch.documents):
            return out
        place, entry, weight = batch.occurrences(self.known)
        sums = np.bincount(batch.segments[place], weight * self.weights[entry], len(batch.documents)) + self.bias
        order = np.lexsort((-sums, batch.documents))
        docs = batch.documents[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        out[docs[first], 0] = sums[order[first]]
        second = first + 1
        second = second[(second < len(docs)) & ~np.isin(second, first)]
        out[docs[second], 1] = sums[order[second]]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.margins([t or "" for t in texts]).clip(-20, 20) @ self.logistic[:2] + self.logistic[2]
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


def _landmarks(texts: list[str], labels: np.ndarray, n: int, common: int) -> list[str]:
    """Words and word beginnings of 4 to 10 letters: first those that positives have and negatives lack, then common ones.

    Longer beginnings are counted only where their first four letters are among the LEADS that positives prefer most.
    """
    positives, negatives = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def counted(lengths: range, leads: set[str] | None) -> list[Counter[str]]:
        held: list[Counter[str]] = [Counter(), Counter()]
        for text, label in zip(texts, labels):
            found = set()
            for word in set(text.translate(_FOLD).split()):
                if leads is None or word[:4] in leads:
                    found.update(word[:k] for k in lengths if k <= len(word))
            held[int(label)].update(found)
        return held

    def gain(word: str) -> float:
        here, there = held[1][word] / positives, held[0][word] / negatives
        return here * np.log((here + 1e-4) / (there + 1e-4)) if here > there and held[1][word] >= 3 else 0.0

    held = counted(range(4, 5), None)
    usual = [w for w, _ in sorted(held[0].items(), key=lambda x: (-x[1], x[0]))[:common]]
    leads = sorted(held[1], key=lambda w: (-gain(w), w))[:LEADS]
    held = counted(range(4, 11), set(leads))
    picked: list[str] = []
    for word in sorted(held[1], key=lambda w: (-gain(w), -len(w), w)):
        if len(picked) == n or gain(word) <= 0:
            break
        if not any(p.startswith(word) and held[1][word] < 1.5 * held[1][p] or word.startswith(p) for p in picked):
            picked.append(word)
    return picked + [w for w in usual if w not in picked]


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float, start: np.ndarray | None) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps from start; rows without cost don't count."""
    m = z.shape[1] + 1
    w, ridge = np.zeros(m) if start is None else start, penalty * cost.sum() * np.eye(m)
    ridge[-1, -1] *= 1e-3
    for step in range(10):
        gram, right = ridge.copy(), np.zeros(m)
        for lo in range(0, len(z), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            on = (y[part] * (z[part] @ w[:-1] + w[-1]) < 1) & (cost[part] > 0)
            x = np.concatenate([z[part][on], np.ones((on.sum(), 1), z.dtype)], axis=1)
            weighed = x * cost[part][on, None].astype(z.dtype)
            gram += weighed.T @ x
            right += weighed.T @ y[part][on]
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-5:
            break
        w = 0.5 * w + 0.5 * new if step > 5 else new
    return w


def stretched(text: str, seed: int) -> str:
    """text with one more character inside of about half of its words; a pattern of the seed, not of chance."""
    words = text.split(" ")
    for k, word in enumerate(words):
        mark = (seed * 2654435761 + k * 40503) >> 4
        if len(word) > 3 and mark % 2:
            at = 1 + (mark >> 1) % (len(word) - 2)
            words[k] = word[:at] + ".-*_xa"[(mark >> 9) % 6] + word[at:]
    return " ".join(words)


def fit(texts: list[str], labels: list[int], share: float | None = None) -> ToxicityModel:
    """A model of texts with labels 0 or 1. share: how many of all documents have label 1, for calibration."""
    y = np.array(labels, float)
    known = np.full(1 << 20, -1, np.int32)
    if not len(y) or y.min() == y.max():  # nothing to separate: one score for all
        p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return ToxicityModel(known, np.zeros(1), 0.0, np.array([0, 0, np.log(p / (1 - p))]), [])
    words = _landmarks(texts, y, LANDMARKS, COMMON)
    texts = texts + [stretched(t, k) for k, t in enumerate(texts)]
    y = np.concatenate((y, y))
    maps = [features(w) for w in words]
    strings = sorted({f for m in maps for f in m})
    known[strings] = np.arange(len(strings))
    phi = np.zeros((len(strings), len(words)))
    for k, m in enumerate(maps):
        norm = np.sqrt(sum(v * v for v in m.values())) or 1.0
        for f, v in m.items():
            phi[known[f], k] = v / norm
    values, vectors = np.linalg.eigh(phi.T @ phi)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    mapped, owner = [], []
    for at in range(0, len(texts), 100):
        batch = Batch(texts[at : at + 100])
        place, entry, weight = batch.occurrences(known)
        k_nm = np.zeros((len(batch.documents), len(words)))
        by = np.argsort(entry, kind="stable")
        place, entry, weight = place[by], entry[by], weight[by]
        for lo in range(0, len(place), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            np.add.at(k_nm, batch.segments[place[part]], weight[part, None] * phi[entry[part]])
        mapped.append((k_nm @ root).astype(np.float32))
        owner.append(batch.documents + at)
    z, owner = np.concatenate(mapped), np.concatenate(owner)
    del mapped
    sure, w = y[owner] > 0, None
    for _ in range(ROUNDS):
        clean = y[owner] == 0
        cost = (sure / max(1, sure.sum()) + clean / max(1, clean.sum())) * len(z) / 2
        w = _machine(z, np.where(sure, 1.0, -1.0), cost, PENALTY, w)
        got = z @ w[:-1] + w[-1]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, got)
        sure = (y[owner] > 0) & ((got >= best[owner]) | (got > 0.5))
    alpha = root @ w[:-1]
    model = ToxicityModel(known, phi @ alpha, float(w[-1]), np.array([1.0, 0.0, 0.0]), words)
    model.logistic = _logistic(model.margins(texts), y, y.mean() if share is None else share)
    return model


def _logistic(margins: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Slopes and offset of a logistic function; documents are weighted so that share of them have label 1."""
    share = min(max(share, 0.01), 0.99)
    x = np.concatenate([margins.clip(-20, 20), np.ones((len(y), 1))], axis=1)
    cost = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + 1e-2 * len(y) * 1e-2 * np.eye(3), x.T @ (cost * (y - p)) - 1e-4 * len(y) * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> ToxicityModel:
    """A model of docs (doc_id, text) with labels (doc_id, toxic): at most positives rows with label 1 and twice as many
    with label 0, those with the smallest hashes of id and text. Null labels and texts don't count, nor do texts of more
    than TEXT_BYTES, so that what comes to the driver is bounded: rows are drawn from those that have a label and such a text.
    Rows that repeat an id count each, as do equal rows. Of labels that differ for an id, 1 counts."""
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(F.octet_length("text") <= TEXT_BYTES).select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = written(rows.drop("text").join(marked, "doc_id").select("doc_id", "h", "toxic"), "known-labels")
    some = hashed_sample(known.where("toxic = 1"), "toxic", positives).union(hashed_sample(known.where("toxic = 0"), "toxic", 2 * positives))
    chosen = written(some.groupBy("doc_id", "h", "toxic").agg(F.count("*").alias("times")), "labelled")  # 3 * positives rows at most
    share = marked.agg(F.avg("toxic")).first()[0]
    texts = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic", "times").agg(F.min("text").alias("text"))
    found = sorted(((r.doc_id, r.text, r.toxic) for r in texts.toLocalIterator() for _ in range(r.times)), key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in found], [r[2] for r in found], share)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """docs with their toxicity from 0 to 1; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scored(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.scores(texts.to_pylist()), pa.float64())]

    return with_mapped(docs, text, f"`{to}` double", lambda: scored)


def held_out() -> Column:
    """The contract's test rows; a row without a doc_id is none."""
    return fold("doc_id", 5) == 0
