"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes. A byte costs minus the binary logarithm of its share
among what followed the longest context seen; if it never followed that context it costs the escape probability
(distinct followers over followers plus distinct followers) and is tried in the next shorter one, down to a uniform
choice among 256 bytes. Statistics are frozen after training, so a text's code length is an exact sum over its bytes,
and the language with the shortest code is predicted.

The trees of all languages are one array: nodes stand for the byte strings that any language has seen, and hold the
cost of their last byte in each language. A text is scored by following children for all its bytes at once.
Texts are lower-cased first. Learned from at most ROWS_PER_LANGUAGE whole texts of each language, of BYTES_PER_LANGUAGE bytes
together, or an equal share of BYTES if there are many languages; all languages are learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hashed_sample, sized, with_mapped, written

UNDETERMINED = "und"
#: Whole labelled texts that are learned from, of each language, and their bytes; and the bytes of all languages together.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE, BYTES = 200, 1 << 20, 1 << 26
#: Entries of a table of all children; beyond, children are searched for.
TABLE = 1 << 26
ORDER = 4
#: Bytes times languages that are scored at once.
BLOCK = 1 << 21


class ContextTrees:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        n = len(self.languages)
        data = [[np.frombuffer(t.lower().encode(), np.uint8) for t in texts[k] if t] for k in self.languages]
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *[a for d in data for a in d]]))
        #: Bytes by number; 0 stands for all bytes that no language has seen.
        self.symbols = np.zeros(256, np.int64)
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        # Node 0 stands for "not seen", node 1 for the empty string.
        costs, escapes, children = [np.zeros((2, n))], [np.zeros((2, n))], []
        costs[0][1] = 8.0
        before = np.zeros(1, np.int64)  # the strings of the level above, as numbers
        first, below_level = 2, costs[0]
        coded = [[self.symbols[a] for a in d] for d in data]
        for length in range(1, order + 2):
            counted = [self._count(d, length) for d in coded]
            keys = np.unique(np.concatenate([c[0] for c in counted])) if n else np.zeros(0, np.int64)
            counts = np.zeros((len(keys), n))
            for k, (own, times) in enumerate(counted):
                counts[np.searchsorted(keys, own), k] = times
            parent = np.searchsorted(before, keys // self.width)
            total, kinds = np.zeros((len(before), n)), np.zeros((len(before), n))
            np.add.at(total, parent, counts)
            np.add.at(kinds, parent, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(counts / (total + kinds)[parent])
            shorter = below_level[self._suffix(keys, length, before)] if length > 1 else np.full((len(keys), n), 8.0)
            cost = np.where(counts > 0, known, escape[parent] + shorter)
            escapes[-1][-len(before) :] = escape
            children.append((parent + first - len(before)) * self.width + keys % self.width)
            costs.append(cost)
            escapes.append(np.zeros((len(keys), n)))
            before, below_level, first = keys, cost, first + len(keys)
        #: Of each node but the first two, its parent's number times width, plus its last symbol; rising.
        self.edges = np.concatenate(children)
        self.costs = np.concatenate(costs).astype(np.float32)
        self.escapes = np.concatenate(escapes).astype(np.float32)
        self.inner = first - len(before)
        self.table = None
        if self.inner * self.width <= TABLE:
            self.table = np.zeros(self.inner * self.width, np.int32)
            self.table[self.edges] = np.arange(2, 2 + len(self.edges))

    def children(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node of each parent's string with one more byte; 0 if it was not seen."""
        edge = np.where(parents < self.inner, parents, 0).astype(np.int64) * self.width + codes
        if self.table is not None:
            return self.table[edge]
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, at + 2, 0).astype(np.int32) if len(self.edges) else np.zeros(len(edge), np.int32)

    def _count(self, texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings of length in texts, as numbers, and how often each occurs."""
        found = [np.zeros(0, np.int64)]
        for a in texts:
            if len(a) >= length:
                number = np.zeros(len(a) - length + 1, np.int64)
                for i in range(length):
                    number = number * self.width + a[i : len(a) - length + 1 + i]
                found.append(number)
        return np.unique(np.concatenate(found), return_counts=True)

    def _suffix(self, keys: np.ndarray, length: int, before: np.ndarray) -> np.ndarray:
        return np.searchsorted(before, keys % self.width ** (length - 1))

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return out
        block, size, most = [], 0, max(1, BLOCK // len(self.languages))
        for k, t in enumerate(texts):
            data = t.lower().encode()
            for at in range(0, len(data), most):  # the contexts of a part begin in the part before
                lead = min(at, self.order)
                block.append((k, lead, data[at - lead : at + most]))
                size += len(block[-1][2])
                if size >= most:
                    self._add(block, out)
                    block, size = [], 0
        if block:
            self._add(block, out)
        return out

    def _add(self, block: list[tuple[int, int, bytes]], out: np.ndarray) -> None:
        codes = self.symbols[np.frombuffer(b"".join(b[2] for b in block), np.uint8)]
        sizes = np.array([len(b[2]) for b in block])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # levels[k][i]: the node of the k bytes that end with byte i, 0 if not seen
        levels = [np.ones(len(codes), np.int32)]
        for _ in range(self.order + 1):
            context = np.empty_like(levels[-1])
            context[1:] = levels[-1][:-1]
            context[starts] = 1 if len(levels) == 1 else 0
            levels.append(self.children(context, codes))
        bits = self.costs[levels[-1]]
        todo = np.flatnonzero(levels[-1] == 0)
        first = np.zeros(len(codes), bool)
        first[starts] = True
        for length in range(self.order + 1, 0, -1):  # a string not seen: its context's escape, and a byte less
            if not len(todo):
                break
            if length > 1:
                context = np.where(first[todo], 0, levels[length - 1][todo - 1])
                bits[todo] += self.escapes[context]
                bits[todo] += self.costs[levels[length - 1][todo]]
                todo = todo[levels[length - 1][todo] == 0]
            else:
                bits[todo] += self.escapes[1] + 8.0
        for start, (_, lead, _) in zip(starts, block):
            bits[start : start + lead] = 0
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        np.add.at(out, [b[0] for b in block], sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores: the shortest code's share among all codes taken as probabilities; `und` and 0 if a text
        is null or has no letter, or if no language was learned."""
        spoken = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths([texts[k] for k in spoken])
        if len(spoken):
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
            for k, b, s in zip(spoken, best, share):
                names[k], scores[k] = self.languages[b], float(s)
        return names, scores


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, order: int = ORDER, bytes_per_language: int = BYTES_PER_LANGUAGE) -> ContextTrees:
    """Trees from docs (doc_id, text, lang), of which only rows with a text and a language count.

    Of each language the texts with the smallest hashes are learned from, up to the number of rows and bytes; a text of more
    bytes alone is passed over, but if a language has no other, its smallest text counts with its first characters, as many as
    bytes are allowed. Equal texts of a language count once; doc_ids don't matter, be they repeated or null. No rows, no
    languages.
    """
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))
    sizes = written(rows.groupBy("lang").agg(F.min_by(F.struct("h", "bytes"), F.struct("bytes", "h")).alias("least")), "languages")
    most = min(bytes_per_language, BYTES // max(1, sizes.count()))
    known = rows.where(F.col("bytes") <= most).select("lang", "h", "bytes")
    chosen = hashed_sample(known, "lang", rows_per_language, size="bytes", most=most, once=True).select("lang", "h")
    only = sizes.where(F.col("least.bytes") > most).select("lang", "least.h")
    chosen = written(chosen.union(only), "labelled")
    some = rows.join(sized(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # one of equal ones
    texts: dict[str, list[str]] = {}
    for r in some.select("lang", F.left("text", F.lit(most)).alias("text")).toLocalIterator():  # whole, but for those in only
        texts.setdefault(r.lang, []).append(r.text)
    return ContextTrees({k: sorted(v) for k, v in texts.items()}, order)


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score. Of languages whose codes are equally short, the first by name is
    predicted; a null, empty or letterless text is `und` with a score of 0. Empty tables stay empty."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the rows that were learned from

    def predicted(texts: pa.Array) -> list[pa.Array]:
        langs, scores = model.value.predict(texts.to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return with_mapped(docs, text, f"`{to}` string, `{score}` double", lambda: predicted)


def held_out() -> Column:
    """The contract's test rows; a row without a doc_id is none."""
    return fold("doc_id", 4) == 2
