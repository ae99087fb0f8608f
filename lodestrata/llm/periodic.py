"""Runs (maximal periodic stretches) of a text's words, by longest previous factors.

1. A part's texts become one sequence of word numbers, which differ between texts. Doubling names all stretches of 1, 2, 4,
   ... words by their rank among stretches of that length; positions whose stretch is alone drop out. The last ranks are the
   suffix array. Equal names tell the common extension of two places, forward and backward, exactly, in one step for each
   length: the LCP of neighbours and of any other places.
2. The longest previous factor of a position is its longest extension with the nearest earlier positions on either side of
   it in the suffix array. The factors that follow each other are the Lempel-Ziv blocks.
3. A run that is not inside a block touches the end of one. With an exponent of 4 or more it has two periods before or behind
   that boundary. If two are behind it, the period is at most half of the block there. If two are before it, the period is at
   most the length of the block before: else that block would have an earlier copy which is longer. So for each boundary
   and each such period whose next words agree, the extensions in both directions give a run.
4. A run inside a block is a copy of one in the block's earlier occurrence. Runs are kept in buckets by their starts, and
   blocks copied from left to right.

All but the copying is done on arrays of a part of about PART_BYTES; a longer text is a part of its own. What a text takes is
linear in its length, times the logarithm of its longest repeat.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, unused, with_mapped

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Names:
    """The names of all stretches of 2^k words of a sequence; ends has the end of each position's text."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        sizes = np.bincount(ids, minlength=n)
        rank = (np.cumsum(sizes) - sizes)[ids]
        open_ = np.flatnonzero(sizes[ids] > 1)
        self.repeated, self.levels, step = open_, [], 1
        while len(open_):
            self.levels.append(np.append(rank, -1).astype(np.int32 if n < 1 << 31 else np.int64))
            after = open_ + step
            inside = after < ends[open_]
            behind = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            key = rank[open_] * (n + 1) + behind
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            old = rank[open_]
            at = np.arange(len(open_))
            first = np.append(True, key[1:] != key[:-1])
            group = np.append(True, old[1:] != old[:-1])
            new = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[open_] = new
            open_ = open_[~(first & np.append(first[1:], True))]
            step *= 2
        self.rank = rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree (i other than j)."""
        i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, n = i + step, j + step, n + step
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j agree (i other than j)."""
        i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (np.minimum(a, b) >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            i, j, n = i - step, j - step, n + step
        return n


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it; -1 for none. All between an index and its pointer are
    larger, so a pointer at a larger value may be moved on to that value's own."""
    to = np.arange(-1, len(values) - 1)
    moving = np.arange(len(values))
    while len(moving):
        at = to[moving]
        moving = moving[(at >= 0) & (values[at] > values[moving])]
        to[moving] = to[to[moving]]
    return to


def previous_factors(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """The length of each position's longest previous factor, and where that begins."""
    n = len(names.rank)
    length, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = names.repeated[np.argsort(names.rank[names.repeated], kind="stable")]  # the suffix array of what can recur
    before = _smaller_before(order)
    behind = len(order) - 1 - _smaller_before(order[::-1])[::-1]
    for to, there in ((before, before >= 0), (behind, behind < len(order))):
        at, other = order[there], order[to[there]]
        found = names.forward(at, other)
        better = found > length[at]
        length[at[better]], where[at[better]] = found[better], other[better]
    return length, where


def blocks(length: np.ndarray) -> np.ndarray:
    """The starts of the Lempel-Ziv blocks. No factor leaves its text, so texts end with a block."""
    steps, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def _periods(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each entry of most, once for each period from 1 to that entry, and these periods."""
    owner = np.repeat(np.arange(len(most)), most)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1


def _boundary_runs(ids: np.ndarray, firsts: np.ndarray, names: Names, starts: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Distinct (start, end, period) of the runs that touch a block's end or start; firsts has the start of each position's text."""
    owner, p = _periods(sizes // 2)
    b = starts[owner]
    near = ids[b] == ids[b + p]
    b, p = b[near], p[near]
    ahead = names.forward(b, b + p)
    b, p, ahead = (x[ahead >= p] for x in (b, p, ahead))
    found = [(b - names.backward(b, b + p), b + p + ahead, p)]

    ends = starts + sizes
    owner, p = _periods(np.minimum(sizes, (ends - firsts[starts]) // 2))
    b = ends[owner]
    near = ids[b - 1] == ids[b - 1 - p]
    b, p = b[near], p[near]
    back = names.backward(b, b - p)
    b, p, back = (x[back >= p] for x in (b, p, back))
    found.append((b - p - back, b + names.forward(b, b - p), p))

    start, end, p = (np.concatenate(x) for x in zip(*found))
    long = end - start >= np.maximum(least, exponent * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))  # a run is found with multiples of its period too
    start, end, p = start[order], end[order], p[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    return np.stack([start[new], end[new], p[new]], axis=1)


def find_runs(ids: np.ndarray, firsts: np.ndarray, ends: np.ndarray, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """start, end, period (rows, sorted by start and period) of all runs of a sequence of word numbers (below its length), in which
    firsts and ends are the bounds of each position's text."""
    if exponent < 4:
        raise ValueError("runs of exponents below 4 are not found")
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    names = Names(ids, ends)
    length, where = previous_factors(names)
    starts = blocks(length)
    sizes = np.maximum(length[starts], 1)
    found = _boundary_runs(ids, firsts, names, starts, sizes, least, exponent)
    if not len(found):
        return found
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, p in found.tolist():
        buckets.setdefault(start, []).append((end, p))
    having = np.zeros(len(ids) + 1, bool)  # texts with a run are the only ones with copies of runs
    having[firsts[found[:, 0]]] = True
    some = (sizes >= least + 2) & having[firsts[starts]]
    for start, size, source in zip(starts[some].tolist(), sizes[some].tolist(), where[starts[some]].tolist()):
        by = start - source
        for at in range(source + 1, source + size - least):
            for end, p in buckets.get(at, ()):
                if end < source + size:
                    buckets.setdefault(at + by, []).append((end + by, p))
    return np.array(sorted((start, end, p) for start, ends_ in buckets.items() for end, p in ends_), np.int64)


def _compute(least: int, exponent: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        words: list[bytes] = []
        numbers, firsts, bounds = [], [], [0]
        for text in column.cast(pa.large_binary()).to_pylist():
            own, seen = (text or b"").split(), {}  # at the six ASCII white-space characters
            numbers.append(np.fromiter(map(seen.setdefault, own, count(len(words))), np.int64, len(own)))
            firsts.append(np.full(len(own), len(words)))
            words += own
            bounds.append(len(words))
        edges = np.array(bounds)
        first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        end = np.repeat(edges[1:], np.diff(edges))
        found = find_runs(np.concatenate(numbers) if numbers else first, first, end, least, exponent)
        owners = np.searchsorted(found[:, 0], edges)
        starts = found[:, 0] - (first[found[:, 0]] if len(found) else 0)
        goes = np.zeros(len(words) + 1, np.int64)
        np.add.at(goes, found[:, 0] + found[:, 2], 1)
        np.add.at(goes, found[:, 1], -1)
        stays = np.cumsum(goes) == 0
        kept = [b" ".join(compress(words[a:b], stays[a:b]) if x < y else words[a:b]) for a, b, x, y in zip(bounds, bounds[1:], owners, owners[1:])]
        runs = pa.StructArray.from_arrays([pa.array(x) for x in (starts, found[:, 1] - found[:, 0], found[:, 2])], ["start", "length", "period"])
        return [
            pa.array(np.diff(edges)),
            pa.ListArray.from_arrays(pa.array(owners, pa.int32()), runs),
            pa.array(kept, pa.large_binary()).cast(pa.large_string()),
        ]

    return compute


def with_runs(docs: DataFrame, text: str = "text", least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with n_words, runs and collapsed; with an underscore more if docs has columns of these names.

    Words are what ASCII white space separates, numbered from 0; a null or empty text, or one of white space only, has none. runs
    is array<struct<start,length,period>>, by start and period: stretches with a smallest period of period words, at least
    `least` words and `exponent` (4 or more) periods long, that no word beside them continues. collapsed is the text's words without
    those that any run contains behind its first period, joined by spaces. Every row is treated by itself: repeated rows and null
    ids give the same as others. An empty table gives an empty result.
    """
    names = [unused(docs, c) for c in ("n_words", "runs", "collapsed")]
    cast = docs.withColumn(text, docs[text].cast("string"))
    return with_mapped(cast, text, f"{names[0]} bigint, {names[1]} array<{RUN}>, {names[2]} string", lambda: _compute(least, exponent))


def repeated_words(text: Column, doc_id: Column) -> Column:
    """text, in which of one document in ten, by its id's crc32, the words from some word on are a repeated stretch: what the
    contract's query is made on."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")
    n, h = F.size(words).cast("long"), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    a = g % F.greatest(n, F.lit(1).cast("long"))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null without any."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and sha256 of all runs and of what is left."""
    best = strongest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(listed, "").alias("listed"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
