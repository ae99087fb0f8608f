"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with each run of white space as one space. An item of m characters may differ by up to
k = floor(m * ERROR_RATE) edits. It is cut into k + 1 pieces: any passage within k edits holds one of them unchanged. An
Aho-Corasick automaton finds the pieces in whole texts; around each hit, Myers's bit-parallel algorithm finds the
passages within the budget, nearest first. Every passage within the budget is given or overlaps one that is.

The benchmark is taken in blocks of bounded size, each of which is sent to all rows; documents are not shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, with_mapped

ERROR_RATE = 0.06
#: Characters of items in a block.
BLOCK_CHARACTERS = 400_000
MATCHES = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>"


def normal(text: str) -> str:
    """Lower case, character by character where a lower-case form would be longer; white-space runs as one space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def origins(text: str) -> list[int]:
    """For each character of normal(text) its place in text."""
    found, gap = [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = True
        else:
            if gap and found:
                found.append(i - 1)
            gap = False
            found.append(i)
    return found


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The budget-plus-one pieces of an item with their offsets."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distances(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """After each character of text, the least edit distance of pattern to what ends there: to a passage that may start
    anywhere, or anchored to all of text so far. One big integer holds a column of the distance matrix."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    more, less, score = full, 0, m
    for c in text:
        same = masks.get(c, 0)
        vertical = same | less
        horizontal = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(horizontal | more)), more & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        more, less = down | (full & ~(vertical | up)), up & vertical
        yield score


def nearest(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of text nearest to item, the first of equals; None beyond the budget."""
    best, end = budget + 1, 0
    for i, d in enumerate(distances(item, text, False)):
        if d < best:
            best, end = d, i + 1
    if best > budget:
        return None
    start = end
    for i, d in enumerate(distances(item[::-1], text[max(0, end - len(item) - budget) : end][::-1], True)):
        if d == best:
            start = end - i - 1
            break
    return best, start, end


def passages(item: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of passages of text within the budget that don't overlap, taken nearest first."""
    least = len(item) - budget  # no passage is shorter
    ends = sorted((d, i + 1) for i, d in enumerate(distances(item, text, False)) if d <= budget)
    taken: list[tuple[int, int, int]] = []  # start, end, distance
    for d, end in ends:
        at = bisect_left(taken, (end,))  # those before it start before end
        if at and taken[at - 1][1] > end - least:
            continue
        start = end
        for i, x in enumerate(distances(item[::-1], text[max(0, end - len(item) - budget) : end][::-1], True)):
            if x == d:
                start = end - i - 1
                break
        if not at or taken[at - 1][1] <= start:
            taken.insert(at, (start, end, d))
    found = [(d, a, b) for a, b, d in taken]
    # what is between may hold passages that end as well where a nearer one that overlaps those taken does
    edges = [0, *(x for a, b, _ in taken for x in (a, b)), len(text)]
    for lo, hi in zip(edges[::2], edges[1::2]) if taken else ():
        if any(lo + least <= end <= hi for _, end in ends):
            found += [(d, a + lo, b + lo) for d, a, b in passages(item, text[lo:hi], budget)]
    return found


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(k, normal(t)) for k, t in items]
        self.budgets = [int(len(t) * rate) for _, t in self.items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(self.items):
            if text:
                for offset, piece in pieces(text, rate):
                    at[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece) - 1, places))
        self.any = bool(at)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the passages near each item that text holds, by place."""
        if not text or not self.any:
            return []
        line, windows = normal(text), defaultdict(list)
        for last, (back, places) in self.automaton.iter(line):
            for n, offset in places:
                begin, k = last - back - offset, self.budgets[n]
                end, spans = begin + len(self.items[n][1]) + k, windows[n]
                if spans and begin - k <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                    spans[-1][0] = min(spans[-1][0], begin - k)
                else:
                    spans.append([begin - k, end])
                spans[-1].append(begin)
        found = []
        for n, spans in windows.items():
            item, budget = self.items[n][1], self.budgets[n]
            begins, ends = sorted({b for s in spans for b in s[2:]}), [0]
            for b in begins:
                if b >= ends[-1] and line.startswith(item, b):
                    found.append((self.items[n][0], b, b + len(item), 0))
                    ends += [b, b + len(item)]
            ends.append(len(line))
            # around what is held word for word, where there are hits
            for lo, hi in zip(ends[::2], ends[1::2]):
                for a, b in _joined(begins, budget, len(item), lo, hi):
                    found += [(self.items[n][0], x + a, y + a, d) for d, x, y in passages(item, line[a:b], budget)]
        if found:
            place = origins(text)
            found = [(k, place[a], place[b - 1] + 1 if b > a else place[a], d) for k, a, b, d in found]
        return sorted(found, key=lambda m: (m[1], m[2], m[0]))


def _joined(begins: list[int], budget: int, size: int, lo: int, hi: int) -> list[list[int]]:
    """The windows of hits, joined where they overlap, within lo and hi; those that are too short for an item are left out."""
    joined: list[list[int]] = []
    for b in begins[bisect_left(begins, lo - budget) : bisect_right(begins, hi - size + 2 * budget)]:
        if joined and b - budget <= joined[-1][1]:
            joined[-1][1] = b + size + budget
        else:
            joined.append([b - budget, b + size + budget])
    cut = [[max(lo, a), min(hi, b)] for a, b in joined]
    return [[a, b] for a, b in cut if b - a >= size - budget]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", to: str = "matches", rate: float = ERROR_RATE) -> DataFrame:
    """docs with the benchmark items (item_id, text) that each row's text holds, as array<struct<item_id,start,end,distance>>.

    Places are code points of the text as it is, end exclusive; of each item all passages within the
    budget are given, of those that overlap the nearest. Null and empty texts and items match nothing; repeated items are searched once, and rows of an item_id with several texts each.
    """
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {to}")
    out = docs.withColumn(to, F.array().cast(MATCHES))
    for block in _blocks(benchmark):
        out = _matched(out, block, text, to, rate)
    return out


def _matched(docs: DataFrame, block: list[tuple[int, str]], text: str, to: str, rate: float) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(block)  # of at most BLOCK_CHARACTERS and one item
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))

    def make():
        matcher = Matcher(items.value, rate)

        def searched(texts: pa.Array) -> list[pa.Array]:
            rows = ([dict(zip(("item_id", "start", "end", "distance"), m)) for m in matcher.find(t.as_py())] for t in texts)
            return [pa.array(list(rows), kind)]

        return searched

    found = unused(docs, "found")
    return with_mapped(docs, text, f"`{found}` {MATCHES}", make).withColumn(to, F.concat(f"`{to}`", f"`{found}`")).drop(found)
