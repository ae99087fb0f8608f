"""Substring deduplication of paragraphs by MinHash banding.

Paragraphs are taken at two levels with classes of their own: sentences, so that a passage inside of a line lines up wherever
it stands, and whole lines. A line and a sentence inside of it never remove each other; what repeats is the union of both.
Words are compared in lower case (A-Z); paragraphs of fewer than five words are left alone.

Equal paragraphs are one class by a 128-bit BLAKE2b digest of their words. Distinct ones are signed with BANDS bands of ROWS
MinHashes of their five-word shingles: a pair of Jaccard similarity 0.8 shares a band with probability
1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998. Those with fewer than four different shingles, which are similar only if all are the
same, have one band that stands for all. Paragraphs that share a band are linked if the exact Jaccard similarity of their
shingle sets is at least 0.8; connected components are classes. Of each class the first paragraph stays (smallest doc_id,
then place) and the others are removed.

Bands that only one distinct paragraph has never leave the first aggregation. Within a band paragraphs are linked to
their connected group, not in all pairs. A band of more paragraphs, or more shingles, than one task should hold is first
measured against single pivots: see around_pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import connected_components, given_back, lookup, salted, sized_lists, tidy, with_mapped, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 6, 2
#: Levels, as bits: sentences and whole lines. What is both belongs to both.
CUT, WHOLE = 1, 2
#: Paragraphs of a band, and their shingles, that are compared in one task.
CHUNK, CHUNK_SHINGLES = 2000, 500_000
#: Pivots that a larger band is measured against before what is left is compared in pairs of chunks.
PIVOTS = 4
#: Bands that more than one distinct paragraph has, up to which they are broadcast.
BROADCAST_BANDS = 1_000_000
#: Bytes of a word above which it is hashed by XXH64 rather than a polynomial.
LONG_WORD = 64
#: Stands for a null doc_id, which sorts after all others.
NONE = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_SEEDS = _rng.integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_STEPS = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        found = _powers[int(base)] = np.multiply.accumulate(factors)
    return found[:n]


def _range_hash(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for each range, from prefix sums; the same wherever the range stands."""
    powers = _powers_of(base, len(values) + 1)
    back = _powers_of(np.uint64(pow(int(base), -1, 1 << 64)), len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * back[starts]


class Paragraphs:
    """The sentences and lines of several texts, by place: document's number, levels, byte and character ranges, shingles."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        before = np.concatenate(([True], space[:-1]))
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        n = len(starts)
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        last = data[ends - 1]
        stop = (last == 46) | (last == 33) | (last == 63)
        new = np.ones(n, bool)
        new[1:] = (line[1:] != line[:-1]) | stop[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        spans = np.diff(np.append(heads, n))
        pieces = np.add.reduceat(new.astype(np.int64), heads) if n else spans
        levels = np.where(np.repeat(pieces, spans)[first] > 1, CUT, CUT | WHOLE)
        whole = pieces > 1
        first, sizes = np.append(first, heads[whole]), np.append(sizes, spans[whole])
        levels = np.append(levels, np.full(np.count_nonzero(whole), WHOLE))
        by = np.lexsort((levels, first))
        by = by[sizes[by] >= SHINGLE_WORDS]
        self.first, self.sizes, self.levels = first[by], sizes[by], levels[by]
        self.words = _mixed(_range_hash(data.astype(np.uint64) + np.uint64(1), _BASE, starts, ends)) if n else np.zeros(0, np.uint64)
        self._data = data.tobytes()
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            self.words[i] = xxhash.xxh64_intdigest(self._data[starts[i] : ends[i]])
        # words apart by other than one space, summed up
        plain = (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 32) if n else np.zeros(0, bool)
        self._odd = np.concatenate(([0, 0], np.cumsum(~plain))) if n else np.zeros(1, int)
        begin, end = starts[self.first], ends[self.first + self.sizes - 1]
        self._begin, self._end = begin, end
        lengths = np.array([len(r) + 1 for r in raw])
        edges = np.cumsum(lengths)
        self.documents = np.searchsorted(edges, begin, "right")
        heads = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
        origin = np.concatenate(([0], heads[edges[:-1] - 1])) if len(raw) else np.zeros(0, int)
        self.start = heads[begin] - 1 - origin[self.documents]
        self.end = heads[end - 1] - origin[self.documents]

    def keys(self) -> np.ndarray:
        """Two 64-bit numbers for each paragraph: the BLAKE2b digest of its words."""
        odd = self._odd[self.first + self.sizes] > self._odd[self.first + 1]
        digests = []
        for a, b, x in zip(self._begin.tolist(), self._end.tolist(), odd.tolist()):
            part = self._data[a:b]
            digests.append(hashlib.blake2b(b" ".join(part.split()) if x else part, digest_size=16).digest())
        return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all shingles, paragraph after paragraph, and where each paragraph's begin."""
        counts = self.sizes - SHINGLE_WORDS + 1
        offsets = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(self.first, counts)
        total = np.zeros(len(at), np.uint64)
        for k, step in enumerate(_STEPS):
            total += self.words[at + k] * step
        return _mixed(total), offsets

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """The band hashes of all paragraphs, one after another, and where each paragraph's begin."""
        shingles, offsets = self.shingles()
        heads, counts = offsets[:-1], np.diff(offsets)
        few, alike = counts < 4, np.zeros(len(counts), np.uint64)
        for n in (1, 2, 3):
            on = np.flatnonzero(counts == n)
            alike[on] = _set_hash(shingles[heads[on][:, None] + np.arange(n)])
        many = np.flatnonzero(~few)
        front = np.sort(shingles[heads[many][:, None] + np.arange(4)], axis=1) if len(many) else np.zeros((0, 4), np.uint64)
        for i in many[(front[:, 1:] == front[:, :-1]).any(axis=1)]:  # words that repeat
            own = np.unique(shingles[offsets[i] : offsets[i + 1]])
            few[i] = len(own) < 4
            alike[i] = _set_hash(own[None])[0]
        places = np.concatenate(([0], np.cumsum(np.where(few, 1, BANDS))))
        out = np.zeros(places[-1], np.uint64)
        out[places[:-1][few]] = _mixed(alike[few] + _BASE)
        signed = np.flatnonzero(~few)
        if len(signed):
            for band in range(BANDS):
                total = np.full(len(signed), band + 1, np.uint64)
                for a, b in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                    lows = np.minimum.reduceat(shingles * a + b, heads)[signed]
                    total = _mixed(total * _BASE + lows)
                out[places[:-1][signed] + band] = total
        return out, places


def _set_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of the different values of each row, whatever their order."""
    rows = np.sort(rows, axis=1)
    values = _mixed(rows)
    values[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
    return values.sum(axis=1, dtype=np.uint64)


_FIELDS = {"k1": "bigint", "k2": "bigint", "start": "int", "end": "int", "levels": "int", "size": "int", "bands": "array<bigint>"}
PARAGRAPHS = f"array<struct<{','.join(f'{n}:{k}' for n, k in _FIELDS.items())}>>"


def _signed(texts: pa.Array) -> list[pa.Array]:
    p = Paragraphs(texts.to_pylist())
    k = p.keys()
    bands, places = p.bands()
    lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(bands.view(np.int64)))
    numbers = (p.start, p.end, p.levels, p.sizes - SHINGLE_WORDS + 1)
    rows = pa.StructArray.from_arrays(
        [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), *(pa.array(x, pa.int32()) for x in numbers), lists], names=list(_FIELDS)
    )
    counts = np.bincount(p.documents, minlength=len(texts))
    return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), rows)]


def jaccard_links(keys: list[int], sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets at a similarity of at least `least`: a forest.

    Breadth first; each step compares one set with all that are left, by marking its elements.
    """
    sets = [np.unique(s) for s in sets]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    left, links, mark = np.ones(len(sets), bool), [], np.zeros(flat.max() + 1, bool)
    for seed in range(len(sets)):
        todo = [seed] if left[seed] else []
        left[seed] = False
        while todo and left.any():
            i = todo.pop()
            mine = flat[offsets[i] : offsets[i] + sizes[i]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat].astype(np.int64), offsets)
            mark[mine] = False
            near = np.flatnonzero(left & (both >= least * (sizes + sizes[i] - both) - 1e-9))
            links += [(keys[i], keys[j]) for j in near]
            left[near] = False
            todo += near.tolist()
    return links


def _low(level: int) -> Column:
    return F.min(F.when(F.col("levels").bitwiseAND(level) > 0, F.col("doc_id")))


def _members(units: DataFrame) -> DataFrame:
    """band, k1, k2, low1, low2 (the smallest doc_id at each level), size of paragraphs whose band more than one of a level has."""
    banded = units.select("k1", "k2", "doc_id", "levels", "size", F.explode("bands").alias("band"))
    mine = lambda level: F.when(F.col("levels").bitwiseAND(level) > 0, F.col("k1"))
    ends = banded.groupBy("band").agg(*[f(mine(x)).alias(f"{n}{x}") for x in (CUT, WHOLE) for n, f in (("low", F.min), ("high", F.max))])
    many = sum(F.when(F.col(f"low{x}") != F.col(f"high{x}"), x).otherwise(0) for x in (CUT, WHOLE))
    shared = written(ends.select("band", many.alias("shared")).where("shared > 0"), "bands")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_BANDS else shared
    found = banded.join(shared, "band").where(F.col("levels").bitwiseAND(F.col("shared")) > 0).groupBy("band", "k1", "k2")
    return written(found.agg(_low(CUT).alias("low1"), _low(WHOLE).alias("low2"), F.max("size").alias("size")), "band-members")


def _nodes(members: DataFrame) -> DataFrame:
    """id, k1, k2, low1, low2, size: the paragraphs of members, numbered. 2 * id and 2 * id + 1 stand for their levels."""
    each = members.groupBy("k1", "k2").agg(F.min("low1").alias("low1"), F.min("low2").alias("low2"), F.max("size").alias("size"))
    return written(written(each, "unnumbered").withColumn("id", F.monotonically_increasing_id()), "nodes")


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, shingles of nodes, from the document of smallest doc_id that holds each; at least one row for each."""
    held = nodes.select(F.least("low1", "low2").alias("doc_id"), F.struct("k1", "k2", "id").alias("k"))
    wanted = written(held.groupBy("doc_id").agg(F.collect_list("k").alias("ks")), "wanted")
    texts = docs.join(sized_lists(wanted, "ks", 48), "doc_id").select(F.struct("text", "ks").alias("source"))

    def cut(sources: pa.Array) -> list[pa.Array]:
        texts = sources.field("text").to_pylist()
        wanted = [{(k["k1"], k["k2"]): k["id"] for k in ks} for ks in sources.field("ks").to_pylist()]
        p = Paragraphs(texts)
        shingles, offsets = p.shingles()
        rows = [[] for _ in texts]
        for u, (d, k) in enumerate(zip(p.documents.tolist(), p.keys().tolist())):
            node = wanted[d].pop(tuple(k), None)
            if node is not None:
                rows[d].append({"id": node, "shingles": np.unique(shingles[offsets[u] : offsets[u + 1]]).view(np.int64)})
        return [pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])))]

    return with_mapped(texts, "source", "cut array<struct<id:bigint,shingles:array<bigint>>>", lambda: cut).select(F.inline("cut"))


def around_pivots(rows: DataFrame, sets: DataFrame, fits: Column, rounds: int = PIVOTS) -> tuple[DataFrame | None, DataFrame]:
    """Of large groups (g, id, level, size), links (id, other, level), and the rows that are still to be compared.

    Each round measures a group's paragraphs against one of them. Those that are similar to it are linked to it, so that
    they need not be compared with each other, only with those that are not. And since the Jaccard distance is a metric,
    a similar one can only meet another one if it is at most 1 - SIMILARITY nearer to the pivot. In a group that is
    all alike nothing is left. No row is multiplied. Groups that fit into one task, and those of the last round, are left.
    """
    links, left, far = None, None, 1 - SIMILARITY + 1e-9
    for turn in range(rounds):
        pivots = rows.groupBy("g").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("pivot"), F.count("*").alias("n"))
        pivots = pivots.join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("p")).dropDuplicates(["pivot"]), "pivot")
        total = rows.count()
        placed = salted(rows.select("g", "id", "level", "size").join(sets.dropDuplicates(["id"]), "id"), written(pivots, "pivots"), "g", total=total)
        both = F.size(F.array_intersect("shingles", "p"))
        placed = placed.withColumn("far", 1 - both / (F.size("shingles") + F.size("p") - both))
        placed = written(placed.select("g", "id", "level", "size", "pivot", "far"), "measured")
        found = placed.where((F.col("far") <= far) & (F.col("id") != F.col("pivot"))).select("id", F.col("pivot").alias("other"), "level")
        links = found if links is None else links.union(found)
        others = placed.groupBy("g").agg(F.min(F.when(F.col("far") > far, F.col("far"))).alias("next"), F.count("*").alias("n"))
        open_ = lookup(placed, written(others, "nearest-others"), "g", total=total).where("next is not null")
        open_ = open_.where((F.col("far") > far) | (F.col("far") + far >= F.col("next"))).select("g", "id", "level", "size")
        open_ = written(open_, "open")
        sizes = open_.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
        rows = written(lookup(open_, written(sizes, "open-sizes"), "g", total=total), "rows")
        ready = rows if turn == rounds - 1 else rows.where(fits)
        left = ready if left is None else left.union(ready)
        rows = rows.where(~fits)
        if rows.isEmpty():
            break
    return links, left


def _near_links(docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes between distinct paragraphs of one level that share a band and are similar."""
    levels = F.array(*[F.struct(F.col(f"low{x}").isNotNull().alias("on"), F.lit(x).alias("level")) for x in (CUT, WHOLE)])
    each = members.join(nodes.select("k1", "k2", "id"), ["k1", "k2"])
    each = each.select("id", "size", "band", F.inline(levels)).where("on").select("id", "level", "size", F.xxhash64("band", "level").alias("g"))
    each = written(each, "band-nodes")
    sizes = written(each.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1"), "band-sizes")
    found = lookup(each, sizes, "g")
    fits = (F.col("n") <= CHUNK) & (F.col("total") <= CHUNK_SHINGLES)
    sets = written(_shingle_sets(docs, nodes), "shingle-sets")
    links, large = None, sizes.where(~fits)
    if not large.isEmpty():
        links, rest = around_pivots(written(found.where(~fits), "large-bands"), sets, fits)
        found = found.where(fits).select("g", "id", "level", "n", "total").union(rest.select("g", "id", "level", "n", "total"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j"))
    )
    tiled = found.withColumn("mine", mine).select("id", "level", "g", F.explode(tiles).alias("tile"))
    lists = tiled.groupBy("g", "level", "tile").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    # bands with the same paragraphs, of both levels, are compared once
    once = lists.groupBy("ids").agg(F.min(F.struct("g", "level", "tile")).alias("list"), F.bit_or("level").alias("levels"))
    rows = once.select("list", "levels", F.explode("ids").alias("id"))
    rows = rows.join(sets, "id")  # a paragraph is in BANDS lists a level, and more only where bands are dealt as chunks
    groups = rows.groupBy("list", "levels").agg(F.collect_list(F.struct("id", "shingles")).alias("s")).select("s", "levels")
    ship(docs.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int]] = set()
            for row, levels in zip(batch.column(0), batch.column(1).to_pylist()):
                ids, lists = row.values.field("id").to_pylist(), row.values.field("shingles")
                some = jaccard_links(ids, [lists[i].values.to_numpy() for i in range(len(ids))])
                found.update((a, b, level) for level in (CUT, WHOLE) if levels & level for a, b in some)
            rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], ["id", "other", "level"])

    pairs = groups.mapInArrow(given_back(linked), "id bigint, other bigint, level bigint")
    pairs = pairs if links is None else pairs.union(links.select("id", "other", F.col("level").cast("long")))
    node = lambda c: (F.col(c) * 2 + (F.col("level") == WHOLE).cast("long"))
    return pairs.select(node("id").alias("a"), node("other").alias("b"))


def _classes(found: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """k1, k2, class (level first), keep_id, times of paragraphs that repeat: equal ones in several places, and near ones."""
    times = lambda level: F.count_if(F.col("levels").bitwiseAND(level) > 0)
    equal = found.groupBy("k1", "k2").agg(_low(CUT).alias("e1"), _low(WHOLE).alias("e2"), times(CUT).alias("n1"), times(WHOLE).alias("n2"))
    every = equal.where("n1 > 1 or n2 > 1").join(nodes.drop("size"), ["k1", "k2"], "full_outer")

    def at(level: int) -> Column:
        known = F.col(f"low{level}").isNotNull()
        many = F.coalesce(F.col(f"n{level}") > 1, F.lit(False))
        node = F.when(known, F.col("id") * 2 + int(level == WHOLE))
        return F.struct(F.lit(level).alias("level"), many.alias("many"), node.alias("node"), F.coalesce(f"e{level}", f"low{level}").alias("low"))

    count = (F.coalesce("n1", F.lit(1)) + F.coalesce("n2", F.lit(1))).alias("times")
    rows = every.select("k1", "k2", count, F.inline(F.array(at(CUT), at(WHOLE)))).join(groups, "node", "left")
    near = F.col("component").isNotNull()
    name = F.struct("level", near.alias("near"), F.coalesce("component", "k1").alias("x"), F.when(near, 0).otherwise(F.col("k2")).alias("y"))
    rows = written(rows.where(F.col("many") | near).select("k1", "k2", "times", "low", name.alias("class")), "classes")
    lows = rows.groupBy("class").agg(F.min("low").alias("keep_id"), F.count("*").alias("n"))
    return written(lookup(rows, written(lows, "lows"), "class").select("k1", "k2", "class", "keep_id", "times"), "named-classes")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, removed, removed_lines of every row of docs (doc_id, text; other columns are ignored).

    n_paragraphs counts sentences of five words or more; removed is array<struct<start,end,keep_id>> by place, in code
    points, end exclusive, with the document whose sentence stays. removed_lines is the same of whole lines; to drop all
    that repeats, cut out both. Null and empty texts have none. Rows that repeat a doc_id, or have none, are one document
    with the paragraphs of all, of which equal ones at the same place stay together; a null doc_id comes after all others.
    An empty table gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = with_mapped(docs, "text", f"p {PARAGRAPHS}", lambda: _signed).select("doc_id", F.inline_outer("p"))
    units = written(cut, "paragraphs")
    found = units.where("k1 is not null")
    members = _members(found)
    tidy(docs.sparkSession)
    nodes = _nodes(members)
    groups = written(connected_components(_near_links(docs, members, nodes)), "near")
    tidy(docs.sparkSession)
    classes = _classes(found, nodes, groups)
    places = found.select(F.struct("k1", "k2").alias("k"), "doc_id", "start", "end", "levels")
    hit = lookup(places, classes.select(F.struct("k1", "k2").alias("k"), "class", "keep_id", "times"), "k", n="times", total=units.count())
    per = hit.where(F.col("levels").bitwiseAND(F.col("class.level")) > 0).groupBy("doc_id", "class").agg(
        F.min("keep_id").alias("keep_id"), F.min("start").alias("first"), F.collect_list(F.struct("start", "end")).alias("all")
    )
    gone = F.filter("all", lambda x: (F.col("doc_id") != F.col("keep_id")) | (x["start"] != F.col("first")))
    keep = F.nullif("keep_id", F.lit(NONE)).alias("keep_id")
    gone = F.transform(gone, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), keep))
    listed = lambda level: F.array_sort(F.flatten(F.collect_list(F.when(F.col("level") == level, F.col("r")))))
    removed = per.select("doc_id", F.col("class.level").alias("level"), gone.alias("r")).groupBy("doc_id")
    removed = removed.agg(listed(CUT).alias("removed"), listed(WHOLE).alias("removed_lines"))
    counts = units.groupBy("doc_id").agg(F.count_if(F.col("levels").bitwiseAND(CUT) > 0).alias("n_paragraphs"))
    none = F.array().cast("array<struct<start:int,end:int,keep_id:bigint>>")
    return counts.join(removed, "doc_id", "left").select(
        F.nullif("doc_id", F.lit(NONE)).alias("doc_id"), "n_paragraphs",
        F.coalesce("removed", none).alias("removed"), F.coalesce("removed_lines", none).alias("removed_lines"),
    )
