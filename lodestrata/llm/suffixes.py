"""Exact substring deduplication with sorted suffixes that are compared by hashes.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (in a smaller document, or before it in
the same one). Strings of LENGTH bytes are windows; of its K-byte strings a window's anchor is the one with the smallest
hash, the leftmost of equals, so equal windows have equal anchors at equal places, and a text needs about two anchors in
LENGTH - K bytes. Windows with the same anchor that follow each other form a segment.

1. Anchor hashes are counted. Those that occur twice or more set bits in a filter, which has BITS_PER_ANCHOR bits for each.
2. Segments whose anchors pass the filter are sent to the task of their anchor, without those that repeat what the same
   task has sent already; all others are unique.
3. There, the suffixes that begin at the anchors are sorted by a merge sort. Two suffixes are compared by the length of
   their common extension, which a binary search over prefix polynomial hashes finds in log2(LENGTH) steps; the order
   and the extensions of neighbours in the result are verified byte by byte. Windows are equal where neighbours' extensions
   reach over their right part and the hashes of their left parts agree (verified too). If a hash turns out to be shared
   by different bytes, the same sort is done again with extensions found byte by byte.
4. Anchors with many segments or copies are made longer until they are rare, and their equal segments folded: see divided. Segments of any anchor, long or short, are
   sorted alike.
5. The windows found are laid over the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import PART_BYTES, given_back, lookup, tidy, with_mapped, written

LENGTH, K = 100, 32
#: Segments of one anchor that one task sorts, about a megabyte; of more, the anchor is made longer.
HOT = 8192
#: Occurrences of an anchor above which it is treated so too, however alike its segments are: where documents come in descending
#: order, a task sends each copy, as each comes before the one that it has sent.
HOT_COPIES = 1 << 16
#: Bits of a filter for each hash in it, and in all (64 MB, which every executor gets; more hashes let more others pass).
BITS_PER_ANCHOR, MOST_BITS = 16, 1 << 29
#: Segments that a task remembers to have sent.
SEEN = 200_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _tables.get(base)
    if found is None or len(found) < n:
        factors = np.full(max(n, PIECE + 4096), base, np.uint64)
        factors[0] = 1
        found = _tables[base] = np.multiply.accumulate(factors)
    return found[:n]


def _prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, shifted back, are the polynomial hashes of all substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def _hashes(prefixes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    return (prefixes[starts + lengths] - prefixes[starts]) * _powers(_INVERSE, len(prefixes))[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor's place, first window, windows) of data's segments, by place."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    grams = len(data) - k + 1
    sums = _prefixes(data)
    hashes = _mixed((sums[k:] - sums[:grams]) * _powers(_INVERSE, grams))
    low = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:  # the smallest of each span, by doubling
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchors = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    return hashes[anchors[first]], anchors[first], first, np.diff(np.append(first, n))


def _pieces(text: str | None, length: int) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        yield at, data[at : at + PIECE + length - 1]


def _blocks(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks of about PIECE bytes: bytes, and for each text in it its row, begin in the block and place
    in the text. Blocks overlap so that each window is in one of them."""
    parts: list[np.ndarray] = []
    about: list[tuple[int, int, int]] = []
    size = 0
    for row, text in enumerate(texts):
        for at, data in _pieces(text.as_py(), length):
            if len(data) < length:
                continue
            about.append((row, size, at))
            parts.append(data)
            size += len(data)
            if size >= PIECE:
                yield np.concatenate(parts), *np.array(about).T
                parts, about, size = [], [], 0
    if parts:
        yield np.concatenate(parts), *np.array(about).T


def _within(data: np.ndarray, begins: np.ndarray, length: int, k: int):
    """The segments of a block without the windows that cross from one text to the next; and each one's text."""
    h, anchor, first, count = segments(data, length, k)
    ends = np.append(begins[1:], len(data))
    text = np.searchsorted(begins, first, "right") - 1
    # a segment's windows may cross a border: keep those before it and, apart, those after it
    keep = np.minimum(count, np.maximum(0, ends[text] - length + 1 - first))
    after = np.minimum(text + 1, len(begins) - 1)
    late = np.maximum(begins[after], first)
    more = np.where((text + 1 < len(begins)) & (first + count > begins[after]), first + count - late, 0)
    # an anchor before the border can't belong to windows after it, nor can their text be shorter than a window
    a, b = keep > 0, (more > 0) & (anchor >= late)
    order = np.argsort(np.concatenate((first[a], late[b])), kind="stable")
    join = lambda x, y: np.concatenate((x[a], y[b]))[order]
    return join(h, h), join(anchor, anchor), join(first, late), join(keep, more), join(text, after)


def _counted(length: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in _parts(batch.column(0)):
            for data, _, begins, _ in _blocks(texts, length):
                h, anchor, first, count, _ = _within(data, begins, length, k)
                whole = _mixed(_hashes(_prefixes(data), first, count + length - 1) + (anchor - first).astype(np.uint64))
                by = np.lexsort((whole, h))
                h, whole = h[by], whole[by]
                head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                other = np.concatenate(([True], (whole[1:] != whole[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
                kinds = np.add.reduceat(other.astype(np.int64), head) if len(h) else head
                n = np.diff(np.append(head, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(n), pa.array(kinds)], ["h", "n", "kinds"])


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    rows = max(1, len(column) * PART_BYTES // max(1, column.nbytes))
    for start in range(0, len(column), rows):
        yield column.slice(start, rows)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), buffers)


class Anchored:
    """Segments of several anchors: their bytes in one array, and the suffixes that begin at the anchors.

    by_bytes: common extensions are found byte by byte instead of by hashes."""

    def __init__(
        self, group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, length: int = LENGTH,
        by_bytes: bool = False,
    ):
        self.group, self.data, self.length, self.by_bytes = group, data, length, by_bytes
        self.start, self.size, self.left = start, size, left
        self.at = start + left
        self.room = np.minimum(size - left, length)
        self.sums = _prefixes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The lengths of the common extensions of pairs of suffixes: binary search over prefix hashes. Never too short."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.room[x], self.room[y])
        if self.by_bytes:
            return self._same(a, b, high)
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = _hashes(self.sums, a, mid) == _hashes(self.sums, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y: by the byte after their common extension, the shorter first, then by number."""
        n = self.extension(x, y)
        a = np.where(n < self.room[x], self.data[np.minimum(self.at[x] + n, len(self.data) - 1)].astype(np.int64), -1)
        b = np.where(n < self.room[y], self.data[np.minimum(self.at[y] + n, len(self.data) - 1)].astype(np.int64), -1)
        return (a < b) | ((a == b) & (x < y))

    def sorted(self) -> np.ndarray | None:
        """The suffixes, group after group (groups are in order), by bottom-up merge sort. In each round an element's place
        is its own plus the number of elements of the neighbouring run before it, found by binary search. None if shared
        hashes leave no order."""
        n = len(self.group)
        order = np.arange(n)
        first = np.flatnonzero(np.diff(self.group, prepend=-1))
        sizes = np.diff(np.append(first, n))
        base, total = np.repeat(first, sizes), np.repeat(sizes, sizes)
        inner = np.arange(n) - base
        width = 1
        while width < sizes.max(initial=0):
            run = inner // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width  # the neighbouring run's begin within the group
            length = np.clip(total - other, 0, width)
            todo = np.flatnonzero(length > 0)
            mine, begin = order[todo], base[todo] + other[todo]
            low, high = np.zeros(len(todo), np.int64), length[todo]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                less = self.before(order[begin[open_] + mid], mine[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            place = np.arange(n)
            pair = base[todo] + (run[todo] // 2) * 2 * width
            place[todo] = pair + (inner[todo] % width) + low
            new = np.full_like(order, -1)
            new[place] = order
            if (new < 0).any():  # the order contradicts itself
                return None
            order, width = new, width * 2
        return order

    def _same(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many bytes from a and b on are the same, up to lengths, byte by byte."""
        out = np.zeros(len(a), np.int64)
        steps = np.arange(self.length + 1)
        for lo in range(0, len(a), 20_000):
            part = slice(lo, lo + 20_000)
            x, y = (np.minimum(z[part, None] + steps, len(self.data) - 1) for z in (a, b))
            out[part] = ((self.data[x] != self.data[y]) | (steps >= lengths[part, None])).argmax(axis=1)
        return out

    def repeated(self, rank: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(segment, window) of all windows that a segment of the same group with a smaller rank (or the same one, before
        it) holds too. Window j of a segment starts j bytes after the segment. None if different bytes share a hash.

        Extensions that hashes give are never too short, so that an order whose neighbours are right is right as a whole,
        and what is equal is side by side."""
        order = self.sorted()
        if order is None:
            return None
        x, y = order[:-1], order[1:]
        near = self.group[x] == self.group[y]
        reach = np.where(near, self.extension(x, y), 0)
        if not self.by_bytes and not ((self._same(self.at[x], self.at[y], reach) == reach) & (self.before(x, y) | ~near)).all():
            return None
        found_s, found_w = [], []
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for back in range(self.length - K + 1):  # windows that start this many bytes before their anchor
            j = self.left - back
            held = np.flatnonzero((j >= 0) & (j < windows))
            if len(held) < 2:
                continue
            block = np.concatenate(([0], np.cumsum(reach < self.length - back)))[place[held]]
            begin = self.start[held] + j[held]
            if self.by_bytes:
                raw = np.lib.stride_tricks.sliding_window_view(self.data, back)[begin] if back else np.zeros((len(held), 0), np.uint8)
                lefts = np.unique(raw, axis=0, return_inverse=True)[1].reshape(-1) if back else np.zeros(len(held), np.int64)
            else:
                lefts = _hashes(self.sums, begin, back)
            by = np.lexsort((rank[held], lefts, block))
            b, l, h = block[by], lefts[by], held[by]
            same = (b[1:] == b[:-1]) & (l[1:] == l[:-1]) & (self.group[h[1:]] == self.group[h[:-1]])
            first, again = h[:-1][same], h[1:][same]
            if not self.by_bytes and not (self._same(self.at[first] - back, self.at[again] - back, np.full(len(first), back)) == back).all():
                return None
            found_s.append(again)
            found_w.append(j[again])
        if not found_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_s), np.concatenate(found_w)


#: A segment: its anchor's key, its place, its windows, the anchor's begin and length in it, its bytes. Without bytes: w windows
#: from s on that are known to repeat.
SEGMENT = "h bigint, doc_id bigint, tag bigint, s bigint, w int, a int, k int, seg binary"
NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
RUNS = "doc_id bigint, tag bigint, s bigint, w int"


def _runs(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of repeated windows of segments that come in the order of their keys. Only the last key's are held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        given = batch.column("seg").is_null().to_numpy(zero_copy_only=False)
        if given.any():
            yield _run_rows(*(batch.column(c).to_numpy()[given] for c in ("doc_id", "tag", "s", "w")))
            batch = batch.filter(pa.array(~given))
            if not batch.num_rows:
                continue
        h = batch.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))  # rows are in order, as signed integers
        if held and (last or held[0].column("h")[0].as_py() != h[0]):
            same = 0 if held[0].column("h")[0].as_py() != h[0] else int(np.searchsorted(h, h[0], "right"))
            yield from _repeats(length, [*held, batch.slice(0, same)])
            yield from _repeats(length, [batch.slice(same, last - same)])
            held = [batch.slice(last)]
        elif last:
            yield from _repeats(length, [batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    yield from _repeats(length, held)


def _repeats(length: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of repeated windows of whole groups of segments."""
    rows = pa.Table.from_batches([b for b in batches if b.num_rows], schema=batches[0].schema if batches else None) if batches else None
    if rows is None or rows.num_rows < 2:
        return
    h = rows.column("h").to_numpy()
    alone = np.concatenate(([True], h[1:] != h[:-1])) & np.concatenate((h[1:] != h[:-1], [True]))
    rows, h = rows.filter(pa.array(~alone)), h[~alone]
    if not len(h):
        return
    doc, tag, s, w, a = (rows.column(c).to_numpy() for c in ("doc_id", "tag", "s", "w", "a"))
    segs = rows.column("seg").to_pylist()
    lengths = np.array([len(x) for x in segs], np.int64)
    raw = b"".join(segs)
    data = np.frombuffer(raw, np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
    by = np.lexsort((s, tag, doc))
    rank = np.empty(len(doc), np.int64)
    rank[by] = np.arange(len(doc))
    alike, known = {}, np.zeros(len(doc), bool)  # equal segments of an anchor: all but the first repeat it whole
    for i in by.tolist():
        known[i] = alike.setdefault((group[i], a[i], segs[i]), i) != i
    yield _run_rows(doc[known], tag[known], s[known], w[known])
    del alike, segs
    kept = np.flatnonzero(~known)
    parts = (group[kept], data, starts[kept], lengths[kept], a[kept].astype(np.int64), length)
    windows = w[kept].astype(np.int64)
    found = Anchored(*parts).repeated(rank[kept], windows)
    if found is None:
        found = Anchored(*parts, by_bytes=True).repeated(rank[kept], windows)
    item, window = kept[found[0]], found[1]
    by = np.lexsort((window, item))
    item, window = item[by], window[by]
    new = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    i = item[new]
    yield _run_rows(doc[i], tag[i], s[i] + window[new], np.diff(np.append(new, len(item))))


def _run_rows(doc: np.ndarray, tag: np.ndarray, s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(s, pa.int64()), pa.array(w, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "s", "w"])


def _filter(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit for each h in keys, modulo the number of bits, which follows the number of keys. At most MOST_BITS / 64 words come
    to the driver, whatever the table."""
    if bits is None:
        bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_PER_ANCHOR * keys.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


class _Seen:
    """The segments that a task has sent, with the first place of each: what is equal to one of them but later needs not
    be sent, and what comes before it is sent and takes its place. Emptied when full, which only sends more."""

    def __init__(self, most: int = SEEN):
        self.most = most
        self.first: dict[bytes, tuple[int, int, int]] = {}

    def new(self, data: bytes, starts: list[int], ends: list[int], places: list[tuple[int, int, int]]) -> np.ndarray:
        first, out = self.first, np.ones(len(starts), bool)
        for i, (a, b, place) in enumerate(zip(starts, ends, places)):
            key = data[a:b]
            known = first.get(key)
            if known is None or place < known:
                first[key] = place
            else:
                out[i] = known == place
        if len(first) > self.most:
            first.clear()
        return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """(doc_id, tag, s, w): runs of w windows from byte s that also start earlier, of docs (doc_id, tag, text)."""
    spark = docs.sparkSession
    ship(spark)
    anchors = docs.select("text").mapInArrow(given_back(lambda batches: _counted(length, k, batches)), "h bigint, n bigint, kinds bigint")
    counts = anchors.groupBy("h").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).where("n > 1")
    dups = written(counts, "anchors")
    passed = spark.sparkContext.broadcast(_filter(dups, bits))
    often = spark.sparkContext.broadcast(_filter(dups.where((F.col("kinds") > hot) | (F.col("n") > HOT_COPIES)), bits))
    del anchors, counts
    tidy(spark)

    def cut(batches: Iterator[pa.RecordBatch], want_hot: bool) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            done = 0
            for texts in _parts(batch.column(2)):
                for data, rows, begins, places in _blocks(texts, length):
                    h, anchor, first, count, text = _within(data, begins, length, k)
                    on = np.flatnonzero(_has(passed.value, h) & (_has(often.value, h) == want_hot))
                    h, anchor, first, count, text = (x[on] for x in (h, anchor, first, count, text))
                    row = rows[text] + done
                    doc, tag, s = ids[row], tags[row], first - begins[text] + places[text]
                    where = list(zip(doc.tolist(), tag.tolist(), s.tolist()))
                    new = seen.new(data.tobytes(), first.tolist(), (first + count + length - 1).tolist(), where)
                    send = np.flatnonzero(new)
                    yield _segment_rows(h[send], doc[send], tag[send], s[send], count[send], (anchor - first)[send],
                                        np.full(len(send), k), _gathered(data, first[send], count[send] + length - 1))
                    old = np.flatnonzero(~new)  # runs of segments that repeat what this task has sent, as they are
                    if len(old):
                        d, t, a, n = doc[old], tag[old], s[old], count[old]
                        head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1] + n[:-1]))))
                        n = np.add.reduceat(n, head)
                        key = _mixed((d[head] * 31 + a[head]).astype(np.uint64))
                        zero = np.zeros(len(head), int)
                        yield _segment_rows(key, d[head], t[head], a[head], n, zero, zero, pa.nulls(len(head), pa.binary()))
                done += len(texts)

    source = docs.select("doc_id", "tag", "text")
    found = source.mapInArrow(given_back(lambda batches: cut(batches, False)), SEGMENT)
    known = None
    if often.value.any():
        found_hot = source.mapInArrow(given_back(lambda batches: cut(batches, True)), SEGMENT)
        rare, known = divided(found_hot, length, hot)
        found = found.union(rare)
    ordered = found.repartition("h").sortWithinPartitions("h")
    runs = ordered.mapInArrow(given_back(lambda batches: _runs(length, batches)), RUNS)
    return runs if known is None else runs.union(known)


def _segment_rows(h, doc, tag, s, w, a, k, seg) -> pa.RecordBatch:
    columns = [pa.array(h.view(np.int64)), *(pa.array(x, pa.int64()) for x in (doc, tag, s)), *(pa.array(x, pa.int32()) for x in (w, a, k)), seg]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def divided(found: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Segments (SEGMENT) of anchors with at most hot different segments each, and runs (RUNS) that are known to repeat.

    Equal segments are folded to the first. If an anchor of k bytes still has more than hot, each of its segments is cut in
    two: the windows that begin at most half of length - k bytes before the anchor all hold more bytes after it, and the
    others all hold more bytes before it. These are the anchors of the halves. Equal windows have equal anchors at equal
    places again, and after log2(length - k) rounds at most an anchor is a whole window.
    """
    spark = found.sparkSession
    unit, place = ["h", "a", "k", "seg"], F.struct("doc_id", "tag", "s")
    rare, known = [], []
    while True:
        found = written(found, "hot-segments")
        known.append(found.where("seg is null").select("doc_id", "tag", "s", "w"))
        found = found.where("seg is not null")
        first = written(found.groupBy(*unit).agg(F.min(place).alias("f"), F.count("*").alias("n"), F.first("w").alias("w")), "hot-units")
        copies = first.where("n > 1").select(F.struct(*unit).alias("unit"), "f", "n")
        again = lookup(found.select(F.struct(*unit).alias("unit"), "doc_id", "tag", "s", "w"), copies, "unit", total=found.count())
        known.append(again.where(place != F.col("f")).select("doc_id", "tag", "s", "w"))
        counts = first.where(F.col("k") < length).groupBy("h").agg(F.count("*").alias("n"))
        often = spark.sparkContext.broadcast(_filter(counts.where(F.col("n") > hot)))
        units = first.select("h", "f.doc_id", "f.tag", "f.s", "w", "a", "k", "seg")
        if not often.value.any():
            rare.append(units)
            break
        rare.append(units.mapInArrow(given_back(_kept(often, False, length)), SEGMENT))
        found = units.mapInArrow(given_back(_kept(often, True, length)), SEGMENT)
    return _union(rare), _union(known)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.union(df)
    return out


def _kept(often, want: bool, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The segments whose anchors are not in often, or the halves of those whose are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            short = batch.column(6).to_numpy(zero_copy_only=False) < length
            part = batch.filter(pa.array((_has(often.value, h) & short) == want))
            yield from _halves(part, length) if want else [part]

    return run


def _halves(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    doc, tag, s, w, a, k = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 7))
    segs = batch.column(7).to_pylist()
    sizes = np.array([len(x) for x in segs], np.int64)
    data = np.frombuffer(b"".join(segs), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sums = _prefixes(data)
    middle = (length - k) // 2
    early = np.clip(a - middle, 0, w)  # so many windows begin more than middle bytes before the anchor
    for skipped, count, left, size in ((early, w - early, a, length - middle), (np.zeros(len(w), np.int64), early, a - middle - 1, k + middle + 1)):
        on = np.flatnonzero(count > 0)
        if not len(on):
            continue
        skipped, count, left, size = (x[on] for x in (skipped, count, left, size))
        key = _mixed(_hashes(sums, starts[on] + left, size) + size.astype(np.uint64) * np.uint64(_BASE))
        bytes_ = _gathered(data, starts[on] + skipped, count + length - 1)
        yield _segment_rows(key, doc[on], tag[on], s[on] + skipped, count, left - skipped, size, bytes_)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """doc_id, n_bytes, removed, kept of every row of docs (doc_id, text; other columns are ignored).

    removed is array<struct<start,end>> of maximal removed byte ranges, end exclusive; kept are the remaining bytes. Null
    texts are empty; texts shorter than length keep all. A null doc_id sorts before all others. Rows that repeat a doc_id
    are ordered by a hash of their texts; if those are equal too, they are treated as one row and have the same result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc_id", F.coalesce("id", F.lit(-(1 << 63))))
    alone = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("tag", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    distinct = docs
    if not alone and not docs.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        distinct = written(docs.select("doc_id", "tag", "text").distinct(), "distinct")
    runs = repeated_windows(distinct, length, k, hot, bits)
    ends = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("s", (F.col("s") + F.col("w") + (length - 1)).alias("e"))).alias("r"))

    def united(column: pa.Array) -> list[pa.Array]:
        out = []
        for ranges in column.to_pylist():
            merged: list[list[int]] = []
            for r in sorted((x["s"], x["e"]) for x in ranges):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            out.append([{"start": a, "end": b} for a, b in merged])
        return [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    ranges = "array<struct<start:bigint,end:bigint>>"
    spans = written(with_mapped(ends, "r", f"removed {ranges}", lambda: united).drop("r"), "repeats")
    out = docs.join(spans, ["doc_id", "tag"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.coalesce("removed", F.array().cast(ranges)).alias("removed"), F.coalesce("text", F.lit("")).alias("text"),
    )
    both = out.withColumn("_both", F.struct(F.col("text").cast("binary").alias("text"), "removed"))

    def kept(column: pa.Array) -> list[pa.Array]:
        rows = []
        for r in column:
            data, at, parts = r["text"].as_py(), 0, []
            for x in r["removed"].as_py():
                parts.append(data[at : x["start"]])
                at = x["end"]
            rows.append(b"".join([*parts, data[at:]]))
        return [pa.array(rows, pa.binary())]

    return with_mapped(both, "_both", "kept binary", lambda: kept).select("doc_id", "n_bytes", "removed", "kept")
