import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import catalog, suffixes


def brute(docs, length):
    """{doc_id: (removed ranges, kept)} by a dictionary of all strings."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[d] = ([tuple(e) for e in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def test_segments_cover_windows_and_agree():
    random.seed(1)
    for alphabet in (b"ab", b"a", bytes(range(256))):
        data = np.frombuffer(bytes(random.choice(alphabet) for _ in range(700)), np.uint8)
        h, anchor, first, count = suffixes.segments(data)
        assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and count.sum() == len(data) - 99
        assert (anchor >= first + count - 1).all() and (anchor + 32 <= first + 100).all()


@pytest.mark.parametrize("alphabet", ["ab", "abcdef"])
def test_sorted_suffixes(alphabet):
    random.seed(2)
    sizes = [random.randint(1, 40) for _ in range(60)]
    data = "".join(random.choice(alphabet) for _ in range(sum(sizes))).encode()
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    group = np.sort(np.array([random.randrange(5) for _ in sizes]))
    a = suffixes.Anchored(group, np.frombuffer(data, np.uint8), starts, np.array(sizes), np.zeros(60, np.int64))
    want = sorted(range(60), key=lambda i: (group[i], data[starts[i] : starts[i] + sizes[i]], i))
    assert a.sorted().tolist() == want
    x, y = np.arange(59), np.arange(1, 60)
    for i, n in enumerate(a.extension(x, y)):
        u, v = (data[starts[k] : starts[k] + sizes[k]] for k in (i, i + 1))
        assert n == next((q for q, (p, r) in enumerate(zip(u, v)) if p != r), min(len(u), len(v)))


def made(seed, alphabet):
    random.seed(seed)
    text = lambda n: "".join(random.choice(alphabet) for _ in range(n))
    pool = [text(random.randint(60, 400)) for _ in range(12)]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(random.randint(0, 4)):
            p = random.choice(pool)
            cut = random.randint(0, 50)
            parts += [text(random.randint(0, 120)), p[cut:] if random.random() < 0.5 else p]
        docs.append((d * 3, "".join(parts)))
    return docs + [(1, pool[0] * 3), (2, None), (4, ""), (5, "é" * 300), (301, docs[10][1]), (302, docs[10][1])]


def test_blocks_hold_each_window_once(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t in made(9, "ab")]
    monkeypatch.setattr(suffixes, "PIECE", 300)
    found = {}
    for data, rows, begins, places in suffixes._blocks(pa.array(texts), 100):
        for h, anchor, first, count, text in zip(*suffixes._within(data, begins, 100, 32)):
            for j in range(first, first + count):
                at = (int(rows[text]), int(j - begins[text] + places[text]))
                assert at not in found
                found[at] = (int(h), bytes(data[j : j + 100]))
                assert j <= anchor <= j + 68
    want = {}
    for row, t in enumerate(texts):
        data = (t or "").encode()
        for j in range(len(data) - 99):
            want[row, j] = data[j : j + 100]
    assert {k: w for k, (_, w) in found.items()} == want
    anchors = {}
    for h, w in found.values():
        assert anchors.setdefault(w, h) == h  # equal windows have equal anchors


def test_seen_never_hides_a_first_place():
    random.seed(4)
    seen, sent, firsts = suffixes._Seen(3), set(), {}
    for _ in range(500):
        word, place = random.choice([b"ab", b"ba", b"aa", b"bb", b"cc"]), (random.randrange(100), 0, random.randrange(3))
        if seen.new(word, [0], [2], [place])[0]:
            sent.add((word, place))
        firsts[word] = min(firsts.get(word, place), place)
    assert all((w, p) in sent for w, p in firsts.items())


@pytest.mark.parametrize("hot", [256, 2])
def test_matches_brute_force(spark, hot):
    docs = made(hot, "abcdé ")
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, tag string").repartition(6)
    out = suffixes.remove_repeats(table, hot=hot, bits=1 << 12).collect()
    got = {r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in out}
    assert got == brute(docs, 100) and len(out) == len(docs)
    assert all(r.n_bytes == len((dict(docs)[r.doc_id] or "").encode()) for r in out)


def test_odd_rows(spark):
    t = "".join(chr(97 + i % 26) * (1 + i % 3) for i in range(90))
    rows = [(None, t), (3, t), (3, t), (3, t + "y"), (None, None), (4, "x" * 99), (5, "x" * 101)]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = sorted((r.doc_id or -1, r.n_bytes, len(r.kept)) for r in out)
    assert got[:2] == [(-1, 0, 0), (-1, len(t), len(t))] and got[-1] == (5, 101, 1)  # its second window repeats its first
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = brute(docs, 100)
    for r in catalog.queries()["op1_suffix_dedup"](spark, sf_small).collect():
        spans, kept = want[r.doc_id]
        assert (r.n_spans, r.n_removed) == (len(spans), sum(b - a for a, b in spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [256, 0])
def test_rows_that_repeat_keep_their_text(spark, hot):
    random.seed(7)
    t, u, v = ("".join(random.choice("abcdefgh") for _ in range(400)) for _ in range(3))
    rows = [(3, t), (3, t), (None, u), (None, u), (None, u), (5, v), (5, v), (9, t), (9, v[:300])]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in out)
    assert got == [(-1, 400, u)] * 3 + [(3, 400, t)] * 2 + [(5, 400, v)] * 2 + [(9, 300, ""), (9, 400, "")]


def _anchored_rows(n, seed):
    """n segments that hold one anchor, and some of another, in the order of their keys."""
    random.seed(seed)
    anchor = "".join(random.choice("xyz") for _ in range(32))
    rows = []
    for d in range(n):
        left, right = ("".join(random.choice("ab") for _ in range(random.choice((0, 2, 40, 68)))) for _ in range(2))
        text = (left + anchor + right + "c" * 68)[: max(100, len(left) + 100)]
        rows.append((d % 3, d, 0, 5, len(text) - 99 if len(left) >= len(text) - 100 else 1, len(left), 32, text.encode()))
    return sorted(r for r in rows if r[5] < r[4] + 68)


def test_shared_hashes_are_told_apart_by_bytes(monkeypatch):
    import pyarrow as pa

    rows = _anchored_rows(300, 11)
    types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], suffixes.NAMES)
    runs = lambda batches: sorted(tuple(r.values()) for b in suffixes._runs(100, batches) for r in b.to_pylist())
    want = runs([batch])
    assert want and runs([batch.slice(i, 7) for i in range(0, len(rows), 7)]) == want
    whole = suffixes._hashes
    monkeypatch.setattr(suffixes, "_hashes", lambda *a: whole(*a) & np.uint64(7))
    assert runs([batch]) == want


@pytest.mark.parametrize("hot", [3, 20, 8192])
def test_frequent_anchors(spark, hot):
    random.seed(12)
    passage = "".join(random.choice("abcdefgh ") for _ in range(260))
    word = lambda n: "".join(random.choice("pqrst") for _ in range(n))
    docs = [(d, word(random.randrange(150)) + passage[random.randrange(90) : 260 - random.randrange(90)] + word(random.randrange(150))) for d in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in suffixes.remove_repeats(table, hot=hot).collect()}
    assert got == brute(docs, 100)


@pytest.mark.parametrize("copies", [5, 1 << 16])
def test_copies_in_descending_order(spark, monkeypatch, copies):
    """Each copy comes before the one that its task has sent. Above HOT_COPIES none goes to the one task of its anchor: equal
    segments are folded by a partial aggregate first."""
    monkeypatch.setattr(suffixes, "HOT_COPIES", copies)
    folded, divided = [], suffixes.divided

    def counted(found, length, hot):
        rare, known = divided(found, length, hot)
        folded.append(rare.groupBy("h").count().agg(F.max("count")).first()[0])
        return rare, known

    monkeypatch.setattr(suffixes, "divided", counted)
    random.seed(3)
    line = "".join(random.choice("abcdefgh ") for _ in range(180))
    word = lambda n: "".join(random.choice("pqrst") for _ in range(n))
    docs = [(d, word(20) + line + word(d % 30)) for d in range(200, 0, -1)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in suffixes.remove_repeats(table).collect()}
    assert got == brute(docs, 100)
    assert len(folded) == (copies == 5) and all(n <= 200 for n in folded)
