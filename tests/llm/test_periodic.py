import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import catalog, periodic


def plain_runs(words, least=6, exponent=4):
    """Every stretch of equal words q apart, for each q; of equal stretches the one with the smallest q."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = changed(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequence(texts):
    ids, firsts, ends = [], [], []
    for words in texts:
        base, seen = len(ids), {}
        ids += [seen.setdefault(w, base + i) for i, w in enumerate(words)]
        firsts += [base] * len(words)
        ends += [base + len(words)] * len(words)
    return [np.array(x, np.int64) for x in (ids, firsts, ends)]


def periodic_words(rng, letters, size):
    out = []
    while len(out) < size:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        part = unit * rng.randrange(1, 8)
        if out and rng.random() < 0.3:  # copies of what was there, with their runs inside
            at = rng.randrange(len(out))
            part = out[at : at + rng.randrange(1, 40)]
        out += part[: rng.randrange(1, len(part) + 1)]
    return out


def test_runs_by_brute_force():
    rng, some = random.Random(5), 0
    for _ in range(1500):
        letters = "abcdef"[: rng.randrange(1, 6)]
        texts = [periodic_words(rng, letters, rng.randrange(0, 60)) for _ in range(rng.randrange(1, 5))]
        ids, firsts, ends = sequence(texts)
        got = [(int(firsts[s]), int(s - firsts[s]), int(e - s), int(p)) for s, e, p in periodic.find_runs(ids, firsts, ends)]
        want, base = [], 0
        for words in texts:
            want += [(base, *r) for r in plain_runs(words)]
            base += len(words)
        assert got == want, texts
        some += len(want)
    assert some > 2000


def test_previous_factors_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(1, 25))]
        ids, _, ends = sequence([words])
        length, where = periodic.previous_factors(periodic.Names(ids, ends))
        n = len(words)
        for i in range(n):
            common = [next((k for k in range(n - i) if words[j + k] != words[i + k]), n - i) for j in range(i)]
            assert length[i] == max(common, default=0)
            if length[i]:
                assert where[i] < i and common[where[i]] == length[i]


@pytest.mark.parametrize("words", [["x"] * 30_000, ["a", "b"] * 20_000, [*"abcde"] * 3 + ["z"] * 5, [str(i * i % 977) for i in range(50_000)]])
def test_long_texts(words):
    got = [tuple(map(int, r)) for r in periodic.find_runs(*sequence([words]))]
    assert [(s, e - s, p) for s, e, p in got] == (plain_runs(words) if len(set(words)) < 10 and len(words) < 100 else got)
    if len(set(words)) <= 2:
        assert got == [(0, len(words), len(set(words)))]
    if len(words) == 50_000:
        assert got == [(0, 50_000, 977)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rows_by_definition(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(periodic_words(rng, "abc", rng.randrange(0, 70)))) for i in range(150)]
    rows += [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(0, 90)))) for i in range(150, 300)]
    rows += [(None, "a a a a a a"), (None, None), (7, None), (7, ""), (7, " \t\n\x0b\x0c\r"), (8, "b c d " * 6), (8, "b c d " * 6)]
    docs = frame(spark, rows)
    found = periodic.with_runs(docs.withColumn("text", periodic.repeated_words(F.col("text"), F.col("doc_id"))))
    got = sorted(map(tuple, periodic.digest_columns(found).collect()), key=str)
    assert got == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100


def test_odd_tables(spark):
    clash = frame(spark, [(1, "a b " * 5)]).withColumns({"runs": F.lit(1), "N_WORDS": F.lit(2), "collapsed": F.lit("c")})
    row = periodic.with_runs(clash).collect()[0]
    assert (row["runs"], row["N_WORDS"], row["collapsed"], row["n_words_"], row["collapsed_"]) == (1, 2, "c", 10, "a b")
    assert [tuple(r) for r in row["runs_"]] == [(0, 10, 2)]
    assert periodic.with_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(*sequence(["aa"]), exponent=3)


def test_query_by_definition(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, catalog.op11_periodic_runs(spark, sf_small).collect()))
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] for r in got) > 0
