import random
import re

import pytest
import xxhash

from lodestrata.llm import catalog, simhash
from lodestrata.llm.common import connected_components


def plain(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    lead = {v: v for v in values}

    def find(v):
        while lead[v] != v:
            v = lead[v]
        return v

    for i, x in enumerate(values):
        for y in values[:i]:
            if near(x, y):
                a, b = sorted((find(x), find(y)))
                lead[b] = a
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("chunk", [20_000, 5, 1])
def test_links_keep_components(spark, chunk):
    random.seed(3)
    centers = [random.getrandbits(64) for _ in range(15)]
    values = sorted({signed(c ^ sum({1 << random.randrange(64) for _ in range(random.randint(0, 4))})) for c in centers for _ in range(25)})
    want = components(values, lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 3)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), chunk=chunk)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 300), (300, 250), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 250: 200, 300: 200}


def test_query(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = catalog.queries()["op8_simhash_dedup"](spark, sf_small).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in out}
    assert fps == {d: plain(t) for d, t in texts.items()}
    want = components(sorted(fps), lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in out} == want and all(len(r.fingerprint) == 16 for r in out)


def test_odd_rows(spark):
    rows = [(7, None, "x"), (3, "", "y"), (5, " \n", "z"), (9, "one", "w"), (9, "ONE", "w"), (None, "one", "v"), (4, "w " * 60_000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (5, 3), (9, 9), (9, 9), (None, 9), (4, 4)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
