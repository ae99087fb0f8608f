import hashlib
import re

import pytest

from lodestrata.llm import catalog, common, exact_dedup


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(1, "a b"), (2, "a\t\n b"), (3, "a b "), (4, None), (5, ""), (6, " "), (7, "\n"), (8, "a b"), (8, "a b"), (None, "c"), (None, "a  b"), (9, "é" * 40_000), (10, "é" * 40_000)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, keep_id string")
    assert rows_of(exact_dedup.exact_duplicates(docs)) == brute(ROWS)
    assert exact_dedup.exact_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("most, bytes_", [(200_000, 1), (5, 0), (5, 32)])
def test_colliding_digests_are_split(spark, monkeypatch, most, bytes_):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (common, exact_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    monkeypatch.setattr(exact_dedup, "HITS_PER_SALT", 7)
    index = exact_dedup.DigestIndex(spark, digest_bytes=bytes_)
    assert rows_of(exact_dedup.exact_duplicates(docs, index)) == brute(rows)


def test_repeated_ids_with_different_texts(spark):
    rows = [(1, "A"), (2, "A"), (2, "B"), (2, "C"), (3, "B"), (None, "C"), (2, "B")]
    for bytes_ in (32, 0):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        index = exact_dedup.DigestIndex(spark, digest_bytes=bytes_)
        assert rows_of(exact_dedup.exact_duplicates(docs, index)) == brute(rows)


@pytest.mark.parametrize("bytes_, most", [(32, 200_000), (1, 200_000), (0, 2)])
def test_batches_of_a_reopened_index(spark, monkeypatch, tmp_path, bytes_, most):
    for module in (common, exact_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITMAPS", most)
    path = f"file://{tmp_path}/index"
    batches = [[(50 + i, f"t{i % 9}") for i in range(30)], [(i, f"t{i % 14}") for i in range(40)], [], [(200, "t3"), (201, "new"), (0, "t13")]]
    before = []
    for batch in batches:
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        index = exact_dedup.DigestIndex(spark, path, bytes_)  # opened anew each time
        # what a lost driver leaves of a generation is overwritten
        index.flush(index.digests(docs.limit(1)), index.generation + 1)
        before += batch
        want = brute(before)
        for d, t in batch:
            assert (d, t) in before
        mine = {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in batch}
        got = rows_of(exact_dedup.exact_duplicates(docs, index))
        assert got == [r for r in want if (r[0], r[4]) in mine]
    assert exact_dedup.DigestIndex(spark, path).generation == len(batches)


def test_filters_rule_out_what_a_level_lacks(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    exact_dedup.exact_duplicates(spark.range(5000).selectExpr("id AS doc_id", "concat('a', id) AS text"), index)
    digests = lambda n, a: index.digests(spark.range(n).selectExpr("id AS doc_id", f"concat('{a}', id) AS text")).select("digest")
    assert index._passed(digests(5000, "a"), 1).count() == 5000
    assert index._passed(digests(20_000, "b"), 1).count() < 20_000 * 0.2


def test_an_index_without_a_path_serves_one_batch(spark):
    index, docs = exact_dedup.DigestIndex(spark), spark.createDataFrame([(1, "x")], "doc_id long, text string")
    exact_dedup.exact_duplicates(docs, index)
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs, index)


def test_query(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert rows_of(catalog.queries()["op9_exact_dedup"](spark, sf_small)) == brute(rows)
