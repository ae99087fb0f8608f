import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lodestrata.llm import byte_bpe, decontaminate, simhash


def brute(docs, items):
    """{doc_id: token ids} of (doc_id, text) rows by plain loops."""
    kept = {d: t for d, t in docs if t and any(c.isalpha() for c in t)}
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", kept[d]), d)
    kept = {d: kept[d] for d in first.values()}
    ids = sorted(kept)
    fps = np.array([simhash.fingerprint(kept[d]) for d in ids], dtype=np.uint64)
    lead = list(range(len(ids)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(ids)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            a, b = sorted((find(i), find(j)))
            lead[b] = a
    kept = {d: kept[d] for i, d in enumerate(ids) if find(i) == i}
    from .test_decontaminate import brute_near

    texts = [decontaminate.normal(t) for t in items]
    kept = {d: t for d, t in kept.items() if not any(brute_near(x, decontaminate.normal(t)) for x in texts)}
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(raw), special_tokens={})
    return {d: bpe.encode_ordinary(t) for d, t in kept.items()}


def test_pipeline_matches_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_small).collect()
    got = {r.doc_id: list(memoryview(bytes(r.ids)).cast("I")) for r in out}
    assert got == brute(docs, items) and len(got) == len(out)
    assert all(r.exact and r.n_tokens == len(got[r.doc_id]) for r in out)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_small):
    text = "The cat sat on the mat, and the dog lay by the door of the old house near the mill."
    rows = [(1, text, "en", "a", 1, "p"), (2, text.replace(" ", "\n"), "en", "b", 2, "q"), (3, None, None, None, None, None), (4, "", "en", "c", 0, "r"),
            (5, "12 34 !!", None, "d", 8, "s"), (6, "Ein anderer Text über den Hund und die Katze im Garten.", "de", "e", 5, "t")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns, name
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
        assert sorted(r.doc_id for r in last) == ([1, 6] if data else []) and all(r.exact for r in last)


def test_one_row_of_each_group_stays(spark, sf_small):
    x = "The cat sat on the mat, and the dog lay by the door of the old house near the mill."
    y, z = "Ein anderer Text über den Hund und die Katze im Garten.", "Nobody had seen the letters that were kept in the attic for years."
    rows = [(5, x), (1, x.replace(" ", "\n")), (5, y), (5, y), (None, x), (None, z), (None, z), (7, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(3)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns
        got = sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in out.collect())
        assert got == [("1", x), ("5", y), ("7", ""), ("None", z)]


def test_columns_of_any_name(spark, sf_small):
    x = "The cat sat on the mat, and the dog lay by the door of the old house near the mill."
    names = "language language_score matches found at row _language _score _matches _found kept keep_id component_id fp digest sha".split()
    rows = [(5, x, "en"), (1, x, "en"), (None, x + " More.", "en"), (5, "Nobody had seen the letters in the attic for years.", "en")]
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], ["doc_id", "text", "lang", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns, name
        docs = out
    left = docs.collect()
    assert sorted((str(r.doc_id), r.matches) for r in left) in ([("1", "matches1"), ("5", "matches3")], [("1", "matches1"), ("5", "matches3"), ("None", "matches2")])
    assert all(r[n].startswith(n) for r in left for n in names)


def test_only_odd_rows_are_numbered(spark, sf_small, monkeypatch):
    """Rows with a doc_id of their own are neither sorted nor written again, whatever else the table holds."""
    x = "The cat sat on the mat, and the dog lay by the door of the old house near the mill."
    rows = [(i, f"{x} {i * i}") for i in range(20)] + [(None, "alone here"), (3, "another text of row three"), (3, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables, write = {}, corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, tag: tables.setdefault(tag, write(df, tag)))
    out = corpus_pipeline.exact(spark, docs, sf_small)
    assert tables["pipeline-rows"].count() == 4 and out.count() == 23
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan


def test_odd_rows_by_brute_force(spark, sf_small):
    import random

    rng = random.Random(4)
    texts = [f"word{i} stands in a row of its own with number {i * 7919}" for i in range(6)] + [None, ""]
    for _ in range(3):
        rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice(texts)) for _ in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        lows = {}
        for d, t in rows:
            k = " ".join((t or "").split())
            lows[k] = min(lows.get(k, (True, 0)), (d is None, d or 0))
        for stage in (corpus_pipeline.exact, corpus_pipeline.near):
            got = sorted((r.doc_id is None, r.doc_id or 0, " ".join((r.text or "").split())) for r in stage(spark, docs, sf_small).collect())
            assert got == sorted((*low, k) for k, low in lows.items())
