import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import catalog, lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def plain(rows, min_docs, min_chars):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(d)
    often = {k: max(ds, key=lambda d: (d is not None, d or 0)) for k, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in often or often[key(x)] == d]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df, **given):
    kept = lines.keep_bitmaps(df, **given)
    rows = kept.select("doc_id", "n_lines", lines.n_dropped(F.col("keep")), lines.kept_text(F.col("text"), F.col("keep"))).collect()
    return sorted(map(tuple, rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [10_000, 3, 1])
def test_equals_the_definition(spark, hot):
    rng = random.Random(3)
    pool = ["Licence ÄÉ", "  licence ÄÉ\t", "LICENCE äé", "abcde", "ABCDE\r", "abcd", "", "fünf!", "\x0bfünf!", "a b c"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(40)]
    rows += [(5, "abcde\nabcde\nabcde"), (None, "abcde\nfünf!"), (None, None), (77, ""), (78, None), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(i, "abcde") for i in range(100, 130)]
    rng.shuffle(rows)
    for min_docs in (2, 5):
        assert found(frame(spark, rows), min_docs=min_docs, min_chars=5, hot=hot) == plain(rows, min_docs, 5)


def test_boundaries_of_the_contract(spark):
    line, short = "x" * 38 + "éé", "y" * 39
    four = [(i, f"{line}\n{short}") for i in range(4)]
    assert all(r[2] == 0 for r in found(frame(spark, four)))
    five = found(frame(spark, [*four, (9, f"{line}\n{line}\nz")]))
    assert [r[2] for r in five] == [1, 1, 1, 1, 0]
    # rows that share a doc_id are one document
    assert all(r[2] == 0 for r in found(frame(spark, [*four, (3, f"{line}!"), (3, line)])))


def test_bitmap_is_run_lengths(spark):
    line = "w" * 40
    rows = [(i, line) for i in range(5)] + [(-1, f"a\n{line}\n{line}\nb\nc\n{line}"), (-2, f"{line}\nx"), (-3, "one\ntwo")]
    kept = {r.doc_id: r.keep for r in lines.keep_bitmaps(frame(spark, rows)).collect()}
    assert (kept[-1], kept[-2], kept[-3], kept[4], kept[0]) == ([1, 2, 2, 1, 0], [0, 1, 1], [2], [1], [0, 1, 0])


def test_odd_tables(spark):
    clash = frame(spark, [(1, "a")]).withColumns({"keep": F.lit(1), "N_LINES": F.lit(2), "tag": F.lit(3), "_doc": F.lit(4), "dropped": F.lit(5)})
    row = lines.keep_bitmaps(clash).collect()[0]
    assert (row["keep"], row["N_LINES"], row["tag"], row["_doc"], row["n_lines_"], row["keep_"]) == (1, 2, 3, 4, 1, [1])
    assert lines.keep_bitmaps(frame(spark, [])).collect() == []
    long = "\n".join(f"{'line ' * 10}{i % 50_000}" for i in range(200_000))
    rows = [(i, long) for i in range(5)]
    assert [r[2] for r in found(frame(spark, rows))] == [200_000] * 4 + [0]


def test_ranges_serve_the_windows(spark, monkeypatch):
    """Sorted rows are shuffled once, by ranges, and their windows need no further shuffle or sort."""
    plans, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, tag: (plans.__setitem__(tag, df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    lines.dropped_lines(frame(spark, [(1, "z" * 50)]))
    plan = plans["streamed-lines"]
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0
    assert plan.count("Sort [") == 1


def test_query_equals_its_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf_small}/documents.parquet'")
    want = sorted(con.execute(lines.SQL).fetchall())
    got = sorted(map(tuple, catalog.op12_line_dedup(spark, sf_small).collect()))
    assert got == want and sum(r[2] for r in got) > 0
