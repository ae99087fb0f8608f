import random

from lodestrata.llm import catalog, decontaminate


def brute(item, text):
    """(distance, ends) of the passages of text nearest to item, by the whole matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_distance_matches_matrix():
    random.seed(3)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    for _ in range(500):
        item, text = word(random.randint(1, 12)), word(random.randint(1, 25))
        want, end = brute(item, text)
        got = decontaminate.nearest(item, text, len(item))
        if want < len(item):
            assert got[0] == want and got[2] == end
            assert brute(item, text[got[1] : got[2]])[0] == want
        assert decontaminate.nearest(item, text, want - 1) is None


def edited(text, k):
    text = list(text)
    for _ in range(k):
        i = random.randrange(len(text))
        kind = random.randrange(3)
        if kind == 0:
            text[i] = random.choice("xyz")
        elif kind == 1:
            text.insert(i, random.choice("xyz"))
        else:
            del text[i]
    return "".join(text)


def test_none_within_budget_is_missed():
    random.seed(4)
    filler = lambda n: " ".join("".join(random.choice("etaoin") for _ in range(5)) for _ in range(n))
    items = [(k, filler(random.randint(8, 40))) for k in range(20)]
    matcher = decontaminate.Matcher(items)
    for _ in range(300):
        k, item = random.choice(items)
        normal, budget = decontaminate.normal(item), matcher.budgets[k]
        passage = edited(normal, random.randint(0, budget + 2))
        text = filler(20) + "\n\n" + passage.replace(" ", "  \n", 2).upper() + " " + filler(20)
        want = brute(normal, decontaminate.normal(text))[0]
        got = {m[0]: m for m in matcher.find(text)}
        assert (k in got) == (want <= budget)
        if k in got:
            _, a, b, d = got[k]
            assert d == want and brute(normal, decontaminate.normal(text[a:b]))[0] == d
        assert set(got) <= {k}


def test_table(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs"
    marks = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "unrelated words that never do occur")], "item_id long, text string")
    rows = [(1, f"See: {item.upper()}!", "a"), (2, None, "b"), (3, "", "c"), (None, item.replace("fox", "f0x"), "d"), (5, item[:30], "e"), (1, item, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for size in (400_000, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", size)
        out = decontaminate.matches(docs, marks).collect()
        got = {(r.doc_id, r.item_id): [tuple(m) for m in r.matches] for r in out}
        assert got == {(1, "a"): [(1, 5, 57, 0)], (2, "b"): [], (3, "c"): [], (None, "d"): [(1, 0, 52, 1)], (5, "e"): [], (1, "f"): [(1, 0, 52, 0)]}
    assert decontaminate.matches(docs.where("false"), marks).count() == 0
    assert {len(r.matches) for r in decontaminate.matches(docs, marks.where("false")).collect()} == {0}


def test_query_finds_all_exact_passages(spark, sf_small):
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontaminate.normal(r.text or "") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in catalog.queries()["op4_decontaminate"](spark, sf_small).collect()}
    want = {(d, k) for d, t in docs.items() for k, item in items.items() if brute_near(item, t)}
    assert got == want and got


def brute_near(item, text):
    """Whether a passage of text is within the budget, with numpy: one row of the matrix at a time."""
    import numpy as np

    t = np.array([ord(c) for c in text])
    row = np.zeros(len(t) + 1, int)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
        new = np.concatenate(([i], new))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= int(len(item) * decontaminate.ERROR_RATE)


def test_all_passages_are_given():
    random.seed(8)
    filler = lambda n: " ".join("".join(random.choice("etaoin") for _ in range(5)) for _ in range(n))
    items = [(k, filler(random.randint(8, 30))) for k in range(10)]
    matcher = decontaminate.Matcher(items)
    for _ in range(100):
        k, item = random.choice(items)
        budget, text, n = matcher.budgets[k], filler(3), random.randint(1, 5)
        for _ in range(n):
            text += " " + edited(item, random.choice([0, 0, random.randint(0, budget // 2)])) + " " + filler(random.choice([0, 1, 30]))
        text = decontaminate.normal(text)
        got = matcher.find(text)
        assert len(got) == n and {m[0] for m in got} == {k} and all(x[2] <= y[1] for x, y in zip(got, got[1:]))
        assert all(brute(item, text[a:b])[0] <= d <= budget for _, a, b, d in got)
        rest = [0, *(x for m in got for x in m[1:3]), len(text)]  # no passage is left between them
        assert all(brute(item, text[a:b])[0] > budget for a, b in zip(rest[::2], rest[1::2]))
