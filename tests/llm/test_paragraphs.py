import random
import re

from pyspark.sql import functions as F

from lodestrata.llm import catalog, paragraphs


def cut(text, lines=False):
    """(start, end, words) of the sentences or lines of at least five words, by plain string handling."""
    found, at = [], 0
    for line in (text or "").split("\n"):
        words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^ \t-\r]+", line)]
        at += len(line) + 1
        group = []
        for k, (a, b) in enumerate(words):
            group.append((a, b))
            if k == len(words) - 1 or not lines and text[b - 1] in ".!?":
                if len(group) >= 5:
                    low = "".join(c.lower() if c.isascii() else c for c in text)
                    found.append((group[0][0], group[-1][1], tuple(low[x:y] for x, y in group)))
                group = []
    return found


def brute(docs, lines=False):
    """{doc_id: removed spans with keep_id} by comparing all distinct paragraphs."""
    units = [(d, a, b, w) for d, t in docs for a, b, w in cut(t, lines)]
    sets = {w: {w[i : i + 5] for i in range(len(w) - 4)} for _, _, _, w in units}
    keys = sorted(sets)
    lead = {k: k for k in keys}

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                lead[find(x)] = find(y)
    first = {}
    for d, a, _, w in sorted(units):
        first.setdefault(find(w), (d, a))
    out = {d: [] for d, _ in docs}
    for d, a, b, w in units:
        if first[find(w)] != (d, a):
            out[d].append((a, b, first[find(w)][0]))
    return {d: sorted(r) for d, r in out.items()}, {d: len(cut(t, lines)) for d, t in docs}


def made(seed):
    random.seed(seed)
    word = lambda: "".join(random.choice(["th", "é", "on", "Re", "in"]) for _ in range(random.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    pool = [sentence(random.randint(3, 90)) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(random.randint(0, 6)):
            line = random.choice(pool) if random.random() < 0.6 else " ".join(sentence(random.randint(4, 20)) for _ in range(random.randint(1, 6)))
            words = line.split(" ")
            if random.random() < 0.4 and len(words) > 1:
                words[random.choice([0, -1])] = word()
            lines.append((" " if random.random() < 0.8 else "\t ").join(words))
        docs.append((d, random.choice(["\n", "\n\n"]).join(lines)))
    return docs


def test_cut_matches_plain_strings():
    docs = made(1) + [(99, None), (100, ""), (101, "  a b c d e. f\n\r x")]
    p = paragraphs.Paragraphs([t for _, t in docs])
    for level in (paragraphs.CUT, paragraphs.WHOLE):
        on = p.levels & level > 0
        got = list(zip(p.documents[on].tolist(), p.start[on].tolist(), p.end[on].tolist()))
        assert got == [(i, a, b) for i, (_, t) in enumerate(docs) for a, b, _ in cut(t, level == paragraphs.WHOLE)]


def test_matches_brute_force(spark, monkeypatch):
    docs = made(2) + [(200, None), (201, "")]
    table = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, k1 long").repartition(5)
    want, counts = brute(docs)
    for chunk, shingles, most in ((2000, 500_000, 1_000_000), (2, 500_000, 0), (2000, 60, 0)):
        monkeypatch.setattr(paragraphs, "CHUNK", chunk)
        monkeypatch.setattr(paragraphs, "CHUNK_SHINGLES", shingles)
        monkeypatch.setattr(paragraphs, "BROADCAST_BANDS", most)
        out = paragraphs.repeated_paragraphs(table).collect()
        assert {r.doc_id: [tuple(x) for x in r.removed] for r in out} == want
        assert {r.doc_id: r.n_paragraphs for r in out} == counts
    assert any(want.values())


def test_query(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want, counts = brute(docs)
    out = catalog.queries()["op3_paragraph_dedup"](spark, sf_small).collect()
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in out}
    assert got == want and {r.doc_id: r.n_paragraphs for r in out} == counts


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated_paragraphs(none).count() == 0


def test_odd_rows(spark):
    line = "one two three four five six seven"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, line), (None, None), (7, line), (7, line), (3, f"{line}\n{line}"), (9, ""), (8, long), (5, long + " end"), (6, "too short")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class string")
    out = {r.doc_id: (r.n_paragraphs, [tuple(x) for x in r.removed]) for r in paragraphs.repeated_paragraphs(docs).collect()}
    n = len(line)
    assert out == {
        None: (1, [(0, n, 3)]), 7: (2, [(0, n, 3), (0, n, 3)]), 3: (2, [(n + 1, 2 * n + 1, 3)]), 9: (0, []),
        8: (1, [(0, len(long), 5)]), 5: (1, []), 6: (0, []),
    }


def test_lines_are_compared_whole(spark):
    random.seed(6)
    docs, fresh = made(6), iter(range(10**6))
    for d in range(100, 130, 3):
        words = [f"w{next(fresh)}" + "." * (i % 9 == 8) for i in range(random.choice([50, 51, 90]))]
        docs.append((d, " ".join(words)))
        docs.append((d + 1, " ".join([*words[:4], "other", *words[5:]])))  # no sentence but the first is changed
        docs.append((d + 2, "before it\n" + " ".join([*words, "more"])))  # 50 words become 51
    same = "it goes on and on and on for long. Yes. " * 8
    docs += [(140, same), (141, same)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = paragraphs.repeated_paragraphs(table).collect()
    want = brute(docs, True)[0]
    assert {r.doc_id: [tuple(x) for x in r.removed_lines] for r in out} == want
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in out} == brute(docs)[0]
    assert all(want[d + 1] and want[d + 2] for d in range(100, 130, 3)) and want[141] == [(0, len(same) - 1, 140)]


def test_query_lines(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    out = catalog.queries()["op3_paragraph_dedup"](spark, sf_small).collect()
    assert {r.doc_id: [tuple(x) for x in r.removed_lines] for r in out} == brute(docs, True)[0]
    assert all(r.n_removed_lines == len(r.removed_lines) for r in out)


def test_words_that_polynomials_confuse(spark):
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"one two three four {morse}"), (2, f"one two three four {other}"), (3, f"one two three four {morse}")]
    out = {r.doc_id: len(r.removed) for r in paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 0, 3: 1}


def test_few_shingles(spark):
    docs = [(1, "la " * 5), (2, "la " * 9), (3, "a b c d e a b c d e a b"), (4, "a b c d e f"), (5, "a b c d e"), (6, "b c d e f a"),
            (7, "a b c d e a b c d e"), (8, "a b c d e a b c d e a"), (None, "la " * 7)]
    want = brute([(9 if d is None else d, t) for d, t in docs])[0]
    out = paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {9 if r.doc_id is None else r.doc_id: [tuple(x) for x in r.removed] for r in out} == want and want[2] and want[9]


def test_large_bands_are_not_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "CHUNK", 50)
    random.seed(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{d}", *base[k + 1 :]]) for d in range(3000) for k in [random.choice((0, 1, 58, 59))]]
    texts += [" ".join(base[:40] + [f"y{i % 7}{j}" for j in range(20)]) for i in range(40)]  # not near those
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    units = paragraphs.written(paragraphs.with_mapped(docs, "text", f"p {paragraphs.PARAGRAPHS}", lambda: paragraphs._signed).selectExpr("doc_id", "inline(p)"), "units")
    members = paragraphs._members(units)
    nodes = paragraphs._nodes(members)
    each = members.join(nodes.select("k1", "k2", "id"), ["k1", "k2"]).selectExpr("band AS g", "id", "1 AS level", "size")
    links, left = paragraphs.around_pivots(paragraphs.written(each, "rows"), paragraphs.written(paragraphs._shingle_sets(docs, nodes), "sets"), F.expr("n <= 50"))
    rows = left.count()
    assert links.count() >= 2900 and rows < 1000
    out = {r.doc_id: [x.keep_id for x in r.removed] for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert all(out[d] == [0] for d in range(1, 3000)) and out[0] == [] == out[3000]
    assert sorted(len(out[d]) for d in range(3000, 3040)) == [0] * 7 + [1] * 33
