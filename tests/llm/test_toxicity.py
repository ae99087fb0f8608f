import math
import random
from itertools import combinations

import numpy as np

from lodestrata.llm import catalog, toxicity


def brute_kernel(a, b):
    def weights(word):
        found = {}
        for at in combinations(range(len(word)), 4):
            steps = [y - x for x, y in zip(at, at[1:])]
            if max(steps) <= 2:
                s = "".join(word[i] for i in at)
                found[s] = found.get(s, 0) + toxicity.DECAY ** (sum(steps) - 3)
        return found

    x, y = weights(a), weights(b)
    return sum(v * y[s] for s, v in x.items() if s in y)


def test_features_are_the_kernel():
    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in "ab")
        x, y = toxicity.features(a), toxicity.features(b)
        assert np.isclose(sum(v * y.get(s, 0) for s, v in x.items()), brute_kernel(a, b))


def test_batches_find_what_features_hold():
    words = ["idiot", "worthless", "loser"]
    known = np.full(1 << 20, -1, np.int32)
    strings = sorted({f for w in words for f in toxicity.features(w)})
    known[strings] = np.arange(len(strings))
    texts = ["An idiot. A wor-thless LÓSER\nx", "", "i d i o t idiot idiot", "loser " * 30]
    batch = toxicity.Batch(texts)
    assert list(batch.documents) == [0, 0, 0, 2, 3, 3]
    place, entry, weight = batch.occurrences(known)
    total = np.bincount(batch.segments[place], weight, len(batch.documents))
    size = {w: sum(toxicity.features(w).values()) for w in words}
    assert np.isclose(total[0], size["idiot"]) and np.isclose(total[4], size["loser"]) and np.isclose(total[5], size["loser"])
    assert total[2] == 0 and np.isclose(total[3], size["idiot"] + toxicity.DECAY**3 * 2)
    assert total[1] > 0.5 * (size["worthless"] + size["loser"])


def examples(n, seed):
    random.seed(seed)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(random.choice(["th", "er", "on", "in", "ed", "re"]) for _ in range(random.randint(1, 4))) for _ in range(60)]
        if k % 3 == 0:
            for _ in range(3):
                words[random.randrange(60)] = random.choice(["grumbo", "klotze", "snarfix"])
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_learns_and_tolerates_insertions():
    model = toxicity.fit(*examples(300, 1))
    texts, labels = examples(150, 2)
    found = model.scores(texts) >= 0.5
    assert (found == np.array(labels, bool)).mean() > 0.97
    clean = [t for t, y in zip(texts, labels) if not y]
    odd = [t + " gru-mbo klo.tze snar*fix grum_bo" for t in clean]
    assert (model.scores(odd) > model.scores(clean)).mean() > 0.95
    empty = model.scores([None, "", " \n"])
    assert np.ptp(empty) == 0 and empty[0] < 0.5
    for few in ([], ["a"]), ([], [1]):
        got = toxicity.fit(few[0], few[1][: len(few[0])] if few[0] else [])
        assert 0 <= got.scores(["x"])[0] <= 1


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in catalog.queries()["op2_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(out[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert np.mean([b > g for b in bad for g in good]) > 0.85


def test_odd_rows(spark):
    texts, labels = examples(60, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "y"), (None, "", "z")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, None), (None, 1), (0, labels[0])], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(out) == 62 and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(docs.where("false"), marks.where("false"))
    assert toxicity.score(docs.select("doc_id", "text"), none).count() == 62


def test_very_long_texts_and_empty_tables(spark):
    texts, labels = examples(90, 4)
    long = " ".join(texts[:1]) + " plain words of no harm" * 20_000
    docs = spark.createDataFrame([*enumerate(texts), (500, long), (501, long + " grumbo klotze snarfix")], "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels), (500, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)  # the long one with label 1 is not learned from
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, to="score").collect()}
    assert len(got) == len(texts) + 2 and got[501] >= got[500]
    assert toxicity.score(docs.where("false"), model).count() == 0
    nothing = spark.createDataFrame([(None, "x")], "doc_id long, text string").select(toxicity.held_out().alias("h")).first()
    assert nothing.h is False


def test_repeated_ids_are_rows(spark, monkeypatch):
    """One id for all rows, labels without a text, and texts over the bound: what is drawn fills the bound with what can be read."""
    texts, labels = examples(120, 6)
    toxic = [t for t, y in zip(texts, labels) if y]
    rows = [(7, t) for t in toxic] + [(100 + i, t) for i, (t, y) in enumerate(zip(texts, labels)) if not y] + [(900 + i, "x" * 70_000) for i in range(50)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    marks = spark.createDataFrame([(7, 1)] + [(100 + i, 0) for i in range(120)] + [(900 + i, 1) for i in range(50)] + [(5000 + i, 1) for i in range(500)], "doc_id long, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity, "fit", lambda t, y, share: drawn.append((t, y)))
    toxicity.train(docs, marks, positives=20)
    assert (drawn[0][1].count(1), drawn[0][1].count(0)) == (20, 40) and set(drawn[0][0]) <= {t for _, t in rows}
    toxicity.train(docs, marks, positives=1000)
    assert sorted(t for t, y in zip(*drawn[1]) if y) == sorted([*toxic, toxic[0]])


def brute_features(word):
    found = {}
    for at in combinations(range(len(word)), 4):
        steps = [y - x for x, y in zip(at, at[1:])]
        if max(steps) <= 2:
            s = "".join(word[i] for i in at)
            found[s] = found.get(s, 0) + toxicity.DECAY ** (sum(steps) - 3)
    return found


def test_scores_are_those_of_the_kernel_expansion():
    """The folded weights give what the machine's expansion over the landmarks gives, kernel by kernel."""
    texts, labels = examples(120, 5)
    model = toxicity.fit(texts, labels)
    words = model.landmarks
    norms = [math.sqrt(sum(v * v for v in brute_features(w).values())) or 1.0 for w in words]
    gram = np.array([[brute_kernel(a, b) / (x * y) for b, y in zip(words, norms)] for a, x in zip(words, norms)])
    assert np.allclose(gram, gram.T) and np.allclose(np.diag(gram), 1.0)
    spoken = {toxicity.features(w) and w for w in words}
    assert len(spoken) == len(words)
    # the expansion's coefficients, from the folded weights of the landmarks' own subsequences
    strings = sorted({f for w in words for f in toxicity.features(w)})
    phi = np.zeros((len(strings), len(words)))
    for k, w in enumerate(words):
        for f, v in toxicity.features(w).items():
            phi[strings.index(f), k] = v / norms[k]
    alpha, *_ = np.linalg.lstsq(phi, model.weights, rcond=None)
    assert np.allclose(phi @ alpha, model.weights, atol=1e-6)
    for text in ("grumbo", "klotze", "snarfix", "snar-fix", "therin"):
        batch = toxicity.Batch([text])
        place, entry, weight = batch.occurrences(model.known)
        folded = np.bincount(batch.segments[place], weight * model.weights[entry], len(batch.documents))
        held = "".join(c for c in text if c.isalpha())
        if len(batch.documents) == 1 and held == text:
            direct = sum(a * brute_kernel(text, w) / n for a, w, n in zip(alpha, words, norms))
            assert np.isclose(folded[0], direct, atol=1e-6)


def test_query_scores_whole_texts_with_what_was_learned(spark, sf_small):
    """Every row's score and fold, by a model that is fitted here from the rows that the contract allows."""
    import zlib

    remainder = lambda d: zlib.crc32(str(d).encode()) % 5
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect() if remainder(r.doc_id)}
    rows = [(d, docs[d], y) for d, y in sorted(marks.items()) if docs.get(d) is not None and len(docs[d].encode()) <= toxicity.TEXT_BYTES]
    assert sum(marks.values()) <= toxicity.POSITIVES and len(marks) - sum(marks.values()) <= 2 * toxicity.POSITIVES  # all are learned from
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows], sum(marks.values()) / len(marks))
    got = {r.doc_id: r for r in catalog.queries()["op2_toxicity"](spark, sf_small).collect()}
    assert got.keys() == docs.keys()
    for d, want in zip(docs, model.scores(list(docs.values()))):
        assert abs(got[d].score - want) < 1e-6 and got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (remainder(d) == 0)


def plain_segments(text):
    """The words of each segment, as lists of symbols in which 0 is no letter, with the space between letters that stand alone."""
    import unicodedata

    def symbol(c):
        cp = ord(c)
        if cp >= 0x250:
            return 27 + cp % 5
        c = toxicity._LEET.get(c, unicodedata.normalize("NFD", c.lower())[0])
        return ord(c) - 96 if "a" <= c <= "z" else 27 + cp % 5 if c.isalpha() else 0

    space = lambda c: ord(c) < 0x250 and c.isspace()
    tokens, at = [], 0
    while at < len(text):
        if space(text[at]):
            at += 1
            continue
        end = at
        while end < len(text) and not space(text[end]):
            end += 1
        tokens.append((at, end))
        at = end
    alone = lambda t: t[1] - t[0] == 1 and symbol(text[t[0]]) > 0
    segments, count, closed = [], 0, True
    for k, (a, b) in enumerate(tokens):
        former = tokens[k - 1] if k else None
        follows = bool(former) and alone(former) and alone((a, b)) and a - former[1] == 1 and text[former[1]] != "\n"
        if closed:
            count = 0
        if closed or (count % toxicity.SEGMENT_WORDS == 0 and not follows):
            segments.append([])
        word = [symbol(c) for c in text[a:b]]
        if follows:
            segments[-1][-1] += [0, *word]
        else:
            segments[-1].append(word)
        count += 1
        after = tokens[k + 1] if k + 1 < len(tokens) else None
        joins = bool(after) and alone((a, b)) and alone(after) and after[0] - b == 1 and text[b] != "\n"
        closed = (text[b - 1] in ".!?" or b == len(text) or text[b] == "\n") and not joins
    return segments


def plain_features(symbols):
    found = {}
    for i in range(len(symbols)):
        for a in (1, 2):
            for b in (1, 2):
                for c in (1, 2):
                    if i + a + b + c < len(symbols):
                        four = symbols[i], symbols[i + a], symbols[i + a + b], symbols[i + a + b + c]
                        if all(four):
                            found[four] = found.get(four, 0) + toxicity.DECAY ** (a + b + c - 3)
    return found


def plain_machine(z, y, cost, penalty):
    """The least of penalty and squared hinge losses, by Newton steps that are halved until they lessen it, to a vanishing gradient."""
    x = np.c_[z, np.ones(len(z))]
    ridge = penalty * cost.sum() * np.r_[np.ones(z.shape[1]), 1e-3]
    value = lambda w: (ridge * w * w).sum() / 2 + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() / 2
    w = np.zeros(x.shape[1])
    for _ in range(200):
        on = y * (x @ w) < 1
        slope = ridge * w - x[on].T @ (cost[on] * (y[on] - x[on] @ w))
        if np.abs(slope).max() < 1e-8 * cost.sum():
            break
        step = np.linalg.solve(np.diag(ridge) + (x[on].T * cost[on]) @ x[on], slope)
        size = 1.0
        while value(w - size * step) > value(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w


def test_margins_of_a_plain_machine(spark, sf_small):
    """The whole model by its definition: Gram matrices over all words and landmarks, their inverse root, the machine and its rounds."""
    docs, marks = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    toxic = {r.doc_id: r.toxic for r in marks.where("toxic in (0, 1)").collect()}
    ids = [d for d in sorted(toxic) if d in texts]
    learned = [texts[d] for d in ids] + [toxicity.stretched(texts[d], k) for k, d in enumerate(ids)]
    label = np.array([toxic[d] for d in ids] * 2, float)
    marks_of = [plain_features([ord(c) - 96 for c in w]) for w in model.landmarks]
    norms = [math.sqrt(sum(v * v for v in m.values())) or 1.0 for m in marks_of]
    dot = lambda f, g: sum(v * g[s] for s, v in f.items() if s in g)
    known = {}

    def kernels(symbols):
        key = tuple(symbols)
        if key not in known:
            f = plain_features(symbols)
            known[key] = np.array([dot(f, m) / n for m, n in zip(marks_of, norms)])
        return known[key]

    def mapped(text):
        return [sum((kernels(w) for w in {tuple(w): w for w in s}.values()), np.zeros(len(norms))) for s in plain_segments(text)]

    gram = np.array([[dot(f, g) / (m * n) for g, n in zip(marks_of, norms)] for f, m in zip(marks_of, norms)])
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    rows = [mapped(t) for t in learned]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = np.array([s for r in rows for s in r]) @ root
    sure = label[owner] > 0
    for _ in range(toxicity.ROUNDS):
        clean = label[owner] == 0
        cost = (sure / max(1, sure.sum()) + clean / max(1, clean.sum())) * len(z) / 2
        w = plain_machine(z[cost > 0], np.where(sure, 1.0, -1.0)[cost > 0], cost[cost > 0], toxicity.PENALTY)
        got = z @ w[:-1] + w[-1]
        best = [max((g for g, o in zip(got[lo:hi], owner[lo:hi])), default=0) for lo, hi in zip(np.searchsorted(owner, range(len(rows))), np.searchsorted(owner, range(len(rows)), "right"))]
        sure = (label[owner] > 0) & ((got >= np.array(best)[owner]) | (got > 0.5))
    want = []
    for text in texts.values():
        sums = sorted((float(s @ root @ w[:-1] + w[-1]) for s in mapped(text)), reverse=True)
        want.append([*sums, w[-1], w[-1]][:2] if len(sums) < 2 else sums[:2])
    have = model.margins(list(texts.values()))
    assert len(texts) > 100 and np.abs(have - np.array(want)).max() < 0.05
    assert np.corrcoef(have[:, 0], np.array(want)[:, 0])[0, 1] > 0.9999
