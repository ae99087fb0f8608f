import random
import re
import time

import pytest

from lodestrata.llm import secrets

PATTERNS = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def brute(text):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def texts(n):
    random.seed(6)
    words = ["token", "TOKEN", "secret", "Api_Key", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678",
             "deadbeef" * 4, "0123456789abcdef", "é", "😀", "x", "-", "apikey", "\n"]
    return ["".join(random.choice(words) for _ in range(random.randint(0, 14))) for _ in range(n)] + [None, "", "token=" * 3000 + "abcdefgh"]


@pytest.mark.parametrize("most", [200_000, 150, 0])
def test_matches_patterns(spark, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", most)
    rows = list(enumerate(texts(300))) + [(0, "again"), (900, texts(300)[0])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "path long, text string, blob string")
    ledger = secrets.BlobLedger(spark, rules=secrets.BASE)
    ledger.update(docs.select("path", "text", "blob"))
    got = sorted((r.path, [(s.kind, s.start, s.end) for s in r.spans]) for r in ledger.findings(docs).collect())
    assert got == sorted((i, brute(t)) for i, t in rows)


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secrets.BlobLedger(spark, rules=secrets.BASE)
    first = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "plain")], "path long, text string")
    ledger.update(first)
    assert ledger.scanned == 2 and ledger.read().count() == 2 * len(secrets.BASE)
    ledger.update(first.union(spark.createDataFrame([(3, "plain"), (4, "new")], "path long, text string")))
    assert ledger.scanned == 1
    ledger.rules = (*secrets.BASE, secrets.Rule("word", 1, "plain"))
    ledger.update(first)
    assert ledger.scanned == 2 and ledger.read().count() == 3 * len(secrets.BASE) + 2
    spans = {r.path: [s.kind for s in r.spans] for r in ledger.findings(first).collect()}
    assert spans == {1: ["assign"], 2: ["word"]}
    ledger.update(first.where("false"))
    assert ledger.scanned == 0


def test_a_reopened_ledger_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "plain")], "path long, text string")
    secrets.BlobLedger(spark, path, secrets.BASE).update(docs)
    docs.limit(1).write.parquet(f"{path}/update=lost")  # an update that a lost driver left unfinished does not count
    (tmp_path / "ledger" / "update=lost" / "_SUCCESS").unlink()
    again = secrets.BlobLedger(spark, path, secrets.BASE)
    more = docs.union(spark.createDataFrame([(3, "plain"), (4, "secret: 12345678")], "path long, text string"))
    again.update(more)
    assert again.scanned == 1 and again.read().count() == 3 * len(secrets.BASE)
    found = {r.path: [tuple(s) for s in r.spans] for r in secrets.BlobLedger(spark, path, secrets.BASE).findings(more).collect()}
    assert found == {1: [("assign", 0, 17)], 2: [], 3: [], 4: [("assign", 0, 16)]}


def test_no_rows_and_no_updates(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh1"), (None, None)], "path long, text string")
    ledger = secrets.BlobLedger(spark)
    assert [r.spans for r in ledger.findings(docs).collect()] == [[], []]
    ledger.update(docs)
    assert ledger.findings(docs.where("false")).count() == 0


def test_positions_take_a_time_in_proportion_to_the_hits(spark):
    text = "é token=abcdefgh1 " * 100_000
    docs = spark.createDataFrame([(1, text)], "path long, text string")
    ledger = secrets.BlobLedger(spark, rules=secrets.BASE)
    began = time.perf_counter()
    ledger.update(docs)
    spans = ledger.findings(docs).first().spans
    assert time.perf_counter() - began < 60
    assert [(s.start, s.end) for s in spans] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]


@pytest.mark.parametrize("unit", ["eyJ", "eyJ-", "eyJabcdefgh.", "eyJabcdefgh.eyJ", "AKIA", "password", "password = ", "secret:", "token   ", "-----BEGIN ", "-----BEGIN A", "0f", "api_key'"])
def test_long_runs_take_a_time_in_proportion_to_their_length(spark, unit):
    """A million characters that begin matches everywhere and end none, or one: seconds, for every rule."""
    text = unit * (1_000_000 // len(unit))
    docs = spark.createDataFrame([(1, text), (2, text + ".")], "path long, text string")
    ledger = secrets.BlobLedger(spark)
    began = time.perf_counter()
    ledger.update(docs)
    assert time.perf_counter() - began < 40 and ledger.read().count() == 2 * len(ledger.rules)


def test_tokens_have_headers_of_bounded_length(spark):
    rest = ".eyJ" + "b" * 3000 + "." + "c" * 9
    docs = spark.createDataFrame([(1, "x eyJ" + "a" * 509 + rest), (2, "x eyJ" + "a" * 510 + rest), (3, "eyJ" + "a" * 8 + rest)], "path long, text string")
    ledger = secrets.BlobLedger(spark)
    ledger.update(docs)
    found = {r.path: [tuple(s) for s in r.spans if s.kind == "jwt"] for r in ledger.findings(docs).collect()}
    assert found == {1: [("jwt", 2, 2 + 512 + len(rest))], 2: [], 3: [("jwt", 0, 11 + len(rest))]}
