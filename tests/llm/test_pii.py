import hashlib
import random
import re

import pytest

from lodestrata.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                ok = 12 <= len(digits) <= 19 and pii._luhn(list(digits))
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                found.append((m.start(), k, m.end()))
    return [(pii.BASE[k], a, b) for a, k, b in sorted(found)]


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


@pytest.mark.parametrize("alphabet", ["0123 -.+()", "01+ -.", "ab@.-1", "a@.é😀 1-+", "4111 -.@a+("])
def test_agrees_with_patterns(alphabet):
    random.seed(alphabet)
    for _ in range(4000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        assert base(text) == brute(text), text


def test_known_cases():
    text = "Mail a.b@c.de, 10.0.0.255 or 10.0.0.256; card 4111-1111 1111 1111 phone +49 (30) 1234-567."
    assert [(k, text[a:b]) for k, a, b in base(text)] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111-1111 1111 1111"), ("phone", "+49 (30) 1234-567"),
    ]
    more = "see https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00 is"
    assert [(k, more[a:b]) for k, a, b in pii.find(more) if k in ("url", "iban")] == [
        ("url", "https://x.org/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ]
    assert pii.find("") == [] and pii.find("9" * 100_000) == []


def test_table(spark):
    rows = [(1, "a@b.c", "x"), (2, None, "y"), (3, "", None), (None, "é +123456789 a@b.c", "z"), (1, "a@b.c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.digest_columns(pii.spans(docs.select("doc_id", "text"))).collect()
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out)
    assert got == [(0, 1, 0, 0, 1, "phone:2:12,email:13:18"), (1, 1, 0, 0, 0, "email:0:5"), (1, 1, 0, 0, 0, "email:0:5"),
                   (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, "")]
    empty = {r.base_sha256 for r in out if not r.spans}
    assert empty == {hashlib.sha256(b"").hexdigest()}
    from pyspark.sql import functions as F

    shown = pii.spans(docs.select("doc_id", "text")).select(pii.redacted(F.col("text"), F.col("spans")).alias("r"))
    assert "é [phone] [email]" in [r.r for r in shown.collect()]
    assert pii.digest_columns(pii.spans(docs.select("doc_id", "text").where("false"))).count() == 0


def test_query_matches_patterns(spark, sf_small):
    from lodestrata.llm import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in catalog.queries()["op6_pii"](spark, sf_small).collect():
        want = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
