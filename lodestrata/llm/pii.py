"""Personal data by anchor expansion.

One Aho-Corasick automaton finds what personal data is anchored on: at-signs, plus signs before a digit, dots between
digits, pairs of digits, schemes and words that announce an account. A local parser for each kind expands an anchor to
its boundaries and validates what it has found. Parsers are deterministic, never look back past the end of the last
span of their kind, and agree with the leftmost non-overlapping matches of the base patterns.

Base kinds: email, ip, card, phone. Added: url (a scheme and what follows it) and iban (an account number, validated by
its check digits, that a cue word announces). Spans are code points, end exclusive.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_kind, joined_spans, with_mapped

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

_DIGITS = "0123456789"
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_LOCAL = _LABEL | frozenset("._%+")
_AFTER_PLUS = frozenset(" ().0123456789-")
_IBAN = re.compile(r"[^0-9A-Za-z]{0,12}([A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]){10,30})")
_URL_END = re.compile(r"[^\s<>\"'|]*")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 0))
    for a in _DIGITS:
        found.add_word(f"+{a}", ("phone", 1))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 2))
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", ("card", len(gap) + 1))
    for scheme in SCHEMES:
        for word in (scheme, scheme.upper()):
            found.add_word(word, ("url", len(word) - 1))
    for cue in CUES:
        for word in (cue, cue.upper(), cue.capitalize()):
            found.add_word(word, ("iban", 0))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels, i = len(text), at, 0, at + 1
    while True:
        j = i
        while j < n and text[j] in _LABEL:
            j += 1
        if j == i:
            break
        end, labels = j, labels + 1
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return (start, end, True) if labels >= 2 else None


def _ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: the first digit of a digit, dot, digit."""
    start, n = at, len(text)
    while start > floor and text[start - 1] in _DIGITS:
        start -= 1
    i, parts = start, []
    while len(parts) < 4:
        j = i
        while j < n and text[j] in _DIGITS:
            j += 1
        if j == i:
            return None
        parts.append(text[i:j].lstrip("0"))
        if len(parts) < 4 and (j >= n or text[j] != "."):
            return None
        i = j + 1
    return start, j, all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    n, i, digits = len(text), at + 1, [text[at]]
    while i < n:
        if text[i] in _DIGITS:
            digits.append(text[i])
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _DIGITS:
            digits.append(text[i + 1])
            i += 2
        else:
            break
    return at, i, 12 <= len(digits) <= 19 and _luhn(digits)


def _luhn(digits: list[str]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: a plus sign before a digit."""
    n, i, end = len(text), at + 2, 0
    while i < n and text[i] in _AFTER_PLUS:
        if text[i] in _DIGITS and i > at + 2:
            end = i + 1
        i += 1
    if not end:
        return None
    return at, end, 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def _url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    end = _URL_END.match(text, at).end()
    while end > at and text[end - 1] in ".,;:!?)]}":
        end -= 1
    rest = text[at:end].split(":", 1)[-1].lstrip("/")
    return at, end, bool(rest) and rest[0].isalnum()


def _iban(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: the last character of a cue word."""
    m = _IBAN.match(text, at + 1)
    if m is None:
        return None
    start, end = m.span(1)
    for stop in range(end, start + 14, -1):  # a word after the number may look like its last group
        raw = text[start:stop].replace(" ", "")
        if text[stop - 1] != " " and 15 <= len(raw) <= 34:
            if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
                return start, stop, True
    return None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "iban": _iban}


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind as listed."""
    found: list[tuple[int, int, int]] = []
    floors = dict.fromkeys(KINDS, 0)
    for last, (kind, back) in _AUTOMATON.iter(text):
        at = last - back
        if at < floors[kind]:
            continue
        got = _PARSERS[kind](text, at, floors[kind])
        if got is not None:
            start, end, valid = got
            floors[kind] = end
            if valid:
                found.append((start, KINDS.index(kind), end))
    found.sort()
    return [(KINDS[k], a, b) for a, k, b in found]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """docs with their spans; null and empty texts have none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(texts: pa.Array) -> list[pa.Array]:
        rows = ([{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")] for t in texts)
        return [pa.array(list(rows), kind)]

    return with_mapped(docs, text, f"`{to}` {SPANS}", lambda: found)


def redacted(text: Column, found: Column) -> Column:
    """text with each span of found replaced by its kind in brackets; where spans overlap the first one counts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.concat(state["out"], between, F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    done = F.aggregate(found, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text).cast("bigint")))


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of documents with spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
