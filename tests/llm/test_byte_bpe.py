import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lodestrata.llm import byte_bpe, catalog


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return byte_bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts(ranks, reference, monkeypatch):
    random.seed(1)
    coder = byte_bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 50)
    letters = "  \t\n\r\x0b\x1c\x85\xa0 　aeéñ中１²½'st.,!́😀<|endoftext|>"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 20)))
        ids = coder.encode(text)
        assert list(memoryview(ids).cast("I")) == reference.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_appends_edits_and_pairs(ranks):
    random.seed(2)
    vocabulary = byte_bpe.Vocabulary(ranks)
    word = lambda n: bytes(random.choice(b"aeinrst thon\xc3\xa9") for _ in range(n))
    for _ in range(150):
        piece = byte_bpe.PieceEncoder(vocabulary, word(random.randint(0, 30)))
        piece.append(word(random.randint(0, 9)))
        a = random.randint(0, len(piece.data))
        b = random.randint(a, len(piece.data))
        piece.replace(a, b, word(random.randint(0, 6)))
        assert vocabulary.unwound(piece.last) == vocabulary.merged(piece.data)
    ids = list(ranks.values())
    for _ in range(3000):
        a, b = random.choice(ids), random.choice(ids[:2000])
        assert vocabulary.follows(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b])


def test_edits_stop_early(ranks):
    piece = byte_bpe.PieceEncoder(byte_bpe.Vocabulary(ranks), b"the quick brown fox " * 50)
    assert piece.replace(10, 11, b"x") < 300


def test_query(spark, sf_small, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in catalog.queries()["op10_byte_bpe"](spark, sf_small).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_odd_rows(spark):
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "z" * 50_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    one, two = bpe.decode(bpe.encode(docs)).collect(), bpe.round_trip(docs).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 5
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in one)
    assert bpe.round_trip(docs.where("false")).count() == 0
