"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has exactly one token that can end its encoding: the token whose remaining prefix ends in a
token that it can follow, that is, a pair that encodes to itself. Storing that last token for each prefix makes an
append exact (only new prefixes are filled in), and an edit is re-encoded only until the stored tokens agree again.
A piece that is itself in the vocabulary is one token, as in the tiktoken library.

Pieces are cut from texts by a pattern, and recur; each Python worker keeps a bounded memo of encoded pieces.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import with_mapped

#: Encoded pieces in each of two generations, and tested pairs, that a worker keeps at once.
MEMO_PIECES = 150_000
MEMO_PAIRS = 300_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks in a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token, with the token it is or -1: what to look for before a prefix's end.
        self._endings: dict[bytes, int] = {}
        for token, rank in ranks.items():
            self._endings[token] = rank
            for i in range(1, len(token)):
                self._endings.setdefault(token[i:], -1)
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, dict[int, list]] = {-1: {}, 0: {}}
        self._whole: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank, leftmost first: the definition that the rest is tested against."""
        return [self.ranks[p] for p in self._merge(data, 1)]

    def _merge(self, data: bytes, least: int) -> list[bytes]:
        """Merges until no pair has a rank or only least parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > least:
            best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether right can stand after left: their bytes together encode to these two tokens."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._meets(left, right)
        return found

    def _meets(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges on both sides that would use up its parts."""
        ends, starts = self._edge(left, -1), self._edge(right, 0)
        if not ends or not starts:
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        rank = self.ranks.get
        for a, a_made, a_used in ends:
            for b, b_made, b_used in starts:
                across = rank(a + b)
                if across is not None:
                    when = max(across, a_made, b_made)
                    if when < a_used and when <= b_used:  # of equal ranks the leftmost pair is merged first
                        return False
        return True

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at token's right (-1) or left (0) edge while it is merged: bytes, and the ranks at which they are
        made and used up. Empty if ranks along the edge don't rise, so that they can't serve as times."""
        found = self._edges[side].get(token)
        if found is None:
            data, used, found = self.tokens[token], 1 << 62, []
            while True:
                made = self.ranks[data] if len(data) > 1 else -1
                if made >= used:
                    found = []
                    break
                found.append((data, made, used))
                if len(data) == 1:
                    break
                parts = self._merge(data, 2)
                if len(parts) != 2:
                    found = []
                    break
                data, used = parts[side], made
            self._edges[side][token] = found
        return found

    def starts(self, token: int) -> bool:
        """Whether token's own bytes encode to it."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return found

    def last_tokens(self, data: bytes, last: list[int], start: int = 0, stop: int | None = None) -> None:
        """Fills last[i], the token that ends data[: i + 1], for start <= i < stop; what precedes start is right."""
        endings, known, follows = self._endings.get, self._pairs.get, self.follows
        for end in range(start + 1, (len(data) if stop is None else stop) + 1):
            begin = end - 1
            while begin >= 0:
                token = endings(data[begin:end])
                if token is None:
                    if begin == end - 1:
                        raise ValueError(f"byte {begin} of a piece is not in the vocabulary")
                    break
                if token >= 0:
                    if not begin:
                        if self.starts(token):
                            last[end - 1] = token
                    else:
                        left = last[begin - 1]
                        fits = known(left << 32 | token)
                        if follows(left, token) if fits is None else fits:
                            last[end - 1] = token
                            break
                begin -= 1

    def unwound(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [0] * len(data)
        self.last_tokens(data, last)
        return self.unwound(last)


class PieceEncoder:
    """One growing, editable piece with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.last += [0] * len(data)
        self.vocabulary.last_tokens(self.data, self.last, start)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts data in place of [start, stop); returns how many prefixes were encoded again."""
        old = self.last[stop:]
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = self.last[:start] + [0] * len(data) + old
        at, agree = start, 0
        while at < len(self.data) and agree < self.vocabulary.longest:
            before = self.last[at] if at >= start + len(data) else -1
            self.vocabulary.last_tokens(self.data, self.last, at, at + 1)
            agree = agree + 1 if self.last[at] == before else 0
            at += 1
        return at - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.unwound(self.last)


class _Memo(dict):
    """Piece to its ids as little-endian 32-bit integers: the pieces met since the last change of generations, and the
    generation before, from which a piece that is met again is taken over."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = pack(self.vocabulary.encode_piece(piece.encode()))
            if len(piece) > 64:
                return found
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self._pieces = regex.compile(pattern).findall
        self._memo = _Memo(self.vocabulary)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._memo.__getitem__, self._pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, memoryview(ids).cast("I")))


_loaded: dict[tuple[int, str], TextEncoder] = {}


def _encoder(raw: bytes, pattern: str) -> TextEncoder:
    key = (hash(raw), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TextEncoder(read_ranks(raw), pattern)
    return _loaded[key]


def _forget() -> None:
    """Frees the memos: a worker that has coded pieces may next run something else."""
    _loaded.clear()


class ByteBPE:
    """Encodes and decodes columns. path: a .tiktoken file that the driver can read; pattern: what cuts the pieces."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self._raw = spark.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """docs with ids: token ids as little-endian 32-bit integers in one binary; null counts as the empty text."""
        raw, pattern = self._raw, self.pattern

        def make():
            encode = _encoder(raw.value, pattern).encode
            return lambda texts: [pa.array([encode(t.as_py() or "") for t in texts], pa.binary())]

        return with_mapped(docs, text, f"`{ids}` binary", make, _forget)

    def round_trip(self, docs: DataFrame, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
        """docs with ids and the bytes decoded from them, in one pass: each core needs one Python worker, not two."""
        raw, pattern = self._raw, self.pattern

        def make():
            coder = _encoder(raw.value, pattern)

            def both(texts: pa.Array) -> list[pa.Array]:
                coded = [coder.encode(t.as_py() or "") for t in texts]
                return [pa.array(coded, pa.binary()), pa.array(map(coder.decode, coded), pa.binary())]

            return both

        return with_mapped(docs, text, f"`{ids}` binary, `{data}` binary", make, _forget)

    def decode(self, docs: DataFrame, ids: str = "ids", data: str = "decoded") -> DataFrame:
        """docs with data: the bytes that the ids stand for."""
        raw, pattern = self._raw, self.pattern

        def make():
            decode = _encoder(raw.value, pattern).decode
            return lambda column: [pa.array([decode(i.as_py() or b"") for i in column], pa.binary())]

        return with_mapped(docs, ids, f"`{data}` binary", make, _forget)
