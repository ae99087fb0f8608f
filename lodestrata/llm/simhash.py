"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into blocks. Two fingerprints that differ in at most `bits` bits agree on at least
blocks - bits whole blocks, so every close pair shares the key made of some such combination of blocks. Distinct
fingerprints are joined on these keys, and the Hamming distance of those that share a key is verified. Only distinct fingerprints take
part; copies follow by a lookup.

Within a key, close fingerprints are linked to the first of their connected group instead of in all pairs, which keeps
the components and makes as many links as fingerprints. A key that more than `chunk` fingerprints share is split by further
blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import connected_components, given_back, lookup, with_mapped, written

SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The 64-bit majority of the XXH64 of each 3-word shingle, repeats included; 0 without a word.

    A-Z are lower-cased; words are cut at ASCII white space; fewer words than a shingle make one shorter shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxh(line, SEED)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], stops[:-SHINGLE_WORDS]))
        ends = stops[SHINGLE_WORDS - 1 :] - 1
        hashes = [xxh(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]
    n, counts = len(hashes), np.zeros(64, np.int64)
    block = np.array(hashes, dtype=">u8")
    for i in range(0, n, 1 << 16):
        part = block[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """docs with their fingerprint as a signed long."""

    def marked(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))]

    return with_mapped(docs, text, f"`{to}` bigint", lambda: marked)


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """The keys of a fingerprint: for each combination of blocks - bits blocks, their bits and the combination's number."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - bits)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("combo"), fp.bitwiseAND(F.lit(signed)).alias("part")))
    return F.array(*keys)


def close_links(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among values (uint64, distinct) at up to bits differing bits: a forest.

    Breadth first over rows of the distance matrix, one row at a time: memory is linear in the values.
    """
    left, links = values, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                todo += list(left[near])
                left = left[~near]
    return links


def second_keys(fp: Column, combo: Column, bits: int, blocks: int) -> Column:
    """Keys that split a key further: of the bits that are not in the key's blocks, cut in blocks themselves, the same
    combinations. Fingerprints that share a key and are close share such a key too."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    every = []
    for chosen in combinations(range(blocks), blocks - bits):
        used = [p for i in chosen for p in range(cuts[i], cuts[i + 1])]
        rest = [p for p in range(64) if p not in used]
        parts = [rest[len(rest) * i // blocks : len(rest) * (i + 1) // blocks] for i in range(blocks)]
        masks = [sum(1 << p for p in [*used, *(q for i in more for q in parts[i])]) for more in combinations(range(blocks), blocks - bits)]
        every.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]))
    masks = F.element_at(F.array(*every), combo + 1)
    return F.transform(masks, lambda m, i: F.struct((combo * 1000 + i + 1000).alias("combo"), fp.bitwiseAND(m).alias("part")))


def links(distinct: DataFrame, bits: int = 3, blocks: int = 6, chunk: int = 20_000) -> DataFrame:
    """Links (a, b) between the fingerprints (column fp, distinct) whose components are those of all close pairs.

    Of a key that more than chunk fingerprints share, these are told apart by further bits, which makes 20 rows of each (by
    default) and groups of at most 2 ** 16: distinct fingerprints that share 48 bits are no more.
    """
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), bits, blocks)).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    total = distinct.count() * math.comb(blocks, bits)
    found = lookup(keyed, shared, "key", total=total)
    rare = found.where(F.col("n") <= chunk).select("fp", "key")
    often = found.where(F.col("n") > chunk).select("fp", F.explode(second_keys(F.col("fp"), F.col("key.combo"), bits, blocks)).alias("key"))
    groups = rare.union(often).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    buckets = groups.select("fps").where(F.size("fps") > 1)
    ship(distinct.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(0).offsets.to_numpy()
            flat = batch.column(0).values.to_numpy().view(np.uint64)
            found: set[tuple[int, int]] = set()
            two = np.flatnonzero(np.diff(offsets) == 2)
            a, b = flat[offsets[two]], flat[offsets[two] + 1]
            near = np.bitwise_count(a ^ b) <= bits
            found.update(zip(a[near].tolist(), b[near].tolist()))
            for k in np.flatnonzero(np.diff(offsets) > 2):
                found.update(close_links(flat[offsets[k] : offsets[k + 1]], bits))
            pairs = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.mapInArrow(given_back(linked), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, blocks: int = 6) -> DataFrame:
    """doc_id, fp, component_id, component of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that is reachable over fingerprints that differ in at most bits bits, component the
    smallest such fingerprint, which names components without a doc_id too. Null,
    empty and blank texts have fingerprint 0, and link like any other. Rows that repeat a doc_id are one document per
    row; a null doc_id is in a component like any other, and names it only if all are null. Empty tables stay empty.
    """
    marked = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")), "distinct-fingerprints")
    groups = connected_components(links(distinct.select("fp"), bits, blocks))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first", "times", F.coalesce("component", "fp").alias("component")
    )
    named = written(named, "named-fingerprints")
    lows = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    classes = lookup(named, lows, "component").select("fp", "component_id", "component", "times")
    return lookup(marked, written(classes, "classes"), "fp", n="times").select("doc_id", "fp", "component_id", "component")
