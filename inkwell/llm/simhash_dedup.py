"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.
Fingerprints that differ in at most two bits have, going round the segments,
one that is equal and is followed by one with at most one differing bit. A
segment with one wrong bit is found through the perfect [23, 12, 7] Golay code:
each 23-bit word is mapped to the indices of the codewords within distance 4
(the nearest one alone when it is within 2, else it and five more); words one
bit apart always share an index. So every fingerprint has up to 18 keys
(segment number, equal segment, index of the next one). Fingerprints that share
a key are compared bit by bit; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import shielded, shuffle_partitions, stored
from inkwell.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Segments of the fingerprint as (shift, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Buckets up to this size are compared pair by pair, larger ones by variants.
PAIRWISE = 24
BLOCK = 1 << 16


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included.

    Null, empty and blank texts give 0; a text of fewer than ``size`` words is
    one shingle. A bit is set if it is set in more than half the hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + size - 1]
        shingles = zip(*(part[k:] for k in range(size))) if len(part) >= size else [part]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` (any columns, with ``text`` as binary last) with ``text``
    replaced by ``fp``, the fingerprint as a signed 64-bit number."""
    keep = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in texts), "u8", len(texts))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view("i8"))], [*names, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "fp bigint"])
    return docs.mapInArrow(run, schema)


# ------------------------------------------------------------------- Golay keys
@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 23-bit word's upper 12 bits, and for each of the 2048
    syndromes six error patterns that lead to codewords within distance 4."""
    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word
    upper = np.array([rest(x << 11) for x in range(4096)], np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            found[rest(error)].append(error)
    patterns = np.array([(p * 6)[:6] if len(p) < 6 else p[:6] for p in found], np.int64)
    return upper, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices (0..4095) of the codewords within distance 4 of each
    23-bit word; with fewer than six, they repeat."""
    upper, patterns = _golay()
    syndrome = upper[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[syndrome]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, position) pairs of unsigned fingerprints: the equal
    segment with its number, and each codeword index of the next segment."""
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64)
             for s, b in SEGMENTS]
    made, where = [], []
    for i, exact in enumerate(parts):
        index = np.sort(codeword_indices(parts[(i + 1) % 3]), axis=1)
        fresh = np.ones(index.shape, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        made.append((np.int64(i) << 34) | (exact[row] << 12) | index[row, col])
        where.append(row)
    return np.concatenate(made), np.concatenate(where)


# ------------------------------------------------------------------------ links
def _flip_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large bucket for one bit: each flip of a fingerprint is looked
    up among the others."""
    order = np.argsort(fps, kind="stable")
    ranked = fps[order]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for flip in np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)):
        at = np.minimum(np.searchsorted(ranked, fps ^ flip), len(fps) - 1)
        own = np.flatnonzero(ranked[at] == fps ^ flip)
        left.append(own)
        right.append(order[at[own]])
    return np.concatenate(left), np.concatenate(right)


def _variant_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large bucket without its pairs, for two bits: fingerprints
    within two bits have a common variant at most one flip from each, and any
    two that share a variant are within two bits."""
    flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))])
    left, right = [], []
    step = 4096
    variants = np.concatenate([(fps[at:at + step, None] ^ flips.astype(np.uint64)).ravel()
                               for at in range(0, len(fps), step)])
    owner = np.repeat(np.arange(len(fps), dtype=np.int32), 65)
    order = np.argsort(variants, kind="stable")
    variants, owner = variants[order], owner[order]
    same = variants[1:] == variants[:-1]
    left.append(owner[:-1][same])
    right.append(owner[1:][same])
    return np.concatenate(left), np.concatenate(right)


def _close(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(left ^ right) <= bits


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) that connect what the edges connect."""
    if not len(left):
        return left, right
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def bucket_links(key: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links within each run of equal keys."""
    size_at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(size_at)
    small = np.repeat(sizes <= PAIRWISE, sizes)
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    k, f = key[small], fps[small]
    for d in range(1, PAIRWISE):
        if d >= len(k):
            break
        hit = (k[d:] == k[:-d]) & _close(f[d:], f[:-d], bits)
        left.append(f[d:][hit])
        right.append(f[:-d][hit])
    for at, size in zip(size_at[:-1][sizes > PAIRWISE], sizes[sizes > PAIRWISE]):
        f = fps[at:at + size]
        a, b = _flip_links(f) if bits == 1 else _variant_links(f)
        ok = _close(f[a], f[b], bits)
        left.append(f[a[ok]])
        right.append(f[b[ok]])
    return _forest(np.concatenate(left), np.concatenate(right))


def links(classes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v) star edges between distinct fingerprints ``fp`` that are at most
    ``bits`` apart (1 or 2): key every fingerprint, bring equal keys together,
    compare."""
    if bits not in (1, 2):
        raise ValueError("the segments find up to two differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("i8")
            key, row = keys(fps.view("u8"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key; the last, possibly unfinished bucket waits.
        key, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])
            yield edges(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
        if len(key):
            yield edges(key, fps)

    def edges(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        if len(key) < 2:
            u = v = np.empty(0, np.uint64)
        else:
            u, v = bucket_links(key, fps.view(np.uint64), bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    partitions = shuffle_partitions(classes.sparkSession)
    return (classes.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
            .repartition(partitions, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(compared, "u bigint, v bigint").distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without ``text``, plus ``fp`` and ``component_id``.

    Equal fingerprints are one class first, so copies meet no comparison.
    ``component_id`` is the least doc_id of the component; null doc_ids are
    grouped like others but never name a component unless all of it is null.
    Null and empty texts have fingerprint 0 and form one class. Extra columns
    pass through; columns named ``fp``, ``label``, ``component`` or ``component_id`` are
    replaced, and ``component``, the component's least fingerprint, is added.
    No rows: no output.
    """
    rows = docs.drop("fp", "label", "component", "component_id")
    others = [F.col(f"`{c}`") for c in rows.columns if c != "text"]
    rows = stored(fingerprinted(rows.select(*others, F.col("text").cast("binary").alias("text")),
                                size), "simhash-fps")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(links(classes, bits))
    classes = classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "label").select(
        "fp", F.col("label").alias("component"), "component_id")
    return rows.join(classes, "fp")


def deduplicated(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the least
    doc_id (nulls last), among equal ones the first in the input."""
    def work(docs: DataFrame) -> DataFrame:
        rows = stored(docs.withColumn("_rid", F.monotonically_increasing_id()), "simhash-docs")
        grouped = near_duplicates(rows.select("_rid", "doc_id", "text"), size, bits)
        # A component without any doc_id is told apart by its label alone.
        kept = grouped.groupBy("component").agg(F.min(F.struct(
            F.col("doc_id").isNull(), "doc_id", "_rid"))["_rid"].alias("_rid"))
        return rows.join(kept.select("_rid"), "_rid")

    return shielded(docs, ("doc_id", "text"), work)


def query(docs: DataFrame) -> DataFrame:
    """op8: fingerprints and components of all documents."""
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id")
