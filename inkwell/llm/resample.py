"""Target-distribution importance resampling over hashed word windows.

A pre-tokeniser of the tokenizers library (an untrained regex split) returns
the words of an ASCII-lowered text with their byte offsets. Windows of one to
three consecutive words, told by the offsets of their first and last word in
the text with one space between words, fall into buckets by CRC-32. One pass over
all documents and one over the target texts make two histograms of buckets, from
which every bucket has a gain; a second pass over the documents sums the gains
of each document's windows. Gumbel noise from a keyed digest of the id is added,
and the documents with the highest scores are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from inkwell.llm.common import numbered, stored

#: Words are runs of 0-9, a-z and code points beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets, longest window in words, and the scale of gains and noise.
BUCKETS, LONGEST, SCALE = 10_000, 3, 1000
#: Words of a document that may be drawn, at least.
LEAST_WORDS = 20
KEY = 42

_SPLIT = None


def word_spans(text: bytes) -> np.ndarray:
    """(n, 2) byte offsets of the words of a lowered text."""
    global _SPLIT
    if _SPLIT is None:
        _SPLIT = Split(Regex(WORD), "removed", invert=True)
    parts = PreTokenizedString(text.decode())
    _SPLIT.pre_tokenize(parts)
    spans = [word[1] for word in parts.get_splits("original", "byte")]
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


class Crc:
    """CRC-32 of many windows at once. The sum of x y is that of x moved on by as
    many zero bytes as y has, combined with that of y; moving is linear in the 32 bits."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        self.byte = byte
        # moved[k][j][b]: byte j of a sum holds b, moved on by 2^k bytes.
        value = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
        step = self._one(value)
        self.moved = [step]
        for _ in range(40):
            step = self._by(step, step)
            self.moved.append(step)
        # The shortest moves have a table of their own: one look-up in place of several.
        self.near = np.empty((64, 4, 256), np.uint32)
        self.near[0] = value
        for n in range(1, 64):
            self.near[n] = self._one(self.near[n - 1])

    def of(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the slices of ``data`` at ``start``; those of less than 64 bytes
        go on together, byte by byte."""
        flat, out = np.frombuffer(data, np.uint8), np.empty(len(start), np.uint32)
        for i in np.flatnonzero(size > 63).tolist():
            out[i] = zlib.crc32(data[start[i]:start[i] + size[i]])
        short = np.flatnonzero(size <= 63)
        short = short[np.argsort(-size[short], kind="stable")]
        begin, left = start[short], size[short]
        sums = np.full(len(short), 0xFFFFFFFF, np.uint32)
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k, side="left"))  # the longer ones stand first
            sums[:n] = self.byte[(sums[:n] ^ flat[begin[:n] + k]) & 255] ^ (sums[:n] >> 8)
        out[short] = ~sums
        return out

    def _one(self, x: np.ndarray) -> np.ndarray:
        return self.byte[x & 255] ^ (x >> 8)

    @staticmethod
    def _by(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (table[0][x & 255] ^ table[1][x >> 8 & 255]
                ^ table[2][x >> 16 & 255] ^ table[3][x >> 24])

    def move(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``x`` moved on by ``n`` bytes each."""
        low = n & 63
        out = (self.near[low, 0, x & 255] ^ self.near[low, 1, x >> 8 & 255]
               ^ self.near[low, 2, x >> 16 & 255] ^ self.near[low, 3, x >> 24])
        high = n >> 6
        for k in range(int(high.max(initial=0)).bit_length()):
            at = np.flatnonzero(high >> k & 1)
            out[at] = self._by(self.moved[k + 6], out[at])
        return out

    def spaced(self, x: np.ndarray) -> np.ndarray:
        """Sums of the same strings with a space behind."""
        x = ~x
        return ~(self.byte[(x ^ np.uint32(32)) & 255] ^ (x >> 8))


_CRC = None


def crc() -> Crc:
    """The tables, made once in a worker."""
    global _CRC
    if _CRC is None:
        _CRC = Crc()
    return _CRC


def window_crcs(words: np.ndarray, size: np.ndarray, text: np.ndarray, longest: int = LONGEST) -> list[np.ndarray]:
    """CRC-32 of all windows of 1, 2, ... ``longest`` words. ``words`` are the sums
    of the words, ``size`` their bytes, ``text`` the text of each: a window lies in one text."""
    out, ahead = [words], words
    for k in range(1, min(longest, len(words))):
        ahead = crc().move(crc().spaced(ahead[:-1]), size[k:]) ^ words[k:]
        out.append(ahead)
    return [x[text[:len(x)] == text[k:]] for k, x in enumerate(out)]


def batch_windows(texts) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for each length of window the buckets of all
    windows and the texts (their places) they are in."""
    low = [(t.as_py() or "").encode().lower() for t in texts]  # bytes: A-Z only
    spans = [word_spans(t) for t in low]
    n = np.array([len(s) for s in spans], np.int64)
    text = np.repeat(np.arange(len(low)), n)
    begin = np.cumsum([0, *map(len, low)])[:-1]
    spans = np.concatenate([np.empty((0, 2), np.int64), *spans])
    size = spans[:, 1] - spans[:, 0]
    words = crc().of(b"".join(low), spans[:, 0] + np.repeat(begin, n), size)
    crcs = window_crcs(words, size, text)
    places = [text[:len(text) - k][text[:len(text) - k] == text[k:]] for k in range(len(crcs))]
    return n, [c % BUCKETS for c in crcs], places


def _runs(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` bytes of text, one row at least."""
    size, first = 0, 0
    for i, text in enumerate(batch.column("text")):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= limit:
            yield batch.slice(first, i + 1 - first)
            size, first = 0, i + 1
    if first < len(batch):
        yield batch.slice(first)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for run in _runs(batch):
            for bucket in batch_windows(run.column("text"))[1]:
                total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())],
                                     names=["bucket", "n"])


def histogram(texts: DataFrame) -> np.ndarray:
    """Windows of all ``texts`` in each bucket; ``BUCKETS`` rows reach the driver."""
    rows = (texts.select("text").mapInArrow(_histogram, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole gain of each bucket, from its numbers in the raw and the target texts."""
    s, t = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((float(b) + 1) * s / ((float(a) + 1) * t)))
                     for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: str, key: int = KEY) -> int:
    """Whole Gumbel noise from the digest of ``key`` and the id."""
    h = int(hashlib.sha256(f"{key}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch):
                n, buckets, places = batch_windows(run.column("text"))
                weight = np.zeros(len(n), np.int64)
                for bucket, place in zip(buckets, places):
                    np.add.at(weight, place, gain[bucket])
                features = sum((np.maximum(n - k, 0) for k in range(LONGEST)), np.zeros(len(n), np.int64))
                drawn = weight + np.array([noise(d.as_py()) for d in run.column("_id")], np.int64)
                made = {"n_words": n, "n_features": features, "weight": weight, "score": drawn}
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), *(pa.array(v, pa.int64()) for v in made.values())],
                    names=["doc_id", *made])
    return score


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``
    (doc_id, text); ``target`` has a column ``text``.

    Null and empty texts have no windows and weight 0. A null doc_id reads
    'null' in the digest. An empty target gives every bucket the gain of 0 windows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), "text")
    gain = gains(histogram(docs), histogram(target))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        _scorer(gain), f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: of the N rows with at least ``least_words`` words
    the floor(percent * N / 100) highest scores have ranks from 1, ties to the
    smaller doc_id (null last), then to fewer words; the others have null. Rows equal in
    all that take consecutive ranks. No rows: no output.
    """
    rows = stored(scored(docs, target).withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_words").asc()]
    drawn = numbered(able.select("_row", "score", "doc_id", "n_words"), order, "resample-order")
    drawn = drawn.where(F.col("row_number") < n).select("_row", (F.col("row_number") + 1).alias("rank"))
    return rows.join(drawn, "_row", "left").drop("_row")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op13: 5 % of the documents of 20 words or more, towards all benchmark texts."""
    return resampled(docs, items).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))
