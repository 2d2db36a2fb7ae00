"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are windows of consecutive words of benchmark items. Document and
pattern are brought to one form, words with one space around each, so that an
occurrence of the pattern's bytes is one of its words. A table of patterns
knows, for each block of ``block`` bytes in the first ``least`` bytes of any
pattern (``least``: the shortest pattern), how far the search may move on when
the text has that block; unknown blocks move it past themselves. Where a
pattern's ``least`` bytes could end, the block picks a bucket of patterns and
direct comparison confirms an occurrence.

Patterns are split into tables of bounded size. Documents pass through one
table after the other, each carrying what was found so far, so their texts are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import shielded, stored

#: The bytes of a word are 0-9, a-z (A-Z in lower case) and all of UTF-8 beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256))
#: Patterns of at least so many bytes share a table whose blocks have so many bytes. A few short
#: patterns thus do not shorten the steps that long ones allow.
CLASSES = ((32, 8), (12, 4), (3, 3))
#: Bytes of patterns in one table; what the driver and a worker hold at a time follows from it.
TABLE_BYTES = 4 << 20
#: Tables searched by one stage; after so many the rows are written.
STAGE_TABLES = 2
#: Consecutive windows of an item that go to one table.
RUN = 512


def lower_ascii(text):
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(text: bytes) -> bytes:
    """Words of a text with one space around each; no words: one space."""
    split = text.translate(_TO_WORDS).split()
    return b" " + b" ".join(split) + b" " if split else b" "


def windows(items: DataFrame, size: int) -> DataFrame:
    """(window, item, run), distinct by window and item: ``size`` consecutive words
    of each item, or all of its words if they are fewer, and the run of ``RUN``
    windows they stand in. Null item_id is read as ''."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item", "w", F.explode(starts).alias("i"))
    window = F.array_join(F.slice("w", F.col("i"), size), " ").alias("window")
    return w.groupBy(window, "item").agg(F.floor(F.min("i") / RUN).alias("run"))


class Patterns:
    """One Wu-Manber table: patterns (canonical bytes) with the items they are from."""

    def __init__(self, items_of: dict[bytes, list[str]], block: int):
        self.items_of, self.block = items_of, block
        self.least = min(map(len, items_of))
        self.far = self.least - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[int]] = {}
        lengths: dict[bytes, set[int]] = {}
        for pattern in items_of:
            for end in range(block, self.least + 1):
                key = pattern[end - block:end]
                move = self.least - end
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
            lengths.setdefault(pattern[self.least - block:self.least], set()).add(len(pattern))
        # A bucket is told by the block; within it patterns of one length are told by comparison.
        self.bucket = {key: sorted(found) for key, found in lengths.items()}

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        block, least, far, shift, known = self.block, self.least, self.far, self.shift.get, self.items_of
        end, last = least, len(text)
        while end <= last:
            key = text[end - block:end]
            move = shift(key, far)
            if move:
                end += move
                continue
            start = end - least
            for length in self.bucket[key]:
                found = text[start:start + length]
                if found in known:
                    yield start, found
            end += 1


def tables(patterns: Iterable[tuple[str, str]]) -> list[Patterns]:
    """Tables of (window, item) rows, one for each class of lengths."""
    classes: list[dict[bytes, list[str]]] = [{} for _ in CLASSES]
    for window, item in patterns:
        pattern = b" " + window.encode() + b" "
        at = next(i for i, (least, _) in enumerate(CLASSES) if len(pattern) >= least)
        classes[at].setdefault(pattern, []).append(item)
    return [Patterns(found, block) for found, (_, block) in zip(classes, CLASSES) if found]


def hits(text: bytes, found: list[Patterns]) -> tuple[np.ndarray, set[str]]:
    """Hit words of a canonical text (ascending places) and the items that hit them."""
    spaces = None
    runs, items = [], set()
    for table in found:
        for start, pattern in table.search(text):
            if spaces is None:  # word k follows space k
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            first = int(np.searchsorted(spaces, start))
            runs.append((first, first + pattern.count(b" ") - 1))
            items.update(table.items_of[pattern])
    if not runs:
        return np.empty(0, np.int32), items
    edge = np.zeros(len(spaces), np.int32)
    for first, end in runs:
        edge[first] += 1
        edge[end] -= 1
    return np.flatnonzero(np.cumsum(edge) > 0).astype(np.int32), items


def _searcher(rows):
    """mapInArrow function that adds what one table's patterns hit."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables(rows.value)
        for batch in batches:
            words, hit, items = [], [], []
            for text, h, i in zip(*(batch.column(c) for c in ("text", "_hit", "_items"))):
                form = canonical((text.as_py() or "").encode())
                places, names = hits(form, found)
                if len(places) and h.as_py():
                    places = np.union1d(places, np.frombuffer(h.as_py(), np.int32))
                words.append(form.count(b" ") - 1)
                hit.append(places.tobytes() if len(places) else h.as_py())
                items.append(sorted(names.union(i.as_py())) if names else i.as_py())
            made = {"_words": words, "_hit": hit, "_items": items}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name)
                 for f in batch.schema], schema=batch.schema)
    return search


def searched(docs: DataFrame, items: DataFrame, size: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with ``_words`` (their number), ``_hit`` (binary: ascending 32-bit
    places of the words inside an occurrence of an item's window; null: none)
    and ``_items`` (the ids of those items as strings, in UTF-8 order).

    ``docs`` has a column ``text``, ``items`` has ``item_id`` and ``text``. Null
    texts have no words and match nothing, nor do items without words; items of
    one id are one item, a null id reads ''. Documents are neither merged nor
    dropped; no documents: no rows.
    """
    spark = docs.sparkSession
    patterns = stored(windows(items, size), "leak-windows")
    total = patterns.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    count = max(1, -(-total // table_bytes))
    # Neighbouring windows of an item share blocks, so they go to one table.
    table = F.pmod(F.xxhash64("item", "run"), F.lit(count))
    docs = (docs.withColumn("_words", F.lit(None).cast("long"))
            .withColumn("_hit", F.lit(None).cast("binary"))
            .withColumn("_items", F.array().cast("array<string>")))
    for i in range(count):
        if i and i % STAGE_TABLES == 0:
            docs = stored(docs, "leak-found")
        rows = patterns.where(table == i).select("window", "item")
        rows = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # about table_bytes
        docs = docs.mapInArrow(_searcher(rows), docs.schema)
    return docs


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit word, with the columns of ``docs``."""
    return shielded(docs, ("text",), lambda d: searched(d, items, size).where("_hit IS NULL"))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op11: windows of ten words of all benchmark items in all documents."""
    found = searched(docs.select("doc_id", "text"), items.select("item_id", "text"))
    n_hit = F.coalesce(F.octet_length("_hit") / 4, F.lit(0)).cast("long")
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
