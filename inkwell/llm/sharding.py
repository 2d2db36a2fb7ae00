"""Reproducible shuffle into shards by a Feistel permutation (native).

Rows get global numbers 0..n-1 in key order. A keyed Feistel network over a
mixed-radix domain ``a * b >= n`` permutes the numbers; a value that lands
outside 0..n-1 is permuted again until it is inside (cycle walking), so the
result is a permutation of 0..n-1 itself. Place p goes to shard ``p % shards``,
slot ``p // shards``: counts differ by one at most, slots are gapless, and both
can be computed from a row number alone (and back, see :func:`row_at`).
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import numbered

ROUNDS = 8


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0..n-1 with its domain ``a * b``."""

    n: int
    key: str
    a: int
    b: int

    @classmethod
    def of(cls, n: int, key: str) -> "Permutation":
        """The near-square domain that exceeds n the least: few values lie outside
        0..n-1, some 3,000 for 10^12 rows."""
        root = max(1, isqrt(max(1, n)))
        a = min(range(root, root + 1000), key=lambda x: (x * -(-max(1, n) // x) - n, x))
        return cls(n, key, a, -(-max(1, n) // a))

    def _round(self, i: Column, half: Column) -> Column:
        text = F.concat_ws(":", F.lit(self.key), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")

    def _once(self, x: Column) -> Column:
        """One pass: even rounds change the left half, odd ones the right."""
        a, b = F.lit(self.a).cast("bigint"), F.lit(self.b).cast("bigint")
        left = x % a
        start = F.struct(left.alias("l"), ((x - left) / a).cast("bigint").alias("r"))
        step = lambda s, i: F.when(
            i % 2 == 0, F.struct(((s.l + self._round(i, s.r)) % a).alias("l"), s.r.alias("r"))
        ).otherwise(F.struct(s.l.alias("l"), ((s.r + self._round(i, s.l)) % b).alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
                           lambda s: s.r * a + s.l)

    def longest_walk(self) -> int:
        """Most further passes that a row's place needs: the longest run of values
        outside 0..n-1 that follow each other, found by a look at each of them."""
        before = {x: self._back(x) for x in range(self.n, self.a * self.b)}
        after = {y: x for x, y in before.items() if y >= self.n}
        longest = 0
        for x, y in before.items():
            if y < self.n:  # a walk enters here; cycles that stay outside have no entry
                steps = 1
                while x in after:
                    x, steps = after[x], steps + 1
                longest = max(longest, steps)
        return longest

    def place(self, x: Column) -> Column:
        """Permuted place of row number ``x`` (cycle walking)."""
        once, steps = self._once(x), self.longest_walk()
        if not steps:
            return once
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), once,
            lambda p, _: F.when(p < self.n, p).otherwise(self._once(p)))

    def _back(self, x: int) -> int:
        """The number that one pass takes to ``x``."""
        left, right = x % self.a, x // self.a
        for i in reversed(range(ROUNDS)):
            half = right if i % 2 == 0 else left
            f = int(md5(f"{self.key}:{i}:{half}".encode()).hexdigest()[:12], 16)
            if i % 2 == 0:
                left = (left - f) % self.a
            else:
                right = (right - f) % self.b
        return right * self.a + left

    def inverse(self, place: int) -> int:
        """Row number whose place is ``place``."""
        x = self._back(place)
        while x >= self.n:
            x = self._back(x)
        return x


def row_at(perm: Permutation, shards: int, shard: int, slot: int) -> int:
    """Global row number stored at ``(shard, slot)``."""
    return perm.inverse(slot * shards + shard)


def shard_rows(rows: DataFrame, order: list[Column], shards: int, key: str) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``.

    Null keys sort first; equal keys are told apart by the rest of ``order``;
    rows equal in all of it are interchangeable. No rows: no output rows. The
    input's own columns ``row_number``, ``place``, ``shard`` and ``slot``, if
    any, are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    out = numbered(rows.drop("row_number", "place", "shard", "slot"), order, "shard-rows")
    perm = Permutation.of(out.count(), key)
    return (out.withColumn("place", perm.place(F.col("row_number")))
            .withColumn("shard", (F.col("place") % shards).cast("int"))
            .withColumn("slot", ((F.col("place") - F.col("shard")) / shards).cast("bigint"))
            .drop("place"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def document_shards(docs: DataFrame, shards: int = 24, key: str = "inkwell") -> DataFrame:
    """Shard of every document; null text counts as empty, extra columns are
    not read, repeated rows are all placed."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    return shard_rows(rows, order, shards, key)


def query(docs: DataFrame) -> DataFrame:
    """op2: all documents in shards 0 to 23, law ``rows``."""
    out = document_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
