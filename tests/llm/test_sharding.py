"""Feistel permutation: a permutation, its inverse, the shards' law."""

import pytest
from pyspark.sql import functions as F

from inkwell.llm import sharding as sh


@pytest.mark.parametrize("n", [1, 2, 7, 23, 24, 97, 1009, 4099])
def test_permutation_and_inverse(spark, n):
    perm = sh.Permutation.of(n, "k")
    got = [r.p for r in spark.range(n).select(perm.place(F.col("id")).alias("p"), "id").orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert [perm.inverse(p) for p in got] == list(range(n))


def test_walk_leaves_the_domain(spark):
    """A domain with values to walk over still gives a permutation."""
    perm = sh.Permutation(90, "k", 10, 12)
    got = [r.p for r in spark.range(90).select(perm.place(F.col("id")).alias("p")).collect()]
    assert sorted(got) == list(range(90))


def test_law_and_reruns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, again = sh.document_shards(docs), sh.document_shards(docs.repartition(7))
    rows = sorted(map(tuple, first.select("doc_id", "shard", "slot").collect()))
    assert rows == sorted(map(tuple, again.select("doc_id", "shard", "slot").collect()))
    slots = {}
    for _, shard, slot in rows:
        slots.setdefault(shard, []).append(slot)
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    perm = sh.Permutation.of(len(rows), "inkwell")
    numbers = {(r.shard, r.slot): r.row_number for r in first.collect()}
    assert all(sh.row_at(perm, 24, *k) == v for k, v in numbers.items())
    sh.write_shards(first, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    with pytest.raises(ValueError):
        sh.document_shards(docs, 0)


def test_walks_are_as_long_as_they_must_be(spark):
    """Domains far larger than n: every walk ends inside, none is cut short."""
    for n, a, b in ((10, 13, 11), (37, 40, 9), (3, 17, 19), (100, 10, 10), (1, 5, 5)):
        perm = sh.Permutation(n, "walk", a, b)
        places = [r[0] for r in spark.range(n).select(perm.place(F.col("id"))).collect()]
        assert sorted(places) == list(range(n))
        assert [perm.inverse(p) for p in places] == list(range(n))
        walked = []
        for p in places:  # passes back to the row number, less one
            x, steps = perm._back(p), 0
            while x >= n:
                x, steps = perm._back(x), steps + 1
            walked.append(steps)
        assert perm.longest_walk() == max(walked)
    for n in (10 ** 9 + 7, 10 ** 12 + 39):
        perm = sh.Permutation.of(n, "inkwell")
        assert 0 < perm.a * perm.b - n < 4000 and perm.longest_walk() <= 3
