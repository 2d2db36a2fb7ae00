"""Constraints over time against a check of everything loaded."""

import random
from collections import Counter
from types import SimpleNamespace

from inkwell.operators import constraints as C
from inkwell.plans import q_quality


def test_batches_equal_the_full_check(spark, tmp_path):
    rng, loaded, parents = random.Random(2), Counter(), {str(k) for k in range(0, 40, 2)}
    C.add_keys(spark.createDataFrame([(int(p),) for p in parents], "k long"), "k", str(tmp_path / "p"), "0")
    path = str(tmp_path / "i")
    for b in range(4):
        keys = [rng.choice([None, *range(40)]) for _ in range(15)]
        batch = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
        own = Counter(str(k) for k in keys if k is not None)
        for _ in range(2 if b == 2 else 1):  # a repeated batch sees the same
            got = {r.key: r.n_records for r in C.unique_failures(spark, batch, "k", path, str(b)).collect()}
            assert got == {k: n + loaded[k] for k, n in own.items() if n + loaded[k] > 1}
            C.add_keys(batch, "k", path, str(b))
        orphans = {r.key: r.n_records for r in C.relationship_failures(spark, batch, "k", str(tmp_path / "p")).collect()}
        assert orphans == {k: n for k, n in own.items() if k not in parents}
        loaded += own


def test_empty_sides(spark, tmp_path):
    none = spark.createDataFrame([], "k string")
    some = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    path = str(tmp_path / "i")
    assert C.unique_failures(spark, none, "k", path, "0").collect() == []
    assert [tuple(r) for r in C.unique_failures(spark, some, "k", path, "0").collect()] == [("a", 2)]
    assert [tuple(r) for r in C.relationship_failures(spark, some, "k", path).collect()] == [("a", 2)]


def test_buckets_without_a_key_are_not_read(spark, tmp_path):
    path = str(tmp_path / "i")
    C.add_keys(spark.range(500), "id", path, "0")
    one = C.key_counts(spark.range(1), "id")
    plan = C.loaded_keys(spark, path, one, "1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_the_query_makes_the_facts_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch
    rows = [(f"t{i % 38}" if i % 7 else None, b, y) for i, (b, y) in enumerate(
        (b, y) for b in (1, 89, 97, 194, None) for y in (2000, 2001, 2002, 2003, None) for _ in range(2))]
    schema = "transaction_id string, book_id long, sale_year int"
    facts = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    books = spark.createDataFrame([(1,), (89,), (97,)], "book_id long")
    got = q_quality._constraints(SimpleNamespace(spark=spark, fact_sales=facts, dim_books=books)).collect()
    sent = [(y % 4 + again, t, -b - 1 if b and b % 89 == 0 else b) for t, b, y in rows if y is not None
            for again in (0, 1) if not again or (b is not None and b % 97 == 0 and y % 4 < 3)]
    want = set()
    for load in range(4):
        upto = Counter(t for at, t, _ in sent if at <= load)
        want |= {(load, "unique", t, upto[t]) for at, t, _ in sent if at == load and t and upto[t] > 1}
        orphans = Counter(b for at, _, b in sent if at == load and b is not None and b not in (1, 89, 97))
        want |= {(load, "relationships", str(b), n) for b, n in orphans.items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert made.value == len(rows)
