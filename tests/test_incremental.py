"""Merging batches by key: keys that move, repeat or are null."""

import datetime as dt
import random

import pytest

from inkwell.operators import incremental as inc
from inkwell.operators import marts, staging
from inkwell.sources.schemas import RAW_SALES

SCHEMA = "k string, v int, y int, m int, at int"
OPTIONS = {"key": "k", "mark": None, "partition_cols": ("y", "m")}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    return sorted((tuple(r) for r in df.select("k", "v", "y", "m", "at").collect()), key=repr)


def test_a_key_that_moves_has_one_row(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("a", 1, 1, 1, 0), ("b", 2, 1, 1, 0), ("c", 3, 1, 2, 0), ("d", 4, 1, 3, 0), (None, 5, 1, 4, 0)]
    inc.write_upsert(spark, path, frame(spark, first), **OPTIONS)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("y=1/m=3/*.parquet")}
    # a moves to a month of its own, c leaves its month empty, the null key moves, too.
    out = inc.write_upsert(spark, path, frame(spark, [("a", 9, 2, 1, 1), ("c", 8, 1, 1, 1), (None, 7, 2, 1, 1)]), **OPTIONS)
    want = sorted([("a", 9, 2, 1, 1), ("b", 2, 1, 1, 0), ("c", 8, 1, 1, 1), ("d", 4, 1, 3, 0), (None, 7, 2, 1, 1)], key=repr)
    assert table(out) == want
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in kept.items()) and kept
    assert not list((tmp_path / "t").glob("y=1/m=2/*.parquet"))
    # back again, and a table whose locator is lost finds its keys
    inc.write_upsert(spark, path, frame(spark, [("a", 1, 1, 1, 2)]), **OPTIONS)
    inc.build_locator(spark, path, "k", ("y", "m"))
    out = inc.write_upsert(spark, path, frame(spark, [("d", 0, 3, 3, 2)]), **OPTIONS)
    assert {r.k: (r.y, r.m) for r in out.collect()} == {"a": (1, 1), "b": (1, 1), "c": (1, 1), "d": (3, 3), None: (2, 1)}


def test_repeated_keys_in_a_batch(spark, tmp_path):
    rows = [("a", 1, 1, 1, 5), ("a", 2, 1, 2, 7), ("a", 3, 1, 3, None), (None, 1, 1, 1, 1), (None, 1, 1, 1, 1), (None, 2, 1, 1, 1)]
    out = inc.write_upsert(spark, str(tmp_path / "t"), frame(spark, rows), key="k", mark=None,
                           version="at", partition_cols=("y", "m"))
    assert table(out) == sorted([("a", 2, 1, 2, 7), (None, 2, 1, 1, 1)], key=repr)


def test_versions_arrive_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "d", None]), i, rng.randrange(2), rng.randrange(4), i) for i in range(40)]
    best = {}
    for r in rows:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda x: x[4])
    rng.shuffle(rows)
    path = str(tmp_path / "t")
    for i in range(0, 40, 10):
        out = inc.write_upsert(spark, path, frame(spark, rows[i:i + 10]), key="k", mark=None,
                               version="at", partition_cols=("y", "m"))
    assert table(out) == sorted(best.values(), key=repr)
    again = inc.write_upsert(spark, path, frame(spark, rows[:10]), key="k", mark=None, version="at", partition_cols=("y", "m"))
    assert table(again) == sorted(best.values(), key=repr)


def test_failure_before_the_table_changes_is_healed_by_a_repeat(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    inc.write_upsert(spark, path, frame(spark, [("a", 1, 1, 1, 0), ("b", 1, 1, 2, 0)]), **OPTIONS)
    batch = frame(spark, [("a", 2, 1, 3, 1)])

    def fail(*args):
        raise OSError("lost")
    monkeypatch.setattr(inc, "_delete_files", fail)
    with pytest.raises(OSError):
        inc.write_upsert(spark, path, batch, **OPTIONS)
    monkeypatch.undo()
    assert table(inc.write_upsert(spark, path, batch, **OPTIONS)) == [("a", 2, 1, 3, 1), ("b", 1, 1, 2, 0)]


def test_whole_table_and_partitioned_merge_agree(spark, tmp_path):
    t0, t1 = dt.datetime(2001, 1, 1), dt.datetime(2001, 2, 1)
    schema = "transaction_id string, quantity int, sale_year int, sale_month int, dbt_updated_at timestamp_ntz"
    first = spark.createDataFrame([("a", 1, 2000, 1, t0), (None, 2, 2000, 1, t0), ("c", 3, 2000, 2, t0)], schema)
    batch = spark.createDataFrame([("a", 5, 2000, 2, t1), (None, 6, 2000, 3, t1), ("a", 4, 2000, 4, t1), ("c", 9, 2000, 9, t0)], schema)
    path = str(tmp_path / "t")
    inc.write_upsert(spark, path, first)
    rows = lambda df: sorted((tuple(r) for r in df.select(*first.columns).collect()), key=repr)
    assert rows(inc.write_upsert(spark, path, batch)) == rows(inc.upsert(first, batch))
    assert {r[0]: r[1] for r in rows(inc.upsert(first, batch))} == {"a": 5, None: 6, "c": 3}


def test_small_batches_read_few_buckets_of_the_locator(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.write_upsert(spark, path, frame(spark, [(str(i), i, 1, i % 3, 0) for i in range(200)]), **OPTIONS)
    entries = inc._located(frame(spark, [("7", 1, 1, 1, 1)]), ["k"], ("y", "m"))
    locator = spark.read.schema(entries.schema).parquet(inc.locator_path(path))
    found = inc._holding(locator, entries, ("y", "m"))
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    none = inc._holding(locator, entries.limit(0), ("y", "m"))
    assert none.collect() == []


@pytest.mark.parametrize("broadcast", [0, 10])
def test_only_rows_of_repeated_keys_are_compared(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(inc, "MAX_REPEATED", broadcast)
    compared = []
    whole = inc.one_per_key

    def one_per_key(rows, keys, mark):
        compared.append(sorted(rows.toPandas()["v"]))
        return whole(rows, keys, mark)
    monkeypatch.setattr(inc, "one_per_key", one_per_key)
    rows = [("a", 1, 1, 1, 5), ("a", 2, 1, 2, 7), (None, 3, 1, 1, 1), (None, 4, 1, 1, 1), ("b", 5, 1, 1, 1), ("c", 6, 1, 2, 1)]
    out = inc.write_upsert(spark, str(tmp_path / "t"), frame(spark, rows), **OPTIONS)
    assert {r.k: r.v for r in out.collect()} == {"a": 2, None: 4, "b": 5, "c": 6}
    assert compared == [[1, 2, 3, 4] if broadcast else [1, 2, 3, 4, 5, 6]]
    inc.write_upsert(spark, str(tmp_path / "t"), frame(spark, [("b", 9, 2, 2, 2)]), **OPTIONS)
    assert len(compared) == 1  # no key repeats, nothing is compared


def test_the_shuffle_to_the_books_carries_no_parts_of_the_date(spark):
    sale = ("t", 1, dt.date(2024, 2, 4), 2, 1.0, 0.0, 2.0, "Online", "Retail", "EU", dt.datetime(2024, 2, 4))
    sales = staging.stg_sales(spark.createDataFrame([sale, (None, 2, None, *sale[3:])], RAW_SALES))
    books = spark.createDataFrame([(1, 7, "Fiction", "Print", "Mid", "Short")],
        "book_id long, publisher_id long, genre string, format string, price_category string, length_category string")
    facts = marts.fact_sales(sales, books)
    got = {(r.book_id, r.sale_year, r.sale_month, r.day_of_week, r.genre) for r in facts.collect()}
    assert got == {(1, 2024, 2, 0, "Fiction"), (2, None, None, None, None)}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftOuter"):]
    assert "sale_year" not in joined and "day_of_week" not in joined and "transaction_id" in joined


def test_tables_and_copies_are_zstd(spark, tmp_path):
    import pyarrow.parquet as pq
    rows = lambda load, n: spark.range(n).selectExpr(
        "cast(id AS string) AS transaction_id", f"{load} AS dbt_updated_at", "2000 AS sale_year", "cast(id % 2 AS int) AS sale_month")
    for load in (1, 2):
        inc.write_upsert(spark, str(tmp_path / "facts"), rows(load, 9))
    found = {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in tmp_path.rglob("*.parquet")
             if pq.ParquetFile(p).metadata.num_row_groups}
    assert found == {"ZSTD"}
