"""Stateful loading of sales: replays, corrections and arrivals out of order."""

import datetime as dt
from pathlib import Path

import pytest

from inkwell.sources.schemas import RAW_SALES
from inkwell.streaming import loaders


def sale(key, month, quantity, version, book=1):
    stamp = dt.datetime(2024, 1, 1, 0, 0, 0, version)  # versions a microsecond apart
    return (key, book, dt.date(2024, month, 3), quantity, 10.0, 0.0, 10.0 * quantity, "Online", "Retail", "EU", stamp)


@pytest.fixture
def load(spark, tmp_path):
    books = spark.createDataFrame(
        [(1, 7, "Fiction", "Print", "Mid", "Short"), (2, None, None, None, None, None)],
        "book_id long, publisher_id long, genre string, format string, price_category string, length_category string")
    landing, target = str(tmp_path / "in"), str(tmp_path / "facts")

    def run(*arrivals, **options):
        for rows in arrivals:
            spark.createDataFrame(rows, RAW_SALES).coalesce(1).write.mode("append").parquet(landing)
        out = loaders.fact_sales_stream(spark, landing, books, target, str(tmp_path / "ck"), files_per_batch=1, **options)
        table = {r.transaction_id: (r.sale_month, r.quantity) for r in out.collect()}
        files = {p: p.stat().st_mtime_ns for p in Path(target).rglob("*.parquet")}
        assert out.count() == len(table)
        return table, files
    return run


def test_replays_rewrite_nothing(load):
    first = [sale("a", 1, 9, 4), sale("c", 2, 3, 1, book=2), sale("c", 2, 3, 1, book=2),
             sale(None, 2, 6, 1)]
    second = [sale("a", 2, 1, 3), sale("b", 1, 2, 1), sale("c", 3, 5, 2)]  # a: too late; c: moves month
    table, files = load(first, second + [sale("d", 1, 1, 1)])
    assert table == {"a": (1, 9), "b": (1, 2), "c": (3, 5), "d": (1, 1), None: (2, 6)}
    again, same = load(second + first)
    assert again == table and same == files


def test_past_the_horizon_the_merge_decides(load):
    arrivals = [sale("a", 1, 1, 1)], [sale("a", 2, 4, 2), sale("b", 1, 2, 1)]
    table, _ = load(*arrivals, arrivals[0], replay_horizon="0 seconds")
    assert table == {"a": (2, 4), "b": (1, 2)}


def test_without_a_version_every_row_is_merged(load):
    table, _ = load([sale("a", 1, 1, 1)], [sale("a", 1, 2, 1)], [sale("a", 1, 1, 1)], version=None)
    assert table == {"a": (1, 1)}


def test_a_load_writes_one_file_into_a_folder(load, tmp_path):
    table, files = load([sale(f"k{i}", 1 + i % 2, 1, 1) for i in range(300)])
    assert len(table) == 300 and len(files) == 2
    keys = [p.parent for p in Path(f"{tmp_path}/facts__keys").rglob("*.parquet")]
    assert len(keys) == len(set(keys))


def test_state_is_on_disk(spark, load, tmp_path, monkeypatch):
    """Replays are dropped by state in RocksDB, 16 bytes a row, and the session is as it was."""
    key, seen, merge = "spark.sql.streaming.stateStore.providerClass", [], loaders.incremental.write_upsert
    before = spark.conf.get(key)
    monkeypatch.setattr(loaders.incremental, "write_upsert",
                        lambda s, *a, **k: seen.append(s.conf.get(key)) or merge(s, *a, **k))
    table, _ = load([sale("a", 1, 1, 1)], [sale("a", 1, 1, 1), sale("b", 1, 2, 1)])
    assert table == {"a": (1, 1), "b": (1, 2)}
    assert seen and set(seen) == {loaders.DISK_STATE[key]} and spark.conf.get(key) == before
    assert [p for p in (tmp_path / "ck" / "state").rglob("*.changelog")]
    with loaders.disk_state(spark):
        spark.conf.set(key, before)
        with loaders.disk_state(spark):  # what the session names stays
            assert spark.conf.get(key) == before
