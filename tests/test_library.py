"""Parts of the library that no registered query reaches: failures and
fallbacks on small fixtures, writers, stored models, logs, display tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwell.operators import content, extras, metrics, quality, recommend, similarity
from inkwell.plans.models import TABLE_MODELS, Models
from inkwell.sources import catalog
from tests.conftest import SF_SMALL

BOOKS = [(1, "A", "X", "Mystery", 10.0), (2, "B", "Y", "Romance", 20.0), (3, "C", "Z", "Unheard", 30.0)]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, "book_id long, title string, author string, genre string, price double")


def test_failing_rows_are_found_and_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (1, -2.0), (None, 7000.0), (4, None)], "k long, v double")
    parent = spark.createDataFrame([(1,)], "k long")
    found = [quality.unique(df, "t", "k"), quality.not_null(df, "t", "k"),
             quality.accepted_range(df, "t", "v", 0, 1000), quality.relationships(df, "t", "k", parent, "k")]
    rows = [{(r.failing_value, r.n_rows) for r in f.collect()} for f in found]
    assert rows[0] == {("1", 2)} and len(rows[1]) == 1
    assert {v for v, _ in rows[2]} == {"-2.0", "7000.0"} and {v for v, _ in rows[3]} == {"4"}
    for f in found:
        quality.store_failures(f, str(tmp_path / "failures"))
    assert spark.read.parquet(str(tmp_path / "failures")).count() == sum(map(len, rows))


def test_missing_empty_and_broken_tables(spark, tmp_path):
    sales = "transaction_id string, total_amount double, quantity int"
    bad = spark.range(3).select(F.raise_error(F.lit("unreadable")).cast("string").alias("x"))
    out = quality.validate_tables(spark, {
        "books": lambda: spark.read.parquet(str(tmp_path / "none")),
        "publishers": lambda: spark.createDataFrame([], "a int"),
        "sales": lambda: spark.createDataFrame([("a", -1.0, 0), ("b", 2.0, 1)], sales),
        "inventory": lambda: bad}).collect()
    got = {r.table_name: (r.overall_status, r.issues) for r in out}
    assert got["books"] == ("FAIL", ["Table does not exist"])
    assert got["publishers"] == ("FAIL", ["Table is empty"])
    assert got["sales"][0] == "FAIL" and len(got["sales"][1]) == 2
    assert got["inventory"][0] == "ERROR" and "unreadable" in got["inventory"][1][0]


def test_cascade_reaches_every_branch(spark):
    users = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b")], "user_id string, user_type string")
    personal = spark.createDataFrame([("u1", 7, 0.5, 1)], "user_id string, book_id long, score double, rank int")
    by_type = spark.createDataFrame([("a", 8, 9, 1)], "user_type string, book_id long, popularity_score long, rank int")
    overall = spark.createDataFrame([(9, 100), (10, 50)], "book_id long, total_sales long")
    got = {(r.user_id, r.book_id, r.source) for r in
           extras.recommend_with_fallback(users, personal, by_type, overall, 1).collect()}
    assert got == {("u1", 7, "personal"), ("u2", 8, "user_type"), ("u3", 9, "overall")}


def test_items_without_vector_score_their_popularity(spark):
    scores = spark.createDataFrame([("u", 1, 0.3)], "user_id string, book_id long, score double")
    inter = spark.createDataFrame([("u", 2), ("v", 1), ("v", 3), ("v", 4)], "user_id string, book_id long")
    vectors = spark.createDataFrame([(1,), (2,)], "book_id long")
    popular = spark.createDataFrame([(3, 40), (1, 60)], "book_id long, total_sales long")
    got = {tuple(r) for r in recommend.with_popularity(scores, inter, vectors, popular).collect()}
    assert got == {("u", 1, 0.3), ("u", 3, 40.0)}


def test_popular_list_for_books_without_vector(spark, books):
    topk = spark.createDataFrame([(1, 2, 0.9, 1)], "book_id long, other_id long, similarity_score double, rank int")
    popular = spark.createDataFrame([(2, 30, 1), (3, 20, 1)], "book_id long, total_sales long, unique_customers long")
    got = {(r.source_book_id, r.book_id) for r in recommend.similar_books(books, topk, popular, 2).collect()}
    assert got == {(1, 2), (2, 2), (2, 3), (3, 2), (3, 3)}


def test_minimum_similarity(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "book_id long, vec array<double>")
    low = {(r.book_id, r.other_id) for r in similarity.item_similarity_topk(vec, 2).collect()}
    high = {(r.book_id, r.other_id) for r in similarity.item_similarity_topk(vec, 2, min_similarity=0.7).collect()}
    assert len(low) == 6 and high == {(1, 2), (2, 1)}


def test_allowed_values_and_palette(books):
    with pytest.raises(ValueError):
        content.ad_copy(books, ["radio"])
    with pytest.raises(ValueError):
        content.image_prompts(books, ["cubist"])
    assert content.ad_copy(books, ["print"]).count() > 0
    assert content.image_prompts(books, ["commercial"]).count() == 9
    palettes = {r.book_id: tuple(r.colors) for r in content.color_palette(books).collect()}
    assert palettes[1] != palettes[3] and palettes[2] != palettes[3]


def test_display_tables(books):
    ad = content.display_ad_copy(content.ad_copy(books)).first()
    assert ad.type == "Template" and ad.confidence == "80.0%" and ad.variant.startswith("#")
    assert content.display_image_prompts(content.image_prompts(books)).first().focus in {"Cover", "Typography", "Theme"}
    row = content.display_recommendations(books.limit(1)).first()
    assert (row.confidence_score, row.reason) == ("N/A", "Recommended")


def test_evaluate_and_log(spark, tmp_path):
    path = str(tmp_path / "log")
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0)], "label double, prediction double")
    cls = spark.createDataFrame([(1, 1), (0, 1)], "label int, prediction int")
    metrics.log_metrics(metrics.evaluate(reg, "forecasting", "demand", "2001-01-01"), path)
    metrics.log_metrics(metrics.evaluate(reg, "forecasting", "demand", "2001-02-01"), path)
    log = metrics.log_metrics(metrics.evaluate(cls, "classification", "kind", "2001-01-01"), path)
    assert log.count() == 14 and metrics.evaluate(reg, "recommendation", "x", "2001-01-01").count() == 0
    latest = {(r.model_name, r.metric): r.ts for r in metrics.latest_metrics(log).collect()}
    assert latest["demand", "mae"] == dt.datetime(2001, 2, 1) and ("kind", "accuracy") in latest


def test_time_series_rows(spark):
    daily = spark.range(20).select(F.expr("date_add(date'2001-01-01', cast(id as int))").alias("sale_date"))
    rows = extras.time_series_rows(daily, 5).collect()
    for split in range(1, 5):
        own = [r for r in rows if r.split == split]
        train, test = ([r.sale_date for r in own if r.role == x] for x in ("train", "test"))
        assert len(train) == 4 * split and len(test) == 4 and max(train) < min(test)


def test_catalog_writers(spark, tmp_path):
    catalog.create_schemas(spark, ["inkwell_a"])
    assert spark.catalog.databaseExists("inkwell_a") and not catalog.table_exists(spark, "t", "inkwell_a")
    df, path = spark.range(3), str(tmp_path / "t")
    catalog.save_table(df, path)
    catalog.save_table(df, path)
    catalog.append_table(df, path)
    assert catalog.scan_table(spark, path).count() == 6
    catalog.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_stored_models_equal_views(spark, tmp_path):
    stored, lazy = Models(spark, SF_SMALL, store=str(tmp_path / "store")), Models(spark, SF_SMALL)
    for name in TABLE_MODELS:
        a, b = getattr(stored, name), getattr(lazy, name)
        assert a.columns == b.columns
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_load_stamp_reaches_the_models(spark):
    m = Models(spark, SF_SMALL, run_ts="2001-08-01 12:00:00")
    assert len(m.fact_sales.columns) == 20 and len(m.book_features.columns) == 34
    stamp = dt.datetime(2001, 8, 1, 12)
    assert [r[0] for r in m.fact_sales.select("dbt_updated_at").distinct().collect()] == [stamp]
    assert [r[0] for r in m.book_features.select("feature_created_at").distinct().collect()] == [stamp]
