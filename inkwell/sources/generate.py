"""Seeded generation of the five raw tables as Spark jobs.

Rows come from ``spark.range(n)``; every random draw is a hash of
(seed, column, id), so a table is the same for any partitioning or
cluster size and needs no driver-side loop. Foreign keys are draws over
the parent's id range. Text values that the source fakes (names,
companies, ISBNs) are deterministic labels here.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.schemas import RAW_SCHEMAS, assert_schema

# Value domains of the source generator.
PUBLISHER_TYPES = ["Traditional", "Independent", "Academic", "Digital"]
ACTIVE_STATUS = ["Active", "Inactive"]
GENRES = ["Fiction", "Non-Fiction", "Science", "Biography", "Fantasy"]
FORMATS = ["Hardcover", "Paperback", "eBook", "Audiobook"]
LANGUAGES = ["English", "Spanish", "French", "German"]
CHANNELS = ["Online", "Retail", "Wholesale", "Direct"]
CUSTOMER_TYPES = ["Individual", "Business", "Educational"]
REGIONS = ["North", "South", "East", "West", "Central"]
WAREHOUSES = ["Warehouse_A", "Warehouse_B", "Warehouse_C"]
TREATMENTS = ["control", "treatment"]


@dataclass(frozen=True)
class GenerationConfig:
    n_publishers: int = 1000
    n_books: int = 10000
    n_sales: int = 100000
    n_inventory: int = 50000
    n_campaigns: int = 5000
    seed: int = 42
    as_of: _dt.date = _dt.date(2001, 8, 1)
    partitions: int | None = None


class _Draw:
    """Deterministic pseudo-random draws keyed by (seed, name, id)."""

    def __init__(self, seed: int):
        self.seed = seed

    def _h(self, name: str) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(name), F.col("id"))

    def uniform(self, name: str) -> Column:
        """Double in [0, 1)."""
        return F.pmod(self._h(name), F.lit(1 << 30)).cast("double") / float(1 << 30)

    def integer(self, name: str, lo: int, hi: int | Column) -> Column:
        """Integer in [lo, hi] (hi may be a column)."""
        span = (hi - lo + 1) if isinstance(hi, int) else (hi - F.lit(lo) + 1)
        return (F.lit(lo) + F.pmod(self._h(name), span)).cast("int")

    def choice(self, name: str, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.integer(name, 1, len(values)))

    def chance(self, name: str, p: float) -> Column:
        return self.uniform(name) < p

    def money(self, name: str, lo: float, hi: float) -> Column:
        return F.round(F.lit(lo) + self.uniform(name) * (hi - lo), 2)


def _range(spark: SparkSession, n: int, cfg: GenerationConfig) -> DataFrame:
    return spark.range(0, n, numPartitions=cfg.partitions) if cfg.partitions else spark.range(0, n)


def _key(prefix: str, width: int, col: Column | None = None) -> Column:
    return F.concat(F.lit(prefix), F.lpad((col if col is not None else F.col("id")).cast("string"), width, "0"))


def _created(d: _Draw, cfg: GenerationConfig) -> Column:
    start = _dt.datetime(cfg.as_of.year, 1, 1)
    secs = F.lit(int(start.timestamp())) + (d.uniform("created_at") * (cfg.as_of - start.date()).days * 86400).cast("bigint")
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def _days_back(d: _Draw, name: str, cfg: GenerationConfig, days: int) -> Column:
    return F.date_sub(F.lit(str(cfg.as_of)).cast("date"), d.integer(name, 0, days))


def generate_publishers(spark: SparkSession, cfg: GenerationConfig) -> DataFrame:
    d = _Draw(cfg.seed + 1)
    df = _range(spark, cfg.n_publishers, cfg).select(
        F.col("id").alias("publisher_id"),
        F.concat(F.lit("Publisher "), F.col("id").cast("string")).alias("publisher_name"),
        d.choice("publisher_type", PUBLISHER_TYPES).alias("publisher_type"),
        F.concat(F.lit("Country "), d.integer("country", 1, 50).cast("string")).alias("country"),
        d.integer("established_year", 1950, 2020).alias("established_year"),
        d.integer("total_titles", 1, 500).alias("total_titles"),
        d.choice("active_status", ACTIVE_STATUS).alias("active_status"),
        _created(d, cfg).alias("created_at"))
    return assert_schema(df, RAW_SCHEMAS["publishers"], "generated publishers")


def generate_books(spark: SparkSession, cfg: GenerationConfig) -> DataFrame:
    d = _Draw(cfg.seed + 2)
    df = _range(spark, cfg.n_books, cfg).select(
        F.col("id").alias("book_id"),
        F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("isbn"),
        F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("Author "), d.integer("author", 1, 5000).cast("string")).alias("author"),
        d.integer("publisher_id", 0, cfg.n_publishers - 1).cast("bigint").alias("publisher_id"),
        d.choice("genre", GENRES).alias("genre"),
        d.integer("publication_year", 2000, 2024).alias("publication_year"),
        d.integer("page_count", 50, 800).alias("page_count"),
        d.money("price", 9.99, 99.99).alias("price"),
        d.choice("format", FORMATS).alias("format"),
        d.choice("language", LANGUAGES).alias("language"),
        _created(d, cfg).alias("created_at"))
    return assert_schema(df, RAW_SCHEMAS["books"], "generated books")


def generate_sales(spark: SparkSession, cfg: GenerationConfig) -> DataFrame:
    d = _Draw(cfg.seed + 3)
    base = _range(spark, cfg.n_sales, cfg).select(
        "id", d.integer("quantity", 1, 5).alias("quantity"),
        d.money("unit_price", 9.99, 99.99).alias("unit_price"),
        (d.uniform("discount") * 0.3).alias("disc"))
    df = base.select(
        _key("TXN_", 8).alias("transaction_id"),
        d.integer("book_id", 0, cfg.n_books - 1).cast("bigint").alias("book_id"),
        _days_back(d, "sale_date", cfg, 730).alias("sale_date"),
        "quantity", "unit_price",
        F.round(F.col("disc") * 100, 2).alias("discount_percent"),
        F.round(F.col("quantity") * F.col("unit_price") * (F.lit(1) - F.col("disc")), 2).alias("total_amount"),
        d.choice("channel", CHANNELS).alias("channel"),
        d.choice("customer_type", CUSTOMER_TYPES).alias("customer_type"),
        d.choice("region", REGIONS).alias("region"),
        _created(d, cfg).alias("created_at"))
    return assert_schema(df, RAW_SCHEMAS["sales"], "generated sales")


def generate_inventory(spark: SparkSession, cfg: GenerationConfig) -> DataFrame:
    d = _Draw(cfg.seed + 4)
    df = _range(spark, cfg.n_inventory, cfg).select(
        F.col("id").alias("inventory_id"),
        d.integer("book_id", 0, cfg.n_books - 1).cast("bigint").alias("book_id"),
        d.choice("warehouse", WAREHOUSES).alias("warehouse_location"),
        d.integer("stock_quantity", 0, 1000).alias("stock_quantity"),
        d.integer("reorder_point", 10, 100).alias("reorder_point"),
        _days_back(d, "last_restock_date", cfg, 182).alias("last_restock_date"),
        d.money("storage_cost", 0.50, 5.00).alias("storage_cost_per_unit"),
        d.integer("shelf_life_days", 365, 1825).alias("shelf_life_days"),
        _created(d, cfg).alias("created_at"))
    return assert_schema(df, RAW_SCHEMAS["inventory"], "generated inventory")


def generate_campaigns(spark: SparkSession, cfg: GenerationConfig) -> DataFrame:
    d = _Draw(cfg.seed + 5)
    base = _range(spark, cfg.n_campaigns, cfg).select("id", d.integer("impressions", 1000, 100000).alias("imp"))
    df = base.select(
        _key("CAMP_", 6).alias("campaign_id"),
        F.when(d.chance("has_experiment", 0.3),
               F.concat(F.lit("EXP_"), F.lpad(d.integer("experiment", 1, 50).cast("string"), 3, "0")))
         .alias("experiment_id"),
        F.when(d.chance("has_treatment", 0.3), d.choice("treatment", TREATMENTS)).alias("treatment_group"),
        F.col("imp").cast("bigint").alias("impressions"),
        d.integer("clicks", 10, F.floor(F.col("imp") / 10).cast("int")).cast("bigint").alias("clicks"),
        d.money("spend", 100.0, 10000.0).alias("spend"),
        _days_back(d, "campaign_date", cfg, 365).alias("campaign_date"),
        _created(d, cfg).alias("created_at"))
    return assert_schema(df, RAW_SCHEMAS["campaign_events"], "generated campaign_events")


def generate_all(spark: SparkSession, cfg: GenerationConfig | None = None) -> dict[str, DataFrame]:
    cfg = cfg or GenerationConfig()
    return {"publishers": generate_publishers(spark, cfg), "books": generate_books(spark, cfg),
            "sales": generate_sales(spark, cfg), "inventory": generate_inventory(spark, cfg),
            "campaign_events": generate_campaigns(spark, cfg)}
