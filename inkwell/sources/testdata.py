"""Adapter: the driver's TPC-H-like tables -> the five raw catalog tables.

Every derived column is a deterministic expression on source keys, so the
same tables can be stated in SQL for the DuckDB oracle
(``inkwell.plans.oracle.RAW_CTES``).  Joins are written small-side-last so
the big fact (lineitem) meets one pre-joined order attribute table:

    lineitem -> (orders -> customer -> nation -> region)

nation and region are fixed-size dimensions (25 and 5 rows by the TPC-H
spec), so they are the only sides broadcast by hint; every other join is
left to the size-checked planner (static stats + AQE runtime stats).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.schemas import RAW_SCHEMAS, assert_schema

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")

# Fixed values of the adapter (they must equal the oracle's SQL).
LOAD_TS = "2000-01-01 00:00:00"
RESTOCK_BASE = "2001-08-01"
PUBLISHER_TYPES = ["Traditional", "Independent", "Academic", "Digital"]
BOOK_FORMATS = ["Hardcover", "Paperback", "eBook", "Audiobook"]
WAREHOUSES = ["Warehouse_A", "Warehouse_B", "Warehouse_C"]


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE chain (index already reduced modulo len)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _load_ts() -> Column:
    return F.lit(LOAD_TS).cast("timestamp_ntz")


def raw_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_source(spark, sf_dir, "supplier")
    nation = read_source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
    k = F.col("s_suppkey")
    df = s.select(
        k.alias("publisher_id"),
        F.col("s_name").alias("publisher_name"),
        _pick(k % 4, PUBLISHER_TYPES).alias("publisher_type"),
        F.col("n_name").alias("country"),
        (F.lit(1950) + (k * 7) % 71).cast("int").alias("established_year"),
        (F.lit(1) + (k * 13) % 500).cast("int").alias("total_titles"),
        F.when(F.col("s_acctbal") >= 1000, "Active").otherwise("Inactive").alias("active_status"),
        _load_ts().alias("created_at"),
    )
    return assert_schema(df, RAW_SCHEMAS["publishers"], "raw_publishers")


def raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_source(spark, sf_dir, "part")
    n_suppliers = read_source(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    k = F.col("p_partkey")
    df = part.select(
        k.alias("book_id"),
        F.concat(F.lit("978"), F.lpad(k.cast("string"), 10, "0")).alias("isbn"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        (k % n_suppliers).alias("publisher_id"),
        F.col("p_type").alias("genre"),
        (F.lit(2000) + k % 25).cast("int").alias("publication_year"),
        (F.col("p_size") * 16).cast("int").alias("page_count"),
        ((F.lit(999) + (k * 7919) % 9001) / F.lit(100.0)).alias("price"),
        _pick(k % 4, BOOK_FORMATS).alias("format"),
        F.when(k % 10 == 0, "Spanish").when(k % 10 == 1, "French")
         .when(k % 10 == 2, "German").otherwise("English").alias("language"),
        _load_ts().alias("created_at"),
    )
    return assert_schema(df, RAW_SCHEMAS["books"], "raw_books")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_source(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate")
    orders = read_source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read_source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_source(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_source(spark, sf_dir, "region").select("r_regionkey", "r_name")

    customer_region = (
        customer
        .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    order_attrs = orders.join(customer_region, orders.o_custkey == customer_region.c_custkey).select(
        "o_orderkey", "o_orderpriority", "c_mktsegment", "r_name")
    li = lineitem.join(order_attrs, lineitem.l_orderkey == order_attrs.o_orderkey)

    sale_date = F.col("l_shipdate").cast("date")
    df = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    sale_date.cast("string")).alias("transaction_id"),
        F.col("l_partkey").alias("book_id"),
        sale_date.alias("sale_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_discount") * 100).alias("discount_percent"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("total_amount"),
        F.col("o_orderpriority").alias("channel"),
        F.col("c_mktsegment").alias("customer_type"),
        F.col("r_name").alias("region"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
    )
    return assert_schema(df, RAW_SCHEMAS["sales"], "raw_sales")


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_source(spark, sf_dir, "part").select("p_partkey")
    # Up to three warehouses per book; a generator, not a join.
    slots = part.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w"))
    slots = slots.where((F.col("p_partkey") + F.col("w")) % 2 == 0)
    k, w = F.col("p_partkey"), F.col("w")
    df = slots.select(
        (k * 3 + w).alias("inventory_id"),
        k.alias("book_id"),
        _pick(w, WAREHOUSES).alias("warehouse_location"),
        ((k * 37 + w * 331) % 1001).cast("int").alias("stock_quantity"),
        (F.lit(10) + (k * 13 + w * 7) % 91).cast("int").alias("reorder_point"),
        F.date_sub(F.lit(RESTOCK_BASE).cast("date"), ((k * 3 + w * 5) % 90).cast("int")).alias("last_restock_date"),
        ((F.lit(50) + (k * 17 + w * 29) % 451) / F.lit(100.0)).alias("storage_cost_per_unit"),
        (F.lit(365) + (k * 11 + w * 3) % 731).cast("int").alias("shelf_life_days"),
        _load_ts().alias("created_at"),
    )
    return assert_schema(df, RAW_SCHEMAS["inventory"], "raw_inventory")


def raw_campaign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_source(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    d = F.col("ts").cast("date").alias("campaign_date")
    # Partial aggregation on (user_id, day) happens map-side before the shuffle.
    daily = events.groupBy("user_id", d).agg(
        F.count(F.when(F.col("event_type") == "view", 1)).alias("impressions"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,2)"))
              .otherwise(F.lit(0).cast("decimal(12,2)"))).cast("double").alias("spend"),
    )
    u, day = F.col("user_id"), F.col("campaign_date")
    df = daily.select(
        F.concat(F.lit("CAMP_"), u.cast("string"), F.lit("_"), F.date_format(day, "yyyyMMdd")).alias("campaign_id"),
        F.when(u % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("EXP_"), (u % 50).cast("string"))).alias("experiment_id"),
        F.when(F.dayofmonth(day) % 2 == 0, "control").otherwise("treatment").alias("treatment_group"),
        "impressions", "clicks", "spend", "campaign_date",
        day.cast("timestamp_ntz").alias("created_at"),
    )
    return assert_schema(df, RAW_SCHEMAS["campaign_events"], "raw_campaign_events")


RAW_BUILDERS = {
    "publishers": raw_publishers,
    "books": raw_books,
    "sales": raw_sales,
    "inventory": raw_inventory,
    "campaign_events": raw_campaign_events,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in RAW_BUILDERS.items()}
