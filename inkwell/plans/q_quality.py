"""Registered data-quality, incremental and table-access queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.functions.columns import safe_division
from inkwell.operators import constraints, incremental, quality
from inkwell.plans.oracle import build
from inkwell.plans.registry import register
from inkwell.session import scratch_dir
from inkwell.sources import catalog

# Declared column tests of the models (fixed list from the model YAML).
UNIQUE_NOT_NULL = [
    ("raw_publishers", "publisher_id"), ("raw_books", "book_id"), ("raw_sales", "transaction_id"),
    ("stg_publishers", "publisher_id"), ("stg_books", "book_id"), ("stg_sales", "transaction_id"),
    ("stg_inventory", "inventory_id"), ("dim_publishers", "publisher_id"),
    ("dim_books", "book_id"), ("fact_sales", "transaction_id"),
]
NOT_NULL_ONLY = [("fact_sales", "book_id")]
RANGES = [("stg_books", "price", 0, 1000), ("stg_sales", "total_amount", 0, None)]
RELATIONSHIPS = [("fact_sales", "book_id", "dim_books", "book_id")]
RAW_TABLES = ["publishers", "books", "sales", "inventory", "campaign_events"]


def _frame(m, table: str):
    return m.raw(table[4:]) if table.startswith("raw_") else getattr(m, table)


def _spark_tests(m, kinds=("unique", "not_null", "accepted_range", "relationships")):
    out = []
    if "unique" in kinds:
        out += [("unique", t, c, quality.unique(_frame(m, t), t, c)) for t, c in UNIQUE_NOT_NULL]
    if "not_null" in kinds:
        out += [("not_null", t, c, quality.not_null(_frame(m, t), t, c))
                for t, c in UNIQUE_NOT_NULL + NOT_NULL_ONLY]
    if "accepted_range" in kinds:
        out += [("accepted_range", t, c, quality.accepted_range(_frame(m, t), t, c, lo, hi))
                for t, c, lo, hi in RANGES]
    if "relationships" in kinds:
        out += [("relationships", t, c, quality.relationships(_frame(m, t), t, c, _frame(m, p), pc))
                for t, c, p, pc in RELATIONSHIPS]
    return out


def _sql_tests(kinds=("unique", "not_null", "accepted_range", "relationships")):
    """(test, table, column, failure-select) per declared test."""
    out = []
    head = "SELECT '{k}' AS test_name, '{t}' AS table_name, '{c}' AS column_name, "
    if "unique" in kinds:
        out += [("unique", t, c, head.format(k="unique", t=t, c=c) +
                 f"CAST({c} AS VARCHAR) AS failing_value, COUNT(*) AS n_rows FROM {t} "
                 f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1") for t, c in UNIQUE_NOT_NULL]
    if "not_null" in kinds:
        out += [("not_null", t, c, head.format(k="not_null", t=t, c=c) +
                 f"CAST(NULL AS VARCHAR) AS failing_value, COUNT(*) AS n_rows FROM {t} "
                 f"WHERE {c} IS NULL HAVING COUNT(*) > 0") for t, c in UNIQUE_NOT_NULL + NOT_NULL_ONLY]
    if "accepted_range" in kinds:
        for t, c, lo, hi in RANGES:
            cond = " OR ".join(x for x in (f"{c} < {lo}" if lo is not None else "",
                                           f"{c} > {hi}" if hi is not None else "") if x)
            out.append(("accepted_range", t, c, head.format(k="accepted_range", t=t, c=c) +
                        f"CAST({c} AS VARCHAR) AS failing_value, COUNT(*) AS n_rows FROM {t} "
                        f"WHERE {cond} GROUP BY {c}"))
    if "relationships" in kinds:
        out += [("relationships", t, c, head.format(k="relationships", t=t, c=c) +
                 f"CAST(s.{c} AS VARCHAR) AS failing_value, COUNT(*) AS n_rows FROM {t} s "
                 f"WHERE s.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} x WHERE x.{pc} = s.{c}) "
                 f"GROUP BY s.{c}") for t, c, p, pc in RELATIONSHIPS]
    return out


def _deps(tests):
    return sorted({t for _, t, _, _ in tests} | {"dim_books"})


def _union_sql(tests) -> str:
    return build("\nUNION ALL\n".join(s for *_, s in tests), *_deps(tests))


for _kind, _key in [("unique", "dq_unique"), ("not_null", "dq_not_null"),
                    ("accepted_range", "dq_accepted_range"),
                    ("relationships", "dq_relationship_fact_books")]:
    register(_key, _union_sql(_sql_tests((_kind,))))(
        lambda m, k=_kind: quality.union_all(f for *_, f in _spark_tests(m, (k,))))

_summary_sql = "\nUNION ALL\n".join(
    f"SELECT '{k}' AS test_name, '{t}' AS table_name, '{c}' AS column_name, "
    f"CAST(COALESCE(SUM(n_rows), 0) AS BIGINT) AS failures, "
    f"CASE WHEN COALESCE(SUM(n_rows), 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({s}) f"
    for k, t, c, s in _sql_tests())
register("dq_tests_summary", build(_summary_sql, *_deps(_sql_tests())))(
    lambda m: _tests_summary(m))


def _tests_summary(m):
    """One aggregate per table for its not-null and range tests, one grouping
    per unique key, one join per relationship."""
    tables = list(dict.fromkeys(t for t, _ in UNIQUE_NOT_NULL + NOT_NULL_ONLY))
    tables += [t for t, *_ in RANGES if t not in tables]
    rows = [quality.table_summary(
        _frame(m, t), t, [c for x, c in UNIQUE_NOT_NULL + NOT_NULL_ONLY if x == t],
        [(c, lo, hi) for x, c, lo, hi in RANGES if x == t]) for t in tables]
    return quality.union_all([quality.test_summary(_spark_tests(m, ("unique", "relationships"))), *rows])

# -- table validator ---------------------------------------------------------
_RAW_COLS = {
    "publishers": ["publisher_id", "publisher_name", "publisher_type", "country", "established_year",
                   "total_titles", "active_status", "created_at"],
    "books": ["book_id", "isbn", "title", "author", "publisher_id", "genre", "publication_year",
              "page_count", "price", "format", "language", "created_at"],
    "sales": ["transaction_id", "book_id", "sale_date", "quantity", "unit_price", "discount_percent",
              "total_amount", "channel", "customer_type", "region", "created_at"],
    "inventory": ["inventory_id", "book_id", "warehouse_location", "stock_quantity", "reorder_point",
                  "last_restock_date", "storage_cost_per_unit", "shelf_life_days", "created_at"],
    "campaign_events": ["campaign_id", "experiment_id", "treatment_group", "impressions", "clicks",
                        "spend", "campaign_date", "created_at"],
}
_RULES_SQL = quality.TABLE_RULES


def _nulls_sql(t: str) -> str:
    return " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in _RAW_COLS[t])


_null_ratio_sql = "\nUNION ALL\n".join(
    f"SELECT 'raw_{t}' AS table_name, COUNT(*) AS record_count, ({_nulls_sql(t)}) AS null_cells, "
    f"CASE WHEN COUNT(*) > 0 THEN ({_nulls_sql(t)}) / (COUNT(*) * {len(_RAW_COLS[t])}) END AS null_ratio "
    f"FROM raw_{t}" for t in RAW_TABLES)
register("dq_null_ratio", build(_null_ratio_sql, *[f"raw_{t}" for t in RAW_TABLES]))(
    lambda m: quality.union_all(quality.null_ratio(m.raw(t), f"raw_{t}") for t in RAW_TABLES))

_rules_sql = "\nUNION ALL\n".join(
    f"SELECT 'raw_{t}' AS table_name, '{name}' AS rule, COUNT(*) FILTER (WHERE {cond}) AS violations FROM raw_{t}"
    for t, rules in _RULES_SQL.items() for name, cond, _ in rules)
register("dq_table_rules", build(_rules_sql, *[f"raw_{t}" for t in _RULES_SQL]))(
    lambda m: quality.union_all(quality.table_rules(m.raw(t), t).withColumn("table_name", F.lit(f"raw_{t}"))
                                for t in _RULES_SQL))


def _report_sql(t: str) -> str:
    n = len(_RAW_COLS[t])
    pct = ("CAST((nulls * 20000 + n * {k}) // (n * {k} * 2) // 100 AS VARCHAR) || '.' || "
           "lpad(CAST((nulls * 20000 + n * {k}) // (n * {k} * 2) % 100 AS VARCHAR), 2, '0') || '%'").format(k=n)
    issues = [f"CASE WHEN nulls > n * {n} * CAST(0.1 AS DOUBLE) THEN 'High null percentage: ' || {pct} END"]
    issues += [f"CASE WHEN {name} > 0 THEN '{text}' || CAST({name} AS VARCHAR) END"
               for name, _, text in _RULES_SQL.get(t, [])]
    rule_cols = "".join(f", COUNT(*) FILTER (WHERE {cond}) AS {name}" for name, cond, _ in _RULES_SQL.get(t, []))
    issue_expr = (f"CASE WHEN n = 0 THEN ['Table is empty'] ELSE "
                  f"list_filter([{', '.join(issues)}], lambda x: x IS NOT NULL) END")
    return (f"SELECT '{t}' AS table_name, CASE WHEN len(issues) = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status, "
            f"n AS record_count, CAST({n} AS INTEGER) AS column_count, "
            f"CASE WHEN n > 0 THEN {pct} END AS null_percentage, issues FROM ("
            f"SELECT *, {issue_expr} AS issues FROM ("
            f"SELECT COUNT(*) AS n, ({_nulls_sql(t)}) AS nulls{rule_cols} FROM raw_{t}) a) b")


register("dq_report", build("\nUNION ALL\n".join(_report_sql(t) for t in RAW_TABLES),
                            *[f"raw_{t}" for t in RAW_TABLES]))(
    lambda m: quality.union_all(quality.table_report(m.raw(t), t) for t in RAW_TABLES))

# -- incremental fact load ----------------------------------------------------
FIRST_LOAD_END = "2001-07-01"
CHANGED_DAY = "2001-06-30"
LATE_DAY = "2001-01-15"
MOVED = ("2001-03-05", "2001-03-20")  # sales of these days move on by MOVED_BY days
MOVED_BY = 60
NULL_KEYS = ("2001-05-01", "2001-05-31")  # sales of every tenth book lose their id
FIRST_LOAD = "2001-07-01 00:00:00"
REPEATED_LOAD = "2001-07-15 00:00:00"
SECOND_LOAD = "2001-08-01 00:00:00"


def _incremental(m):
    """Two loads of the fact table: the first takes the sales before
    FIRST_LOAD_END except those of LATE_DAY; the second brings the rest, the
    late ones included, CHANGED_DAY twice again with other quantities, MOVED
    with dates in other months, and the sales without id again."""
    date = lambda d: F.lit(d).cast("date")
    day = lambda d: F.col("sale_date") == date(d)
    no_key = F.col("sale_date").between(*map(date, NULL_KEYS)) & (F.col("book_id") % 10 == 0)
    source = m.fact_sales.withColumn(
        "transaction_id", F.when(no_key, F.lit(None)).otherwise(F.col("transaction_id")))
    # The facts of a run with this load stamp (as ``Models(run_ts=...)`` gives them).
    facts = lambda ts: source.withColumn(
        incremental.LOAD_STAMP, F.lit(ts).cast("timestamp_ntz"))
    early = (F.col("sale_date") < date(FIRST_LOAD_END)) & ~day(LATE_DAY)
    path = scratch_dir(m.spark, f"fact-incremental-{uuid.uuid4().hex}")
    incremental.write_upsert(m.spark, path, facts(FIRST_LOAD).where(early))
    moved = F.col("sale_date").between(*map(date, MOVED))
    batch = facts(SECOND_LOAD).where(~early | day(CHANGED_DAY) | moved | no_key)
    batch = batch.withColumn("quantity", F.col("quantity") + F.when(day(CHANGED_DAY), 1).otherwise(0))
    batch = batch.withColumn("sale_date", F.when(moved, F.date_add("sale_date", MOVED_BY)).otherwise(
        F.col("sale_date")))
    batch = (batch.withColumn("sale_year", F.year("sale_date")).withColumn("sale_month", F.month("sale_date"))
             .withColumn("day_of_week", (F.dayofweek("sale_date") - 1).cast("int")))
    again = facts(REPEATED_LOAD).where(day(CHANGED_DAY)).withColumn("quantity", F.col("quantity") + 5)
    return incremental.write_upsert(m.spark, path, batch.unionByName(again))


_order = ("book_id, sale_date, quantity, unit_price, discount_percent, total_amount, channel, customer_type, "
          "region")
# Both loads in one statement: a sale stands as its last load left it, one sale without id is left.
register("fact_sales_incremental", build(f"""
WITH s AS (SELECT * REPLACE (
    if(sale_date BETWEEN DATE '{NULL_KEYS[0]}' AND DATE '{NULL_KEYS[1]}' AND book_id % 10 = 0, NULL, transaction_id)
      AS transaction_id,
    quantity + if(sale_date = DATE '{CHANGED_DAY}', 1, 0) AS quantity,
    sale_date + if(sale_date BETWEEN DATE '{MOVED[0]}' AND DATE '{MOVED[1]}', {MOVED_BY}, 0) AS sale_date),
  if(transaction_id IS NOT NULL AND sale_date < DATE '{FIRST_LOAD_END}'
     AND sale_date NOT IN (DATE '{LATE_DAY}', DATE '{CHANGED_DAY}')
     AND sale_date NOT BETWEEN DATE '{MOVED[0]}' AND DATE '{MOVED[1]}'
     AND NOT (sale_date BETWEEN DATE '{NULL_KEYS[0]}' AND DATE '{NULL_KEYS[1]}' AND book_id % 10 = 0),
     TIMESTAMP '{FIRST_LOAD}', TIMESTAMP '{SECOND_LOAD}') AS dbt_updated_at
  FROM fact_sales)
SELECT * REPLACE (CAST(year(sale_date) AS INTEGER) AS sale_year, CAST(month(sale_date) AS INTEGER) AS sale_month,
  CAST(dayofweek(sale_date) AS INTEGER) AS day_of_week)
FROM (FROM s WHERE transaction_id IS NOT NULL
      UNION ALL (FROM s WHERE transaction_id IS NULL
                 ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _order.split(', '))} LIMIT 1))""",
    "fact_sales"))(_incremental)

# -- constraints over time ------------------------------------------------------
LOADS = 4
REPEATED, ORPHANED = 97, 89  # books whose sales come again a load later, or name an unknown book


def _load(year):
    return F.pmod(year, F.lit(LOADS)).cast("int")


def _constraints(m):
    """Failing keys of each of LOADS batches of facts. Sales of every REPEATEDth
    book are sent again with the next batch, those of every ORPHANEDth name a book
    that the catalogue lacks. The facts' keys are written once, by load, so that a
    batch reads its own; checks read key indexes only, never the loaded facts."""
    facts = m.fact_sales.select("transaction_id", "book_id", _load(F.col("sale_year")).alias("load"))
    facts = facts.withColumn("book_id", F.when(F.col("book_id") % ORPHANED == 0, -F.col("book_id") - 1)
                             .otherwise(F.col("book_id")))
    run = scratch_dir(m.spark, f"constraints-{uuid.uuid4().hex}")
    facts.write.partitionBy("load").parquet(f"{run}/facts")
    facts = m.spark.read.schema(facts.schema).parquet(f"{run}/facts")
    again = facts.where((F.col("book_id") % REPEATED == 0) & (F.col("load") < LOADS - 1)).withColumn(
        "load", F.col("load") + 1)
    sent = facts.unionByName(again)
    constraints.add_keys(m.dim_books, "book_id", f"{run}/books", "0")
    out = []
    for load in range(LOADS):
        batch = sent.where(F.col("load") == load)
        # Written as each load's report: the index grows by the next one's keys.
        for test, rows in (
                ("unique", constraints.unique_failures(m.spark, batch, "transaction_id", f"{run}/sales", str(load))),
                ("relationships", constraints.relationship_failures(m.spark, batch, "book_id", f"{run}/books"))):
            rows.select(F.lit(load).alias("load"), F.lit(test).alias("test"), "key", "n_records").write.mode(
                "append").parquet(f"{run}/failures")
        constraints.add_keys(batch, "transaction_id", f"{run}/sales", str(load))
    return m.spark.read.schema("load int, test string, key string, n_records long").parquet(f"{run}/failures")


register("dq_constraints_over_time", build(f"""
WITH f AS (SELECT transaction_id, if(book_id % {ORPHANED} = 0, -book_id - 1, book_id) AS book_id,
    CAST(sale_year % {LOADS} AS INTEGER) AS load FROM fact_sales),
sent AS (FROM f UNION ALL SELECT transaction_id, book_id, load + 1 FROM f
         WHERE book_id % {REPEATED} = 0 AND load < {LOADS} - 1),
per AS (SELECT load, transaction_id AS key, count(*) AS n FROM sent WHERE transaction_id IS NOT NULL GROUP BY ALL),
upto AS (SELECT load, key, sum(n) OVER (PARTITION BY key ORDER BY load) AS n FROM per)
SELECT load, 'unique' AS test, key, CAST(n AS BIGINT) AS n_records FROM upto WHERE n > 1
UNION ALL
SELECT load, 'relationships', CAST(book_id AS VARCHAR), count(*) FROM sent
WHERE book_id IS NOT NULL AND book_id NOT IN (SELECT book_id FROM dim_books) GROUP BY ALL""",
    "fact_sales", "dim_books"))(_constraints)

# -- table access ---------------------------------------------------------------
register("scan_table", "SELECT * FROM part")(
    lambda m: catalog.scan_table(m.spark, f"{m.sf_dir.rstrip('/')}/part.parquet"))
register("param_filter", build("SELECT book_id, title, price FROM dim_books WHERE price > 20", "dim_books"))(
    lambda m: catalog.fetch(m.spark, "SELECT book_id, title, price FROM {books} WHERE price > :min_price",
                            {"min_price": 20}, books=m.dim_books))
register("safe_division", build("""
SELECT book_id, total_revenue AS n, CAST(total_quantity_sold AS DOUBLE) AS d,
  CASE WHEN total_quantity_sold = 0 THEN CAST(0 AS DOUBLE) ELSE total_revenue / total_quantity_sold END AS ratio
FROM book_features""", "book_features"))(
    lambda m: m.book_features.select(
        "book_id", F.col("total_revenue").alias("n"), F.col("total_quantity_sold").cast("double").alias("d"),
        safe_division("total_revenue", "total_quantity_sold", 0.0).alias("ratio")))
