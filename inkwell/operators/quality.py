"""Data-quality checks. Each check returns failing values (like a stored
test failure table); ``test_summary`` gives one pass/fail row per test.

All checks are aggregations (partial aggregation map-side, no collect).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = ("table_name string, overall_status string, record_count bigint, column_count int, "
                 "null_percentage string, issues array<string>")
REPORT_COLUMNS = [c.split()[0] for c in REPORT_SCHEMA.split(", ")]
FAILURE_COLUMNS = ["test_name", "table_name", "column_name", "failing_value", "n_rows"]


def _failures(test: str, table: str, column: str, df: DataFrame) -> DataFrame:
    """df has columns value (any type) and n_rows."""
    return df.select(
        F.lit(test).alias("test_name"), F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.col("value").cast("string").alias("failing_value"),
        F.col("n_rows").cast("bigint").alias("n_rows"))


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values present more than once (NULLs are not compared)."""
    dup = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
             .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))
    return _failures("unique", table, column, dup)


def not_null(df: DataFrame, table: str, column: str) -> DataFrame:
    nulls = (df.where(F.col(column).isNull()).agg(F.count(F.lit(1)).alias("n_rows"))
               .where(F.col("n_rows") > 0).select(F.lit(None).cast("string").alias("value"), "n_rows"))
    return _failures("not_null", table, column, nulls)


def accepted_range(df: DataFrame, table: str, column: str, min_value: float | None = None,
                   max_value: float | None = None, inclusive: bool = True) -> DataFrame:
    """Values outside [min, max] (NULL passes, as in the range test)."""
    c = F.col(column)
    bad = F.lit(False)
    if min_value is not None:
        bad = bad | ((c < min_value) if inclusive else (c <= min_value))
    if max_value is not None:
        bad = bad | ((c > max_value) if inclusive else (c >= max_value))
    out = df.where(bad).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return _failures("accepted_range", table, column, out)


def relationships(child: DataFrame, table: str, column: str, parent: DataFrame,
                  parent_column: str) -> DataFrame:
    """Child keys with no parent row (left anti join; NULL child passes)."""
    keys = parent.select(F.col(parent_column).alias("_pk"))
    orphans = (child.where(F.col(column).isNotNull())
                    .join(keys, F.col(column) == F.col("_pk"), "left_anti")
                    .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")))
    return _failures("relationships", table, column, orphans)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def test_summary(failures: Sequence[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """One row per declared test: (test, table, column) -> failures, status."""
    rows = [f.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("failures"))
             .select(F.lit(t).alias("test_name"), F.lit(tb).alias("table_name"),
                     F.lit(c).alias("column_name"), "failures")
            for t, tb, c, f in failures]
    return union_all(rows).withColumn(
        "status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))


def table_summary(df: DataFrame, table: str, not_null: Sequence[str] = (),
                  ranges: Sequence[tuple[str, float | None, float | None]] = ()) -> DataFrame:
    """``test_summary`` rows of all not-null and range tests of one table, from
    one aggregate over it."""
    tests = [("not_null", c, F.col(c).isNull()) for c in not_null]
    for c, lo, hi in ranges:
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        tests.append(("accepted_range", c, bad))
    counts = df.agg(*[F.count(F.when(bad, 1)).alias(f"_{i}") for i, (_, _, bad) in enumerate(tests)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("test_name"), F.lit(table).alias("table_name"),
                 F.lit(c).alias("column_name"), F.col(f"_{i}").alias("failures"))
        for i, (kind, c, _) in enumerate(tests)])).alias("t")
    return counts.select(rows).select("t.*").withColumn(
        "status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))


# --------------------------------------------------------------------------
# Table-level validator (null ratio, per-table rules, report).
# --------------------------------------------------------------------------
# Fixed rule set per raw table: (rule name, failing condition as SQL, issue text).
TABLE_RULES = {
    "sales": [
        ("invalid_amount", "total_amount <= 0", "Invalid sales amounts found: "),
        ("invalid_quantity", "quantity <= 0", "Invalid quantities found: "),
    ],
    "books": [("invalid_price", "price <= 0", "Invalid prices found: ")],
    "inventory": [("negative_stock", "stock_quantity < 0", "Negative stock quantities found: ")],
}
NULL_RATIO_LIMIT = 0.1


def _null_cells(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b,
                  [F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns])


def null_ratio(df: DataFrame, table: str) -> DataFrame:
    """Share of NULL cells over all cells, one global aggregate."""
    n_cols = len(df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("n"), _null_cells(df).alias("nulls"))
    return agg.select(
        F.lit(table).alias("table_name"), F.col("n").alias("record_count"),
        F.col("nulls").alias("null_cells"),
        F.when(F.col("n") > 0, F.col("nulls") / (F.col("n") * n_cols)).alias("null_ratio"))


def table_rules(df: DataFrame, table: str) -> DataFrame:
    """Violation count per rule of the table (a row even when 0)."""
    rules = TABLE_RULES.get(table, [])
    if not rules:
        return df.sparkSession.createDataFrame([], "table_name string, rule string, violations bigint")
    agg = df.agg(*[F.count(F.when(F.expr(cond), 1)).alias(name) for name, cond, _ in rules])
    return union_all(agg.select(F.lit(table).alias("table_name"), F.lit(name).alias("rule"),
                                F.col(name).alias("violations")) for name, _, _ in rules)


def _pct_text(nulls: str, n: str, n_cols: int) -> Column:
    """'12.34%' of nulls / (n * n_cols), rounded half-up in exact integer
    arithmetic (``div``), so it does not depend on float formatting."""
    bp = f"(({nulls} * 20000 + {n} * {n_cols}) div ({n} * {n_cols} * 2))"
    return F.concat(F.expr(f"cast({bp} div 100 as string)"), F.lit("."),
                    F.lpad(F.expr(f"cast({bp} % 100 as string)"), 2, "0"), F.lit("%"))


def table_report(df: DataFrame, table: str) -> DataFrame:
    """One report row: status, record / column counts, null %, issues.
    A table with no rows fails with the single issue 'Table is empty'."""
    n_cols = len(df.columns)
    # A rule whose column the table does not have is not checked.
    rules = [r for r in TABLE_RULES.get(table, []) if r[1].split()[0] in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("n"), _null_cells(df).alias("nulls"),
                 *[F.count(F.when(F.expr(cond), 1)).alias(name) for name, cond, _ in rules])
    n, nulls = F.col("n"), F.col("nulls")
    cells = n * n_cols
    issue_list = [F.when(nulls > cells * NULL_RATIO_LIMIT,
                         F.concat(F.lit("High null percentage: "), _pct_text("nulls", "n", n_cols)))]
    issue_list += [F.when(F.col(name) > 0, F.concat(F.lit(text), F.col(name).cast("string")))
                   for name, _, text in rules]
    issues = F.when(n == 0, F.array(F.lit("Table is empty"))).otherwise(
        F.array_compact(F.array(*issue_list)))
    return agg.select(
        F.lit(table).alias("table_name"),
        F.when(F.size(issues) == 0, "PASS").otherwise("FAIL").alias("overall_status"),
        n.alias("record_count"), F.lit(n_cols).cast("int").alias("column_count"),
        F.when(n > 0, _pct_text("nulls", "n", n_cols)).alias("null_percentage"),
        issues.alias("issues"))


def validate_tables(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """``table_report`` of each table that its function reads. A table that is
    not there fails; one whose reading or checking breaks gives status ERROR
    with the message as its issue, and the others are still reported. Each
    report (one row) is computed here, because a table may break only when it
    is read."""
    rows = []
    for name, read in tables.items():
        try:
            rows += [tuple(r) for r in table_report(read(), name).select(*REPORT_COLUMNS).collect()]
        except Exception as error:  # any failure is the table's result
            missing = isinstance(error, AnalysisException) and error.getCondition() in (
                "PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
            rows.append((name, "FAIL" if missing else "ERROR", None, None, None,
                         ["Table does not exist" if missing else str(error).split("\n")[0]]))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def store_failures(failures: DataFrame, path: str) -> None:
    """Append a test's failing values to the table of stored failures."""
    failures.select(*FAILURE_COLUMNS).write.mode("append").partitionBy("test_name").parquet(path)
