"""Registered dashboard queries (book analytics, inventory, fallback
recommendations and forecast)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import dashboards as D
from inkwell.plans.oracle import build, cte
from inkwell.plans.registry import register

register("book_list", build("""
SELECT book_id, title, genre, price FROM dim_books ORDER BY title NULLS LAST, book_id LIMIT 100""",
                            "dim_books"))(lambda m: D.book_list(m.dim_books))

register("selection_book_id", build("""
SELECT concat_ws(' - ', CAST(book_id AS VARCHAR), title) AS label,
  CAST(split_part(concat_ws(' - ', CAST(book_id AS VARCHAR), title), ' - ', 1) AS BIGINT) AS selection_book_id
FROM dim_books""", "dim_books"))(lambda m: D.selection_labels(m.dim_books))

register("table_counts", build("""
SELECT 'dim_books' AS table_name, COUNT(*) AS row_count FROM dim_books
UNION ALL SELECT 'fact_sales' AS table_name, COUNT(*) AS row_count FROM fact_sales""",
                               "dim_books", "fact_sales"))(lambda m: D.table_counts(m.dim_books, m.fact_sales))

cte("book_monthly_sales", """
SELECT book_id, CAST(date_trunc('month', sale_date) AS DATE) AS month,
  CAST(SUM(quantity) AS BIGINT) AS total_quantity,
  CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_revenue,
  COUNT(*) AS transactions, CAST(SUM(CAST(unit_price AS DECIMAL(18,8))) AS DOUBLE) / COUNT(unit_price) AS avg_price
FROM fact_sales GROUP BY 1, 2""", "fact_sales")
register("book_monthly_sales", build("SELECT * FROM book_monthly_sales", "book_monthly_sales"))(
    lambda m: D.book_monthly_sales(m.fact_sales))

cte("book_sales_summary", """
SELECT book_id, CAST(SUM(total_quantity) AS BIGINT) AS total_units,
  CAST(SUM(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) AS total_revenue,
  AVG(total_quantity) AS avg_monthly_sales,
  CASE WHEN SUM(total_quantity) > 0
       THEN CAST(SUM(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) / SUM(total_quantity)
       ELSE CAST(0 AS DOUBLE) END AS revenue_per_unit,
  COUNT(*) AS months
FROM book_monthly_sales GROUP BY book_id""", "book_monthly_sales")
register("book_sales_summary", build("SELECT * FROM book_sales_summary", "book_sales_summary"))(
    lambda m: D.book_sales_summary(D.book_monthly_sales(m.fact_sales)))

register("book_detail", build("""
SELECT b.*, s.total_units, s.total_revenue, s.avg_monthly_sales, s.revenue_per_unit, s.months
FROM dim_books b LEFT JOIN book_sales_summary s ON b.book_id = s.book_id""",
                              "dim_books", "book_sales_summary"))(
    lambda m: D.book_detail(m.dim_books, D.book_sales_summary(D.book_monthly_sales(m.fact_sales))))

cte("inventory_insights", """
SELECT i.warehouse_location, b.genre, COUNT(*) AS unique_books,
  CAST(SUM(i.stock_quantity) AS BIGINT) AS total_stock,
  AVG(i.stock_quantity) AS avg_stock_per_book,
  CAST(SUM(CAST(i.stock_quantity * b.price AS DECIMAL(18,4))) AS DOUBLE) AS inventory_value
FROM stg_inventory i JOIN dim_books b ON i.book_id = b.book_id
GROUP BY i.warehouse_location, b.genre""", "stg_inventory", "dim_books")
register("inventory_insights", build("SELECT * FROM inventory_insights ORDER BY inventory_value DESC",
                                     "inventory_insights"))(
    lambda m: D.inventory_insights(m.stg_inventory, m.dim_books))
register("inventory_insights_one_warehouse", build("""
SELECT i.warehouse_location, b.genre, COUNT(*) AS unique_books,
  CAST(SUM(i.stock_quantity) AS BIGINT) AS total_stock,
  AVG(i.stock_quantity) AS avg_stock_per_book,
  CAST(SUM(CAST(i.stock_quantity * b.price AS DECIMAL(18,4))) AS DOUBLE) AS inventory_value
FROM stg_inventory i JOIN dim_books b ON i.book_id = b.book_id
WHERE i.warehouse_location = 'Warehouse_A'
GROUP BY i.warehouse_location, b.genre ORDER BY inventory_value DESC""", "stg_inventory", "dim_books"))(
    lambda m: D.inventory_insights(m.stg_inventory, m.dim_books, "Warehouse_A"))
register("inventory_totals", build("""
SELECT CAST(SUM(CAST(inventory_value AS DECIMAL(28,4))) AS DOUBLE) AS total_value,
  CAST(SUM(unique_books) AS BIGINT) AS total_books, CAST(SUM(total_stock) AS BIGINT) AS total_stock,
  COUNT(DISTINCT warehouse_location) AS warehouses, COUNT(DISTINCT genre) AS genres
FROM inventory_insights""", "inventory_insights"))(
    lambda m: D.inventory_totals(D.inventory_insights(m.stg_inventory, m.dim_books)))
register("inventory_top_categories", build("""
SELECT * FROM inventory_insights ORDER BY inventory_value DESC, warehouse_location, genre LIMIT 5""",
                                           "inventory_insights"))(
    lambda m: D.inventory_top_categories(D.inventory_insights(m.stg_inventory, m.dim_books)))

cte("book_popularity", """
SELECT b.book_id, b.title, b.genre, b.price, b.price_category,
  CAST(COALESCE(s.units, 0) AS BIGINT) AS popularity
FROM dim_books b LEFT JOIN (SELECT book_id, SUM(quantity) AS units FROM fact_sales GROUP BY book_id) s
  ON b.book_id = s.book_id""", "dim_books", "fact_sales")
register("popular_overall", build("""
SELECT * FROM book_popularity ORDER BY popularity DESC, title NULLS LAST, book_id LIMIT 10""",
                                  "book_popularity"))(
    lambda m: D.popular_overall(D.book_popularity(m.dim_books, m.fact_sales)))
# Brute force on purpose: every same-genre pair, ranked per source book.
register("similar_by_genre", build("""
SELECT source_book_id, book_id, title, genre, price, price_category, popularity, rank FROM (
  SELECT s.book_id AS source_book_id, o.book_id, o.title, o.genre, o.price, o.price_category, o.popularity,
    CAST(row_number() OVER (PARTITION BY s.book_id
                            ORDER BY o.popularity DESC, o.title NULLS LAST, o.book_id) AS INTEGER) AS rank
  FROM book_popularity s JOIN book_popularity o ON o.genre = s.genre AND o.book_id <> s.book_id
) x WHERE rank <= 5""", "book_popularity"))(
    lambda m: D.similar_by_genre(D.book_popularity(m.dim_books, m.fact_sales)))

cte("genre_avg_demand", """
SELECT b.genre, COALESCE(NULLIF(AVG(s.quantity), 0), CAST(5 AS DOUBLE)) AS avg_demand
FROM fact_sales s JOIN dim_books b ON s.book_id = b.book_id GROUP BY b.genre""", "fact_sales", "dim_books")
register("genre_avg_demand", build("SELECT * FROM genre_avg_demand", "genre_avg_demand"))(
    lambda m: D.genre_avg_demand(m.fact_sales, m.dim_books))

cte("seasonal_forecast", """
SELECT book_id, day, predicted_demand,
  GREATEST(1, CAST(trunc(predicted_demand * CAST(0.7 AS DOUBLE)) AS INTEGER)) AS confidence_lower,
  CAST(trunc(predicted_demand * CAST(1.3 AS DOUBLE)) AS INTEGER) AS confidence_upper
FROM (
  SELECT b.book_id, CAST(d.day AS INTEGER) AS day,
    GREATEST(1, CAST(trunc(COALESCE(g.avg_demand, CAST(5 AS DOUBLE))
      * (CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * sin(2 * pi() * d.day / CAST(7 AS DOUBLE)))
      * CAST(1 AS DOUBLE)) AS INTEGER)) AS predicted_demand
  FROM dim_books b LEFT JOIN genre_avg_demand g ON b.genre = g.genre
  CROSS JOIN range(1, 8) d(day)
) f""", "dim_books", "genre_avg_demand")
register("seasonal_forecast", build("SELECT * FROM seasonal_forecast", "seasonal_forecast"))(
    lambda m: D.seasonal_forecast(m.dim_books, D.genre_avg_demand(m.fact_sales, m.dim_books), days=7))
register("forecast_summary", build("""
SELECT f.book_id, AVG(f.predicted_demand) AS avg_demand, CAST(SUM(f.predicted_demand) AS DOUBLE) AS total_demand,
  CAST(MIN(CASE WHEN f.predicted_demand = m.mx THEN f.day END) AS INTEGER) AS peak_day
FROM seasonal_forecast f
JOIN (SELECT book_id, MAX(predicted_demand) AS mx FROM seasonal_forecast GROUP BY book_id) m
  ON f.book_id = m.book_id
GROUP BY f.book_id""", "seasonal_forecast"))(
    lambda m: D.forecast_summary(D.seasonal_forecast(
        m.dim_books, D.genre_avg_demand(m.fact_sales, m.dim_books), days=7)))

register("book_month_table", build("""
SELECT book_id, strftime(month, '%Y-%m') AS month, total_quantity AS units_sold,
  CAST(round(CAST(total_revenue AS DECIMAL(18,4)), 2) AS DOUBLE) AS revenue, transactions,
  CAST(round(CAST(avg_price AS DECIMAL(18,6)), 2) AS DOUBLE) AS avg_price
FROM book_monthly_sales""", "book_monthly_sales"))(
    lambda m: D.book_month_table(D.book_monthly_sales(m.fact_sales)))
