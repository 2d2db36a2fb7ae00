"""Registered recommender queries. The similarity oracles are brute force
in DuckDB: every item pair over the whole catalogue, ranked per item."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import recommend as R
from inkwell.operators import rolling as RO
from inkwell.operators import similarity as S
from inkwell.operators import user_items as UI
from inkwell.plans.oracle import AS_OF, build, cte
from inkwell.plans.registry import register
from inkwell.session import scratch_dir

# The customer segments of the test data, for the oracle; the query takes its users from the data.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def interactions(m):
    return R.user_item_interactions(m.fact_sales, m.as_of)


def item_features(m):
    return R.recommender_item_features(m.dim_books, m.book_features, m.fact_sales)


def vectors(m):
    return S.feature_vectors(item_features(m))


def popular(m):
    return R.popular_items(m.dim_books, m.fact_sales, m.as_of)


cte("user_item_interactions", f"""
SELECT customer_type AS user_id, book_id, CAST(SUM(quantity) AS BIGINT) AS rating,
  COUNT(*) AS interaction_count,
  CAST(SUM(CAST(unit_price AS DECIMAL(18,8))) AS DOUBLE) / COUNT(unit_price) AS avg_price,
  MAX(sale_date) AS last_interaction
FROM fact_sales WHERE sale_date >= {AS_OF} - INTERVAL '365 days' AND quantity > 0
GROUP BY customer_type, book_id HAVING SUM(quantity) > 0""", "fact_sales")
register("user_item_interactions", build("SELECT * FROM user_item_interactions", "user_item_interactions"))(
    interactions)

register("user_item_matrix", build(
    "SELECT book_id, " + ", ".join(
        f"CAST(COALESCE(SUM(rating) FILTER (WHERE user_id = '{u}'), 0) AS BIGINT) AS {u}" for u in SEGMENTS)
    + " FROM user_item_interactions GROUP BY book_id", "user_item_interactions"))(
    lambda m: R.user_item_matrix(interactions(m)))

register("interaction_matrix_stats", build("""
SELECT COUNT(DISTINCT user_id) AS num_users, COUNT(DISTINCT book_id) AS num_items,
  COUNT(*) AS num_interactions,
  1.0 - COUNT(*) / (COUNT(DISTINCT user_id) * COUNT(DISTINCT book_id)) AS sparsity
FROM user_item_interactions""", "user_item_interactions"))(
    lambda m: R.interaction_matrix_stats(interactions(m)))

cte("recommender_item_features", """
SELECT b.book_id, b.genre, b.price_category, b.length_category, b.recency_category, b.publisher_type,
  b.price, b.page_count, b.publication_year,
  CAST(COALESCE(bf.total_quantity_sold, 0) AS BIGINT) AS total_sales,
  COALESCE(bf.velocity_score, 0) AS velocity_score,
  COALESCE(bf.avg_selling_price, b.price) AS avg_selling_price
FROM dim_books b LEFT JOIN book_features bf ON b.book_id = bf.book_id
WHERE b.book_id IN (SELECT DISTINCT book_id FROM fact_sales)""", "dim_books", "book_features", "fact_sales")
register("recommender_item_features", build("SELECT * FROM recommender_item_features",
                                            "recommender_item_features"))(item_features)
register("recommender_item_features_fallback", build("""
SELECT b.book_id, b.genre, b.price_category, b.price, b.page_count, b.publication_year, p.publisher_type
FROM dim_books b LEFT JOIN dim_publishers p ON b.publisher_id = p.publisher_id
WHERE b.book_id IN (SELECT DISTINCT book_id FROM fact_sales)""", "dim_books", "dim_publishers", "fact_sales"))(
    lambda m: R.recommender_item_features_fallback(m.dim_books, m.dim_publishers, m.fact_sales))

# Sales are summed per book and buyer type, then per book; the catalogue joins last.
cte("popular_items", f"""
WITH by_type AS (
  SELECT book_id, customer_type, sum(quantity) AS units, count(unit_price) AS priced,
    sum(CAST(unit_price AS DECIMAL(18,8))) AS paid
  FROM fact_sales WHERE date_diff('day', sale_date, {AS_OF}) <= 180 GROUP BY book_id, customer_type),
totals AS (
  SELECT book_id, CAST(sum(units) AS BIGINT) AS total_sales, count(customer_type) AS unique_customers,
    CAST(sum(paid) AS DOUBLE) / sum(priced) AS avg_price
  FROM by_type GROUP BY book_id)
SELECT book_id, title, author, genre, price, total_sales, unique_customers, avg_price
FROM totals JOIN dim_books USING (book_id)
QUALIFY row_number() OVER (ORDER BY total_sales DESC, unique_customers DESC, book_id) <= 100""",
    "dim_books", "fact_sales")
register("popular_items", build("SELECT * FROM popular_items", "popular_items"))(popular)
register("popular_items_90d", build(f"""
WITH totals AS (
  SELECT book_id, CAST(sum(quantity) AS BIGINT) AS popularity_score FROM fact_sales
  WHERE date_diff('day', sale_date, {AS_OF}) <= 90 AND book_id IN (SELECT book_id FROM dim_books)
  GROUP BY book_id)
SELECT * FROM totals
QUALIFY row_number() OVER (ORDER BY popularity_score DESC, book_id) <= 10""", "dim_books", "fact_sales"))(
    lambda m: R.popular_items_90d(m.dim_books, m.fact_sales, m.as_of))
cte("popular_items_head", """
SELECT book_id, total_sales FROM popular_items ORDER BY total_sales DESC, unique_customers DESC, book_id
LIMIT 10""", "popular_items")
register("popular_items_head", build("SELECT * FROM popular_items_head", "popular_items_head"))(
    lambda m: R.popular_items_head(popular(m), 10))

# Popular lists of several windows and dates, from day buckets.
WINDOWS = [(back, days) for back in (0, 30) for days in (90, 180)]


def _rolling(m):
    """The buckets are written once without the last 45 days, whose months are then written again."""
    path = scratch_dir(m.spark, f"popular-days-{uuid.uuid4().hex}")
    late = F.col("sale_date") >= F.date_sub(F.lit(str(m.as_of)).cast("date"), 45)
    RO.write_days(m.spark, path, m.fact_sales.where(~late))
    days = RO.write_days(m.spark, path, m.fact_sales, m.fact_sales.where(late).select("sale_date"))
    windows = m.spark.createDataFrame(WINDOWS, "back int, days int").select(
        F.date_sub(F.lit(str(m.as_of)).cast("date"), F.col("back")).alias("as_of"), "days")
    return RO.popular(days, m.dim_books, windows, 50)


register("popular_items_rolling", build(f"""
WITH w AS (SELECT CAST({AS_OF} - back AS DATE) AS as_of, CAST(days AS INTEGER) AS days
           FROM (VALUES {', '.join(map(str, WINDOWS))}) v(back, days)),
t AS (SELECT as_of, days, book_id, CAST(sum(quantity) AS BIGINT) AS total_sales,
    count(DISTINCT customer_type) AS unique_customers,
    CAST(sum(CAST(unit_price AS DECIMAL(18,8))) AS DOUBLE) / count(unit_price) AS avg_price
  FROM fact_sales JOIN w ON sale_date >= as_of - days
  WHERE book_id IN (SELECT book_id FROM dim_books) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY as_of, days
  ORDER BY total_sales DESC, unique_customers DESC, book_id) AS INTEGER) AS rank
FROM t QUALIFY rank <= 50""", "fact_sales", "dim_books"))(_rolling)

register("popular_by_user_type", build(f"""
WITH pt AS (
  SELECT customer_type AS user_type, book_id, SUM(quantity) AS popularity_score
  FROM fact_sales WHERE sale_date >= {AS_OF} - INTERVAL '180 days' GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_type ORDER BY popularity_score DESC, book_id) AS rank FROM pt),
missing AS (
  SELECT DISTINCT customer_type AS user_type FROM fact_sales
  WHERE customer_type NOT IN (SELECT user_type FROM pt)),
head AS (
  SELECT book_id, row_number() OVER (ORDER BY total_sales DESC, book_id) AS rank FROM popular_items_head)
SELECT r.user_type, r.book_id, b.title, b.author, b.genre, b.price,
  CAST(r.popularity_score AS DOUBLE) AS popularity_score, CAST(r.rank AS INTEGER) AS rank,
  'Popular among ' || r.user_type || ' customers' AS reason
FROM ranked r JOIN dim_books b ON r.book_id = b.book_id WHERE r.rank <= 10
UNION ALL
SELECT m.user_type, h.book_id, b.title, b.author, b.genre, b.price, CAST(0 AS DOUBLE) AS popularity_score,
  CAST(h.rank AS INTEGER) AS rank, 'Popular among ' || m.user_type || ' customers' AS reason
FROM missing m CROSS JOIN head h JOIN dim_books b ON h.book_id = b.book_id""",
    "fact_sales", "dim_books", "popular_items_head"))(
    lambda m: R.popular_by_user_type(m.dim_books, m.fact_sales, m.as_of, popular=popular(m)))

# -- similarity ----------------------------------------------------------------
_NUM = ["price", "page_count", "publication_year", "total_sales", "velocity_score", "avg_selling_price"]
_CAT = ["genre", "price_category", "publisher_type"]
cte("item_x", "\nUNION ALL\n".join(
    [f"SELECT book_id, 'n{i}_{c}' AS f, COALESCE(CAST({c} AS DOUBLE), 0) AS x FROM recommender_item_features"
     for i, c in enumerate(_NUM)] +
    [f"SELECT r.book_id, 'c_{c}=' || v.v AS f, CASE WHEN r.{c} = v.v THEN CAST(1 AS DOUBLE) "
     f"ELSE CAST(0 AS DOUBLE) END AS x FROM recommender_item_features r "
     f"CROSS JOIN (SELECT DISTINCT {c} AS v FROM recommender_item_features WHERE {c} IS NOT NULL) v"
     for c in _CAT]), "recommender_item_features")
cte("item_vec", """
SELECT book_id, list(u ORDER BY f) AS v FROM (
  SELECT z.book_id, z.f, CASE WHEN n.norm > 0 THEN z.z / n.norm ELSE 0 END AS u
  FROM (SELECT x.book_id, x.f, CASE WHEN st.s > 0 THEN (x.x - st.m) / st.s ELSE 0 END AS z
        FROM item_x x JOIN (SELECT f, AVG(x) AS m, STDDEV_POP(x) AS s FROM item_x GROUP BY f) st
          ON x.f = st.f) z
  JOIN (SELECT book_id, sqrt(SUM(zz * zz)) AS norm FROM (
          SELECT x.book_id, CASE WHEN st.s > 0 THEN (x.x - st.m) / st.s ELSE 0 END AS zz
          FROM item_x x JOIN (SELECT f, AVG(x) AS m, STDDEV_POP(x) AS s FROM item_x GROUP BY f) st
            ON x.f = st.f) q GROUP BY book_id) n ON z.book_id = n.book_id
) t GROUP BY book_id""", "item_x")
cte("item_similarity_topk", """
SELECT book_id, other_id, similarity_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.book_id, b.book_id AS other_id, list_inner_product(a.v, b.v) AS similarity_score,
    row_number() OVER (PARTITION BY a.book_id
                       ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.book_id) AS rank
  FROM item_vec a JOIN item_vec b ON a.book_id <> b.book_id
) p WHERE rank <= 10""", "item_vec")
register("item_similarity_topk", build("SELECT * FROM item_similarity_topk", "item_similarity_topk"))(
    lambda m: S.item_similarity_topk(vectors(m), k=10))

register("similar_books", build("""
SELECT s.book_id AS source_book_id, s.other_id AS book_id, b.title, b.author, b.genre, b.price,
  s.similarity_score, s.rank, 'Similar content and features' AS reason
FROM item_similarity_topk s JOIN dim_books b ON s.other_id = b.book_id
UNION ALL
SELECT d.book_id AS source_book_id, h.book_id, b.title, b.author, b.genre, b.price,
  CAST(h.total_sales AS DOUBLE) AS similarity_score, CAST(h.rank AS INTEGER) AS rank,
  'Similar content and features' AS reason
FROM dim_books d
CROSS JOIN (SELECT book_id, total_sales, row_number() OVER (ORDER BY total_sales DESC, book_id) AS rank
            FROM popular_items_head) h
JOIN dim_books b ON h.book_id = b.book_id
WHERE d.book_id NOT IN (SELECT book_id FROM item_vec)""",
    "item_similarity_topk", "dim_books", "popular_items_head", "item_vec"))(
    lambda m: R.similar_books(m.dim_books, S.item_similarity_topk(vectors(m), k=10), popular(m), 10))


def _user_recs(m):
    inter = interactions(m)
    return UI.user_recommendations(vectors(m), inter, n=10)


cte("user_recommendations", """
WITH iv AS (
  SELECT v.book_id, v.v FROM item_vec v WHERE v.book_id IN (SELECT book_id FROM user_item_interactions)),
usr AS (SELECT DISTINCT user_id FROM user_item_interactions),
cand AS (
  SELECT u.user_id, i.book_id, i.v FROM usr u CROSS JOIN iv i
  WHERE NOT EXISTS (SELECT 1 FROM user_item_interactions o WHERE o.user_id = u.user_id AND o.book_id = i.book_id)),
sc AS (
  SELECT c.user_id, c.book_id,
    SUM(list_inner_product(c.v, j.v) * o.rating) AS num, SUM(abs(list_inner_product(c.v, j.v))) AS den
  FROM cand c JOIN user_item_interactions o ON o.user_id = c.user_id JOIN iv j ON j.book_id = o.book_id
  GROUP BY c.user_id, c.book_id)
SELECT user_id, book_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, book_id, num / den AS score,
    row_number() OVER (PARTITION BY user_id ORDER BY round(num / den, 9) DESC, book_id) AS rank
  FROM sc WHERE den > 0) r
WHERE rank <= 10""", "item_vec", "user_item_interactions")
register("user_recommendations", build("SELECT * FROM user_recommendations", "user_recommendations"))(
    _user_recs)
