"""Registered queries of the declared-only tier (configuration and docs)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from inkwell.operators import extras as X
from inkwell.operators import features as FE
from inkwell.operators import hybrid as HY
from inkwell.operators import recommend as R
from inkwell.operators import retrieval as RT
from inkwell.operators import similarity as S
from inkwell.operators import user_items as UI
from inkwell.plans import q_recommend as QR
from inkwell.plans.oracle import AS_OF, build
from inkwell.plans.registry import register

register("popular_recency_weighted", build(f"""
SELECT b.book_id, b.title, b.author, b.genre, b.price, CAST(SUM(s.quantity) AS BIGINT) AS total_sales,
  COUNT(DISTINCT s.customer_type) AS unique_customers,
  CAST(SUM(CAST(s.unit_price AS DECIMAL(18,8))) AS DOUBLE) / COUNT(s.unit_price) AS avg_price,
  SUM(s.quantity * exp(-CAST({AS_OF} - s.sale_date AS INTEGER) / CAST(30 AS DOUBLE))) AS recency_weighted_sales
FROM dim_books b JOIN fact_sales s ON b.book_id = s.book_id
WHERE s.sale_date >= {AS_OF} - INTERVAL '180 days'
GROUP BY b.book_id, b.title, b.author, b.genre, b.price
ORDER BY recency_weighted_sales DESC, book_id""", "dim_books", "fact_sales"))(
    lambda m: X.popular_recency_weighted(m.dim_books, m.fact_sales, m.as_of))

register("implicit_ratings", build("""
SELECT user_id, book_id, rating, LEAST(GREATEST(ln(1 + rating), 0), CAST(5 AS DOUBLE)) AS implicit_rating
FROM user_item_interactions""", "user_item_interactions"))(lambda m: X.implicit_ratings(QR.interactions(m)))

register("time_series_split", build("""
SELECT sale_date, CAST(ntile(5) OVER (ORDER BY sale_date) AS INTEGER) AS fold
FROM (SELECT DISTINCT sale_date FROM daily_demand) d""", "daily_demand"))(
    lambda m: X.time_series_folds(m.daily_demand, 5))

register("books_page", build("""
SELECT book_id, title, author, genre, price FROM dim_books WHERE price >= 20 AND price <= 60
ORDER BY title NULLS LAST, book_id LIMIT 20 OFFSET 20""", "dim_books"))(
    lambda m: X.books_page(m.dim_books, min_price=20.0, max_price=60.0, page=2, size=20))
register("sales_page", build("""
SELECT transaction_id, book_id, sale_date, quantity, total_amount, channel FROM fact_sales
WHERE channel = '1-URGENT' AND sale_date >= DATE '2000-01-01' AND sale_date <= DATE '2000-12-31'
ORDER BY sale_date DESC, transaction_id LIMIT 50 OFFSET 50""", "fact_sales"))(
    lambda m: X.sales_page(m.fact_sales, channel="1-URGENT", start=_dt.date(2000, 1, 1),
                           end=_dt.date(2000, 12, 31), page=2, size=50))
register("books_by_genre", build("""
SELECT genre, book_id, title, author, price,
  CAST(row_number() OVER (PARTITION BY genre ORDER BY title NULLS LAST, book_id) AS INTEGER) AS position
FROM dim_books""", "dim_books"))(lambda m: X.books_by_genre(m.dim_books))

for _col, _key in [("channel", "sales_by_channel"), ("customer_type", "sales_by_customer_type")]:
    register(_key, build(f"""
SELECT {_col}, COUNT(*) AS transactions, CAST(SUM(quantity) AS BIGINT) AS units,
  CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM fact_sales GROUP BY {_col}""", "fact_sales"))(lambda m, c=_col: X.sales_by(m.fact_sales, c))

register("top_authors", build("""
SELECT b.author, COUNT(*) AS titles, CAST(SUM(s.u) AS BIGINT) AS units, CAST(SUM(s.rv) AS DOUBLE) AS revenue
FROM dim_books b JOIN (SELECT book_id, SUM(quantity) AS u, SUM(CAST(total_amount AS DECIMAL(18,4))) AS rv
                       FROM fact_sales GROUP BY book_id) s ON b.book_id = s.book_id
GROUP BY b.author ORDER BY revenue DESC, author LIMIT 10""", "dim_books", "fact_sales"))(
    lambda m: X.top_authors(m.dim_books, m.fact_sales))

register("month_over_month", build("""
SELECT month, units, revenue, prev_revenue,
  CASE WHEN prev_revenue > 0 THEN (revenue - prev_revenue) / prev_revenue * 100 END AS revenue_change_pct
FROM (SELECT *, LAG(revenue) OVER (ORDER BY month) AS prev_revenue FROM (
  SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, CAST(SUM(quantity) AS BIGINT) AS units,
    CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM fact_sales GROUP BY 1) a) b""", "fact_sales"))(lambda m: X.month_over_month(m.fact_sales))

register("book_features_min5", build("SELECT * FROM book_features WHERE total_transactions >= 5",
                                     "book_features"))(
    lambda m: FE.book_features(m.dim_books, m.dim_publishers, m.fact_sales, m.as_of, min_transactions=5))


def _fallback(m):
    inter = QR.interactions(m)
    users = m.fact_sales.select(F.col("customer_type").alias("user_id")).distinct().withColumn(
        "user_type", F.col("user_id"))
    personal = UI.user_recommendations(QR.vectors(m), inter, n=10)
    pop = QR.popular(m)
    by_type = R.popular_by_user_type(m.dim_books, m.fact_sales, m.as_of, popular=pop)
    return X.recommend_with_fallback(users, personal, by_type, pop, 10)


register("recommend_with_fallback", build("""
SELECT user_id, book_id, CAST(score AS DOUBLE) AS score, rank, 'personal' AS source FROM user_recommendations
WHERE user_id IN (SELECT DISTINCT customer_type FROM fact_sales)""", "user_recommendations", "fact_sales"))(
    _fallback)

# Ranking quality of the per-type popular lists of 90 days ago against
# what each type bought in those 90 days.
EVAL_DAYS = 90


def _ranking(m):
    cutoff = F.date_sub(F.lit(str(m.as_of)).cast("date"), EVAL_DAYS)
    cut = (_dt.date.fromisoformat(str(m.as_of)) - _dt.timedelta(days=EVAL_DAYS))
    past = m.fact_sales.where(F.col("sale_date") <= cutoff)
    recs = R.popular_by_user_type(m.dim_books, past, cut).select(
        F.col("user_type").alias("user_id"), "book_id", "rank")
    rel = m.fact_sales.where((F.col("sale_date") > cutoff) & (F.col("sale_date") <= F.lit(str(m.as_of)).cast("date")))
    rel = rel.select(F.col("customer_type").alias("user_id"), "book_id")
    return X.ranking_metrics(recs, rel, m.dim_books, 10, m.dim_books)


register("ranking_metrics", build(f"""
WITH past AS (SELECT * FROM fact_sales WHERE sale_date <= {AS_OF} - INTERVAL '{EVAL_DAYS} days'),
pt AS (SELECT customer_type AS user_id, book_id, SUM(quantity) AS score FROM past
       WHERE sale_date >= {AS_OF} - INTERVAL '{EVAL_DAYS} days' - INTERVAL '180 days' GROUP BY 1, 2),
recs AS (SELECT * FROM (SELECT user_id, book_id,
           row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM pt) x WHERE rank <= 10),
rel AS (SELECT DISTINCT customer_type AS user_id, book_id FROM fact_sales
        WHERE sale_date > {AS_OF} - INTERVAL '{EVAL_DAYS} days' AND sale_date <= {AS_OF}),
nrel AS (SELECT user_id, COUNT(*) AS n_rel FROM rel GROUP BY user_id),
hits AS (SELECT r.user_id, COUNT(*) AS hits, SUM(1.0 / log2(r.rank + 1)) AS dcg
         FROM recs r JOIN rel ON r.user_id = rel.user_id AND r.book_id = rel.book_id GROUP BY r.user_id),
pu AS (SELECT n.user_id, COALESCE(h.hits, 0) AS hits, COALESCE(h.dcg, 0) AS dcg, n.n_rel,
         (SELECT SUM(1.0 / log2(i + 1)) FROM range(1, LEAST(n.n_rel, 10) + 1) t(i)) AS idcg
       FROM nrel n LEFT JOIN hits h ON n.user_id = h.user_id)
SELECT AVG(hits / CAST(10 AS DOUBLE)) AS precision_at_10, AVG(hits / n_rel) AS recall_at_10,
  AVG(dcg / idcg) AS ndcg_at_10,
  (SELECT COUNT(DISTINCT book_id) FROM recs) / (SELECT COUNT(*) FROM dim_books) AS coverage,
  (SELECT AVG(d) FROM (SELECT r.user_id, COUNT(DISTINCT b.genre) / CAST(10 AS DOUBLE) AS d
                       FROM recs r JOIN dim_books b ON r.book_id = b.book_id GROUP BY r.user_id) q) AS diversity
FROM pu""", "fact_sales", "dim_books"))(_ranking)


def _als(m):
    return X.als_recommendations(QR.interactions(m), n=10)


def _hybrid(m):
    return X.hybrid_topk(QR.vectors(m), QR.interactions(m), n=10)


register("als_recommendations", None)(_als)
register("hybrid_recommendations", None)(_hybrid)

register("embedding_topk", build("""
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM u),
v AS (SELECT vec_id, CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm)
                          ELSE list_transform(e, lambda x: x * 0) END AS v FROM n)
SELECT book_id, other_id, similarity_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS book_id, b.vec_id AS other_id, list_inner_product(a.v, b.v) AS similarity_score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id) p
WHERE rank <= 5"""))(lambda m: S.item_similarity_topk(X.embedding_vectors(m.source("embeddings")), k=5))

# BM25 half of the retrieval settings: benchmark texts are the queries,
# documents the corpus (Okapi k1 = 1.5, b = 0.75, epsilon = 0.25).
_TOK = r"list_filter(regexp_split_to_array(lower(COALESCE({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOK.format(c='text')} AS toks FROM documents),
st AS (SELECT COUNT(*) AS n, AVG(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, term, MAX(dl) AS dl, COUNT(*) AS tf
       FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) x GROUP BY doc_id, term),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
i0 AS (SELECT term, ln(st.n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT AVG(raw) FROM i0) ELSE raw END AS idf FROM i0),
q AS (SELECT item_id, term, COUNT(*) AS qtf
      FROM (SELECT item_id, unnest({_TOK.format(c='text')}) AS term FROM benchmark) x GROUP BY item_id, term),
s AS (SELECT q.item_id, tf.doc_id,
        SUM(q.qtf * idf.idf * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / st.avgdl)))) AS bm25_score
      FROM q JOIN idf ON q.term = idf.term JOIN tf ON tf.term = q.term, st
      GROUP BY q.item_id, tf.doc_id)"""
register("bm25_topk", build(f"""{_BM25}
SELECT item_id, doc_id, bm25_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM s) r
WHERE rank <= 5"""))(lambda m: RT.bm25_topk(m.source("benchmark"), m.source("documents"), k=5))

# Both halves blended; vectors are tf-idf weights folded into 64 signed dimensions.
_FOLD = """SELECT {id} AS id, ('0x' || md5(term)[1:4])::BIGINT % 64 AS dim,
    sum(if(md5(term)[5] < '8', 1.0::DOUBLE, -1.0::DOUBLE) * {tf} * rarity) AS w
  FROM {rows} JOIN rare USING (term) GROUP BY ALL"""
register("hybrid_retrieval", build(f"""{_BM25},
rare AS (SELECT term, ln(1 + n / df::DOUBLE) AS rarity FROM df, st),
dv AS ({_FOLD.format(id='doc_id', tf='tf', rows='tf')}),
qv AS ({_FOLD.format(id='item_id', tf='qtf', rows='q')}),
dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY id),
qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY id),
dot AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.w * d.w) AS dot FROM qv q JOIN dv d USING (dim) GROUP BY ALL),
cosine AS (SELECT dot.item_id, dot.doc_id, CASE WHEN qn.norm * dn.norm > 0 THEN dot / qn.norm / dn.norm ELSE 0 END AS cosine
  FROM dot JOIN qn ON qn.id = item_id JOIN dn ON dn.id = doc_id),
best AS (SELECT item_id, max(bm25_score) AS top FROM s GROUP BY item_id),
blend AS (SELECT qn.id AS item_id, d.doc_id, coalesce(bm25_score, 0) AS bm25_score, coalesce(cosine, 0) AS cosine,
    0.6::DOUBLE * if(top > 0, coalesce(bm25_score, 0) / top, 0) + 0.4::DOUBLE * coalesce(cosine, 0) AS score
  FROM qn CROSS JOIN d LEFT JOIN best ON best.item_id = qn.id
  LEFT JOIN s ON s.item_id = qn.id AND s.doc_id = d.doc_id
  LEFT JOIN cosine c ON c.item_id = qn.id AND c.doc_id = d.doc_id)
SELECT item_id, doc_id, score, bm25_score, cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM blend) r
WHERE rank <= 5"""))(lambda m: HY.hybrid_topk(m.source("benchmark"), m.source("documents"), k=5))
