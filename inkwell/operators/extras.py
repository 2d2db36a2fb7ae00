"""Operators the source declares in its configuration or documentation
without code behind them: recency-weighted popularity, implicit ratings,
a fallback cascade, ranking metrics, time-series folds, ALS and hybrid
scores, catalogue / sales paging and summary reports."""

from __future__ import annotations

import math

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import UNIT, as_of_lit, exact_avg, exact_sum
from inkwell.operators import user_items
from inkwell.operators.keys import dense_ids, group_positions
from inkwell.operators.recommend import _since, check_n
from inkwell.operators.similarity import _with_one_row

# ---------------------------------------------------------------------------
# Popularity and ratings
# ---------------------------------------------------------------------------


def popular_recency_weighted(dim_books: DataFrame, fact_sales: DataFrame, as_of=None,
                             days: int = 180, half_life_days: float = 30.0) -> DataFrame:
    """Popularity with each unit weighted exp(-age_days / 30)."""
    age = F.datediff(as_of_lit(as_of), F.col("sale_date"))
    s = _since(fact_sales, as_of, days).groupBy("book_id").agg(
        F.sum("quantity").alias("total_sales"),
        F.count_distinct("customer_type").alias("unique_customers"),
        exact_avg("unit_price", UNIT).alias("avg_price"),
        F.sum(F.col("quantity") * F.exp(-age / F.lit(half_life_days))).alias("recency_weighted_sales"))
    return (dim_books.select("book_id", "title", "author", "genre", "price").join(s, "book_id")
            .orderBy(F.col("recency_weighted_sales").desc(), "book_id"))


def implicit_ratings(interactions: DataFrame, cap: float = 5.0) -> DataFrame:
    """rating -> clip(log1p(units), 0, 5)."""
    return interactions.select("user_id", "book_id", "rating",
                               F.least(F.greatest(F.log1p("rating"), F.lit(0.0)), F.lit(cap))
                               .alias("implicit_rating"))


# ---------------------------------------------------------------------------
# Cascade and evaluation
# ---------------------------------------------------------------------------


def recommend_with_fallback(users: DataFrame, personal: DataFrame, by_type: DataFrame,
                            overall: DataFrame, n: int = 10) -> DataFrame:
    """Personal list when a user has one; else the list of the user's type;
    else the overall popular list. ``users`` has user_id and user_type."""
    check_n(n)
    p = personal.select("user_id", "book_id", F.col("score").cast("double").alias("score"), "rank",
                        F.lit("personal").alias("source"))
    no_p = users.join(p.select("user_id").distinct(), "user_id", "left_anti")
    t = (no_p.join(by_type.select("user_type", "book_id",
                                  F.col("popularity_score").cast("double").alias("score"), "rank"), "user_type")
         .select("user_id", "book_id", "score", "rank", F.lit("user_type").alias("source")))
    no_t = no_p.join(t.select("user_id").distinct(), "user_id", "left_anti")
    head = (overall.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_sales").desc(), "book_id")))
            .where(F.col("rank") <= n)
            .select("book_id", F.col("total_sales").cast("double").alias("score"), "rank"))
    o = (no_t.withColumn("_one", F.lit(1)).join(F.broadcast(head.withColumn("_one", F.lit(1))), "_one")
         .select("user_id", "book_id", "score", "rank", F.lit("overall").alias("source")))
    return p.unionByName(t).unionByName(o).where(F.col("rank") <= n)


def ranking_metrics(recs: DataFrame, relevant: DataFrame, items: DataFrame, k: int = 10,
                    genre_of: DataFrame | None = None) -> DataFrame:
    """precision@k, recall@k, ndcg@k (binary relevance), catalogue
    coverage and genre diversity, averaged over users with relevant items.
    recs: (user_id, book_id, rank); relevant: (user_id, book_id)."""
    r = recs.where(F.col("rank") <= k)
    rel = relevant.select("user_id", "book_id").distinct()
    n_rel = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = r.join(rel, ["user_id", "book_id"], "left_semi")
    per_user = (hits.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
        .join(n_rel, "user_id", "right")
        .select("user_id", F.coalesce("hits", F.lit(0)).alias("hits"),
                F.coalesce("dcg", F.lit(0.0)).alias("dcg"), "n_rel"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k))), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    per_user = per_user.select(
        (F.col("hits") / F.lit(float(k))).alias("p"), (F.col("hits") / F.col("n_rel")).alias("r"),
        (F.col("dcg") / idcg).alias("g"))
    m = per_user.agg(F.avg("p").alias(f"precision_at_{k}"), F.avg("r").alias(f"recall_at_{k}"),
                     F.avg("g").alias(f"ndcg_at_{k}"))
    cov = _with_one_row(r.agg(F.count_distinct("book_id").alias("_rec_items")),
                        items.agg(F.count(F.lit(1)).alias("_items")))
    cov = cov.select((F.col("_rec_items") / F.col("_items")).alias("coverage"))
    out = _with_one_row(m, cov)
    if genre_of is not None:
        div = (r.join(genre_of.select("book_id", "genre"), "book_id").groupBy("user_id")
               .agg((F.count_distinct("genre") / F.lit(float(k))).alias("d")).agg(F.avg("d").alias("diversity")))
        out = _with_one_row(out, div)
    return out


def time_series_folds(daily: DataFrame, n_folds: int = 5) -> DataFrame:
    """Fold 1..n over the distinct days in time order (a window over the
    distinct dates only: at most one row per calendar day)."""
    dates = daily.select("sale_date").distinct()
    return dates.select("sale_date", F.ntile(n_folds).over(Window.orderBy("sale_date")).alias("fold"))


def time_series_rows(daily: DataFrame, n_folds: int = 5) -> DataFrame:
    """Rows of ``daily`` for each split 1..n_folds-1 of an expanding window:
    ``role`` is 'train' up to the split's fold and 'test' in the next one."""
    folds = daily.join(time_series_folds(daily, n_folds), "sale_date")
    split = F.explode(F.sequence(F.greatest(F.lit(1), F.col("fold") - 1), F.lit(n_folds - 1))).alias("split")
    out = folds.select("*", split)
    return out.withColumn("role", F.when(F.col("fold") <= F.col("split"), "train").otherwise("test"))


# ---------------------------------------------------------------------------
# Collaborative and hybrid scores
# ---------------------------------------------------------------------------


#: Items of a block of the model, about; one task solves a block, and ALS takes at least ``ALS_BLOCKS``.
ALS_ITEMS, ALS_BLOCKS = 2 ** 15, 10


def _ratings(interactions: DataFrame) -> DataFrame:
    """The ratings, written once: numbers, model and marks of owned items all read
    them, and would each work out the interactions from the facts again."""
    return interactions.select("user_id", "book_id", "rating").checkpoint()


def als_factors(interactions: DataFrame, rank: int = 50, seed: int = 42,
                max_iter: int = 10) -> tuple[DataFrame, DataFrame]:
    """(user_id, vec) and (book_id, vec) of implicit-feedback ALS (rank 50) on
    (user, book, units). Users and items may have ids of any kind: the model
    sees dense numbers. Its ids are 32-bit; more users or items are an error.

    The blocks of items grow in number with the items, so that all cores solve
    them. The factors start from the blocks of users, which stay as they are."""
    users = dense_ids(interactions, "user_id", "u")
    items = dense_ids(interactions, "book_id", "i")
    data = (interactions.select("user_id", "book_id", F.col("rating").cast("float").alias("r"))
            .join(users, "user_id").join(items, "book_id")
            .select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), "r").checkpoint())
    model = ALS(rank=rank, implicitPrefs=True, seed=seed, maxIter=max_iter, userCol="u", itemCol="i",
                ratingCol="r", coldStartStrategy="drop", numUserBlocks=ALS_BLOCKS,
                numItemBlocks=max(ALS_BLOCKS, math.ceil(items.count() / ALS_ITEMS))).fit(data)
    vec = F.col("features").cast("array<double>").alias("vec")
    return (model.userFactors.select(F.col("id").alias("u"), vec).join(users, "u").select("user_id", "vec"),
            model.itemFactors.select(F.col("id").alias("i"), vec).join(items, "i").select("book_id", "vec"))


def als_scores(interactions: DataFrame, rank: int = 50, seed: int = 42, max_iter: int = 10) -> DataFrame:
    """(user_id, book_id, score) of every user and unowned item (see ``als_factors``)."""
    inter = _ratings(interactions)
    return user_items.inner_products(*als_factors(inter, rank, seed, max_iter), inter)


def als_recommendations(interactions: DataFrame, n: int = 10, rank: int = 50, seed: int = 42,
                        max_iter: int = 10) -> DataFrame:
    """The n best unowned items of each user by ``als_scores``, without scoring
    the items that cannot be among them."""
    check_n(n)
    inter = _ratings(interactions)
    return user_items.inner_product_topk(*als_factors(inter, rank, seed, max_iter), inter, n)


def hybrid_recommendations(content: DataFrame, collaborative: DataFrame, n: int = 10,
                           content_weight: float = 0.6, collab_weight: float = 0.4) -> DataFrame:
    """Weighted sum of min-max scaled content and collaborative scores, ranked
    after the blend. Both sides hold every scored item of a user (no list cut
    beforehand); an item that one side did not score counts 0 there."""
    check_n(n)

    def scaled(df, name):
        span = df.groupBy("user_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        lo, hi = F.col("lo"), F.col("hi")
        return df.join(span, "user_id").select(
            "user_id", "book_id",
            F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)).alias(name))
    j = scaled(content, "c").join(scaled(collaborative, "f"), ["user_id", "book_id"], "full")
    s = j.select("user_id", "book_id", (F.lit(content_weight) * F.coalesce("c", F.lit(0.0))
                                       + F.lit(collab_weight) * F.coalesce("f", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "book_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hybrid_topk(vectors: DataFrame, interactions: DataFrame, n: int = 10, content_weight: float = 0.6,
                collab_weight: float = 0.4, rank: int = 50, seed: int = 42, max_iter: int = 10,
                heavy: int = user_items.HEAVY) -> DataFrame:
    """``hybrid_recommendations`` of ``user_scores`` and ``als_scores``. Users who own many items are
    searched by bounds of the blend; the others have both whole score tables."""
    check_n(n)
    inter = _ratings(interactions)
    pairs = user_items.pairs_once(inter).checkpoint()
    factors = [x.checkpoint() for x in als_factors(inter, rank, seed, max_iter)]
    many = user_items.heavy_users(pairs.join(vectors.select("book_id"), "book_id", "left_semi"), heavy)
    users, best = pairs.select("user_id").distinct(), None
    if 0 < many.count() <= user_items.MAX_HEAVY:
        names = [r[0] for r in many.collect()]
        best, left = user_items.heavy_blend(pairs, vectors, factors, names, n, (content_weight, collab_weight))
        users = users.where(~F.col("user_id").isin([x for x in names if x not in left]))
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "book_id")
    best = None if best is None else best.withColumn("rank", F.row_number().over(w))
    users = users.checkpoint()
    if best is not None and users.isEmpty():
        return best
    whole = hybrid_recommendations(
        user_items.user_scores(vectors, inter, users=users),
        user_items.inner_products(factors[0].join(users, "user_id", "left_semi"), factors[1], inter), n,
        content_weight, collab_weight)
    return whole if best is None else whole.unionByName(best)


# ---------------------------------------------------------------------------
# Search pages and reports
# ---------------------------------------------------------------------------


def books_page(dim_books: DataFrame, genre: str | None = None, min_price: float | None = None,
               max_price: float | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """One page of the filtered catalogue by title (top-k with offset)."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and 1 <= size <= 100")
    b = dim_books
    if genre is not None:
        b = b.where(F.col("genre") == genre)
    if min_price is not None:
        b = b.where(F.col("price") >= min_price)
    if max_price is not None:
        b = b.where(F.col("price") <= max_price)
    return (b.select("book_id", "title", "author", "genre", "price")
            .orderBy(F.col("title").asc_nulls_last(), "book_id").offset((page - 1) * size).limit(size))


def sales_page(fact_sales: DataFrame, channel: str | None = None, start=None, end=None,
               page: int = 1, size: int = 50) -> DataFrame:
    """One page of filtered sales, newest first."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page >= 1 and 1 <= size <= 500")
    s = fact_sales
    if channel is not None:
        s = s.where(F.col("channel") == channel)
    if start is not None:
        s = s.where(F.col("sale_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        s = s.where(F.col("sale_date") <= F.lit(str(end)).cast("date"))
    return (s.select("transaction_id", "book_id", "sale_date", "quantity", "total_amount", "channel")
            .orderBy(F.col("sale_date").desc(), "transaction_id").offset((page - 1) * size).limit(size))


def books_by_genre(dim_books: DataFrame) -> DataFrame:
    """Each genre's books by title, with their position; a genre may span
    many tasks."""
    rows = dim_books.select("genre", "book_id", "title", "author", "price")
    return group_positions(rows, "genre", [F.col("title").asc_nulls_last(), F.col("book_id").asc()], "position")


def sales_by(fact_sales: DataFrame, column: str) -> DataFrame:
    return fact_sales.groupBy(column).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("quantity").alias("units"),
        exact_sum("total_amount").alias("revenue"))


def top_authors(dim_books: DataFrame, fact_sales: DataFrame, n: int = 10) -> DataFrame:
    per_book = fact_sales.groupBy("book_id").agg(
        F.sum("quantity").alias("u"), F.sum(F.col("total_amount").cast("decimal(18,4)")).alias("rv"))
    j = dim_books.select("book_id", "author").join(per_book, "book_id")
    a = j.groupBy("author").agg(F.count(F.lit(1)).alias("titles"), F.sum("u").alias("units"),
                                F.sum("rv").cast("double").alias("revenue"))
    return a.orderBy(F.col("revenue").desc(), "author").limit(n)


def month_over_month(fact_sales: DataFrame) -> DataFrame:
    """Monthly revenue and units with the change against the previous
    month (one row per month: the window holds one row per month)."""
    m = fact_sales.groupBy(F.trunc("sale_date", "MM").alias("month")).agg(
        F.sum("quantity").alias("units"), exact_sum("total_amount").alias("revenue"))
    w = Window.orderBy("month")
    prev = F.lag("revenue").over(w)
    return m.select("month", "units", "revenue", prev.alias("prev_revenue"),
                    F.when(prev > 0, (F.col("revenue") - prev) / prev * 100).alias("revenue_change_pct"))


def embedding_vectors(embeddings: DataFrame) -> DataFrame:
    """(book_id := vec_id, vec) unit vectors for the blocked top-k."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e * e))
    return embeddings.select(F.col("vec_id").alias("book_id"),
                             F.when(norm > 0, F.transform(v, lambda e: e / norm))
                             .otherwise(F.transform(v, lambda e: e * 0.0)).alias("vec"))

