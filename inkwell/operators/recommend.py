"""Recommender: interactions, item features, popularity, user-type
popularity, similar books and user recommendations as batch tables.

"Users" are customer types, as in the source model. Every list is a
row_number filter per key (planned as WindowGroupLimit: each task keeps
its k best rows before the shuffle), and every join with a fallback list
broadcasts only that list, whose size is bounded by ``n <= MAX_N``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import UNIT, exact_avg, since

MAX_N = 50  # request limit of the source API: 1 <= n <= 50


def check_n(n: int) -> int:
    if not 1 <= n <= MAX_N:
        raise ValueError(f"n must be in 1..{MAX_N}, got {n}")
    return n


def _since(fact_sales: DataFrame, as_of, days: int) -> DataFrame:
    return since(fact_sales, as_of, days)


# ---------------------------------------------------------------------------
# Interactions and item features
# ---------------------------------------------------------------------------


def user_item_interactions(fact_sales: DataFrame, as_of: _dt.date | str | None = None,
                           days: int = 365) -> DataFrame:
    """(user = customer type, book) ratings over the last ``days``."""
    s = _since(fact_sales, as_of, days).where(F.col("quantity") > 0)
    return (s.groupBy(F.col("customer_type").alias("user_id"), "book_id").agg(
        F.sum("quantity").alias("rating"),
        F.count(F.lit(1)).alias("interaction_count"),
        exact_avg("unit_price", UNIT).alias("avg_price"),
        F.max("sale_date").alias("last_interaction"))
        .where(F.col("rating") > 0))


def user_item_matrix(interactions: DataFrame, users: list[str] | None = None) -> DataFrame:
    """Display pivot: one row per book, one 0-filled rating column per user.
    Users come from the data (Spark refuses more than its pivot limit rather
    than dropping any); ``users`` names a known domain instead."""
    p = interactions.groupBy("book_id").pivot("user_id", users).agg(F.sum("rating"))
    return p.na.fill(0)


def interaction_matrix_stats(interactions: DataFrame) -> DataFrame:
    agg = interactions.agg(
        F.count_distinct("user_id").alias("num_users"),
        F.count_distinct("book_id").alias("num_items"),
        F.count(F.lit(1)).alias("num_interactions"))
    return agg.select("*", (F.lit(1.0) - F.col("num_interactions") /
                            (F.col("num_users") * F.col("num_items"))).alias("sparsity"))


def recommender_item_features(dim_books: DataFrame, book_features: DataFrame,
                              fact_sales: DataFrame) -> DataFrame:
    """Features of books that ever sold. The sales are reduced to distinct
    books first, so a best-seller is one row of the semi join."""
    bf = book_features.select("book_id", "total_quantity_sold", "velocity_score",
                              "avg_selling_price").alias("bf")
    b = dim_books.join(fact_sales.select("book_id").distinct(), "book_id", "left_semi").alias("b")
    return b.join(bf, F.col("b.book_id") == F.col("bf.book_id"), "left").select(
        "b.book_id", "b.genre", "b.price_category", "b.length_category", "b.recency_category",
        "b.publisher_type", "b.price", "b.page_count", "b.publication_year",
        F.coalesce(F.col("bf.total_quantity_sold"), F.lit(0)).cast("bigint").alias("total_sales"),
        F.coalesce(F.col("bf.velocity_score"), F.lit(0.0)).alias("velocity_score"),
        F.coalesce(F.col("bf.avg_selling_price"), F.col("b.price")).alias("avg_selling_price"))


def recommender_item_features_fallback(dim_books: DataFrame, dim_publishers: DataFrame,
                                       fact_sales: DataFrame) -> DataFrame:
    """Feature set used when book_features is missing."""
    p = dim_publishers.select("publisher_id", "publisher_type").alias("p")
    b = dim_books.join(fact_sales.select("book_id").distinct(), "book_id", "left_semi").alias("b")
    return b.join(p, F.col("b.publisher_id") == F.col("p.publisher_id"), "left").select(
        "b.book_id", "b.genre", "b.price_category", "b.price", "b.page_count",
        "b.publication_year", "p.publisher_type")


# ---------------------------------------------------------------------------
# Popularity
# ---------------------------------------------------------------------------


def _with_list(keys: DataFrame, short_list: DataFrame) -> DataFrame:
    """Give every key row the whole short list (at most MAX_N rows, so it
    is broadcast) through an equi-join on a constant."""
    return (keys.withColumn("_one", F.lit(1))
            .join(F.broadcast(short_list.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def popular_items(dim_books: DataFrame, fact_sales: DataFrame, as_of=None, days: int = 180,
                  n: int = 100) -> DataFrame:
    """Top n books by units (ties: more customer types, then id). Sales are
    aggregated per book before the join with the catalog."""
    s = _since(fact_sales, as_of, days).groupBy("book_id").agg(
        F.sum("quantity").alias("total_sales"),
        F.count_distinct("customer_type").alias("unique_customers"),
        exact_avg("unit_price", UNIT).alias("avg_price"))
    j = dim_books.select("book_id", "title", "author", "genre", "price").join(s, "book_id")
    return j.orderBy(F.col("total_sales").desc(), F.col("unique_customers").desc(), "book_id").limit(n)


def popular_items_90d(dim_books: DataFrame, fact_sales: DataFrame, as_of=None, n: int = 10) -> DataFrame:
    s = _since(fact_sales, as_of, 90).groupBy("book_id").agg(F.sum("quantity").alias("popularity_score"))
    j = dim_books.select("book_id").join(s, "book_id")
    return j.orderBy(F.col("popularity_score").desc(), "book_id").limit(check_n(n))


def popular_items_head(popular: DataFrame, n: int = 10) -> DataFrame:
    """First n of the cached popular list (same order)."""
    return (popular.orderBy(F.col("total_sales").desc(), F.col("unique_customers").desc(), "book_id")
            .limit(check_n(n)).select("book_id", "total_sales"))


def popular_by_user_type(dim_books: DataFrame, fact_sales: DataFrame, as_of=None, days: int = 180,
                         n: int = 10, popular: DataFrame | None = None) -> DataFrame:
    """Top n books of every customer type over ``days``; a type with no
    sales in the window gets the general popular list with score 0."""
    check_n(n)
    s = _since(fact_sales, as_of, days)
    per_type = s.groupBy(F.col("customer_type").alias("user_type"), "book_id").agg(
        F.sum("quantity").alias("popularity_score"))
    w = Window.partitionBy("user_type").orderBy(F.col("popularity_score").desc(), "book_id")
    top = per_type.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    books = dim_books.select("book_id", "title", "author", "genre", "price")
    ranked = top.join(books, "book_id").select(
        "user_type", "book_id", "title", "author", "genre", "price",
        F.col("popularity_score").cast("double").alias("popularity_score"), "rank")

    all_types = fact_sales.select(F.col("customer_type").alias("user_type")).distinct()
    missing = all_types.join(per_type.select("user_type").distinct(), "user_type", "left_anti")
    if popular is None:
        popular = popular_items(dim_books, fact_sales, as_of)
    head = (popular_items_head(popular, n).join(books, "book_id")
            .withColumn("rank", F.row_number().over(
                Window.orderBy(F.col("total_sales").desc(), "book_id")))
            .select("book_id", "title", "author", "genre", "price", "rank"))
    fallback = _with_list(missing, head).select(
        "user_type", "book_id", "title", "author", "genre", "price",
        F.lit(0.0).alias("popularity_score"), "rank")
    out = ranked.unionByName(fallback)
    return out.withColumn("reason", F.concat(F.lit("Popular among "), F.col("user_type"),
                                             F.lit(" customers")))


def with_popularity(scores: DataFrame, interactions: DataFrame, vectors: DataFrame, popular: DataFrame) -> DataFrame:
    """Scores of users and items, plus those of items that were bought by
    someone but have no vector: to users who do not own them they score the
    units of the popular list, if it has them."""
    bought = interactions.select("book_id").distinct().join(vectors.select("book_id"), "book_id", "left_anti")
    units = popular.select("book_id", F.col("total_sales").cast("double").alias("score"))
    # The popular list is short (its top 100), so its share without vectors is, too.
    listed = F.broadcast(units.join(bought, "book_id", "left_semi"))
    users = interactions.select("user_id").distinct()
    extra = users.crossJoin(listed).join(interactions.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    return scores.select("user_id", "book_id", "score").unionByName(extra.select("user_id", "book_id", "score"))


def similar_books(dim_books: DataFrame, topk: DataFrame, popular: DataFrame, n: int = 10) -> DataFrame:
    """Top n similar books with details for every catalogue book; a book
    with no feature vector (never sold) gets the popular list, its score
    being the units sold, as the source does for an unknown item."""
    check_n(n)
    books = dim_books.select("book_id", "title", "author", "genre", "price")
    sim = (topk.where(F.col("rank") <= n)
           .select(F.col("book_id").alias("source_book_id"), F.col("other_id").alias("book_id"),
                   "similarity_score", "rank")
           .join(books, "book_id"))
    has_vec = topk.select(F.col("book_id").alias("source_book_id")).distinct()
    missing = (dim_books.select(F.col("book_id").alias("source_book_id"))
               .join(has_vec, "source_book_id", "left_anti"))
    head = (popular_items_head(popular, n)
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_sales").desc(), "book_id")))
            .select("book_id", F.col("total_sales").cast("double").alias("similarity_score"), "rank")
            .join(books, "book_id"))
    cols = ["source_book_id", "book_id", "title", "author", "genre", "price", "similarity_score", "rank"]
    out = sim.select(*cols).unionByName(_with_list(missing, head).select(*cols))
    return out.withColumn("reason", F.lit("Similar content and features"))
