"""Hybrid retrieval: BM25 and semantic scores blended 0.6 / 0.4, exact top k.

    score(q, d) = bm25_weight * bm25(q, d) / best bm25 of q + semantic_weight * cos(q, d)

The semantic vectors are tf-idf vectors (idf = ln(1 + N / df)) folded into
``DIMS`` dimensions by signed feature hashing, because no table links texts
to embeddings. Both lists are ranked on their own to a depth m, and the
threshold algorithm says when that is enough: a document in neither list scores
at most the blend of the two m-th scores. Queries that are not yet certain go
on with a greater depth, so no query's blend is computed for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.retrieval import _postings, _score, _search, bm25_bags, few, query_terms, query_vocabulary
from inkwell.operators.similarity import _topk_rows

#: Weights of the settings.
BM25_WEIGHT, SEMANTIC_WEIGHT = 0.6, 0.4
DIMS = 64
#: First depth of the lists in multiples of k, and its growth from round to round.
DEPTH, GROWTH = 8, 8
#: Queries whose vectors are sent to the documents at a time (2 MB).
QUERY_BLOCK = 4096
#: Scores this near are equal (they are ranked at 9 decimals).
NEAR = 2e-9


def hashed_vectors(terms: DataFrame) -> DataFrame:
    """(id, vec) unit vectors from (id, term, weight): a term adds its weight to
    one dimension, with a sign, both from the digits of its MD5."""
    digest = F.md5(F.col("term").cast("binary"))
    dim = F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(DIMS))
    sign = F.when(F.substring(digest, 5, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))
    # One sum for each dimension: a partial aggregate leaves a row for each text before the shuffle.
    sums = [F.coalesce(F.sum(F.when(F.col("dim") == i, F.col("w"))), F.lit(0.0)) for i in range(DIMS)]
    raw = terms.select("id", dim.alias("dim"), (sign * F.col("weight")).alias("w")).groupBy("id").agg(
        F.array(*sums).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return raw.select("id", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vec"))


def _nearest(names: list, vectors: np.ndarray, m: int):
    """mapInPandas function: each query's m nearest documents of a task."""
    code = -1 - np.arange(len(names))

    def best(held: list[pd.DataFrame]) -> list[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True)
        rows["_s"] = rows["similarity_score"].round(9)
        rows = rows.sort_values(["book_id", "_s", "other_id"], ascending=[True, False, True])
        return [rows[rows.groupby("book_id").cumcount() < m].drop(columns="_s")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if len(pdf):
                pdf = pdf.sort_values("id")
                sim = vectors @ np.vstack(pdf["vec"].to_numpy()).T
                held.append(_topk_rows(code, pdf["id"].to_numpy(np.int64), sim, m))
                held = best(held) if len(held) > 8 else held
        if held:
            rows = best(held)[0]
            yield pd.DataFrame({"qid": np.asarray(names, object)[-1 - rows["book_id"].to_numpy()],
                                "id": rows["other_id"], "cos": rows["similarity_score"]})
    return run


def semantic_topk(queries: DataFrame, docs: DataFrame, m: int) -> DataFrame:
    """(qid, id, cos, rank) of each query's m nearest documents; both sides are
    (id, vec). Queries meet the documents in blocks of bounded size."""
    kind = queries.schema["id"].dataType.simpleString()
    total, out = queries.count(), None
    blocks = max(1, -(-total // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK
        if rows:
            part = docs.mapInPandas(_nearest([r["id"] for r in rows], np.array([r["vec"] for r in rows]), m),
                                    f"qid {kind}, id long, cos double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"qid {kind}, id long, cos double")
    w = Window.partitionBy("qid").orderBy(F.round("cos", 9).desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def hybrid_topk(queries: DataFrame, docs: DataFrame, k: int = 5, bm25_weight: float = BM25_WEIGHT,
                semantic_weight: float = SEMANTIC_WEIGHT, query_id: str = "item_id", doc_id: str = "doc_id",
                text: str = "text", depth: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, bm25_score, cosine, rank): each query's k best
    documents by the blend, ties (at 9 decimals) to the smaller doc_id.

    Ids are unique. A query without any term of the corpus has no rows; a
    document without terms has cosine 0. A document that shares no term with the
    query has BM25 score 0, and may be found for its cosine."""
    bags, stats, counts = bm25_bags(docs, doc_id, text, query_vocabulary(queries, text))
    n_docs = docs.count()
    qterms = query_terms(queries, stats, query_id, text).checkpoint()
    idf = few(stats.select("term", F.log(F.lit(1.0) + F.lit(n_docs) / F.col("df")).alias("rarity")))
    weighted = lambda x, n: x.join(idf, "term").select("id", "term", (F.col(n) * F.col("rarity")).alias("weight"))
    made = hashed_vectors(weighted(counts.select("id", "term", "tf"), "tf"))
    zero = F.array_repeat(F.lit(0.0), DIMS)
    vectors = docs.select(F.col(doc_id).cast("long").alias("id")).join(made, "id", "left").select(
        "id", F.coalesce("vec", zero).alias("vec")).checkpoint()
    qvectors = hashed_vectors(weighted(qterms.select(F.col("qid").alias("id"), "term", "qtf"), "qtf")).checkpoint()

    open_, m, done = qvectors.select(F.col("id").alias("qid")), depth or DEPTH * k, []
    while True:
        mine = qterms.join(open_, "qid", "left_semi").checkpoint()
        lists = _blended(bags, vectors, mine, qvectors.join(open_, F.col("id") == F.col("qid"), "left_semi"),
                         m, bm25_weight, semantic_weight).checkpoint()
        best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
        ranked = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        sure = lists.groupBy("qid").agg(F.count(F.when(F.col("sure"), 1)).alias("n")).where(
            (F.col("n") >= k) | F.lit(m >= n_docs)).select("qid").checkpoint()
        done.append(ranked.join(sure, "qid", "left_semi"))
        open_ = open_.join(sure, "qid", "left_anti").checkpoint()
        if m >= n_docs or open_.isEmpty():
            break
        m *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("qid").alias(query_id), F.col("id").alias(doc_id), "score", "bm25_score", "cosine",
                      F.col("rank").cast("int").alias("rank"))


def _blended(bags: DataFrame, vectors: DataFrame, qterms: DataFrame, qvectors: DataFrame, m: int,
             bm25_weight: float, semantic_weight: float) -> DataFrame:
    """(qid, id, score, bm25_score, cosine, sure) of the documents in the first
    ``m`` of either list. ``sure``: no document outside can come before it. One
    outside scores at most the blend of the two m-th scores; with that very
    blend it has a greater id than those inside, as lists rank ties by id."""
    words = _search(bags, qterms, m).checkpoint()
    near = semantic_topk(qvectors, vectors, m).checkpoint()
    ends = lambda x, c, name: x.groupBy("qid").agg(
        F.max(c).alias(f"{name}_top"), F.when(F.max("rank") >= m, F.min(c)).otherwise(F.lit(None)).alias(f"{name}_end"))
    pairs = words.select("qid", "id").unionByName(near.select("qid", "id")).distinct().checkpoint()
    bm25 = _score(pairs, qterms, _postings(bags)).withColumnRenamed("score", "bm25_score")
    cosine = F.aggregate(F.zip_with("vec", "qvec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    cos = (vectors.join(few(pairs), "id").join(qvectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
           .select("qid", "id", cosine.alias("cosine")))
    rows = cos.join(bm25, ["qid", "id"], "left").na.fill(0.0, ["bm25_score"])
    rows = rows.join(ends(words, "score", "word"), "qid", "left").join(ends(near, "cos", "near"), "qid", "left")
    top = F.col("word_top")
    share = lambda c: F.when(top > 0, c / top).otherwise(F.lit(0.0))
    blend = lambda a, b: F.lit(bm25_weight) * share(a) + F.lit(semantic_weight) * b
    # A list shorter than m holds every document that scores in it.
    a, b = F.coalesce("word_end", F.lit(0.0)), F.coalesce("near_end", F.lit(-1.0))
    score, bound = blend(F.col("bm25_score"), F.col("cosine")), blend(a, b)
    last = (F.abs(share(F.col("bm25_score")) - share(a)) < NEAR) & (F.abs(F.col("cosine") - b) < NEAR)
    sure = (score > bound + NEAR) | last | F.col("near_end").isNull()
    return rows.select("qid", "id", score.alias("score"), "bm25_score", "cosine", sure.alias("sure"))
