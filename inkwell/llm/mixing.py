"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a keyed shuffle, followed by the same queue
again up to the allowed number of repeats. A copy's virtual finish time is the
cumulative words of its source up to and including it, divided by the source's
target: a source is served in proportion to its target, and all sources reach
their targets at time 1. The copies of all sources are range-sorted by finish
time and the sequence is cut where the words taken would pass the budget.

Targets are water-filled: weights share the budget, no target passes
``repeats`` times its source's size, and the excess is shared again by weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, join_counted, numbered, shielded, stored

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5,
                   repeats: int = 2) -> DataFrame:
    """(source, source_size, rank, target) from rows (source, size).

    Sources rank by code point, null last, and weigh ``weights`` in turn. A
    source of size 0 gets target 0. Sorted by cap per weight, the capped
    sources are a prefix, found with running sums instead of rounds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "mix-sources")
    per = per.withColumnRenamed("row_number", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(repeats))
    order = [(F.col("cap") / F.col("w")).asc(), F.col("rank").asc()]
    # Whole words and whole weights: the sums below are exact in doubles.
    caps = numbered(per, order, "mix-caps", total="cap").withColumnRenamed("running", "cap_sum")
    both = numbered(caps, order, "mix-weights", total="w").withColumnRenamed("running", "w_sum")
    all_ = per.agg((F.sum("source_size") * share).alias("budget"), F.sum("w").alias("w_all"))
    both = both.crossJoin(F.broadcast(all_))  # one row
    capped = (F.col("cap") * (F.col("w_all") - F.col("w_sum") + F.col("w"))
              <= (F.col("budget") - F.col("cap_sum") + F.col("cap")) * F.col("w"))
    both = both.withColumn("capped", capped)
    kept = both.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)).alias("cap_in"),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))), F.lit(0.0)).alias("w_left"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        (F.col("budget") - F.col("cap_in")) * F.col("w") / F.col("w_left"))
    return both.crossJoin(F.broadcast(kept)).select(
        "source", "source_size", "rank", target.alias("target"))


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5,
        repeats: int = 2, key: str = "inkwell") -> DataFrame:
    """Rows (doc_id, source, size, ...) with ``source_size``, ``target``,
    ``copies`` (0 to ``repeats``) and ``taken`` (copies times size).

    Null doc_ids and null sources count like values (null source last). Rows of
    size 0 are never taken. Rows equal in doc_id, source and size are told
    apart by their place in the input only, so a rerun gives the same rows.
    No rows: no output.
    """
    shuffle = F.md5(F.concat_ws(":", F.lit(key), F.coalesce(F.col("doc_id").cast("string"),
                                                           F.lit("null"))))
    # One range sort by (source, shuffle): a hot source spans many partitions.
    queue = numbered(
        rows.withColumn("_h", shuffle),
        [F.col("source").asc_nulls_last(), F.col("_h").asc(),
         F.col("doc_id").asc_nulls_first(), F.col("size").asc()],
        "mix-queue", total="size")
    queue = stored(queue, "mix-running")
    targets = stored(source_targets(queue, weights, share, repeats), "mix-targets")
    starts = numbered(targets, [F.col("rank").asc()], "mix-starts", total="source_size")
    starts = starts.select(F.col("source").alias("_source"), "source_size", "rank", "target",
                           (F.col("running") - F.col("source_size")).alias("_start"))
    queue = join_counted(queue, starts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = queue.withColumn("_cum", F.col("running") - F.col("_start"))
    copies = queue.where("size > 0").select(
        "row_number", "size", "rank", "target", "_cum", "source_size",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    copies = copies.select(
        F.col("row_number").alias("_row"), "size", "rank", "copy",
        ((F.col("copy") * F.col("source_size") + F.col("_cum")) / F.col("target")).alias("finish"))
    served = numbered(copies, [F.col("finish").asc(), F.col("rank").asc(), F.col("copy").asc(),
                               F.col("_row").asc()], "mix-served", total="size")
    budget = F.broadcast(targets.agg((F.sum("source_size") * share).alias("_budget")))  # one row
    taken = (served.crossJoin(budget).where(F.col("running") <= F.col("_budget"))
             .groupBy("_row").agg(F.count(F.lit(1)).alias("copies")))
    out = queue.join(taken, queue["row_number"] == taken["_row"], "left")
    copies_ = F.coalesce("copies", F.lit(0))
    return (out.withColumn("copies", copies_).withColumn("taken", copies_ * F.col("size"))
            .drop("_row", "row_number", "running", "_cum", "_start", "rank", "_h"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it takes them, with the
    columns of ``docs``. Null text has size 0 and is never taken; whatever else
    the rows hold is kept as it is."""
    def work(docs: DataFrame) -> DataFrame:
        rows = stored(docs.withColumn("_rid", F.monotonically_increasing_id()), "mix-docs")
        sizes = rows.select("doc_id", "source", "_rid", word_count(F.col("text")).alias("size"))
        taken = mix(stored(sizes, "mix-sizes"), **options).where("copies > 0").select("_rid", "copies")
        return rows.join(taken, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))

    return shielded(docs, ("doc_id", "source", "text"), work)


def query(docs: DataFrame) -> DataFrame:
    """op5: 150 % of all words, weights 5, 2, 1, at most 2 copies a document."""
    # Stored, so that the sampling of the range sort does not count the words of all texts again.
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
