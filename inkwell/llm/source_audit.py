"""Source divergence audit: how the sources of a language differ in their terms.

Counting is an Arrow compute pipeline inside ``mapInArrow``: texts are lowered
(``ascii_lower``), cut (``split_pattern_regex``), their terms numbered
(``dictionary_encode``) and counted by hash ``group_by``; a task sends partial
counts, which Spark adds up. The counts of a language are then dealt to
shards of terms; a shard is a columnar table of bounded size (terms x sources)
that works out its share of every divergence, and the shares are added up.

All figures are whole numbers: p = 1 + floor(scale * (count + 1) / (N + V)) per
term and group, f = floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import stored

#: A term is a run of ASCII letters and code points beyond ASCII.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole parts of this.
SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 3
#: Places of the ``term`` part that are reported for each group.
TERM_RANKS = 200
#: Bytes of text that are counted together, and partial counts that a task holds, about.
PIECE_BYTES = 4 << 20
HELD_COUNTS = 400_000
#: Terms x sources in one shard, about.
SHARD_CELLS = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def piece_counts(table: pa.Table) -> pa.Table:
    """Counts (lang, source, term, n, docs) of the rows (text, lang, source)."""
    words = pc.split_pattern_regex(pc.ascii_lower(table["text"]), pattern=BETWEEN_TERMS).combine_chunks()
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.greater(pc.binary_length(term), 0)  # a text may begin or end between terms
    row, term = row.filter(some), term.filter(some).dictionary_encode()
    seen = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False)
    seen = seen.aggregate([([], "count_all")])
    group = table.select(["lang", "source"]).take(seen["row"])
    seen = (pa.table({"lang": group["lang"], "source": group["source"], "term": seen["term"],
                      "n": seen["count_all"]})
            .group_by(["lang", "source", "term"], use_threads=False)
            .aggregate([("n", "sum"), ("n", "count")]))
    return pa.table([seen["lang"], seen["source"], term.dictionary.take(seen["term"].combine_chunks()),
                     seen["n_sum"], seen["n_count"]], schema=_COUNTS)


def _merged(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False)
    return out.aggregate([("n", "sum"), ("docs", "sum")]).select(
        ["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """The rows of a batch in runs of about ``limit`` bytes of text, one row at least."""
    table = pa.Table.from_batches([batch])
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield table.slice(first, last - first)
        first = last


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, floor = [], 0, 0
    for batch in batches:
        for piece in pieces(batch):
            held.append(piece_counts(piece))
            size += len(held[-1])
            if size > HELD_COUNTS + floor:
                held = [_merged(held)]
                size = floor = len(held[0])
                if floor > HELD_COUNTS // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, size, floor = [], 0, 0
    if held:
        yield from _merged(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                          for c in ("text", "lang", "source")])
    counts = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any 64-bit counts."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + F.lit(1).cast("decimal(1,0)"))
    return F.call_function("div", above, whole(total) + whole(terms)) + 1


_SHARES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()),
                     ("item", pa.string()), ("value", pa.int64())])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so 64 bits hold it."""
    return (p - q) * (p - q) // q


def _shard(groups: pa.Table, counts: pa.Table) -> pa.Table:
    """A shard's share of its language: for each ordered pair of sources the sum
    over the shard's terms, and the terms that a source has more of than all."""
    groups = groups.sort_by("source")
    sources, lang = groups["source"].combine_chunks(), groups["lang"][0].as_py()
    names = counts["term"].combine_chunks().dictionary_encode()
    term = names.indices.to_numpy(zero_copy_only=False)
    source = pc.index_in(counts["source"].combine_chunks(), sources).to_numpy(zero_copy_only=False)
    n, k = len(sources), len(names.dictionary)
    table = np.repeat(groups["none"].to_numpy()[:, None], k, axis=1)
    own, whole = counts["p"].to_numpy(), counts["q"].to_numpy()
    table[source, term] = own
    out = []
    for g in range(n):
        value = divergence(table[g], table).sum(axis=1) if k else np.zeros(n, np.int64)
        other = np.delete(np.arange(n), g)
        out.append(_rows(lang, sources.take(pa.array(np.full(n - 1, g))), "pair",
                         sources.take(pa.array(other)), value[other]))
    more = np.flatnonzero(own > whole)
    out.append(_rows(lang, counts["source"].combine_chunks().take(pa.array(more)), "term",
                     counts["term"].combine_chunks().take(pa.array(more)),
                     divergence(own[more], whole[more])))
    return pa.concat_tables(out)


def _rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.Table:
    n = len(value)
    return pa.table([pa.repeat(lang, n), source, pa.repeat(part, n), item,
                     pa.array(value, pa.int64())], schema=_SHARES)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS,
          cells: int = SHARD_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: the divergence of the source from each other source of its
    language, over all kept terms. Part ``term``: the ``term_ranks`` terms that
    the source has most in excess of its language. Null text, lang and source
    are read as ''. A group without terms diverges by its smoothed shares; a
    language without kept terms has pairs of value 0 and no terms; a language
    of one source has no pairs; no documents: no rows. Repeated rows count as often
    as they occur, and a term's documents are rows.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = stored(term_counts(docs.select("text", "lang", "source")), "audit-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_all"), F.sum("docs").alias("docs"))
    terms = stored(terms.where(F.col("docs") >= least_documents).drop("docs"), "audit-terms")
    kept = stored(counts.drop("docs").join(terms, ["lang", "term"]), "audit-kept")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_all").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(name("lang"), name("source")).distinct()
    number = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .join(number, "lang").na.fill(0, ["total", "terms", "lang_total"]))
    empty = F.col("terms") == 0
    groups = groups.withColumn("none", F.when(empty, F.lit(1)).otherwise(
        share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).cast("long"))
    groups = groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(
        F.col("terms") * F.col("sources") / F.lit(cells))).cast("int"))
    groups = stored(groups, "audit-groups")

    rows = kept.join(groups, ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"),
                       "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                       share(F.col("of_all"), F.col("lang_total"), F.col("terms")).alias("q"))
    sent = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                         "source", "none")
    shares = sent.groupBy("lang", "shard").cogroup(rows.groupBy("lang", "shard")).applyInArrow(
        _shard, "lang string, source string, part string, item string, value long")
    shares = stored(shares, "audit-shares")
    pair = shares.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum("value").alias("value"))
    term = _ranked(shares.where("part = 'term'")).where(F.col("rank") <= term_ranks)
    return _ranked(pair).unionByName(term)


def query(docs: DataFrame) -> DataFrame:
    """op12: terms in three documents of a language, 200 ranks."""
    return audit(docs)
