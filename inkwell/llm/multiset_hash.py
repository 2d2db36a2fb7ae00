"""Document fingerprints by a homomorphic multiset hash (native).

A document is the multiset of its paragraphs, cut at line ends, sentence ends
and after ``PIECE`` characters. The 128 bits of a paragraph's digest give a
vector of +1 and -1; the fingerprint is the sum of the vectors modulo 2^16.
Sums do not depend on the order of paragraphs; inserting or deleting a
paragraph adds or subtracts its vector, and fingerprints of two texts add up to
that of both. As the vectors of different paragraphs are nearly orthogonal, two
fingerprints' scalar product estimates how many paragraphs the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import let, numbered, ranged, stored

PIECE = 80
LANES = 128
MODULUS = 1 << 16
#: Rows of neighbouring doc_ids that are handled together, at most (more only
#: if there would be over ``MAX_CHUNKS`` bounds, which are broadcast).
CHUNK_ROWS = 500
BLOCK = 256
MAX_CHUNKS = BLOCK * BLOCK
_PARTS = 1 << 20
#: Copies of one row of a common doc_id that one task writes.
COPIES = 10_000
_PIECES = rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def centred(x: Column) -> Column:
    """Whole number modulo 2^16 as a signed 16-bit one."""
    half = MODULUS // 2
    return (F.pmod(x + half, F.lit(MODULUS)) - half).cast("smallint")


def lanes(text: Column) -> Column:
    """Fingerprint of a text as an array of signed 16-bit numbers."""
    word = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("bigint")
    two = lambda k: lambda d: F.shiftleft(word(d, k), 32) + word(d, k + 1)
    low = F.lit(0xFFFFFFFF).cast("bigint")
    pick = F.lit((1 << 32) + 1).cast("bigint")

    def ones(longs: Column, bit: int) -> Column:
        # Two lanes to a number: bit ``bit`` of either half, counted.
        return F.aggregate(longs, F.lit(0).cast("bigint"),
                           lambda n, x: n + F.shiftrightunsigned(x, bit).bitwiseAND(pick))

    def vector(digests: Column) -> Column:
        n = F.size(digests)
        made = []
        for k in (0, 2):
            made.append(let(F.transform(digests, two(k)), lambda longs: F.flatten(
                F.transform(F.array(*[ones(longs, b) for b in range(32)]),
                            lambda c: F.array(F.shiftrightunsigned(c, 32), c.bitwiseAND(low))))))
        return let(F.struct(F.concat(*made).alias("ones"), n.alias("n")),
                   lambda s: F.transform(s.ones, lambda c: centred(2 * c - s.n)))

    return let(F.transform(paragraphs(text), F.md5), vector)


def added(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together: insertion."""
    return F.zip_with(a, b, lambda x, y: centred(x.cast("int") + y))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``: deletion."""
    return F.zip_with(a, b, lambda x, y: centred(x.cast("int") - y))


def as_text(a: Column) -> Column:
    """Fingerprint as hex digits, four to a lane."""
    return F.array_join(F.transform(
        a, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("int"), F.lit(MODULUS)))), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs in common as the fingerprints estimate it, 0 to 1;
    equal fingerprints have likeness 1."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("bigint") * q), F.lit(0).cast("bigint"), lambda n, v: n + v)
    both = F.struct(dot(a, b).alias("ab"), (dot(a, a) + dot(b, b)).alias("all"))
    return F.when(a == b, F.lit(1.0)).otherwise(let(both, lambda d: F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), 2 * d.ab / d["all"]))))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as
    many (or all) of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def _finished(rows: DataFrame) -> DataFrame:
    """Rows (text, lanes, next_text, next_lanes) with their edited text's
    digest and fingerprint."""
    rows = rows.withColumn("new", edited(F.col("text"), F.col("next_text")))
    return rows.select("*", F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"),
                       lanes(F.col("new")).alias("edited_lanes"))


def _slot(doc_id: Column, blocks: Column) -> Column:
    """Place of ``doc_id`` among ascending bounds, cut into blocks of ``BLOCK``:
    2 i + 1 for the bound i itself, 2 i for ids before it and after bound i - 1."""
    def inside(j: Column) -> Column:
        block = F.get(blocks, j - 1)
        upto = (j - 1) * BLOCK + F.size(F.filter(block, lambda v: v <= doc_id))
        return F.when(j == 0, F.lit(0)).otherwise(2 * upto - F.array_contains(block, doc_id).cast("int"))
    return let(F.size(F.filter(blocks, lambda block: block[0] <= doc_id)), inside)


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``chunk`` and ``copies``. Chunks follow each other
    in descending doc_id, nulls last. Bounds are the ids at which the number of
    rows passes a multiple of the chunk size, each with a chunk of its own, so
    neither gaps between ids nor their range matter. An id with more rows than a
    chunk has them counted by text and parted by text order."""
    counts = stored(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "fingerprint-ids")
    zero = F.lit(0).cast("bigint")
    total, nulls = counts.agg(F.coalesce(F.sum("n"), zero),
                              F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), zero)).first()
    size = max(CHUNK_ROWS, -(-total // MAX_CHUNKS))
    placed = numbered(counts.where("doc_id IS NOT NULL"), [F.col("doc_id").asc()], "fingerprint-order", total="n")
    passed = lambda upto: F.floor(upto / size)
    own = F.col("doc_id").cast("bigint")
    bounds = placed.where(passed(F.col("running")) > passed(F.col("running") - F.col("n"))).agg(
        F.array_sort(F.collect_list(own)).alias("bounds"),
        F.collect_list(F.when(F.col("n") > size, own)).alias("hot"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("bounds") - 1) / BLOCK).cast("int")),
                      lambda i: F.slice("bounds", i * BLOCK + 1, F.lit(BLOCK)))
    bounds = stored(bounds.select("hot", F.when(F.size("bounds") > 0, cut).otherwise(
        F.array().cast("array<array<bigint>>")).alias("blocks")), "fingerprint-bounds")

    rows = rows.crossJoin(F.broadcast(bounds))  # one row, at most MAX_CHUNKS ids
    start = F.when(own.isNull(), F.lit(_PARTS)).otherwise(-_PARTS * _slot(own, F.col("blocks")).cast("bigint"))
    names = ["doc_id", "text", start.cast("bigint").alias("start")]
    if nulls <= size and not bounds.select(F.size("hot")).first()[0]:
        return rows.select(*names[:2], names[2].alias("chunk"), F.lit(1).cast("bigint").alias("copies"))
    common = F.coalesce(F.array_contains("hot", own), F.lit(nulls > size))
    few = rows.where(~common).select(*names, F.lit(1).cast("bigint").alias("copies"), F.lit(0).alias("part"))
    many = rows.where(common).select(*names).groupBy("doc_id", "start", "text").agg(
        F.count(F.lit(1)).alias("copies"))
    many = ranged(many, [F.col("start").asc(), F.col("text").asc()], "fingerprint-common")
    many = many.select("doc_id", "text", "start", "copies", F.col("_part").alias("part"))
    return few.unionByName(many).select("doc_id", "text", (F.col("start") + F.col("part")).alias("chunk"), "copies")


def _repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """``copies - 1`` rows of each row that stands for several: all but the last
    copy are followed by the same text. Worked out once, dealt out in blocks."""
    n = F.col("copies") - 1
    rows = _finished(rows.where(n > 0).withColumns({"next_text": F.col("text"), "next_lanes": F.col("lanes")}))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / COPIES)))
    rows = rows.select(*names, n.alias("n"), block.alias("block")).repartition(F.xxhash64("block", "lanes"))
    first = F.col("block") * COPIES
    each = F.sequence(first, F.least(F.col("n"), first + COPIES) - 1)
    return rows.select(*names, F.explode(each).alias("copy")).drop("copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, lanes, edited_lanes, next_lanes) of every
    document, its edited text and the next document in descending doc_id.

    Null texts count as empty. Ids are whole numbers. Null doc_ids come after all
    others; rows of one doc_id follow in the order of their texts, and the last is
    followed by the first, a single row by itself. Extra columns are not read; no
    rows, no output.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", "next_lanes"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Neighbouring doc_ids meet in chunks: texts are shuffled once.
    rows = _chunked(rows)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    window = Window.partitionBy("chunk").orderBy(*order)
    rows = rows.select("doc_id", "text", "chunk", "copies", lanes(F.col("text")).alias("lanes"))
    repeated = _repeated(rows, names)
    rows = rows.select(
        "*", F.lead("text").over(window).alias("next_text"), F.lead("lanes").over(window).alias("next_lanes"),
        (F.row_number().over(window) == 1).alias("is_first")).withColumn(
        "is_last", F.col("next_text").isNull())
    edge = F.when(F.col("is_first") | F.col("is_last"), F.col("text"))
    rows = _finished(rows).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "chunk", "is_first", "is_last",
        edge.alias("text"), "lanes", "next_lanes", "edited_sha256", "edited_lanes")
    rows = stored(rows, "fingerprints")
    # A chunk's last row is followed by the first of the chunk after it.
    firsts = rows.where("is_first")
    place = stored(numbered(firsts.select("chunk"), [F.col("chunk").asc()], "fingerprint-chunks"),
                   "fingerprint-places")
    n = max(1, place.count())
    lasts = rows.where("is_last").drop("next_lanes", "edited_sha256", "edited_lanes").join(place, "chunk")
    firsts = firsts.join(place, "chunk").select(
        F.pmod(F.col("row_number") - 1, F.lit(n)).alias("row_number"),
        F.col("text").alias("next_text"), F.col("lanes").alias("next_lanes"))
    lasts = _finished(lasts.join(firsts, "row_number"))
    return rows.where("NOT is_last").select(*names).unionByName(lasts.select(*names)).unionByName(repeated)


def query(docs: DataFrame) -> DataFrame:
    """op9: fingerprints of all documents and their edited texts."""
    out = fingerprints(docs)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
