"""Item-item cosine similarity on standardised features, exact and blocked.

Vectors (JVM-side): numerics (NULL -> 0) plus 0/1 columns per category
value (NULL -> all zero), z-scored with the population mean / stddev
(constant column -> 0), then divided by their norm (zero vector stays 0,
so its cosine with anything is 0).

Exact top-k without pairing rows: items stand in blocks of about
``block_size`` neighbours (the same nearest pivot), and a block's items in
leaves. Cells, blocks and leaves are balls with a centre and an angular radius;
every item has a floor, the score of its k-th best partner so far. A pair of
balls is multiplied only if the angle between the centres less the radii allows
an item's floor: block pairs are judged by joins of stored tables, leaf pairs
within the task that holds two blocks. Floors start from the item's own block
and rise once more after the nearest blocks. One ``applyInPandas`` group holds two
blocks (memory bounded by the block size, not by the catalogue), forms their
products a piece at a time and emits only each row's k best partners. How many products remain depends on how the items
cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMERIC_FEATURES = ["price", "page_count", "publication_year", "total_sales", "velocity_score",
                    "avg_selling_price"]
CATEGORY_FEATURES = ["genre", "price_category", "publisher_type"]
# Tasks for block pairs at most, and the slack of the floors (arc cosines near 0, rounded ties).
PAIR_TASKS = 2000
# Up to so many blocks all pairs are multiplied.
FEW_BLOCKS = 16
FLOOR_SLACK = 1e-6
# Pivots of the cells at most (they are sent to every task), items of a leaf, and
# the blocks next to a block that are multiplied before the floors rise.
MAX_PIVOTS, LEAF_SIZE, NEAR_BLOCKS = 4096, 32, 3
# Items per block of a small catalogue. A larger one has FEW_BLOCKS blocks until a block would hold more than
# LARGE_BLOCK items or LARGE_CELLS numbers: each item is shuffled once for each block that it meets. Beyond
# MANY_BLOCKS blocks they grow past LARGE_BLOCK items; first floors come from so many items of the block.
DEFAULT_BLOCK, LARGE_BLOCK, LARGE_CELLS, MANY_BLOCKS = 4096, 65536, 2 ** 22, 24
# Products held at a time: so many rows by so many columns.
ROWS, STRIP = 256, 8192
# Columns of the first piece that give the first floors, and pairs scored again at a time.
HEAD, AGAIN = 1024, 2 ** 16


def _with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a single-row frame (global statistics) to every row; the
    one-row side is broadcast (its size is fixed)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def category_values(items: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct non-NULL values of categorical columns, in one job (small
    domains, like the labels a StringIndexer collects)."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                for c in columns]))
    rows = (items.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
            .distinct().orderBy("c", "v").collect())
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["c"]].append(r["v"])
    return out


def feature_vectors(items: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES,
                    categorical: Sequence[str] = CATEGORY_FEATURES,
                    categories: dict[str, list[str]] | None = None) -> DataFrame:
    """(book_id, vec array<double>) of unit-length standardised features."""
    categories = dict(categories or {})
    keep = ["book_id", *numeric, *[c for c in categorical if c in items.columns]]
    # Written once to the checkpoint folder: the vocabulary, statistics and
    # vector passes then read it instead of recomputing its lineage.
    items = items.select(*keep).checkpoint()
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(numeric)]
    present = [c for c in categorical if c in items.columns]
    missing = [c for c in present if not categories.get(c)]
    categories.update(category_values(items, missing))
    for c in present:
        for v in categories[c]:
            cols.append(F.when(F.col(c) == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"f{len(cols)}"))
    names = [f"f{i}" for i in range(len(cols))]
    x = items.select("book_id", *cols)
    stats = x.agg(*[F.avg(n).alias(f"m_{n}") for n in names],
                  *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    z = [F.when(F.col(f"s_{n}") > 0, (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}"))
         .otherwise(F.lit(0.0)) for n in names]
    v = _with_one_row(x, stats).select("book_id", F.array(*z).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda acc, e: acc + e * e))
    return v.select("book_id", F.when(norm > 0, F.transform("z", lambda e: e / norm))
                    .otherwise(F.transform("z", lambda e: e * 0.0)).alias("vec"))


def n_blocks(n_items: int, block_size: int = DEFAULT_BLOCK) -> int:
    return max(1, math.ceil(n_items / block_size))


def paired_blocks(n_items: int, dims: int, block_size: int = DEFAULT_BLOCK, most: int | None = None) -> int:
    """Blocks of a search in which every block may meet every other: of ``block_size``
    items up to ``FEW_BLOCKS``, of ``LARGE_BLOCK`` up to ``MANY_BLOCKS``, more only when
    blocks pass ``most`` items or ``LARGE_CELLS`` numbers."""
    top = LARGE_CELLS // max(1, dims)
    top = top if most is None else min(most, top)
    large = max(block_size, min(top, max(LARGE_BLOCK, math.ceil(n_items / MANY_BLOCKS))))
    return max(n_blocks(n_items, large), min(FEW_BLOCKS, n_blocks(n_items, block_size)))


def _block_pairs(vectors: DataFrame, blocks: int, extra: Sequence[str] = ()) -> DataFrame:
    """Each item once per block pair (i <= j) it belongs to, with its role:
    'L' in pairs (b, j>=b) and 'R' in pairs (i<=b, b)."""
    b = F.pmod(F.xxhash64("book_id"), F.lit(blocks)).cast("int")
    base = vectors.select("book_id", "vec", *extra, b.alias("blk"))
    left = base.select("*", F.lit("L").alias("role"), F.col("blk").alias("pi"),
                       F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("pj"))
    right = base.select("*", F.lit("R").alias("role"),
                        F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("pi"), F.col("blk").alias("pj"))
    return left.unionByName(right).drop("blk")


def _spread_pairs(pairs: DataFrame, blocks: int, n_pairs: int | None = None) -> DataFrame:
    """Block pairs dealt to tasks. Up to ``PAIR_TASKS`` pairs, each has a task
    of its own (a range partitioning on the pair; hashing few keys would stack
    several in one task); more are hashed to that many tasks, so the number of
    partitions does not grow with the pairs. The explicit count keeps AQE from
    merging the compute-heavy tasks."""
    n_pairs = n_pairs or blocks * (blocks + 1) // 2
    g = (F.col("pi").cast("bigint") * F.lit(blocks) + F.col("pj")).alias("g")
    pairs = pairs.select("*", g)
    return pairs.repartitionByRange(n_pairs, "g") if n_pairs <= PAIR_TASKS else pairs.repartition(PAIR_TASKS, "g")


# ---------------------------------------------------------------------------
# A tree of balls: cells of near pivots, blocks of them, leaves of a block
# ---------------------------------------------------------------------------


def _ball(v: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Centre and angular radius of unit vectors, and whether a zero vector is among them."""
    long = np.linalg.norm(v, axis=1) > 0.5  # unit vectors; the others are zero
    mean = v.sum(axis=0)
    size = np.linalg.norm(mean)
    if not long.any() or size <= 1e-12:
        return np.zeros(v.shape[1]), np.pi, bool((~long).any())
    centre = mean / size
    return centre, float(np.arccos(np.clip(v[long] @ centre, -1, 1)).max()), bool((~long).any())


def _reach(dot: np.ndarray, radii: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Largest cosine that items of two balls can have, from the cosine of the
    centres and the sum of the radii; a zero vector scores 0 with everything."""
    best = np.cos(np.clip(np.arccos(np.clip(dot, -1, 1)) - radii, 0, np.pi))
    return np.where(zero, np.maximum(best, 0), best)


def _leaves(v: np.ndarray, size: int) -> np.ndarray:
    """Leaf number of each row: rows are parted between two far ones, by the one
    that is nearer (in halves if that leaves few on a side), until a leaf has at
    most ``size`` rows."""
    leaf, todo, made = np.zeros(len(v), np.int32), [np.arange(len(v))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaf[rows] = made
            made += 1
            continue
        x = v[rows]
        one = x[np.argmin(x @ x[0])]
        side = x @ (one - x[np.argmin(x @ one)])
        order = np.argsort(side, kind="stable")
        cut = int(np.searchsorted(side[order], (side.min() + side.max()) / 2))
        if min(cut, len(rows) - cut) * 16 < len(rows):
            cut = len(rows) // 2
        todo += [rows[order[:cut]], rows[order[cut:]]]
    return leaf


def neighbour_blocks(vectors: DataFrame, blocks: int, block_size: int) -> DataFrame:
    """(book_id, vec, cell, blk), checkpointed. Every item goes to the cell of
    the nearest of ``blocks`` pivots (at most ``MAX_PIVOTS``: the items with
    the lowest digests); cells with more than ``block_size`` items have several
    blocks. The driver sees the pivots and the cells' sizes, no more."""
    rows = vectors.orderBy(F.xxhash64("book_id"), "book_id").limit(min(blocks, MAX_PIVOTS)).select("vec").collect()
    pivots = np.array([r[0] for r in rows], dtype=np.float64)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                pdf["cell"] = (np.vstack(pdf["vec"].to_numpy()) @ pivots.T).argmax(axis=1).astype(np.int32)
                yield pdf

    placed = vectors.select("book_id", "vec").mapInPandas(
        nearest, "book_id long, vec array<double>, cell int").checkpoint()
    table, total = [], 0
    for cell, n in placed.groupBy("cell").count().orderBy("cell").collect():
        parts = math.ceil(n / block_size)
        table.append((cell, total, parts))
        total += parts
    cells = vectors.sparkSession.createDataFrame(table, "cell int, first int, parts int")
    blk = F.col("first") + F.pmod(F.xxhash64("book_id"), F.col("parts"))
    return placed.join(F.broadcast(cells), "cell").select("book_id", "vec", "cell", blk.cast("int").alias("blk"))


_FOUND = "book_id long, other_id long, similarity_score double"


def _with_leaves(k: int, leaf_size: int):
    """Leaves of a block, and each item's floor: the score of the k-th best of its own
    block (-2 if there are fewer), or of every second, third ... item of a large block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(pdf["vec"].to_numpy())
        floor, every = np.full(len(v), -2.0), -(-len(v) // LARGE_BLOCK)
        some = v[::every]
        if len(some) > k:
            for at in range(0, len(v), 512):
                s = v[at:at + 512] @ some.T
                rows = np.arange(at, at + len(s))
                own = rows % every == 0
                s[np.flatnonzero(own), rows[own] // every] = -np.inf
                floor[at:at + 512] = np.partition(s, len(some) - k, axis=1)[:, len(some) - k]
        return pdf.assign(leaf=_leaves(v, leaf_size), floor=floor)
    return run


def _block_balls(pdf: pd.DataFrame) -> pd.DataFrame:
    centre, radius, zero = _ball(np.vstack(pdf["vec"].to_numpy()))
    return pd.DataFrame({"cell": [int(pdf["cell"].iat[0])], "blk": [int(pdf["blk"].iat[0])], "centre": [centre],
                         "radius": [radius], "zero": [zero]})


def _near_cells(cells: pd.DataFrame):
    """mapInPandas function: the cells that a block's items can reach their
    floors in. A cell's ball holds the balls of its blocks."""
    centre = np.vstack(cells["centre"].to_numpy())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                own = np.vstack(pdf["centre"].to_numpy())
                best = _reach(own @ centre.T, pdf["radius"].to_numpy()[:, None] + cells["radius"].to_numpy(),
                              pdf["zero"].to_numpy()[:, None] | cells["zero"].to_numpy())
                row, col = np.nonzero(best >= pdf["floor"].to_numpy()[:, None] - FLOOR_SLACK)
                yield pdf[["blk", "centre", "radius", "zero", "floor"]].iloc[row].assign(
                    cell=cells["cell"].to_numpy()[col])
    return run


def _angle(dot):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def _reachable(balls: DataFrame, floors: DataFrame) -> DataFrame:
    """(blk, other, gap) of the block pairs in which an item of ``blk`` can reach
    its floor, without the pair of a block with itself. Blocks meet the cells
    (at most ``MAX_PIVOTS``) first and then the blocks of the cells left."""
    cells = balls.groupBy("cell").applyInPandas(
        _cell_ball, "cell int, centre array<double>, radius double, zero boolean").toPandas()
    if not len(cells):
        return balls.select("blk", F.col("blk").alias("other"), F.lit(0.0).alias("gap"))
    kind = "blk int, centre array<double>, radius double, zero boolean, floor double, cell int"
    near = balls.drop("cell").join(floors, "blk").mapInPandas(_near_cells(cells), kind)
    other = balls.select("cell", *[F.col(c).alias(f"_{c}") for c in ("blk", "centre", "radius", "zero")])
    dot = F.aggregate(F.zip_with("centre", "_centre", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    gap = F.greatest(F.lit(0.0), _angle(dot) - F.col("radius") - F.col("_radius"))
    best = F.cos(F.least(F.col("gap"), F.lit(math.pi)))
    best = F.when(F.col("zero") | F.col("_zero"), F.greatest(best, F.lit(0.0))).otherwise(best)
    return (near.join(other, "cell").where("blk <> _blk").withColumn("gap", gap)
            .where(best >= F.col("floor") - FLOOR_SLACK).select("blk", F.col("_blk").alias("other"), "gap"))


def _cell_ball(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ball of a cell's blocks (a few: cells are split into blocks by hash)."""
    centres = np.vstack(pdf["centre"].to_numpy())
    mean = centres.sum(axis=0)
    size = np.linalg.norm(mean)
    centre = mean / size if size > 1e-12 else mean
    far = np.arccos(np.clip(centres @ centre, -1, 1)) + pdf["radius"].to_numpy() if size > 1e-12 else np.array([np.pi])
    return pd.DataFrame({"cell": [int(pdf["cell"].iat[0])], "centre": [centre],
                         "radius": [float(min(far.max(), np.pi))], "zero": [bool(pdf["zero"].any())]})


def _leaf_products(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``) that must be multiplied: for each leaf of
    ``a`` the leaves of ``b`` in which one of its items can reach its floor."""
    va, vb = np.vstack(a["vec"].to_numpy()), np.vstack(b["vec"].to_numpy())
    groups = []
    for v, leaf in ((va, a["leaf"].to_numpy()), (vb, b["leaf"].to_numpy())):
        rows = [np.flatnonzero(leaf == x) for x in np.unique(leaf)]
        groups.append((rows, [_ball(v[r]) for r in rows]))
    (rows_a, balls_a), (rows_b, balls_b) = groups
    centre, radius, zero = (np.array(x) for x in zip(*balls_b))
    floor = a["floor"].to_numpy()
    for rows, (c, r, z) in zip(rows_a, balls_a):
        need = _reach(centre @ c, radius + r, zero | z) >= floor[rows].min() - FLOOR_SLACK
        if need.any():
            yield rows, np.sort(np.concatenate([x for x, n in zip(rows_b, need) if n]))


def _pruned_topk(k: int):
    """Best partners of a block pair's items, leaf by leaf; pairs below an item's
    floor are not sent on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {r: x.sort_values("book_id", kind="stable").reset_index(drop=True) for r, x in pdf.groupby("role")}
        parts = [pd.DataFrame({"book_id": np.zeros(0, np.int64), "other_id": np.zeros(0, np.int64),
                               "similarity_score": np.zeros(0)})]
        turns = [("L", "R")] if pdf["pi"].iat[0] == pdf["pj"].iat[0] else [("L", "R"), ("R", "L")]
        for one, two in turns if len(side) == 2 else []:
            a, b = side[one], side[two]
            ids_a, ids_b = a["book_id"].to_numpy(np.int64), b["book_id"].to_numpy(np.int64)
            va, vb = np.vstack(a["vec"].to_numpy()), np.vstack(b["vec"].to_numpy())
            for rows, cols in _leaf_products(a, b):
                parts.append(_topk_product(ids_a[rows], va[rows], ids_b[cols], vb[cols], k,
                                           a["floor"].to_numpy()[rows] - FLOOR_SLACK))
        return pd.concat(parts, ignore_index=True)
    return run


def _count_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Products that ``_pruned_topk`` forms for a block pair."""
    side = {r: x.sort_values("book_id").reset_index(drop=True) for r, x in pdf.groupby("role")}
    turns = [("L", "R")] if pdf["pi"].iat[0] == pdf["pj"].iat[0] else [("L", "R"), ("R", "L")]
    n = sum(len(r) * len(c) for one, two in turns if len(side) == 2 for r, c in _leaf_products(side[one], side[two]))
    return pd.DataFrame({"g": [int(pdf["g"].iat[0])], "n": [n]})


def _meeting(items: DataFrame, pairs: DataFrame, tasks: int) -> DataFrame:
    """Items once for each of the (pi, pj) block pairs they belong to, with their role."""
    left = items.join(pairs, items["blk"] == pairs["pi"]).withColumn("role", F.lit("L"))
    right = items.join(pairs, items["blk"] == pairs["pj"]).withColumn("role", F.lit("R"))
    both = left.unionByName(right).drop("blk", "cell")
    both = both.withColumn("g", F.xxhash64("pi", "pj"))
    return both.repartition(min(PAIR_TASKS, max(1, tasks)), "g")


def _raised(items: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``items`` with the floors that the pairs found so far allow."""
    w = Window.partitionBy("book_id").orderBy(F.col("similarity_score").desc())
    kth = (found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
           .select("book_id", F.col("similarity_score").alias("_kth")))
    floor = F.greatest(F.col("floor"), F.coalesce("_kth", F.lit(-2.0)))
    return items.join(kth, "book_id", "left").withColumn("floor", floor).drop("_kth")


def _tree_topk(placed: DataFrame, k: int, leaf_size: int = LEAF_SIZE, near: int = NEAR_BLOCKS,
               kernel=None) -> DataFrame:
    """Candidates (book_id, other_id, similarity_score) that hold every item's k
    best, in three rounds: the block itself, the ``near`` blocks next to it, and
    with the floors risen by then all blocks that items can still reach theirs in."""
    kernel = kernel or (_pruned_topk(k), _FOUND)
    items = placed.groupBy("blk").applyInPandas(
        _with_leaves(k, leaf_size), "book_id long, vec array<double>, cell int, blk int, leaf int, floor double").checkpoint()
    balls = items.groupBy("blk").applyInPandas(
        _block_balls, "cell int, blk int, centre array<double>, radius double, zero boolean").checkpoint()
    lowest = lambda x: x.groupBy("blk").agg(F.min("floor").alias("floor"))
    ordered = lambda x: x.select(
        F.least("blk", "other").alias("pi"), F.greatest("blk", "other").alias("pj")).distinct()
    w = Window.partitionBy("blk").orderBy("gap", "other")
    reach = _reachable(balls, lowest(items)).checkpoint()
    close = ordered(reach.withColumn("r", F.row_number().over(w)).where(F.col("r") <= near))
    first = ordered(balls.select("blk", F.col("blk").alias("other"))).unionByName(close).checkpoint()
    run = lambda items, pairs: _meeting(items, pairs, pairs.count()).groupBy("g").applyInPandas(*kernel).checkpoint()
    found = run(items, first)
    if kernel[1] != _FOUND:  # counting: floors rise as they would
        known = _meeting(items, first, first.count()).groupBy("g").applyInPandas(_pruned_topk(k), _FOUND)
        raised = _raised(items, known, k).checkpoint()
    else:
        raised = _raised(items, found, k).checkpoint()
    rest = ordered(_reachable(balls, lowest(raised))).join(first, ["pi", "pj"], "left_anti").checkpoint()
    return found if rest.isEmpty() else found.unionByName(run(raised, rest))


def products_formed(vectors: DataFrame, k: int, blocks: int, block_size: int) -> int:
    """Products of two items that the tree search forms (all pairs: items squared)."""
    placed = neighbour_blocks(vectors.checkpoint(), blocks, block_size)
    return int(_tree_topk(placed, k, kernel=(_count_products, "g long, n long")).agg(F.sum("n")).first()[0] or 0)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("book_id", kind="stable")
    ids = pdf["book_id"].to_numpy(dtype=np.int64)
    vec = np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 0))
    return ids, vec


def _topk_rows(ids_a, ids_b, sim, k) -> pd.DataFrame:
    """Per row of ``sim`` (a x b), the k best columns by (round(score, 9)
    desc, id asc), never the row's own id (``ids_b`` is sorted). The k-th
    best raw score of each row is found by partial selection; only the
    columns within rounding distance of it (ties included) are rounded and
    sorted, so the result is exact."""
    kk = min(k, sim.shape[1])
    if kk == 0 or sim.shape[0] == 0:
        return pd.DataFrame({"book_id": np.zeros(0, np.int64), "other_id": np.zeros(0, np.int64),
                             "similarity_score": np.zeros(0)})
    work = sim
    pos = np.minimum(np.searchsorted(ids_b, ids_a), len(ids_b) - 1)
    own = ids_b[pos] == ids_a
    if own.any():
        work = sim.copy()
        work[np.nonzero(own)[0], pos[own]] = -np.inf
    n = work.shape[1]
    kth = np.partition(work, n - kk, axis=1)[:, n - kk]
    # round(x, 9) >= round(kth, 9) implies x >= round(kth, 9) - 5e-10.
    rows, cols = np.nonzero(work >= (np.round(kth, 9) - 1e-9)[:, None])
    vals = np.round(work[rows, cols], 9)
    fin = np.isfinite(vals)
    rows, cols, vals = rows[fin], cols[fin], vals[fin]
    order = np.lexsort((ids_b[cols], -vals, rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = (np.arange(len(rows)) - first) < kk
    rows, cols = rows[keep], cols[keep]
    return pd.DataFrame({"book_id": ids_a[rows], "other_id": ids_b[cols],
                         "similarity_score": sim[rows, cols]})


def _topk_product(ids_a: np.ndarray, va: np.ndarray, ids_b: np.ndarray, vb: np.ndarray, k: int,
                  floor: np.ndarray | None = None) -> pd.DataFrame:
    """``_topk_rows`` of ``va @ vb.T``, which is formed a piece at a time; pairs below
    a row's ``floor`` are left out. A row's floor rises to the k-th best of the
    pieces seen, so that of a later piece only the few scores above it are held.
    Pieces are in single precision and only say which pairs can reach a floor
    (``err`` bounds what they are off); the scores of those are in double."""
    out = [pd.DataFrame({"book_id": np.zeros(0, np.int64), "other_id": np.zeros(0, np.int64),
                         "similarity_score": np.zeros(0)})]
    vb32, dims = vb.astype(np.float32), vb.shape[1] if vb.ndim > 1 else 0
    longest = [float(np.nanmax(np.linalg.norm(v, axis=1), initial=0.0)) for v in (va, vb)]
    err = (dims + 8) * 2.0 ** -23 * longest[0] * longest[1] + 1e-30
    for at in range(0, len(va), ROWS):
        a, ids = va[at:at + ROWS], ids_a[at:at + ROWS]
        a32 = a.astype(np.float32)
        low = np.full(len(a), -np.inf) if floor is None else np.array(floor[at:at + ROWS], dtype=np.float64)
        rows, cols, vals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(vb), STRIP):
            s = a32 @ vb32[first:first + STRIP].T
            here = ids_b[first:first + STRIP]
            pos = np.minimum(np.searchsorted(here, ids), len(here) - 1)
            own = here[pos] == ids
            s[np.flatnonzero(own), pos[own]] = -np.inf
            if first == 0 and len(here) > k:
                head = s[:, :max(HEAD, k + 1)]
                low = np.maximum(low, np.partition(head, head.shape[1] - k, axis=1)[:, head.shape[1] - k] - err)
            # round(x, 9) >= round(low, 9) implies x >= low - 1e-9.
            least = np.where(np.isfinite(low), low - 2e-9, -np.inf)
            far = np.where(np.isfinite(least), least - err, -1e30).astype(np.float32)
            r, c = np.divmod(np.flatnonzero(s >= np.nextafter(far, np.float32(-np.inf))[:, None]), s.shape[1])
            if 16 * len(r) > s.size:  # many ties: the whole piece again
                v = (a @ vb[first:first + STRIP].T)[r, c]
            else:
                v = np.concatenate([np.zeros(0)] + [
                    np.einsum("ij,ij->i", a[r[i:i + AGAIN]], vb[first + c[i:i + AGAIN]])
                    for i in range(0, len(r), AGAIN)])
            keep = v >= least[r]
            rows, cols = np.concatenate([rows, r[keep]]), np.concatenate([cols, c[keep] + first])
            vals = np.concatenate([vals, v[keep]])
            if len(rows) > 4 * k * len(a) or first + STRIP >= len(vb):  # cut to the k best of each row
                order = np.lexsort((ids_b[cols], -np.round(vals, 9), rows))
                rows, cols, vals = rows[order], cols[order], vals[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                last = nth == k - 1
                low[rows[last]] = np.maximum(low[rows[last]], vals[last] - 1e-9)
                rows, cols, vals = rows[nth < k], cols[nth < k], vals[nth < k]
        out.append(pd.DataFrame({"book_id": ids[rows], "other_id": ids_b[cols], "similarity_score": vals}))
    return pd.concat(out[1:], ignore_index=True) if len(out) > 1 else out[0]


def _pair_topk(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids_l, l = _matrix(pdf[pdf["role"] == "L"])
        ids_r, r = _matrix(pdf[pdf["role"] == "R"])
        parts = [pd.DataFrame({"book_id": np.zeros(0, np.int64), "other_id": np.zeros(0, np.int64),
                               "similarity_score": np.zeros(0)})]
        if len(ids_l) and len(ids_r):
            parts.append(_topk_product(ids_l, l, ids_r, r, k))
            if pdf["pi"].iat[0] != pdf["pj"].iat[0]:
                parts.append(_topk_product(ids_r, r, ids_l, l, k))
        return pd.concat(parts, ignore_index=True)
    return run


def _dims(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vec")).first()
    return row[0] if row else 1


def item_similarity_topk(vectors: DataFrame, k: int = 10, block_size: int = DEFAULT_BLOCK,
                         blocks: int | None = None, min_similarity: float | None = None) -> DataFrame:
    """(book_id, other_id, similarity_score, rank) for each item's k most
    similar other items, exact over the whole catalogue; with
    ``min_similarity``, only those at least that similar. Blocks hold
    neighbouring items, and only block pairs whose items can come near enough
    are multiplied."""
    vectors = vectors.checkpoint()
    count = vectors.count()
    blocks = blocks or paired_blocks(count, _dims(vectors), block_size)
    if blocks <= FEW_BLOCKS:  # bounds cost more than the pairs they could save
        pairs = _spread_pairs(_block_pairs(vectors, blocks), blocks)
        cand = pairs.groupBy("g").applyInPandas(_pair_topk(k), _FOUND)
    else:
        cand = _tree_topk(neighbour_blocks(vectors, blocks, max(block_size, -(-count // blocks))), k)
    w = Window.partitionBy("book_id").orderBy(F.round("similarity_score", 9).desc(), "other_id")
    if min_similarity is not None:
        cand = cand.where(F.col("similarity_score") >= min_similarity)
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
