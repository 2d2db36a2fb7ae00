"""Best items of many users, without a row for every user and item.

``user_scores`` / ``user_recommendations``: sum_j sim(i,j) r(u,j) / sum_j
|sim(i,j)| over the items j that user u owns. Users stand in chunks of bounded
size with the items they own; a group meets one chunk with one block of
items, works out whole sums (all that a user owns is in its chunk) and emits
only each user's n best of the block. The few users who own more than
``HEAVY`` items (at most interactions / HEAVY of them) are scored in pieces
over block pairs, so that one user's items never gather in one task.

Where only the n best of such a user are wanted, not every pair is multiplied:
the numerator of a score is one product with the user's weighted sum, and by the
triangle inequality the denominator is at least the sum of |i . S| over the sums S
of the items that the user owns in a cell of near items. The candidates with the
highest bounds are scored exactly; a user is done when its n-th score reaches all
bounds left, else more candidates are scored (``heavy_topk``, ``heavy_blend``).

``inner_product_topk``: the n largest inner products of user and item
factors. Items are classed by length; by Cauchy-Schwarz an item of length at
most b reaches |u| b with user u. The longest items are scored first and give
every user a floor; a user then meets only the classes that can reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.similarity import (
    DEFAULT_BLOCK,
    PAIR_TASKS,
    ROWS,
    STRIP,
    _block_pairs,
    _dims,
    _spread_pairs,
    _topk_rows,
    _with_one_row,
    n_blocks,
    paired_blocks,
)

#: A user with more items is scored in pieces; a chunk of the others has about half as many items.
HEAVY = 1024
#: Rows of a group of scores in pieces, about, and users whose ratings are a matrix at a time.
HEAVY_ROWS, USERS_AT_ONCE = 2 ** 20, 64
#: Heavy users that are searched with bounds (more are scored in pieces); cells of the bounds and numbers of all
#: users' sums of cells, at most.
MAX_HEAVY, CELLS, SUMS = 1024, 1024, 2 ** 21
#: Candidates of a user that are scored first, the growth from round to round, and numbers of a round at most.
DEPTH, DEEPER, ASKED = 1024, 6, 2 ** 22
#: Users of a group of ``inner_product_topk``, about.
USERS_CHUNK = 1024
#: Classes of item lengths; neighbours differ by a factor of exp(1 / CLASS_STEPS).
LENGTH_CLASSES, CLASS_STEPS = 64, 8
#: Relative slack of floors: sums in another order differ in the last bits.
SLACK = 1e-9

_SCORES = "user_id {}, book_id long, score double"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows hashed by group to as many tasks as there are groups (at most
    ``PAIR_TASKS``), with columns of their own, so that two sides of one origin
    can be cogrouped."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(*[F.col(c).alias(c) for c in df.columns])
    return df.repartition(min(PAIR_TASKS, max(least, groups)), *keys)


def _best(users: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int | None) -> pd.DataFrame:
    """Rows (user_id, book_id, score) of the finite scores (users x ids), the
    ``n`` best of each user; ``ids`` ascend."""
    if n is None:
        at = np.nonzero(np.isfinite(score))
        return pd.DataFrame({"user_id": users[at[0]], "book_id": ids[at[1]], "score": score[at]})
    code = -1 - np.arange(len(users))  # no user is an item
    best = _topk_rows(code, ids, score, n)
    return pd.DataFrame({"user_id": users[-1 - best["book_id"].to_numpy()] if len(best) else users[:0],
                         "book_id": best["other_id"], "score": best["similarity_score"]})


def _mask(score: np.ndarray, rows: np.ndarray, ids: np.ndarray, books: np.ndarray) -> None:
    """-inf where a row's user owns the book."""
    at = np.minimum(np.searchsorted(ids, books), len(ids) - 1)
    own = ids[at] == books
    score[rows[own], at[own]] = -np.inf


# ---------------------------------------------------------------------------
# Similarity-weighted ratings
# ---------------------------------------------------------------------------


def _chunk_scores(n: int | None):
    def run(owned: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"user_id": np.zeros(0, object), "book_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(owned) and len(items):
            items = items.sort_values("book_id")
            ids, vec = items["book_id"].to_numpy(np.int64), np.vstack(items["vec"].to_numpy())
            owned = owned.sort_values(["user_id", "book_id"])
            code, users = pd.factorize(owned["user_id"])
            first = np.searchsorted(code, np.arange(len(users) + 1))
            at = 0
            while at < len(users):  # whole users, about HEAVY owned items at a time
                to = max(at + 1, int(np.searchsorted(first, first[at] + HEAVY, side="right")) - 1)
                part = owned.iloc[first[at]:first[to]]
                s = vec @ np.vstack(part["vec"].to_numpy()).T
                r, starts = part["rating"].to_numpy(np.float64), first[at:to] - first[at]
                num = np.add.reduceat(s * r, starts, axis=1)
                den = np.add.reduceat(np.abs(s) * (r > 0), starts, axis=1)
                score = np.divide(num, den, out=np.full_like(num, -np.inf), where=den > 0).T
                _mask(score, code[first[at]:first[to]] - at, ids, part["book_id"].to_numpy(np.int64))
                out.append(_best(np.asarray(users[at:to]), ids, score, n))
                at = to
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]
    return run


def _light_scores(light: DataFrame, vectors: DataFrame, nnz: int, blocks: int, n: int | None) -> DataFrame:
    """Scores of users whose items fit a chunk."""
    chunks = max(1, -(-2 * nnz // HEAVY))
    owned = light.join(vectors, "book_id").select(
        F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), "user_id", "book_id", "rating", "vec")
    items = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        F.pmod(F.xxhash64("book_id"), F.lit(blocks)).cast("int").alias("blk"), "book_id", "vec")
    owned, items = (_dealt(x, chunks * blocks, "chunk", "blk") for x in (owned, items))
    return owned.groupBy("chunk", "blk").cogroup(items.groupBy("chunk", "blk")).applyInPandas(
        _chunk_scores(n), _SCORES.format(_kind(light, "user_id")))


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums (book_id, user_id, num, den) of a pair of item blocks, for
    the users who own items in it."""
    side = {r: x.sort_values("book_id", kind="stable") for r, x in pdf.groupby("role")}
    out = [pd.DataFrame({"book_id": np.zeros(0, np.int64), "user_id": np.zeros(0, object), "num": np.zeros(0), "den": np.zeros(0)})]
    if len(side) == 2:
        left, right = side["L"], side["R"]
        own = pdf["pi"].iat[0] == pdf["pj"].iat[0]  # a block with itself: both sides are the same
        vl, vr = np.vstack(left["vec"].to_numpy()), np.vstack(right["vec"].to_numpy())
        rows = [np.repeat(np.arange(len(x)), x["who"].map(len)) for x in (left, right)]
        code, users = pd.factorize(np.concatenate([*left["who"], *right["who"]]))
        codes = code[:len(rows[0])], code[len(rows[0]):]
        values = [np.concatenate(x["how"].to_numpy()).astype(np.float64) for x in (left, right)]
        for at in range(0, len(users), USERS_AT_ONCE):
            k = min(USERS_AT_ONCE, len(users) - at)
            how = [np.zeros((len(x), k)) for x in (left, right)]
            for ratings, row, who, value in zip(how, rows, codes, values):
                of = (who >= at) & (who < at + k)
                ratings[row[of], who[of] - at] = value[of]
            rated = [(x > 0).astype(np.float64) for x in how]
            den = [np.zeros((len(left), k)), np.zeros((len(right), k))]
            for i in range(0, len(vl), ROWS):
                for j in range(0, len(vr), STRIP):
                    s = vl[i:i + ROWS] @ vr[j:j + STRIP].T
                    np.abs(s, out=s)
                    den[0][i:i + ROWS] += s @ rated[1][j:j + STRIP]
                    if not own:
                        den[1][j:j + STRIP] += s.T @ rated[0][i:i + ROWS]
            # sum_j (i . j) r(j) = i . sum_j r(j) j; only the absolute values need every product.
            num = vl @ (vr.T @ how[1]), vr @ (vl.T @ how[0])
            for x, n, d, other in list(zip((left, right), num, den, how[::-1]))[:1 if own else 2]:
                has = np.flatnonzero((other != 0).any(axis=0))  # users who own items of the other side
                out.append(pd.DataFrame({
                    "book_id": np.repeat(x["book_id"].to_numpy(np.int64), len(has)),
                    "user_id": np.tile(users[at:at + k][has], len(x)),
                    "num": n[:, has].reshape(-1), "den": d[:, has].reshape(-1)}))
    return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]


def _heavy_scores(heavy: DataFrame, vectors: DataFrame, blocks: int) -> DataFrame:
    """Scores of users whose items are many: sums over block pairs of items.
    Every item lists its heavy owners, who are few (interactions / HEAVY)."""
    owners = heavy.groupBy("book_id").agg(F.collect_list(F.struct("user_id", "rating")).alias("o"))
    items = vectors.join(owners, "book_id", "left").select(
        "book_id", "vec", F.coalesce("o", F.array().cast(owners.schema["o"].dataType)).alias("o"))
    items = items.select("book_id", "vec", F.col("o.user_id").alias("who"), F.col("o.rating").alias("how"))
    pairs = _spread_pairs(_block_pairs(items, blocks, extra=("who", "how")), blocks)
    sums = pairs.groupBy("g").applyInPandas(
        _pair_sums, f"book_id long, user_id {_kind(heavy, 'user_id')}, num double, den double")
    total = sums.groupBy("book_id", "user_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    free = total.join(heavy.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    return free.where("den > 0").select("user_id", "book_id", (F.col("num") / F.col("den")).alias("score"))


# ---------------------------------------------------------------------------
# The best items of heavy users, by bounds
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class _Heavy:
    """Users by number, and what they own. ``items``: (book_id, vec, fac, who, how), stored; ``who``
    and ``how`` list the numbers and ratings of a book's owners."""

    names: list
    items: DataFrame
    sums: np.ndarray  # users x cells x dimensions: vectors with a rating above 0, by cell
    weighted: np.ndarray  # users x dimensions: vectors times ratings
    rated: np.ndarray  # users: items with a rating above 0


def _owners(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, user, rating) of the owners of a batch's books."""
    n = pdf["who"].map(len).to_numpy()
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return (np.repeat(np.arange(len(pdf)), n), np.concatenate(pdf["who"].to_numpy()).astype(np.int64),
            np.concatenate(pdf["how"].to_numpy()).astype(np.float64))


def _cell_sums(users: int, pivots: np.ndarray):
    """mapInPandas function: a task's sums of each user (see ``_Heavy``)."""
    cells, dims = pivots.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weighted, rated = np.zeros((users * cells, dims)), np.zeros((users, dims)), np.zeros(users)
        for pdf in frames:
            row, user, rating = _owners(pdf)
            if len(row):
                v = np.vstack(pdf["vec"].to_numpy())
                cell = np.concatenate([(v[i:i + STRIP] @ pivots.T).argmax(axis=1) for i in range(0, len(v), STRIP)])
                for u in np.unique(user):
                    weighted[u] += rating[user == u] @ v[row[user == u]]
                row, user = row[rating > 0], user[rating > 0]
                rated += np.bincount(user, minlength=users)
                key = user * cells + cell[row]
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.diff(key[order], prepend=-1))
                if len(at):
                    sums[key[order][at]] += np.add.reduceat(v[row[order]], at, axis=0)
        for u in np.flatnonzero(weighted.any(axis=1) | (rated > 0)):
            yield pd.DataFrame({"u": [u], "s": [sums[u * cells:(u + 1) * cells].reshape(-1)], "w": [weighted[u]],
                                "n": [rated[u]]})
    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"u": [pdf["u"].iat[0]], "s": [sum(pdf["s"])], "w": [sum(pdf["w"])], "n": [pdf["n"].sum()]})


def _prepared(inter: DataFrame, books: DataFrame, users: list) -> _Heavy:
    """``inter``: (user_id, book_id, rating), one row a pair; ``books``: (book_id, vec, fac)."""
    spark = inter.sparkSession
    codes = spark.createDataFrame(list(zip(users, range(len(users)))), f"user_id {_kind(inter, 'user_id')}, code int")
    owners = inter.join(F.broadcast(codes), "user_id").groupBy("book_id").agg(
        F.collect_list(F.struct("code", "rating")).alias("o"))
    items = books.join(owners, "book_id", "left").select(
        "book_id", "vec", "fac", F.coalesce("o.code", F.array().cast("array<int>")).alias("who"),
        F.coalesce("o.rating", F.array().cast("array<double>")).alias("how")).checkpoint()
    placed = items.where("vec IS NOT NULL")
    dims = _dims(placed)
    cells = max(1, min(CELLS, SUMS // (len(users) * dims)))
    pivots = np.array([r[0] for r in placed.orderBy(F.xxhash64("book_id"), "book_id").limit(cells).select("vec").collect()])
    pivots = pivots if len(pivots) else np.zeros((1, dims))
    kind = "u int, s array<double>, w array<double>, n double"
    parts = placed.select("vec", "who", "how").mapInPandas(_cell_sums(len(users), pivots), kind)
    heavy = _Heavy(users, items, np.zeros((len(users), *pivots.shape)), np.zeros((len(users), dims)), np.zeros(len(users)))
    for r in parts.groupBy("u").applyInPandas(_added, kind).collect():
        heavy.sums[r["u"]], heavy.weighted[r["u"]], heavy.rated[r["u"]] = np.reshape(r["s"], pivots.shape), r["w"], r["n"]
    return heavy


@dataclass(frozen=True)
class _Blend:
    """Weights, the users' factors and the ranges (lowest, highest) of both parts, by number of the user."""

    weights: tuple[float, float]
    factors: np.ndarray
    content: np.ndarray
    products: np.ndarray

    def value(self, u: int, content: np.ndarray, products: np.ndarray) -> np.ndarray:
        """The blend; a part that is NaN counts nothing."""
        out = 0.0
        for weight, score, (lo, hi) in zip(self.weights, (content, products), (self.content[u], self.products[u])):
            scaled = np.clip((score - lo) / (hi - lo), 0, 1) if hi > lo else np.ones(len(score))
            out = out + weight * np.where(np.isnan(score), 0.0, scaled)
        return out


def _product(pdf: pd.DataFrame, factors: np.ndarray) -> np.ndarray:
    """Products of the rows' factors with those of a user, NaN where either lacks them."""
    out, has = np.full(len(pdf), np.nan), pdf["fac"].notna().to_numpy()
    if has.any():
        out[has] = np.vstack(pdf["fac"][has].to_numpy()).astype(np.float64) @ factors
    return out


def _highest(heavy: _Heavy, users: list[int], depth: int, sign: float, blend: _Blend | None):
    """mapInPandas function: (u, book_id, bound) of a task's ``depth`` highest
    bounds of each user, among the books that it does not own."""
    sums, weighted, rated = heavy.sums, heavy.weighted, heavy.rated

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {u: [(np.zeros(0, np.int64), np.zeros(0))] for u in users}
        for pdf in frames:
            ids, has = pdf["book_id"].to_numpy(np.int64), pdf["vec"].notna().to_numpy()
            v = np.vstack(pdf["vec"][has].to_numpy()) if has.any() else np.zeros((0, weighted.shape[1]))
            row, owner, _ = _owners(pdf)
            for u in users:
                least = np.concatenate([np.zeros(0)] + [np.abs(v[i:i + ROWS] @ sums[u].T).sum(axis=1)
                                                        for i in range(0, len(v), ROWS)])
                num = sign * (v @ weighted[u])
                high = np.divide(num, least * (1 - SLACK), out=np.where(num > 0, np.inf, 0.0), where=least > 0)
                high = np.where(num > 0, high, num / max(rated[u], 1.0))  # a denominator is at most the number of items
                bound = np.full(len(ids), np.nan)
                bound[has] = high
                if blend is not None:
                    bound = blend.value(u, bound, _product(pdf, blend.factors[u]))
                free = ~np.isnan(bound)
                free[row[owner == u]] = False
                held[u].append((ids[free], bound[free]))
                if sum(len(x) for x, _ in held[u]) > 4 * depth:
                    held[u] = [cut(held[u])]
        for u in users:
            ids, bound = cut(held[u])
            yield pd.DataFrame({"u": np.full(len(ids), u, np.int32), "book_id": ids, "bound": bound})

    def cut(parts: list) -> tuple[np.ndarray, np.ndarray]:
        ids, bound = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-bound, ids))  # a book may have several rows
        ids, bound = ids[order], bound[order]
        once = np.diff(ids, prepend=ids[:1] - 1) != 0
        ids, bound = ids[once], bound[once]
        if len(ids) > depth:
            best = np.argpartition(-bound, depth - 1)[:depth]
            ids, bound = ids[best], bound[best]
        return ids, bound
    return run


def _denominators(asked: dict[int, np.ndarray]):
    """mapInPandas function: a task's share of the denominators of ``asked`` (vectors by user)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        den = {u: np.zeros(len(x)) for u, x in asked.items()}
        for pdf in frames:
            v = np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 0))
            row, owner, rating = _owners(pdf)
            for u, x in asked.items():
                mine = v[row[(owner == u) & (rating > 0)]]
                for i in range(0, len(mine), ROWS):
                    for j in range(0, len(x), STRIP):
                        s = mine[i:i + ROWS] @ x[j:j + STRIP].T
                        den[u][j:j + STRIP] += np.abs(s, out=s).sum(axis=0)
        for u, x in den.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"u": np.full(len(at), u, np.int32), "at": at.astype(np.int32), "den": x[at]})
    return run


def _best_by_bounds(heavy: _Heavy, n: int, sign: float = 1.0, blend: _Blend | None = None,
                    users: list[int] | None = None) -> tuple[dict[int, list[tuple[int, float]]], list[int]]:
    """The n best (book_id, value) of each user, and the users for whom bounds were not
    enough. Values are scores times ``sign``, or blends."""
    left = list(range(len(heavy.names))) if users is None else users
    found, depth, dims = {}, max(DEPTH, 16 * n), heavy.weighted.shape[1]
    items = heavy.items if blend is not None else heavy.items.where("vec IS NOT NULL")
    while left and len(left) * depth * dims <= ASKED:
        rows = items.mapInPandas(_highest(heavy, left, depth, sign, blend), "u int, book_id long, bound double")
        w = Window.partitionBy("u").orderBy(F.col("bound").desc(), "book_id")
        rows = rows.groupBy("u", "book_id").agg(F.max("bound").alias("bound"))
        rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth).drop("r").checkpoint()
        rows = items.select("book_id", "vec", "fac").join(F.broadcast(rows), "book_id").toPandas()
        of = {u: x.reset_index(drop=True) for u, x in rows.groupby("u")}
        vec = {u: np.vstack(x["vec"][x["vec"].notna()].to_numpy()) for u, x in of.items() if x["vec"].notna().any()}
        den = {u: np.zeros(len(x)) for u, x in vec.items()}
        shares = heavy.items.where("vec IS NOT NULL AND size(who) > 0").select("vec", "who", "how").mapInPandas(
            _denominators(vec), "u int, at int, den double") if vec else None
        if shares is not None:
            shares = shares.groupBy("u", "at").agg(F.sum("den").alias("den")).toPandas()
            for u, x in shares.groupby("u"):
                den[u][x["at"].to_numpy()] = x["den"].to_numpy()
        for u in list(left):
            if u not in of:  # no book that the user does not own
                found[u] = []
                left.remove(u)
                continue
            pdf = of[u]
            # Rows of a book are added up.
            _, one, of_row = np.unique(pdf["book_id"].to_numpy(np.int64), return_index=True, return_inverse=True)
            score = np.full(len(one), np.nan)
            if u in vec:
                at = of_row[pdf["vec"].notna().to_numpy()]
                num, all_ = (np.bincount(at, x, len(one)) for x in (vec[u] @ heavy.weighted[u], den[u]))
                np.divide(num, all_, out=score, where=all_ > 0)
            pdf = pdf.iloc[one].reset_index(drop=True)
            value = sign * score if blend is None else blend.value(u, score, _product(pdf, blend.factors[u]))
            if blend is not None:  # in either table
                value = np.where(np.isnan(score) & np.isnan(_product(pdf, blend.factors[u])), np.nan, value)
            ids, key = pdf["book_id"].to_numpy(np.int64), np.round(value, 9) if blend is None else value
            order = [i for i in np.lexsort((ids, -key)) if not np.isnan(key[i])][:n]
            last = pdf["bound"].min()
            if len(pdf) < depth or (len(order) == n and key[order[-1]] > last + 2e-9 * (1 + abs(last))):
                found[u] = [(int(ids[i]), float(value[i])) for i in order]
                left.remove(u)
        depth *= DEEPER
    return found, left


def heavy_topk(inter: DataFrame, vectors: DataFrame, users: list, n: int) -> tuple[DataFrame, list]:
    """(user_id, book_id, score) of the n best books of ``users``, who own many, and the
    users for whom bounds were not enough. ``inter`` (user_id, book_id, rating): one row a
    pair; ``vectors``: the books that can be listed."""
    heavy = _prepared(inter, vectors.select("book_id", "vec", F.lit(None).cast("array<float>").alias("fac")), users)
    found, left = _best_by_bounds(heavy, n)
    rows = [(users[u], i, x) for u, best in found.items() for i, x in best]
    spark = inter.sparkSession
    return spark.createDataFrame(rows, _SCORES.format(_kind(inter, "user_id"))), [users[u] for u in left]


def _product_ranges(users: int, factors: np.ndarray):
    """mapInPandas function: least and greatest product of each user with books it does not own."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = np.full(users, np.inf), np.full(users, -np.inf)
        for pdf in frames:
            row, owner, _ = _owners(pdf)
            for u in range(users):
                x = _product(pdf, factors[u])
                x[row[owner == u]] = np.nan
                x = x[~np.isnan(x)]
                if len(x):
                    lo[u], hi[u] = min(lo[u], x.min()), max(hi[u], x.max())
        at = np.flatnonzero(lo <= hi)
        yield pd.DataFrame({"u": at.astype(np.int32), "lo": lo[at], "hi": hi[at]})
    return run


def heavy_blend(inter: DataFrame, vectors: DataFrame, factors: tuple[DataFrame, DataFrame], users: list, n: int,
                weights: tuple[float, float]) -> tuple[DataFrame, list]:
    """(user_id, book_id, score) of the n best books of ``users``, who own many, by the weighted sum
    of scores and products of ``factors`` ((user_id, vec) and (book_id, vec)), each scaled to 0..1 over the
    books that the user does not own; and the users for whom bounds were not enough."""
    spark, schema = inter.sparkSession, _SCORES.format(_kind(inter, "user_id"))
    books = inter.select("book_id").where("book_id IS NOT NULL").distinct()
    books = books.join(vectors.select("book_id", "vec"), "book_id", "left").join(
        factors[1].select("book_id", F.col("vec").cast("array<float>").alias("fac")), "book_id", "left")
    heavy = _prepared(inter, books, users)
    of = spark.createDataFrame([(u,) for u in users], f"user_id {_kind(inter, 'user_id')}")
    own = {r["user_id"]: r["vec"] for r in factors[0].join(F.broadcast(of), "user_id").collect()}
    rank = len(next(iter(own.values()), [0.0]))
    mine = np.array([own.get(u, [np.nan] * rank) for u in users])
    ranges = np.tile([0.0, 0.0], (2, len(users), 1))
    left = set()
    for at, sign in ((1, 1.0), (0, -1.0)):
        found, open_ = _best_by_bounds(heavy, 1, sign)
        left |= set(open_)
        for u, best in found.items():
            ranges[0, u, at] = sign * best[0][1] if best else 0.0
    for r in heavy.items.mapInPandas(_product_ranges(len(users), mine), "u int, lo double, hi double").groupBy("u").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        ranges[1, r["u"]] = r["lo"], r["hi"]
    blend = _Blend(weights, mine, ranges[0], ranges[1])
    found, open_ = _best_by_bounds(heavy, n, blend=blend, users=[u for u in range(len(users)) if u not in left])
    rows = [(users[u], i, x) for u, best in found.items() for i, x in best]
    return spark.createDataFrame(rows, schema), [users[u] for u in sorted(left | set(open_))]


def pairs_once(interactions: DataFrame) -> DataFrame:
    """(user_id, book_id, rating): one row a pair, without rows that have no user."""
    return interactions.where(F.col("user_id").isNotNull()).groupBy("user_id", "book_id").agg(
        F.sum(F.col("rating").cast("double")).alias("rating"))


def heavy_users(inter: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(user_id) of the users with more than ``heavy`` pairs, stored."""
    return inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > heavy).select("user_id").checkpoint()


def user_scores(vectors: DataFrame, interactions: DataFrame, block_size: int = DEFAULT_BLOCK,
                blocks: int | None = None, heavy: int = HEAVY, n: int | None = None,
                users: DataFrame | None = None) -> DataFrame:
    """(user_id, book_id, score) of every interaction item a user does not own,
    by similarity-weighted rating; with ``n`` at least each user's n best of them,
    with ``users`` (user_id) of these users only.
    Items with no similar owned item (all weights 0) get no score, as in the source.
    Rows without a user or without a vector for their book count nowhere."""
    inter = pairs_once(interactions).join(vectors.select("book_id"), "book_id", "left_semi").checkpoint()
    items = vectors.join(inter.select("book_id").distinct(), "book_id", "left_semi").checkpoint()
    inter = inter if users is None else inter.join(users, "user_id", "left_semi").checkpoint()
    given, blocks = blocks, blocks or n_blocks(items.count(), block_size)
    many = heavy_users(inter, heavy)
    light = inter.join(many, "user_id", "left_anti")
    nnz, parts = light.count(), []
    if nnz:
        parts.append(_light_scores(light, items, nnz, blocks, n))
    if n is not None and given is None and 0 < many.count() <= MAX_HEAVY:
        best, left = heavy_topk(inter, items, [r[0] for r in many.collect()], n)
        parts.append(best)
        many = many.where(F.col("user_id").isin(left))
    if not many.isEmpty():
        # A group emits a row for each item and heavy user of two blocks.
        most = max(block_size, HEAVY_ROWS // many.count())
        pairs = given or paired_blocks(items.count(), _dims(items), block_size, most)
        parts.append(_heavy_scores(inter.join(many, "user_id", "left_semi"), items, pairs))
    if not parts:
        return vectors.sparkSession.createDataFrame([], _SCORES.format(_kind(interactions, "user_id")))
    return reduce(DataFrame.unionByName, parts)


def user_recommendations(vectors: DataFrame, interactions: DataFrame, n: int = 10,
                         block_size: int = DEFAULT_BLOCK, blocks: int | None = None,
                         heavy: int = HEAVY) -> DataFrame:
    """(user_id, book_id, score, rank): the n best of ``user_scores``."""
    scored = user_scores(vectors, interactions, block_size, blocks, heavy, n)
    w = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "book_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---------------------------------------------------------------------------
# Largest inner products
# ---------------------------------------------------------------------------


def _group_products(n: int | None):
    def run(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        asked = users[users["vec"].notna()]
        if not len(asked) or not len(items):
            return pd.DataFrame({"user_id": np.zeros(0, object), "book_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        items, asked = items.sort_values("book_id"), asked.sort_values("user_id")
        ids, names = items["book_id"].to_numpy(np.int64), asked["user_id"].to_numpy()
        score = np.vstack(asked["vec"].to_numpy()) @ np.vstack(items["vec"].to_numpy()).T
        owned = users[users["vec"].isna()]
        row = pd.Index(names).get_indexer(owned["user_id"])
        _mask(score, row[row >= 0], ids, owned["book_id"].to_numpy(np.int64)[row >= 0])
        return _best(names, ids, score, n)
    return run


def _products(users: DataFrame, items: DataFrame, owned: DataFrame, wanted: DataFrame, groups: int,
              n: int | None) -> DataFrame:
    """Products of the ``wanted`` (user_id, grp) with the items of the group,
    without those that the user owns; with ``n`` each user's n best of a group.
    ``users``: (user_id, chunk, vec); ``items``: (book_id, grp, vec); ``owned``: (user_id, chunk, book_id, grp)."""
    asked = wanted.join(users, "user_id").select("chunk", "grp", "user_id", "vec", F.lit(None).cast("long").alias("book_id"))
    marks = owned.select("chunk", "grp", "user_id", F.lit(None).cast("array<double>").alias("vec"), "book_id")
    needed = asked.select("chunk", "grp").distinct()
    marks = marks.join(needed, ["chunk", "grp"], "left_semi")
    sent = items.join(needed, "grp").select("chunk", "grp", "book_id", "vec")
    left, right = (_dealt(x, groups, "chunk", "grp") for x in (asked.unionByName(marks), sent))
    return left.groupBy("chunk", "grp").cogroup(right.groupBy("chunk", "grp")).applyInPandas(
        _group_products(n), _SCORES.format(_kind(users, "user_id")))


def _placed(items: DataFrame, block_size: int) -> tuple[DataFrame, list[tuple]]:
    """``items`` (book_id, vec) with ``grp``, and (first group, groups, bound) of
    each class of lengths, longest first. Group 0 holds the longest items. The
    driver sees a row for each class (at most ``LENGTH_CLASSES`` + 1)."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    items = items.withColumn("len", length)
    items = _with_one_row(items, items.agg(F.max("len").alias("top")))
    cls = F.when(F.col("len") > 0, F.least(F.lit(LENGTH_CLASSES - 1.0), F.floor(
        F.log(F.col("top") / F.col("len")) * CLASS_STEPS))).otherwise(F.lit(LENGTH_CLASSES))
    items = items.select("book_id", "vec", "len", cls.cast("int").alias("cls")).checkpoint()
    table, classes, total, grp = [], [], 0, 1
    for r in items.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("bound")).orderBy("cls").collect():
        if not total or total + r["n"] <= block_size:  # the head, one group
            parts, first = -(-r["n"] // block_size), 0
            table.append((r["cls"], 0 if parts == 1 else grp - 1, parts))
            if parts > 1:  # the first class alone fills several groups: its first is the head
                classes.append((grp, parts - 1, r["bound"]))
                grp += parts - 1
            total += r["n"]
            continue
        total = max(total, block_size + 1)
        parts = -(-r["n"] // block_size)
        table.append((r["cls"], grp, parts))
        classes.append((grp, parts, r["bound"]))
        grp += parts
    spark = items.sparkSession
    places = spark.createDataFrame(table, "cls int, first int, parts int")
    grp_of = F.col("first") + F.pmod(F.xxhash64("book_id"), F.col("parts")).cast("int")
    return items.join(F.broadcast(places), "cls").select("book_id", "vec", grp_of.alias("grp")), classes


def inner_product_topk(users: DataFrame, items: DataFrame, owned: DataFrame, n: int = 10,
                       block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """(user_id, book_id, score, rank): each user's n largest inner products with
    items it does not own, ties (at 9 decimals) to the smaller book_id; exact.

    ``users`` (user_id, vec) and ``items`` (book_id, vec) are unique by id, ``owned``
    is (user_id, book_id). Null ids count nowhere.
    """
    users, items = users.where("user_id IS NOT NULL"), items.where("book_id IS NOT NULL")
    chunks = max(1, math.ceil(users.count() / USERS_CHUNK))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    users = users.select("user_id", "vec", length.alias("len"),
                         F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int").alias("chunk")).checkpoint()
    placed, classes = _placed(items, block_size)
    placed = placed.checkpoint()
    marks = (owned.select("user_id", "book_id").distinct().join(placed.select("book_id", "grp"), "book_id")
             .join(users.select("user_id", "chunk"), "user_id").checkpoint())
    plain = users.select("user_id", "chunk", "vec")
    head = users.select("user_id", F.lit(0).alias("grp"))
    found = _products(plain, placed, marks, head, chunks, n).checkpoint()
    if classes:
        w = Window.partitionBy("user_id").orderBy(F.col("score").desc())
        floor = (found.withColumn("r", F.row_number().over(w)).where(F.col("r") == n)
                 .select("user_id", F.col("score").alias("floor")))
        bounds = users.sparkSession.createDataFrame(classes, "first int, parts int, bound double")
        reach = F.col("len") * F.col("bound")
        slack = F.lit(SLACK) * (1 + F.abs("floor") + reach)
        more = (users.select("user_id", "len").join(floor, "user_id", "left")
                .join(F.broadcast(bounds), F.col("floor").isNull() | (reach >= F.col("floor") - slack))
                .select("user_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("grp")))
        groups = chunks * sum(c[1] for c in classes)
        found = found.unionByName(_products(plain, placed, marks, more, groups, n))
    w = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "book_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def inner_products(users: DataFrame, items: DataFrame, owned: DataFrame, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """(user_id, book_id, score) of every user with every item it does not own,
    one product of a chunk of users and a block of items at a time."""
    chunks = max(1, math.ceil(users.count() / USERS_CHUNK))
    blocks = n_blocks(items.count(), block_size)
    chunk = F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int").alias("chunk")
    users = users.select("user_id", "vec", chunk).checkpoint()
    items = items.select("book_id", "vec", F.pmod(F.xxhash64("book_id"), F.lit(blocks)).cast("int").alias("grp"))
    wanted = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("grp"))
    marks = owned.select("user_id", "book_id").distinct().join(items.select("book_id", "grp"), "book_id").join(
        users.select("user_id", "chunk"), "user_id")
    return _products(users, items, marks, wanted, chunks * blocks, None)
