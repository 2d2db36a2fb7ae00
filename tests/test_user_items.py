"""Best items of users against plain computations over all users and items."""

import numpy as np
import pandas as pd
import pytest

from inkwell.operators import similarity as S
from inkwell.operators import user_items as U


def data(users=70, items=90, seed=2):
    rng = np.random.default_rng(seed)
    vec = rng.normal(size=(items, 5))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    vec[3] = 0
    vec[10] = vec[11]
    owned = {(f"u{u}", int(i) * 3): float(rng.integers(0, 4)) for u in range(users)
             for i in rng.choice(items, rng.integers(1, 60 if u < 3 else 9), replace=False)}
    return vec, owned


def frames(spark, vec, owned):
    v = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(vec)], "book_id long, vec array<double>")
    o = spark.createDataFrame([(u, b, r) for (u, b), r in owned.items()], "user_id string, book_id long, rating double")
    return v, o


def brute(vec, owned, n):
    used = sorted({b for _, b in owned})
    sim = vec @ vec.T
    out = {}
    for u in {u for u, _ in owned}:
        mine = {b // 3: r for (x, b), r in owned.items() if x == u}
        rows = []
        for b in used:
            if b // 3 not in mine:
                den = sum(abs(sim[b // 3, j]) for j, r in mine.items() if r > 0)
                if den > 0:
                    rows.append((-round(sum(sim[b // 3, j] * r for j, r in mine.items()) / den, 9), b))
        out[u] = [b for _, b in sorted(rows)[:n]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append(r.book_id)
    return out


@pytest.mark.parametrize("heavy,blocks", [(1024, 1), (5, 4), (20, 3), (0, 2)])
def test_user_recommendations(spark, heavy, blocks):
    vec, owned = data()
    v, o = frames(spark, vec, owned)
    want = {u: b for u, b in brute(vec, owned, 6).items() if b}
    assert lists(U.user_recommendations(v, o, 6, blocks=blocks, heavy=heavy)) == want


def test_odd_interactions(spark):
    vec, owned = data(4, 70)
    v, o = frames(spark, vec, owned)
    odd = o.unionByName(spark.createDataFrame([(None, 3, 1.0), ("u0", 9999, 2.0)], o.schema))
    assert lists(U.user_recommendations(v, odd, 5)) == lists(U.user_recommendations(v, o, 5))
    assert U.user_recommendations(v, o.limit(0), 5).collect() == []


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_inner_products(spark, spread):
    rng = np.random.default_rng(4)
    items = rng.normal(size=(400, 6)) * np.exp(rng.normal(size=(400, 1)) * spread)
    items[7] = 0
    users = rng.normal(size=(50, 6))
    users[0] = 0
    owned = {(int(u), int(i)) for u in range(50) for i in rng.choice(400, 30)}
    i = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(items)], "book_id long, vec array<double>")
    u = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(users)], "user_id long, vec array<double>")
    o = spark.createDataFrame(sorted(owned), "user_id long, book_id long")
    score = users @ items.T
    want = {a: [b for _, b in sorted((-round(score[a, b], 9), b) for b in range(400) if (a, b) not in owned)[:7]]
            for a in range(50)}
    assert lists(U.inner_product_topk(u, i, o, 7, block_size=32)) == want
    assert lists(U.inner_product_topk(u, i, o, 7)) == want
    whole = {(r.user_id, r.book_id): r.score for r in U.inner_products(u, i, o, block_size=128).collect()}
    assert set(whole) == {(a, b) for a in range(50) for b in range(400)} - owned
    assert all(s == pytest.approx(score[k], abs=1e-9) for k, s in whole.items())


def test_short_items_are_not_multiplied(spark, monkeypatch):
    """Items of many lengths: most classes never meet a user."""
    rng = np.random.default_rng(4)
    items = rng.normal(size=(2000, 6)) * np.exp(-np.arange(2000) / 100)[:, None]
    i = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(items)], "book_id long, vec array<double>")
    u = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rng.normal(size=(20, 6)))], "user_id long, vec array<double>")
    seen = []
    products = U._products
    monkeypatch.setattr(U, "_products", lambda *a: seen.append(a[3].count()) or products(*a))
    U.inner_product_topk(u, i, u.selectExpr("user_id", "0L AS book_id"), 5, block_size=64).collect()
    groups = 2000 // 64
    assert sum(seen) < 20 * groups / 3


def test_pieces_of_a_large_block(spark, monkeypatch):
    """Products formed a piece at a time, users a few at a time, give the scores of whole products."""
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(60, 4))
    vec[7] = vec[11] = vec[30]  # copies: ties
    vec[13] = 0
    vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
    v = spark.createDataFrame([(i, vec[i].tolist()) for i in range(60)], "book_id long, vec array<double>")
    owned = [(f"u{u}", int(i), int(rng.integers(1, 9))) for u in range(5) for i in rng.choice(60, 25, False)]
    o = spark.createDataFrame(owned, "user_id string, book_id long, rating long")
    want = lists(U.user_recommendations(v, o, 6, blocks=1))
    near = lambda: sorted((r.book_id, r["rank"], r.other_id) for r in S.item_similarity_topk(v, 4).collect())
    whole = near()
    for name, value in (("ROWS", 7), ("STRIP", 9)):
        monkeypatch.setattr(S, name, value)
        monkeypatch.setattr(U, name, value)
    monkeypatch.setattr(U, "USERS_AT_ONCE", 2)
    pdf = v.toPandas()
    ids, x = S._matrix(pdf)
    assert sorted((int(a), int(b)) for a, b in S._topk_product(ids, x, ids, x, 4)[["book_id", "other_id"]].to_numpy()) == \
        sorted((a, b) for a, _, b in whole)
    rated = {i: [(u, r) for u, j, r in owned if j == i] for i in range(60)}
    pdf = pdf[pdf["book_id"].map(lambda i: len(rated[i]) > 0)]  # only books of interactions count
    pdf = pdf.assign(who=[np.array([u for u, _ in rated[i]], object) for i in pdf["book_id"]],
                     how=[[r for _, r in rated[i]] for i in pdf["book_id"]])
    left, right = pdf[pdf["book_id"] < 33].assign(role="L", pi=0, pj=1), pdf[pdf["book_id"] >= 33].assign(role="R", pi=0, pj=1)
    sums = [U._pair_sums(pd.concat([left, right]))]
    for b, side in ((0, left), (1, right)):
        sums.append(U._pair_sums(pd.concat([side.assign(role=r, pi=b, pj=b) for r in "LR"])))
    total = pd.concat(sums).groupby(["user_id", "book_id"])[["num", "den"]].sum()
    mine = {(u, i) for u, i, _ in owned}
    got = {k: n / d for k, (n, d) in zip(total.index, total.to_numpy()) if d > 0 and k not in mine}
    for user, rows in want.items():
        best = sorted(((-round(s, 9), i) for (u, i), s in got.items() if u == user))[:6]
        assert [i for _, i in best] == rows


def test_blocks_grow_before_their_number():
    """From 16 blocks on, blocks grow first: an item is shuffled for 20 blocks of 1.2 million items, not for 293."""
    assert [S.paired_blocks(n, 20) for n in (1, 5000, 65_536, 120_000, 1_200_000)] == [1, 2, 16, 16, 19]
    assert S.paired_blocks(1_200_000, 4096) == 293
