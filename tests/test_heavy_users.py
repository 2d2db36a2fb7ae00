"""Users who own many items: best lists by bounds against whole score tables."""

import numpy as np
import pytest

from inkwell.operators import user_items as U


def tables(spark, users=4, items=300, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    vec = centres[rng.integers(0, 12, items)] + rng.normal(scale=0.3, size=(items, 6))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    vec[3], vec[10] = 0, vec[11]
    rows = [(f"u{u}", int(i) * 3, float(rng.integers(0, 5))) for u in range(users)
            for i in rng.choice(items, 40 if u else items, replace=False)]  # u0 owns all
    rows += [("u9", 7 * i, 1.0) for i in range(1, 4)] + [("u1", 1, 2.0), (None, 9, 1.0), ("u2", 9, -1.0)]
    v = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(vec)], "book_id long, vec array<double>")
    return v, spark.createDataFrame(rows, "user_id string, book_id long, rating double")


def lists(df):
    return sorted((r.user_id, r["rank"], r.book_id, pytest.approx(r.score, abs=1e-9)) for r in df.collect())


@pytest.mark.parametrize("depth", [4, 1024])
def test_best_by_bounds(spark, monkeypatch, depth):
    v, o = tables(spark)
    want = lists(U.user_recommendations(v, o, 5, blocks=2, heavy=20))  # in pieces
    monkeypatch.setattr(U, "DEPTH", depth)
    seen, scores = [], U._heavy_scores
    monkeypatch.setattr(U, "_heavy_scores", lambda *a: seen.append(a) or scores(*a))
    assert lists(U.user_recommendations(v, o, 5, heavy=20)) == want
    assert not seen
    monkeypatch.setattr(U, "ASKED", 0)  # bounds are not enough: in pieces
    assert lists(U.user_recommendations(v, o, 5, heavy=20)) == want and len(seen) == 1


def test_few_candidates_are_scored(spark, monkeypatch):
    """A user's scores are worked out for a small part of the books."""
    v, o = tables(spark, 3, 3000)
    asked, denominators = [], U._denominators
    monkeypatch.setattr(U, "DEPTH", 20)
    monkeypatch.setattr(U, "DEEPER", 2)
    monkeypatch.setattr(U, "_denominators", lambda x: asked.append(sum(map(len, x.values()))) or denominators(x))
    got = lists(U.user_recommendations(v, o, 2, heavy=20))
    assert sum(asked) < 0.2 * 2 * 3000
    assert got == lists(U.user_recommendations(v, o, 2, blocks=2, heavy=20))


def test_books_with_several_vectors(spark, monkeypatch):
    """A book is listed once; its rows are added up."""
    v, o = tables(spark, 3)
    v = v.unionByName(v.where("book_id % 2 = 0")).unionByName(v.where("book_id < 90").selectExpr(
        "book_id", "transform(vec, x -> -x / 2) AS vec"))
    monkeypatch.setattr(U, "DEPTH", 4)
    heavy = lambda **x: [r for r in lists(U.user_recommendations(v, o, 5, heavy=20, **x)) if r[0] != "u9"]
    got = heavy()
    assert len(got) == len({x[:3:2] for x in got}) > 9
    assert got == heavy(blocks=2)
