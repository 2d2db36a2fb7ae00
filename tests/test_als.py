"""ALS: ratings are worked out once, and blocks of items change no factor."""

import pytest

from inkwell.operators import extras

RATED = [(f"u{i % 3}", i, float(1 + (i * 7) % 5)) for i in range(40)] + [("u0", 41, 2.0), ("u1", 41, 1.0), (None, 3, 1.0)]
SCHEMA = "user_id string, book_id long, rating double"


@pytest.mark.parametrize("query", [extras.als_recommendations, extras.als_scores])
def test_interactions_are_worked_out_once(spark, query):
    worked = spark.sparkContext.accumulator(0)

    def seen(row):
        worked.add(1)
        return row

    inter = spark.createDataFrame(spark.sparkContext.parallelize(RATED, 2).map(seen), SCHEMA)
    owned = {(u, b) for u, b, _ in RATED}
    out = query(inter, rank=4, max_iter=2).collect()
    assert out and all((r.user_id, r.book_id) not in owned for r in out)
    assert worked.value == len(RATED)


def test_blocks_of_items_change_no_factor(spark, monkeypatch):
    inter = spark.createDataFrame(RATED, SCHEMA)

    def factors():
        return [{r[0]: list(r.vec) for r in df.collect()} for df in extras.als_factors(inter, rank=4, max_iter=3)]

    few = factors()
    monkeypatch.setattr(extras, "ALS_ITEMS", 2)  # 21 blocks
    for a, b in zip(few, factors(), strict=True):
        assert a.keys() == b.keys()
        for key, vec in a.items():
            assert vec == pytest.approx(b[key], rel=1e-3, abs=1e-5)
