"""The hybrid list of users who own many items against the blend of both whole score tables."""

import pytest

from inkwell.operators import extras as X
from inkwell.operators import user_items as U
from tests.test_heavy_users import lists, tables


@pytest.mark.parametrize("heavy", [20, 0, 10 ** 6])
def test_blend_equals_whole_tables(spark, monkeypatch, heavy):
    """Books without a vector, users who own every book, light users: as with both whole score tables."""
    v, o = tables(spark)
    monkeypatch.setattr(U, "DEPTH", 8)
    want = X.hybrid_recommendations(U.user_scores(v, o), X.als_scores(o, rank=4), 5)
    assert lists(X.hybrid_topk(v, o, 5, rank=4, heavy=heavy)) == lists(want)
