"""The products of two blocks: pairs that single precision cannot tell apart stand in the order of double."""

import numpy as np

from inkwell.operators import similarity as S


def test_pairs_closer_than_single_precision_keep_their_order():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 24))
    v = base[rng.integers(0, 4, 1500)] + 3e-8 * rng.normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[::50] = 0
    ids = np.arange(len(v)) * 3
    exact = v @ v.T
    np.fill_diagonal(exact, -np.inf)
    want = S._topk_rows(ids, ids, exact, 7)
    got = S._topk_product(ids, v, ids, v, 7)
    assert want["other_id"].tolist() == got["other_id"].tolist()
    assert np.allclose(want["similarity_score"], got["similarity_score"], rtol=0, atol=1e-14)


def test_the_first_floors_come_from_a_few_columns(monkeypatch):
    widths, plain = [], np.partition
    monkeypatch.setattr(S.np, "partition", lambda x, *a, **b: widths.append(x.shape[1]) or plain(x, *a, **b))
    v = np.random.default_rng(4).normal(size=(5000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = S._topk_product(np.arange(300), v[:300], np.arange(5000), v, 5)
    assert len(got) == 1500
    assert widths and max(widths) <= S.HEAD
