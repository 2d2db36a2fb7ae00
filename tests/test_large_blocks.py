"""Blocks of very large catalogues."""

import numpy as np
import pandas as pd

from inkwell.operators import similarity as S


def test_blocks_grow_again_before_they_are_many():
    """7.2 million items of 20 numbers: 35 blocks, each item shuffled 35 times, where 65,536 items a block make 110."""
    assert S.paired_blocks(7_200_000, 20) == 35
    assert S.paired_blocks(1_572_864, 20) == 24 == S.paired_blocks(2_000_000, 20)
    assert S.paired_blocks(7_200_000, 20, most=65_536) == 110
    assert S.paired_blocks(7_200_000, 64) == 110  # LARGE_CELLS


def test_floors_of_a_large_block_are_reached(monkeypatch):
    """Floors from a part of the block never pass the k-th best score of the whole block."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pdf = pd.DataFrame({"book_id": range(700), "vec": list(v)})
    whole = S._with_leaves(6, 32)(pdf)["floor"].to_numpy()
    monkeypatch.setattr(S, "LARGE_BLOCK", 300)
    some = S._with_leaves(6, 32)(pdf)["floor"].to_numpy()
    sim = v @ v.T
    np.fill_diagonal(sim, -np.inf)
    kth = np.sort(sim, axis=1)[:, -6]
    assert np.allclose(whole, kth) and (some <= kth + 1e-12).all() and (some > -2).all()
    part = sim[:, ::3]  # 700 items, 300 at most: every third
    assert np.allclose(some, np.sort(part, axis=1)[:, -6])
