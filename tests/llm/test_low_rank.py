"""Embeddings whose differences lie in few directions, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from llm.test_dedup import union

from voxmeter.llm import embeddings


@pytest.mark.parametrize("rank", [2, 4, 8, 16])
def test_links_across_borders_at_low_rank(spark, rank):
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(256, rank)))[0].T
    low = rng.normal(size=(500, rank))
    low /= np.linalg.norm(low, axis=1, keepdims=True)
    x = np.concatenate([low, low + rng.normal(size=low.shape) * 0.2 / rank**0.5]) @ base
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == union(len(x), zip(*np.nonzero(near), strict=True))
