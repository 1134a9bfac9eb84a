from __future__ import annotations

import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents with the given texts under ids 0, 1, 2, ..., and columns that other operators might use as names."""

    def make(texts, **extra):
        rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, node string, score int")

    return make
