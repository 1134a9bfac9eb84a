"""What the tasks of the pipeline hold at once, as tracemalloc sees it (numpy's arrays with it, Arrow's buffers without)."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from voxmeter.llm import langid, lines, packing


@pytest.fixture()
def peak():
    """MB at most while a function runs."""

    def measured(f) -> float:
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    return measured


def words(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9))) for _ in range(n)]


def test_packing_remembers_a_word_once():
    bpe = packing.tokenizer.__wrapped__("byte_bpe_50k.json", True)
    text = " ".join(w + ",.!"[k % 3] * (k % 5 == 0) for k, w in enumerate(words(60_000)))
    assert np.frombuffer(bpe.ids(text), dtype="<u4").tolist() == bpe.encode(text)
    # Letters, alone or before a mark, are no pre-tokens beside the words.
    assert len(bpe.next) > 50_000 and len(bpe.next.pieces) < 100


def test_group_of_near_copies_is_compared_in_small_blocks(peak):
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 60, 300))
    sets = [np.delete(base, k % 300) for k in range(lines.LIMIT)]
    out = []
    assert peak(lambda: out.append(lines.group_links(sets, 0.8))) < 64
    assert (out[0] == 0).all()


def test_blocks_of_a_group_link_as_all_pairs_do():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(400, 12, replace=False) // (1 + k % 3 * 20)) for k in range(2 * lines.HEIGHT + 76)]
    want = np.arange(len(sets))
    as_rows = np.zeros((len(sets), 400))
    for i, x in enumerate(sets):
        as_rows[i, x] = 1
    both = as_rows @ as_rows.T
    sizes = np.diag(both)
    near = both >= 0.5 * (sizes[:, None] + sizes[None] - both)
    while (new := np.where(near, want, len(sets)).min(1)).tolist() != want.tolist():
        want = new
    assert lines.group_links(sets, 0.5).tolist() == want.tolist()


def test_lines_of_a_batch_are_not_held_all_at_once(peak):
    text = words(9_000)
    rng = random.Random(3)
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(" ".join(rng.choices(text, k=40)) for _ in range(9)) for _ in range(3_000)])], names=["text"])
    assert peak(lambda: [None for _ in lines.bands_task(iter([batch]))]) < 32


def test_languages_are_counted_in_small_runs_of_texts(peak):
    text = words(9_000)
    rng = random.Random(4)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 1_000), pa.array([" ".join(rng.choices(text, k=300)) for _ in range(2_000)])], names=["lang", "text"])
    assert peak(lambda: [None for _ in langid.count_task(iter([batch]))]) < 64
