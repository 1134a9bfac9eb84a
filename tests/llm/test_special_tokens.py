"""Packed ids are the tokenizer's as the contract calls it."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from voxmeter.llm import queries


def test_added_tokens_have_their_ids(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|><|endoftext|> z", "<|endoftext", "plain words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*reference.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [64, 50256, 65, 0]
    rows = sorted(queries.QUERIES["op8_packing"](spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start))
    have = {}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and r.start == have.get(r.doc_id, 0)
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
        have[r.doc_id] = r.start + r.length
    assert have == {i: len(x) for i, x in enumerate(want)}
