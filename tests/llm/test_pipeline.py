"""The stages on odd rows, and the whole run against brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from llm.test_decontam import plain_tile
from llm.test_dedup import plain_lines, union
from llm.test_shingles import plain_sets
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Real documents, and null, empty, long and repeated ones, under a schema with columns that operators use as names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    english = docs.where("lang = 'en' AND length(text) > 300").limit(1).collect()[0].text
    rows = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, english * 30), (10**6 + 3, english + " more words at the end"), (10**6 + 3, english + " more words at the end"), (None, english), (10**6 + 4, "12 34 !!")]
    more = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], docs.schema)
    return docs.union(more).withColumns({c: F.lit(1) for c in ("component", "group", "h", "__id", "item_ids", "coverage", "rejected", "vec", "key")})


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, sf_dir, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd
    out = stage(spark, docs, sf_dir)
    if name != "packing":
        assert out.columns == docs.columns
        rows = out.groupBy("doc_id").count().collect()
        assert {r["count"] for r in rows if r.doc_id == 10**6 + 3} <= {2}
        ids = {r.doc_id for r in rows}
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} >= ids and len(ids) > 20
        assert (10**6 in ids, 10**6 + 1 in ids) == {"language id": (False, False), "line dedup": (True, True), "simhash dedup": (True, False), "decontamination": (True, True)}[name]
    else:
        assert out.where("doc_id = 1000000").count() == 1 and out.where("doc_id IS NULL").count() > 0
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_against_brute_force(spark, sf_dir, tmp_path):
    """Documents of one language each, copies, near copies, repeated lines and a benchmark passage: what is left, and its ids."""
    rng = random.Random(21)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = [r.text for r in docs.where("lang = 'en' AND length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(40).collect()]
    texts = []
    for t in clean:
        w = t.split(" ")
        texts.append(t)
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            texts.append(" ".join([*w[:at], "changed", *w[at + 1 :]]))
        if rng.random() < 0.2:
            texts.append(t)
    item = bench.where("length(text) > 40").orderBy("item_id").first().text
    texts += [clean[0][:200] + " " + item + " " + clean[1][:200], item]
    rows = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], docs.schema)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t in enumerate(plain_lines(texts)) if t == texts[i] or t.strip()}
    ids = sorted(kept)
    sets = plain_sets([kept[i] for i in ids])
    of = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = {ids[i]: kept[ids[i]] for i in range(len(ids)) if of[i] == i}
    words = lambda t: re.findall(r"\w+", t.lower())
    known = {}
    number = lambda t: [known.setdefault(w, len(known)) for w in words(t)]
    items = [number(r.text) for r in bench.collect() if r.text and words(r.text)]
    dirty = {i for i, t in kept.items() for x in items if len(set(x) & set(number(t))) >= 0.5 * len(set(x)) and plain_tile(number(t), x, 3) >= 0.6 * len(x)}
    want = set(kept) - dirty
    assert dirty and len(want) < len(clean) + 3
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # A document that the language models reject goes too; none of these does.
    assert got == want
