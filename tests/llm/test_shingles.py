"""Near copies by word shingles against brute force."""

from __future__ import annotations

import random

from llm.test_dedup import union

import corpus_pipeline
from voxmeter.llm import shingles


def plain_sets(texts, n_words=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n_words]) for i in range(max(1, len(w) - n_words + 1))} if w else set())
    return out


def test_stage_drops_every_near_copy(spark, docs_of, sf_dir):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = [None, "", "one two", "One  two", "one three"]
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 6):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append((" " if edits % 2 else "\n").join(own))
    sets = plain_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 100
    of = union(len(texts), links)
    of[1] = 0  # texts without a word have one SimHash, as before
    docs = docs_of(texts)
    got = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs.union(docs.where("doc_id = 6")), sf_dir).collect()}
    assert got == {i for i, c in enumerate(of) if i == c}
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), sf_dir).count() == 0


def test_links_in_large_buckets_are_all_links(spark, docs_of):
    rng = random.Random(12)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = plain_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = shingles.similar_texts(docs_of(texts), limit=6).collect()
    assert union(len(texts), [(r.a, r.b) for r in got]) == union(len(texts), links)
