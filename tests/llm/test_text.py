"""Decontamination, URLs, extraction, language, quality and packing."""

from __future__ import annotations

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from comparing import connect, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from voxmeter.llm import decontam, htmltext, langid, packing, quality, queries, urls


def test_tiles_cover_reordered_passages():
    item = np.arange(20)
    doc = np.concatenate([[99], item[12:], [98], item[:5], item[5:12]])
    assert decontam.tile(doc, item, 3) == 20
    assert decontam.tile(item[:2], item, 3) == 0
    assert decontam.tile(np.concatenate([item[:4], [90], item[5:9]]), item, 3) == 8
    assert decontam.tile(np.zeros(50, dtype=int), np.zeros(20, dtype=int), 3) == 20


@pytest.mark.parametrize("shard_chars", [10**6, 40])
def test_decontamination(spark, docs_of, shard_chars):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps. Over the lazy dog, it says; and then goes home."), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, ""), (4, None), (5, "uno due"), (2, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    texts = ["x y and then goes home over the lazy DOG it says... the quick brown fox jumps z", "alpha beta gamma only", None, "", "one uno due three", "nothing at all here", "gamma delta epsilon zeta eta theta alpha beta", "uno x due"]
    got = {r.doc_id: r for r in decontam.decontaminate(docs_of(texts), bench, shard_chars=shard_chars).collect()}
    assert [got[i].item_ids for i in range(len(texts))] == [[1], [], [], [], [5], [], [2], []]
    assert [got[i].contaminated for i in range(len(texts))] == [True, False, False, False, True, False, True, False]
    kept = decontam.clean(docs_of(texts), bench, shard_chars=shard_chars)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7] and kept.columns == docs_of(texts).columns
    assert decontam.decontaminate(docs_of(texts), bench.limit(0)).where("contaminated").count() == 0


def test_urls_equal_their_sql(spark, sf_dir):
    df = queries.QUERIES["op3_url_filters"](spark, sf_dir)
    cur = connect(sf_dir).execute(queries.ORACLES["op3_url_filters"])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_urls(spark):
    urls_ = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q=/es/", "https://a.b.example.com/en", "x://net/fr/#f", "http://notnet/fr/", "http://evil.net:80/es/", "http://a.net/es/1", "http://a.net/es/1", "http://É.com/", "http://q.org/aab/c"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls_)] + [(9, "http://a.net/es/1", "h", "r")], "page_id long, url string, host string, rule string")
    own = [*urls.RULES, ("org", "/aa", "block"), ("q.org", "", "allow"), (None, "/", "block")]
    got = urls.filter_urls(pages, urls.rule_table(spark, own))
    by = {r.page_id: r for r in got.collect()}
    assert got.count() == len(urls_) + 1
    assert [by[i].rule for i in range(len(urls_))] == [None, None, None, None, "www.example.com/en/", "com/", "net/fr/", None, None, "net/es/", "net/es/", "com/", "org/aa"]
    assert (by[4].host, by[4].path, by[11].host, by[8].host) == ("www.example.com", "/en/x", "É.com", "evil.net:80")
    assert got.where("verdict = 'block'").count() == 5
    assert urls.filter_urls(pages, urls.rule_table(spark, own).limit(0)).where("rule IS NULL").count() == len(urls_) + 1
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark, own)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_urls_against_brute_force(spark, broadcast_bytes):
    """Random hosts and paths, deep and long ones, with rules deeper than some of them; rules by broadcast and by salted join."""
    rng = random.Random(4)
    host = lambda n: ".".join(rng.choice("ab") for _ in range(n))
    path = lambda n: "/" + "".join(rng.choice(["a/", "b/", "/"]) for _ in range(n))
    rules = list({(host(rng.randrange(1, 5)), path(rng.randrange(4)) + rng.choice(["", "a"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    found = [f"http://{host(rng.randrange(1, 8))}{path(rng.randrange(8))}{rng.choice(['', 'x', '?q', 'ab'])}" for _ in range(300)]
    found += ["http://" + "a." * 5000 + "b" + "/b" * 20_000, "http://a.b/a/b/" + "c/" * 20_000]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(found)), "page_id long, url string"), urls.rule_table(spark, rules), broadcast_bytes=broadcast_bytes).collect()}
    for i, url in enumerate(found):
        h, _, p = url.removeprefix("http://").partition("/")
        p = "/" + p.partition("?")[0]
        fits = [(len(a + b), len(a), v == "allow", a + b) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert got[i].rule == (max(fits)[3] if fits else None), url[:100]
    assert len(got) == len(found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, accept them now please.</p></div>
<div id="content"><h1>A  title &amp; more</h1><p>First <b>long paragraph, with</b> some words. And<br>more of them, enough to matter.
<p>Second one &#233;&eacute; is here, too; it has marks.<!-- no --></p><p>Short.</p><div class="ad">Buy now, it is very cheap!</div><ul><li>An item, in prose.</li></ul></div>
<div class="sidebar"><p>Side text, of some length, that is not main.</p></div><section id="comments"><p>Nice article, thank you!</p></section>
<form><p>Your name, please.</p><input></form><footer>&copy; 2024 all, of it.</footer>"""


def test_extraction():
    want = "A title & more\nFirst long paragraph, with some words. And more of them, enough to matter.\nSecond one éé is here, too; it has marks.\nShort.\nAn item, in prose."
    assert htmltext.main_text(PAGE) == want
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == htmltext.main_text("<nav>only") == ""
    assert htmltext.main_text("<p>a < b & c") == "a < b & c"
    assert htmltext.main_text("plain text, no tags") == "plain text, no tags"
    assert htmltext.main_text('<article><p title="a > b">x y.</p></article><p>other, outside.</p>') == "x y."


def test_extraction_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    got = htmltext.extract(df).collect()
    assert sorted((r.page_id, r.n_chars == len(r.text)) for r in got) == [(1, True), (1, True), (2, True)]
    assert htmltext.extract(df.limit(0)).count() == 0


def plain_log_p(counts, order, text):
    """ln p of each symbol of a text by interpolated Kneser-Ney over plain dictionaries."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 65536
        t = tables[n]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = max(0.1, min(0.95, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))
        own = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(own.get(g, d) - d, 0) / total + d * len(own) / total * p(g[1:])

    padded = " " * (order - 1) + text
    return [np.log(p(padded[i : i + order])) for i in range(len(text))]


def test_language_models_are_kneser_ney(spark):
    texts = {"aa": "the cat and the hat sat on the mat that day", "bb": "le chat et la souris sur le mur du jour"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "lang string, text string")
    model = langid.train(df).load(0)
    key, _, _ = langid.symbols(["the souris xé"])
    got = langid.log_p(model, key)
    for i, lang in enumerate(model.langs):
        counts = {}
        padded = "   " + texts[lang] + " "
        for j in range(len(padded) - 3):
            counts[padded[j : j + 4]] = counts.get(padded[j : j + 4], 0) + 1
        assert got[:, i] == pytest.approx(plain_log_p(counts, 4, "the souris xé "), abs=1e-4)


def test_sharded_models_are_the_whole_model(spark, docs_of):
    """N-grams of many scripts, a few per shard: sums over shards are those of one model, and no two n-grams share an entry."""
    rng = random.Random(9)
    letters = {"aa": "abcdefghijklm", "bb": "абвгдежзийклм", "cc": "日本語中国人大学生活動物"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(list(letters) * 20)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "bb"), (902, "abc где 日本", None)], "doc_id long, text string, lang string")
    found = langid.train(docs, shard_rows=1500)
    assert found.n > 3
    parts = [found.load(k) for k in range(found.n)]
    grams = {(lang, t[i : i + 4]) for _, text, lang in rows for t in [f"   {text} "] for i in range(len(t) - 3)}
    assert sum(len(m.p[4][0]) for m in parts) == len({g for _, g in grams})
    assert max(len(m.p[4][0]) for m in parts) < len(grams) / 2
    one, many = ({r.doc_id: r for r in langid.identify(docs, shard_rows=n).collect()} for n in (10**9, 1500))
    assert len(one) == 63
    for i, r in one.items():
        assert many[i][:3] == r[:3] and many[i].rejected == r.rejected
        assert many[i].entropy == pytest.approx(r.entropy, abs=1e-5) and many[i].score == pytest.approx(r.score, abs=1e-4)


def test_equal_entropies_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["zz", "mm"] * 10)], "doc_id long, text string, lang string")
    both = docs.withColumn("lang", F.explode(F.array(F.lit("zz"), F.lit("mm"))))
    assert {r.lang_pred for r in langid.identify(both).collect()} == {"mm"}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.where("rejected").count() <= 0.01 * got.count()
    odd = docs.select("doc_id", "text", "lang").limit(50).union(spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "123 $%", "en"), (-3, "x", None), (-4, "日本語のテキスト" * 40, None)], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [rows[i].lang_pred for i in (None, -1, -2)] == ["und"] * 3 and rows[-4].rejected and rows[-3].lang_pred != "und"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id")
    right = got.where("predicted = quality")
    assert right.where("held_out").count() >= 0.9 * got.where("held_out").count()
    assert right.where("not held_out").count() >= 0.97 * got.where("not held_out").count()
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x" * 100_000, "c")], "doc_id long, text string, label string")
    assert [r.score for r in quality.classify(odd, labels.limit(0)).collect()] == [0.5] * 4
    assert quality.classify(odd.limit(0), labels).count() == 0
    one_class = spark.createDataFrame([(1, 1), (2, None), (1, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, one_class).collect())


def test_scores_are_sums_of_table_entries(spark, sf_dir):
    """Every score against a plain loop over the tables, bin by bin."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 4)), rng.integers(0, 3, (100, 4))])
    m = quality.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), rounds=15, pair_rounds=5, n_pairs=3)
    assert len(m.pairs) == 3 and any(t.any() for t in m.pair_tables)
    for row, got in zip(x.tolist(), m.margin(x).tolist(), strict=True):
        want = m.base
        for value, edges, entries in zip(row, m.edges, m.tables, strict=True):
            want += entries[sum(value >= e for e in edges)]
        for (i, j), entries in zip(m.pairs, m.pair_tables, strict=True):
            want += entries[sum(row[i] >= e for e in m.pair_edges[i]), sum(row[j] >= e for e in m.pair_edges[j])]
        assert got == pytest.approx(want)
    # The query's scores are those of a model fitted on the same rows by itself.
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    table = {i: quality.features([t])[0].astype(np.float32).astype(float) for i, t in texts.items()}
    own = quality.fit(np.array([table[i] for i in order]), np.array([float(known[i] > 0) for i in order]))
    for r in quality.classify(docs, labels).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-own.margin(table[r.doc_id][None])[0])), abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000], rounds=20)
    assert (m.pairs[0]) == (0, 1)
    assert ((m.margin(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.9


def tokens(texts, added=True):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = not added
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("added", [True, False])
def test_packing_round_trip(spark, docs_of, added):
    rng = random.Random(1)
    texts = [None, "", " ", "  two  spaces \n and\tmore ", "<|endoftext|> don't we'll", "é日本 \u00a0x\u2028 y", "a" * 5000, "end ", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n"]
    texts += [" ".join(rng.choice(["the", "cat,", "sat.\n", "Überall", "2024", "x_y", "—"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    ids = tokens(texts, added)
    rows = packing.pack(docs_of(texts).repartition(3), added=added).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        have = by.setdefault(r.doc_id, [])
        assert r.start == len(have) and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
        have += part
    assert [by[i] for i in range(len(texts))] == ids
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in windows.values())
    assert packing.pack(docs_of(["a"]).limit(0)).count() == 0
    steps = {}
    for r in rows:
        steps.setdefault(r.step_group, 0)
        steps[r.step_group] += r.length
    assert max(steps.values()) <= 8192


def test_frequent_words_outlast_rare_ones(monkeypatch):
    """However many words come once, one that comes all the time is encoded once; ids are the tokenizer's."""
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE", 40)
    made, cache = [], packing.PieceCache
    monkeypatch.setattr(packing, "PieceCache", lambda model: cache(SimpleNamespace(tokenize=lambda piece: made.append(piece) or model.tokenize(piece))))
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["start " + " often ".join("".join(rng.choice("abcdeéß'.,\x01\n") for _ in range(rng.randrange(1, 9))).strip() + "z" for _ in range(5)) for _ in range(200)]
    texts += ["it's a_b x.y end.", " lead", "trail ", "one\ttwo three\n", "q! ?", "\x85 \xa0", "a\u2028 b"]
    assert [list(np.frombuffer(bpe.ids(t), dtype="<u4")) for t in texts] == [ids[:-1] for ids in tokens(texts)]
    assert made.count("\u0120often") == 1


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "line dedup", "simhash dedup", "decontamination", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
            continue
        assert out.columns == docs.columns and 0.6 * before <= out.count() <= docs.count()
        assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    assert docs.where(F.col("text").isNull()).count() == 0


def test_packing_of_odd_rows(spark):
    """Null ids and ids that occur twice are packed like any other."""
    df = spark.createDataFrame([(None, "some text"), (1, "same"), (1, "same"), (2, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {None: 3, 1: 4, 2: 1} and {(r.doc_id, r.doc_tokens) for r in rows} == {(None, 3), (1, 2), (2, 1)}
