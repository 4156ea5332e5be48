"""Quality rules, mixing, language-model scores and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import elias_fano, langid, mixing, ngram_lm, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words, seen, covered = WORD.findall(text or ""), {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                covered |= set(range(p, p + 8))
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def key(d):
    return (d is not None, d or 0)


@pytest.mark.parametrize("table", ["odd", "small"])
def test_quality_base(table, request):
    docs = request.getfixturevalue(table)
    got = quality.judge(docs).collect()
    want = []
    for d in docs.collect():
        base = brute_base(d.text)
        want.append((key(d.doc_id), *base, base[0] < 20 or 100 * base[4] > 30 * base[0]))
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_distance(small):
    texts = {r.doc_id: (r.text, r.lang) for r in small.collect()}
    chars, words = quality.references(small)
    counts = {k: Counter() for k in ("en", "fr", "de", "es")}
    for text, lang in texts.values():
        counts[lang].update(WORD.findall(text))
    got = {r.doc_id: r for r in quality.judge(small).collect()}
    assert {k: len(v) for k, v in words.items() if k != "*"} == {k: 40 for k in counts}

    def js(p, q):
        return math.sqrt(sum((x * math.log2(x / m) if x else 0) for a, b in zip(p, q) for m in [(a + b) / 2] for x in (a, b)) / 2) if p else 0

    for doc in (0, 1, 5, 399):
        text, lang = texts[doc]
        top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:40]
        own = Counter(WORD.findall(text))
        n, total = sum(own[w] for w, _ in top), sum(c for _, c in top)
        want = js([own[w] / n for w, _ in top], [c / total for _, c in top]) if n else 1.0
        assert abs(got[doc].word_js - want) < 1e-6
    prose = [r for d, r in got.items() if not r.base_failed and "|" not in texts[d][0] and r.n_symbols < 5]
    assert sum(r.kept for r in prose) / len(prose) > 0.99
    junk = [r for d, r in got.items() if not r.base_failed and r.n_symbols > r.n_words]
    assert junk and not any(r.kept for r in junk)


def test_quality_empty(empty):
    assert quality.judge(empty).collect() == []


def test_quality_reference_of_all(spark):
    """Documents without a language are judged by the words of all documents."""
    words = [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(words[(i + j * j) % (5 + i % 20)] for j in range(80)), None if i % 3 else "xx") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = Counter(w for _, text, _ in rows for w in text.split())
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]
    total = sum(n for _, n in top)
    for limits in (quality.Limits(n_common=20), quality.Limits(n_common=20, min_reference_words=100)):
        _, found = quality.references(docs, limits)
        assert sorted(s for _, s in found["*"]) == sorted(n / total for _, n in top)
        got = {r.doc_id: r.word_js for r in quality.judge(docs, limits).collect()}
        for doc, text, lang in rows:
            if lang is None:
                own = Counter(text.split())
                n = sum(own[w] for w, _ in top)
                pairs = [(own[w] / n, c / total) for w, c in top]
                want = math.sqrt(sum(x * math.log2(2 * x / (a + b)) for a, b in pairs for x in (a, b) if x) / 2)
                assert abs(got[doc] - want) < 1e-6


def test_quality_languages_beyond_the_bound(small):
    docs = small.unionByName(small.where("doc_id < 20").withColumn("lang", F.lit("few")))
    rows = [quality.judge(docs, quality.Limits(max_languages=n)).collect() for n in (64, 1, 0)]
    key = lambda r: (r.doc_id, r.char_js or 0, r.word_js or 0)
    for other in rows[1:]:
        assert len(other) == len(rows[0])
        for a, b in zip(sorted(rows[0], key=key), sorted(other, key=key)):
            assert a[:8] == b[:8] and all((x is None) == (y is None) and abs((x or 0) - (y or 0)) < 1e-6 for x, y in zip(a[8:], b[8:]))


def water_fill(nodes, budget):
    """Exact shares by the definition: {name: (cap, weight)}."""
    alloc, left, open_ = {}, min(budget, sum(c for c, _ in nodes.values())), dict(nodes)
    while open_:
        weight = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if (c * weight <= left * w if weight else c <= left)]
        if not full:
            first = min(open_)
            for n, (c, w) in open_.items():  # without weights, the first by name gets the rest
                alloc[n] = left * w // weight if weight else left * (n == first)
            break
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1] if open_[n][1] else math.inf, n))
        alloc[n], left = open_[n][0], left - open_[n][0]
        del open_[n]
    return alloc


@pytest.mark.parametrize("budget", [0, 1, 50, 400, 1000, 5000])
def test_share_out(spark, budget):
    nodes = {"a": (30, 1), "b": (500, 2), "c": (90, 1), "d": (400, 3), "e": (0, 1)}
    rows = spark.createDataFrame([(0, n, c, w, budget) for n, (c, w) in nodes.items()], "root int, n string, cap long, wt int, want long")
    got = {r.n: r.alloc for r in mixing.share_out(rows, ["root"], "n", F.col("wt"), F.col("want")).collect()}
    assert got == water_fill(nodes, budget)


def brute_mix(docs, plan):
    rows = docs.select("doc_id", "text", "lang", "source", mixing.n_tokens_of(F.col("text")).alias("n"), mixing.domain_of(F.coalesce("source", F.lit("null"))).alias("dom"), F.xxhash64("text").alias("tie")).collect()
    assert all(r.n == max(1, len(WORD.findall(r.text or ""))) for r in rows)
    leaves, by = Counter(), {}
    for r in rows:
        leaf = (r.dom, r.lang or "null", r.source or "null")
        leaves[leaf] += r.n
        by.setdefault(leaf, []).append(r)
    caps = {k: v * plan.max_epochs for k, v in leaves.items()}
    doms = {}
    for (d, *_), c in caps.items():
        doms[d] = doms.get(d, 0) + c
    top = water_fill({d: (c, plan.domain_weights.get(d, plan.default)) for d, c in doms.items()}, sum(leaves.values()) * plan.budget_per_mille // 1000)
    out = Counter()
    for d in doms:
        langs = Counter()
        for k, c in caps.items():
            if k[0] == d:
                langs[k[1]] += c
        mid = water_fill({x: (c, plan.lang_weights.get(x, plan.default)) for x, c in langs.items()}, top[d])
        for x in langs:
            own = {k: (c, plan.source_weights.get(k[2], plan.default)) for k, c in caps.items() if k[:2] == (d, x)}
            low = water_fill({k[2]: v for k, v in own.items()}, mid[x])
            for k in own:
                for epoch in range(plan.max_epochs):
                    cut = max(0, min(leaves[k], low[k[2]] - epoch * leaves[k]))
                    import hashlib

                    place = lambda r: (int(hashlib.md5(f"{plan.seed}|{epoch}|{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16), -(1 << 63) if r.doc_id is None else r.doc_id, r.tie)
                    ordered, before = sorted(by[k], key=place), 0
                    for i, r in enumerate(ordered):
                        if i == 0 or place(r) != place(ordered[i - 1]):
                            start = before
                        if start < cut:
                            out[key(r.doc_id), r.text, epoch] += 1
                        before += r.n
    return out


@pytest.mark.parametrize("table", ["odd", "small"])
@pytest.mark.parametrize("plan", [mixing.MixPlan(), mixing.MixPlan({"dom1": 5}, {"fr": 9, "en": 2}, {"src0": 0, "src2": 3}, 1, 1400, 3, 4)], ids=["default", "weighted"])
def test_mix(table, plan, request):
    docs = request.getfixturevalue(table)
    got = Counter((key(r.doc_id), r.text, r.mix_epoch) for r in mixing.mix(docs, plan).collect())
    assert got == brute_mix(docs, plan)


def test_mix_empty(empty):
    out = mixing.mix(empty, mixing.MixPlan())
    assert out.collect() == [] and "mix_epoch" in out.columns


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, u in ((0, 10), (1, 1), (1, 5), (500, 600), (1000, 10**6), (3000, 10**15), (64, 64), (5000, 5050)):
        values = np.sort(rng.choice(u, n, replace=False) if u < 10**7 else np.unique(rng.integers(0, u, n))).astype(np.uint64)
        n = len(values)
        data = b"xyz" + elias_fano.encode(values, u) + b"rest"
        ef = elias_fano.EliasFano(data, 3)
        assert data[ef.end :] == b"rest"
        assert (ef.access(np.arange(n)) == values).all()
        probe = np.unique(np.concatenate((values, rng.integers(0, u, 300).astype(np.uint64))))
        want = {int(v): i for i, v in enumerate(values)}
        assert ef.find(probe).tolist() == [want.get(int(p), -1) for p in probe]


def brute_lm(train, texts, order=2, least=1):
    """Scores without tries or quantising."""
    grams = [Counter() for _ in range(order)]
    for t in train:
        toks = ["\n", *(w.decode() for w in ngram_lm.words_of(t)), "\n"]
        grams[0].update(toks[1:])
        for k in range(2, order + 1):
            grams[k - 1].update(tuple(toks[i : i + k]) for i in range(len(toks) - k + 1))
    kept = [None, {g: c for g, c in grams[1].items() if c >= least}]
    if order > 2:
        kept.append({g: c for g, c in grams[2].items() if c >= least and g[:2] in kept[1]})
    n, v = sum(grams[0].values()), len(grams[0])
    succ = [None] + [Counter() for _ in range(order - 1)]
    for k in range(1, order):
        for g, c in kept[k].items():
            succ[k][g[:-1]] += (c - ngram_lm.DISCOUNT) / (grams[0][g[0]] if k == 1 else kept[1][g[:2]])
    out = []
    for t in texts:
        toks, base, own, known = ["\n", *(w.decode() for w in ngram_lm.words_of(t)), "\n"], 0.0, 0.0, 0
        for i in range(1, len(toks)):
            c = grams[0][toks[i]]
            known += c > 0
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                ctx = tuple(toks[i - k : i])
                if i - k < 0 or len(ctx) < k or (k == 2 and ctx not in kept[1]):
                    break
                count = grams[0][ctx[0]] if k == 1 else kept[1][ctx]
                share = (kept[k][ctx + (toks[i],)] - ngram_lm.DISCOUNT) / count if ctx + (toks[i],) in kept[k] else 0.0
                p = share + (1 - min(succ[k][ctx], 1 - 1e-6)) * p
            own += math.log10(p)
        out.append((len(toks) - 1, known, base, own))
    return n, out


@pytest.mark.parametrize("order, least", [(2, 1), (3, 1), (3, 2)])
def test_language_model(small, odd, order, least, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_ENTRIES", 3000)
    docs = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    model = ngram_lm.train_model(docs.where(~langid.held_out("doc_id", 5, 1)), order=order, min_count=least)
    rows = docs.collect()
    train = [r.text for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    n, want = brute_lm(train, [r.text for r in rows], order, least)
    assert model.n_tokens == n
    got = ngram_lm.score(docs, model, "doc_id", "text").collect()
    by = {r.text: r for r in got}
    assert len(got) == len(rows)
    for r, (length, known, base, own) in zip(rows, want):
        g = by[r.text]
        assert (g.n_tokens, g.n_known) == (length, known)
        assert abs(g.base_score - base) < 1e-6 * length + 1e-9
        assert abs(g.score - own) < 0.02 * length + 0.05
    held = [by[r.text] for r in rows if r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_language_model_empty(empty, odd):
    model = ngram_lm.train_model(empty)
    assert model.n_tokens == 0 and ngram_lm.score(empty, model, "doc_id").collect() == []
    got = ngram_lm.score(odd, model, "doc_id").collect()
    assert len(got) == odd.count() and all(r.n_known == 0 for r in got)


def test_shares_of_frequent_contexts(spark, monkeypatch):
    """A context counted 2e8 times: shares and what is left keep their size."""
    counted = ngram_lm._unigrams
    often = F.col("h") == int(np.uint64(ngram_lm.hash_of(b"the")).view(np.int64))
    monkeypatch.setattr(ngram_lm, "_unigrams", lambda train: counted(train).withColumn("c", F.when(often, F.lit(200_000_000)).otherwise(F.col("c")).cast("bigint")))
    docs = spark.createDataFrame([("the cat the cat the dog the dog the dog",)], "text string")
    vocab, level = ngram_lm.opened(ngram_lm.train_model(docs))
    (the, *next_words), _ = vocab.lookup([b"the", b"cat", b"dog"])
    _, share, left = level.lookup(np.array([the, the]), np.array(next_words))
    assert np.abs(share / (np.array([1.25, 2.25]) / 2e8) - 1).max() < 0.05 and (left > 0.9).all()


def test_trie_successors(small):
    model = ngram_lm.train_model(small.limit(100), order=2)
    vocab, level = ngram_lm.opened(model)
    ids, _ = vocab.lookup([b"the", b"of"])
    found = level.successors(int(ids[0]))
    assert len(found) and (np.diff(found) > 0).all()
    node, share, left = level.lookup(np.full(len(found), ids[0]), found)
    assert (node >= 0).all() and (share > 0).all() and (left < 1).all()


def test_words_and_searches_are_met_once(small, odd):
    """Words of every kind as ``words_of`` gives them; a slice's searches are different and in order."""
    texts = [r.text for r in small.limit(60).collect()] + [r.text for r in odd.collect()]
    texts += ["".join(map(chr, range(1, 0x400))) * 2, " \tAÉ b\x0b\x0cc\x1c\x85d\xa0 ", "\r\n", "x", None]
    words, n = ngram_lm._split(texts)
    want = [ngram_lm.words_of(t) for t in texts]
    assert n.tolist() == list(map(len, want)) and words.to_pylist() == [w for t in want for w in t]
    assert [x.tolist() for x in ngram_lm._split([None])][1] == [0] and len(ngram_lm._split([])[1]) == 0
    model = ngram_lm.train_model(small.limit(60))
    vocab, level = ngram_lm.opened(model)
    level.keys[:] = -1
    met = []
    search = level._search
    level._search = lambda nodes, words: met.append(nodes * (model.n_words + 1) + words) or search(nodes, words)
    scores = ngram_lm.score_texts(model, texts)
    del level._search
    assert len(met) == 1 and (np.diff(met[0]) > 0).all()
    alone = [ngram_lm.score_texts(model, [t]) for t in texts]
    for i, column in enumerate(scores):
        assert np.allclose(column, [a[i][0] for a in alone], rtol=1e-12, atol=1e-9)


def test_levels_are_searched_from_their_context(small, monkeypatch):
    """Numbers of successors that no 31 bits hold, without the table of searches, and codes
    that stay in the files' maps."""
    model = ngram_lm.train_model(small.limit(150), order=3)
    vocab, two, three = ngram_lm.opened(model)
    for level in (two, three):
        for _, values, pointers, share, left, _ in level.shards.values():
            assert not any(a.flags.owndata for a in (values.lows, values.highs, pointers.highs, share, left))
    nodes = np.arange(0, model.n_words, 7)
    words = (nodes * 13) % model.n_words
    with_table = [x.copy() for x in two.lookup(nodes, words)]
    monkeypatch.setattr(two, "fits", False)
    assert all((a == b).all() for a, b in zip(two.lookup(nodes, words), with_table))
    for n in nodes[:60].tolist():
        found = two.successors(n)
        at, share, left = two.lookup(np.full(model.n_words, n), np.arange(model.n_words))
        assert np.flatnonzero(at >= 0).tolist() == found.tolist()
    big = np.array([5, 1 << 40, 5, 1 << 40]), np.array([3, 9, 3, 8])
    assert [x.tolist() for x in ngram_lm._counted(*big)] == [[5, 1 << 40, 1 << 40], [3, 8, 9], [2, 1, 1]]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "pack"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), "/root/testdata/sf0.001")
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count()
        if name == "language_id":
            assert docs.count() <= before
        if name == "near_duplicates":
            assert docs.count() < before
    rows = docs.collect()
    assert sum(r.length for r in rows) == max(r.sequence_id * 2048 + r.offset + r.length for r in rows)


def test_pipeline_stages_against_brute_force(spark, small, tokenizer, tmp_path):
    """Every stage over all that the one before kept, held against plain versions."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from test_texts import brute_components, check_passages

    stages = dict(corpus_pipeline.STAGES)
    docs = small.where("doc_id < 260").select(*corpus_pipeline.COLUMNS)

    def run(name, rows):
        rows.write.parquet(str(tmp_path / name))
        out = stages[name](spark, spark.read.schema(rows.schema).parquet(str(tmp_path / name)), "unused")
        out.write.parquet(str(tmp_path / (name + "-out")))
        return rows.collect(), spark.read.schema(out.schema).parquet(str(tmp_path / (name + "-out")))

    before, now = run("language_id", docs)
    assert {(r.doc_id, r.text) for r in now.collect()} == {(r.doc_id, r.text) for r in before if any(c.isalpha() for c in r.text or "")}
    before, now = run("near_duplicates", now)
    least = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in now.collect()) == sorted(least) and len(least) < len(before)
    before, now = run("repeated_passages", now)
    after = {r.doc_id: r.text for r in now.collect()}
    check_passages([(r.doc_id, r.text, after.get(r.doc_id, "")) for r in sorted(before, key=lambda r: r.doc_id)])
    assert any(after.get(r.doc_id) != r.text for r in before)
    before, now = run("source_mix", now)
    mixed = Counter((key(r.doc_id), r.text) for r in now.collect())
    want = Counter()
    for (doc, text, _), n in brute_mix(spark.createDataFrame(before, now.schema), corpus_pipeline.MIX).items():
        want[doc, text] += n
    assert mixed == want and len(want) < len(before)
    before, now = run("pack", now)
    tok = Tokenizer.from_file(tokenizer)
    length = Counter()
    for r in before:
        length[r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    pieces = sorted(now.collect(), key=lambda r: (r.sequence_id, r.offset))
    stream, whole, have = 0, Counter(), 0
    for r in pieces:
        assert r.sequence_id * 2048 + r.offset == stream and r.start == have and r.offset + r.length <= 2048
        stream, have = stream + r.length, have + r.length
        if have == r.doc_tokens:
            whole[r.doc_id, have] += 1
            have = 0
    assert whole == length and have == 0


def test_mix_sql(spark):
    import duckdb

    from tessera.llm import queries

    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op9_mixing"]).df()
    got = queries.op9_mixing(spark, path).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want) == len(got) > 500
    assert (got[cols].sort_values(cols).reset_index(drop=True) == want[cols].sort_values(cols).reset_index(drop=True)).all().all()
    assert got.dtypes.astype(str).to_dict() == {**got.dtypes.astype(str).to_dict(), **want.dtypes.astype(str).to_dict()}


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_pipeline_stages_on_odd_tables(table, request, spark, tmp_path):
    import corpus_pipeline

    docs = request.getfixturevalue(table).withColumn("n_chars", F.col("n_chars").cast("bigint")).select(*corpus_pipeline.COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.schema(docs.schema).parquet(str(tmp_path / name)), "unused")
        kept[name] = docs.collect()
    if table == "empty":
        assert not any(kept.values())
        return
    left = {r.doc_id for r in kept["language_id"]}
    assert not left & {2, 3, 4} and {1, 5, 6, 7, 8, 9, 11} <= left
    assert [r.doc_id for r in kept["near_duplicates"]].count(7) == 1
    texts = {r.doc_id: r.text for r in kept["repeated_passages"]}
    assert "of shared words" in texts[1] and len(texts[8]) < 400
    assert {r.doc_id for r in kept["pack"]} == {r.doc_id for r in kept["source_mix"]}
