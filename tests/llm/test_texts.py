"""Chunk dedup, fingerprints, language ID and SimHash against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, components, fingerprints, langid, simhash


def order(d):
    return (d is not None, d or 0)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def windows(raw, n):
    """Byte ranges of all windows of n words."""
    at = [m.span() for m in WORD.finditer(raw)]
    return [(a[0], b[1]) for a, b in zip(at, at[n - 1 :])]


def check_passages(rows, spans=None):
    """(doc_id, old, new) in order: what goes is said before, word for word; what shares
    nothing stays; no long passage is left twice.  By windows of words, not by the
    operator's chunks."""
    before, left = b"", {}
    seen: set[bytes] = set()
    for k, (doc, old, new) in enumerate(rows):
        raw, kept, last = (old or "").encode(), [], 0
        for start, stop in spans[k] if spans else ():
            kept.append(raw[last:start])
            last = stop
            gone = raw[start:stop]  # may begin or end inside a long word
            said = [(a, b) for a, b in windows(gone, 16) if gone[a:b] in before or raw.find(gone[a:b]) < start + a]
            for m in WORD.finditer(gone):
                assert any(a <= m.start() and m.end() <= b for a, b in said) or gone in before
        if spans:
            assert b"".join([*kept, raw[last:]]).decode() == (new or "")
        own = [b" ".join(WORD.findall(raw[a:b])) for a, b in windows(raw, 16)]
        if len(set(own)) == len(own) and not seen & set(own):
            assert (new or "") == (old or "")
        seen |= set(own)
        before += b"\n" + raw
        text = (new or "").encode()
        for w in {b" ".join(WORD.findall(text[a:b])) for a, b in windows(text, 51)}:
            assert left.setdefault(w, doc) == doc


def test_chunk_dedup(small):
    docs = small.where("doc_id < 400")
    got = chunk_dedup.dedup_substrings(docs.withColumn("old", F.col("text"))).orderBy("doc_id").collect()
    assert len(got) == docs.count() and any(r.removed_bytes for r in got) and any(not r.removed_bytes for r in got)
    check_passages([(r.doc_id, r.old, r.text) for r in got], [[(s.start, s.stop) for s in r.removed_spans] for r in got])
    assert all(r.removed_bytes == sum(s.stop - s.start for s in r.removed_spans) for r in got)


def test_chunk_dedup_odd(odd):
    got = chunk_dedup.dedup_substrings(odd.withColumn("old", F.col("text"))).collect()
    assert len(got) == odd.count()
    assert all((r.text is None) == (r.old is None) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].text == by[1].old and by[5].text == by[5].old and len(by[6].text) < 100
    assert "passage10 of shared words" not in by[8].text and by[8].text.endswith("and after it")
    assert len({(r.doc_id, r.text) for r in got}) == len({(r.doc_id, r.old) for r in got})


def test_rows_of_one_hash_keep_their_bytes(spark):
    """Two rows without an id whose texts have one 32-bit hash: the repeats of one are
    not cut from the other, which repeats nothing."""
    words = F.concat_ws(" ", *[F.concat(F.lit("é" * (i % 5 + 1)), (F.col("id") * 31 + i).cast("string")) for i in range(40)])
    lines = spark.range(150_000).select("id", words.alias("text")).withColumn("h", F.hash("text"))
    pair = lines.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first().t[:2]
    for i in (0, 1):
        rows = [(-5, pair[i]), (7, pair[0]), (7, pair[1]), (None, "x " + pair[i]), (None, pair[1 - i] + " y")]
        got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
        texts = [r.text for r in got]
        assert "x " + pair[i] in texts and pair[1 - i] + " y" in texts
        rows = [(-5, pair[i]), (7, pair[0]), (7, pair[1])]
        got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
        assert sorted(len(r.text) for r in got if r.doc_id == 7) == [0, len(pair[1 - i])]


@pytest.mark.parametrize("alphabet", ["あいうえおかきくけこさしすせそたちつてと", "abcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_texts_without_spaces(spark, alphabet):
    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list(alphabet), n))
    shared = make(1500)
    rows = [(1, make(900) + shared + make(300)), (2, make(77) + shared + make(1300)), (3, make(2500))]
    got = {r.doc_id: r for r in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed_bytes == got[3].removed_bytes == 0
    assert 0.8 * len(shared.encode()) < got[2].removed_bytes <= len(shared.encode())


def test_chunk_dedup_empty(empty):
    out = chunk_dedup.dedup_substrings(empty)
    assert out.collect() == [] and out.columns.count("removed_bytes") == 1


def test_chunks_resist_insertions():
    text = " ".join(f"w{i * 7919 % 1000}ord" for i in range(3000)).encode()
    pieces = lambda t: {t[a:b] for e in [chunk_dedup.chunk_edges(np.frombuffer(t, np.uint8)).tolist()] for a, b in zip(e, e[1:])}
    a, b = pieces(text), pieces(text[:5000] + b" inserted words here " + text[5000:])
    assert len(a & b) > 0.98 * len(a)


@pytest.mark.parametrize("period", [1, 3, 10, 17, 51])
def test_passages_over_fifty_words_are_found(spark, period):
    """Ordinary (period 51) and repetitive passages of 51 words lose their second copy."""
    rng = np.random.default_rng(period)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows = []
    for i in range(60):
        passage = (words(period) * 51)[:51]
        rows += [(2 * i, " ".join(words(30) + passage + words(30))), (2 * i + 1, " ".join(words(40) + passage + words(20)))]
    got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.removed_bytes for r in got if r.doc_id % 2)


def test_prefix_hash():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = "".join(rng.choice(list("abß日"), 60))
        cut = int(rng.integers(0, 50))
        b = a[:cut] + "#" + a[cut + 1 :]
        x, y = fingerprints.PrefixHash.of(a), fingerprints.PrefixHash.of(b)
        assert x.extension(0, y, 0) == cut
        assert x.extension(cut + 1, y, cut + 1) == len(a) - cut - 1
        assert x.equal(0, y, 0, cut) and not x.equal(0, y, 0, cut + 1)
        direct = sum((ord(c) + 1) * pow(fingerprints.BASES[0], k, fingerprints.P31) for k, c in enumerate(a)) % fingerprints.P31
        assert x.span(0, len(a))[0] == direct
        assert x.span(5, 20)[0] == fingerprints.PrefixHash.of(a[5:20]).span(0, 15)[0]
        assert x.windows(7)[9] == x.span(9, 16)[0]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_fingerprints(table, request, monkeypatch):
    docs = request.getfixturevalue(table)
    monkeypatch.setattr(fingerprints._followers, "__defaults__", (100_000,))
    got = fingerprints.fingerprints(docs).collect()
    key = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)))
    rows = sorted(((d.doc_id, d.text or "") for d in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), key(r[1])))
    want = []
    for (doc, text), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want.append((order(doc), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((order(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    texts = {r[1]: None for r in rows}
    assert len({r.fingerprint for r in got}) == len(texts)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if table == "small":
        assert sum(r.near_edited > 0.2 for r in got) > 900


def test_fingerprints_small_tables(spark, empty):
    assert fingerprints.fingerprints(empty).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0


def test_language_id(small, odd, empty):
    docs = small.withColumn("held_out", langid.held_out("doc_id", 4, 2))
    model = langid.fit(docs.where("not held_out"))
    assert sorted(sum(model.families, [])) == ["de", "en", "es", "fr"] and len(model.families) == 2
    got = langid.predict(docs, model, "doc_id", "lang", "held_out").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd_rows = langid.predict(odd, model, "doc_id", "text", "score").collect()
    assert len(odd_rows) == odd.count()

    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd_rows)
    assert langid.predict(empty, langid.fit(empty), "doc_id").collect() == []
    assert {r.lang_pred for r in langid.predict(small, langid.fit(empty), "doc_id").collect()} == {"und"}


def plain_features(text):
    """Counts of hashed 1- to 3-grams, one by one."""
    m = (1 << 32) - 1
    spaced, last = [32], False
    for c in text.lower():
        if c.isalpha() or not last:
            spaced.append(ord(c) if c.isalpha() else 32)
        last = not c.isalpha()
    if not any(c.isalpha() for c in text):
        return None
    codes = [*spaced, 32]
    if not text[:1].lower().isalpha():  # the text's own first space is kept beside the one put before
        assert codes[:2] == [32, 32]
    x = [0.0] * langid.DIM

    def count(h):
        x[(((h ^ h >> 15) * 0x2C1B3C6D) & m) >> 20] += 1

    for i, c in enumerate(codes):
        count(c * 0x9E3779B1 & m)
        if i >= 1:
            two = ((codes[i - 1] * 0x9E3779B1 & m ^ 0x85EBCA77) * 0xC2B2AE3D + c * 0x27D4EB2F) & m
            count(two)
        if i >= 2:
            two = ((codes[i - 2] * 0x9E3779B1 & m ^ 0x85EBCA77) * 0xC2B2AE3D + codes[i - 1] * 0x27D4EB2F) & m
            count(((two ^ 0x165667B1) * 0x9E3779B1 + c * 0x85EBCA6B) & m)
    logs = [np.log1p(v) for v in x]
    norm = sum(v * v for v in logs) ** 0.5
    return [v / norm for v in logs]


def test_language_id_keeps_texts_once(small):
    """A kept text is what is read; one of another type is kept as it is and read as a string."""
    model = langid.fit(small.select("text", "lang"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(small, model, "doc_id").collect()}
    own = {r.doc_id: r.text for r in small.collect()}
    for docs, n in ((small, 3), (small.withColumn("text", F.col("text").cast("binary")), 4)):
        found = langid.predict(docs, model, "lang", "text", "doc_id")
        assert found.columns == ["lang", "text", "doc_id", "lang_pred", "score"] and found.schema["text"] == docs.schema["text"]
        assert found._jdf.queryExecution().analyzed().children().head().output().size() == n
        got = found.select("doc_id", F.col("text").cast("string").alias("text"), "lang_pred", "score").collect()
        assert {r.doc_id: r.text for r in got} == own and {r.doc_id: (r.lang_pred, r.score) for r in got} == want


def test_language_id_against_a_plain_vote(small):
    """The sample, the features and the vote, made again without the operator's."""
    train = small.where("doc_id % 3 = 0")
    model = langid.fit(train, per_lang=30)
    rows = {(r.lang, r.h): r.text for r in train.withColumn("h", F.xxhash64("text", F.lit(11))).collect() if r.lang and r.text and any(c.isalpha() for c in r.text)}
    sample = []
    for lang in sorted({k for k, _ in rows}):
        least = sorted((h % (1 << 64), h) for k, h in rows if k == lang)[:30]
        sample += sorted((lang, h) for _, h in least)
    x = np.array([plain_features(rows[k]) for k in sample]).astype(np.float16).astype(np.float32)
    again = langid.fit_arrays(x, [k for k, _ in sample])
    assert again.families == model.families and again.pairs.keys() == model.pairs.keys()
    for r in langid.predict(small.where("doc_id % 5 = 1"), model, "doc_id", "text").collect():
        v = plain_features(r.text or "")
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        margins = [float(np.dot(w[:-1], v) + w[-1]) for w in model.family_w]
        langs = model.families[int(np.argmax(margins))]
        votes = dict.fromkeys(langs, 0)
        for (a, b), w in model.pairs.items():
            if a in votes:
                votes[a if np.dot(w[:-1], v) + w[-1] >= 0 else b] += 1
        assert votes[r.lang_pred] == max(votes.values())


def test_rare_and_many_languages(spark):
    """A language of many copies of one text, one of a single row, labels on texts without
    letters, and more languages than the sample has room for."""
    rows = [(i, "zq " + "xo wu " * 20, "xx") for i in range(300)] + [(300, "Ünïqüe ßtränge ŵörds", "rare"), (301, "1234", "digits"), (302, None, "none")]
    rows += [(400 + i, f"the words of this text are plain number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, per_lang=20)
    assert sorted(sum(model.families, [])) == ["en", "rare", "xx"]
    got = {r.lang: r.lang_pred for r in langid.predict(docs.where("doc_id in (5, 300, 450)"), model, "lang").collect()}
    assert got == {"xx": "xx", "rare": "rare", "en": "en"}
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i % 40)}{chr(0x5E00 + i % 40)} {'ab'[i % 2]}", f"l{i % 40:02d}") for i in range(400)], "doc_id long, text string, lang string")
    assert len(sum(langid.fit(many, total=20).families, [])) == 40


def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    keys, counts = simhash.golay_keys(words)
    assert set(counts.tolist()) <= {1, 6}
    for w, k, n in zip(words, keys, counts):
        for bit in range(23):
            other, m = simhash.golay_keys(np.array([w ^ (1 << bit)], dtype=np.uint32))
            assert set(k[:n].tolist()) & set(other[0, : m[0]].tolist())


def test_links_miss_none():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for flips in range(5):
        other = base.copy()
        for i in range(len(other)):
            for bit in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(bit)
        ra, ka = simhash.bucket_keys(base)
        rb, kb = simhash.bucket_keys(other)
        a, b = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in a & b} == set(range(400))


def brute_components(docs):
    words = [(t or "").encode().lower().split() for _, t in docs]
    fps = []
    for w in words:
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(order(d), fps[i], least.get(root(i))) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("table", ["odd", "small", "blocks"])
def test_simhash(table, request, monkeypatch):
    if table == "blocks":  # buckets over the block size take the way by block pairs
        monkeypatch.setattr(simhash, "BLOCK", 3)
    docs = request.getfixturevalue("odd" if table == "odd" else "small")
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert sorted((order(r.doc_id), r.fp % (1 << 64), r.component_id or -1) for r in got) == sorted((a, b, c or -1) for a, b, c in want)
    kept = simhash.keep_one(docs).collect()
    assert {r.component_id for r in got} >= {r.doc_id for r in kept}
    assert len(kept) == len({c for _, _, c in want})


def test_simhash_hex_and_empty(spark, empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
    row = spark.range(1).select(simhash.hex_of(F.lit(-1).cast("bigint")).alias("a"), simhash.hex_of(F.lit(10).cast("bigint")).alias("b")).first()
    assert row == ("f" * 16, "0" * 15 + "a")


@pytest.mark.parametrize("hub", [False, True])  # with few edges every node is joined as a hub, with many only the star's centre
def test_components(spark, hub):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (None, 4)]
    if hub:
        edges += [(7000, 5000 + i) for i in range(4000)] + [(20000 + i, 30000 + i) for i in range(3000)] + [(7001, 20000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for n in list(parent)}
