"""Packing, counting and shards against whole-text encoding."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import _shared, counting, packing, sstable
from tessera.llm.tokens import WordEncoder


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def ids_of(tokenizer):
    tok = Tokenizer.from_file(tokenizer)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_whole_texts(tokenizer, ids_of, small):
    enc = WordEncoder(tokenizer, limit=500)
    texts = [r.text for r in small.limit(150).collect()]
    texts += ["a~b ~ c ~~", "<|endoftext|>x <|startoftext|>", "ﬁ Σας\tΑΣ x", "日本語 ́a", "a b c", "~", "", " \n ", "z" * 4000]
    for t, got in zip(texts, enc.encode_batch(texts)):
        assert got.tolist() == ids_of(t)
        assert enc.encode(t).tolist() == got.tolist()


def test_words_are_spelled_by_their_parts(tokenizer, ids_of):
    """The model meets a word once, whatever signs and capitals stand around and in it."""
    enc = WordEncoder(tokenizer)
    met: list[str] = []
    spell = enc._parts
    enc._parts = lambda parts: met.extend(parts) or spell(parts)
    words = ["quandrolisch", "Überèé", "naïf"]
    signs = ["", ",", ".", "'s", "!'", "''ll", "***", "~", "12,5", "$$$"]
    texts = [f"{b}{w}{a} {w.upper()}{a}{w}" for w in words for a in signs for b in signs]
    for _ in range(2):
        for t, got in zip(texts, enc.encode_batch(texts)):
            assert got.tolist() == ids_of(t)
    assert len(met) == len(set(met)) < 60 < len({w for t in texts for w in t.split(" ")})


def test_words_of_any_characters(tokenizer, ids_of):
    """Every character in, before and after a word, those that are not plain too."""
    enc = WordEncoder(tokenizer, limit=300)
    codes = [*range(1, 0x300), 0x307, 0x301, 0x345, 0x3A3, 0x1E9E, 0x2C65, 0x2028, 0x3000, 0xFB01, 0x1F600]
    texts = [f"a{chr(c)}b, {chr(c)} {chr(c)}Z' x{chr(c)}. \u0130{chr(c)}e\u0301{chr(c)}'{chr(c)}s" for c in codes]
    texts += ["<|endoftext|>,a", "a<|startoftext|>b.", "< |>", "", None, " ", "\n\n", "a  b", " a ", "it's 'S I'LL 'lll", "7\x1c8\x858\xa0"]
    for t, got in zip(texts, enc.encode_batch(texts)):
        assert got.tolist() == ids_of(t), t
    assert enc.encode_batch([]) == [] and [x.tolist() for x in enc.encode_batch([None])] == [[]]


def test_slices_give_memory_back(monkeypatch):
    """After each batch, the last one too, Arrow's pool is asked for what it does not use."""
    asked = []
    pool = type("Pool", (), {"release_unused": lambda self: asked.append(len(seen))})()
    monkeypatch.setattr(_shared.pa, "default_memory_pool", lambda: pool)
    seen = []
    batches = [pa.record_batch({"text": ["abc"] * 5}), pa.record_batch({"text": ["d", None]}), pa.record_batch({"text": pa.array([], pa.string())})]
    for part, texts in _shared.text_slices(batches, 7):
        seen += texts
    assert seen == ["abc"] * 5 + ["d", None] and asked == [5, 7, 7]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_packing(table, request, tokenizer, ids_of):
    docs = request.getfixturevalue(table)
    pieces = packing.pack(docs, tokenizer, seq_len=64 if table == "odd" else 2048)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    size = 64 if table == "odd" else 2048
    stream = 0
    for r in rows:  # gapless, in one stream
        assert r.sequence_id * size + r.offset == stream and r.offset + r.length <= size
        stream += r.length
    want = sorted((d.doc_id if d.doc_id is not None else -1, [*ids_of(d.text), 1]) for d in docs.collect())
    got, now = [], []
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32 and r.start == len(now)
        now += ids
        if len(now) == r.doc_tokens:
            got.append((r.doc_id if r.doc_id is not None else -1, now))
            now = []
    assert sorted(got) == want
    seqs = packing.sequences(pieces).collect()
    assert sum(s.n_tokens for s in seqs) == stream and all(len(s.ids) == 2 * s.n_tokens for s in seqs)


def test_packing_empty(empty, tokenizer):
    assert packing.pack(empty, tokenizer).collect() == []


@pytest.mark.parametrize("table", ["odd", "small"])
def test_shards(table, request, spark, tokenizer, ids_of):
    docs = request.getfixturevalue(table)
    path = sstable.write_shards(docs, tokenizer, shard_bytes=60_000)
    got = sstable.read_shards(spark, path, with_ids=True).orderBy("start").collect()
    assert spark.read.format("binaryFile").load(path).count() > 1
    keys = [-(1 << 63) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert r.start == start and crc(np.frombuffer(r.ids, "<u2")) == r.ids_crc32
        start += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(((d.doc_id, [*ids_of(d.text), 2]) for d in docs.collect()), key=key)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in got), key=key) == want
    some = [want[3][0], 10**12]
    found = sstable.lookup(spark, path, some).collect()
    assert {r.doc_id for r in found} == {some[0]}


def test_shards_stand_in_the_order_of_their_numbers(small, spark, tokenizer):
    """part-100000 sorts before part-99999; starts follow the footers all the same."""
    path = sstable.write_shards(small, tokenizer, shard_bytes=200_000)
    want = {r.doc_id: r.start for r in sstable.read_shards(spark, path).collect()}
    folder = Path(path.removeprefix("file:").replace("//", "/"))
    for crc_file in folder.glob(".*.crc"):
        crc_file.unlink()
    for i, file in enumerate(sorted(folder.glob("part-*"))):
        file.rename(folder / f"part-{99_998 + i:05d}-renamed.txt")
    names = [f.name for f in folder.glob("part-*")]
    assert len(names) > 3 and sorted(names) != sorted(names, key=lambda n: int(n.split("-")[1]))
    assert {r.doc_id: r.start for r in sstable.read_shards(spark, path).collect()} == want


def test_rows_without_ids_fill_several_shards(spark, tokenizer):
    docs = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'the same words' as text")
    path = sstable.write_shards(docs, tokenizer, shard_bytes=200_000)
    got = sstable.read_shards(spark, path).selectExpr("count(*) n", "count(distinct start) s", "max(start) m", "max(n_tokens) t", "min(n_tokens) u").first()
    assert got.n == got.s == 100_000 and got.t == got.u and got.m == got.t * 99_999
    sizes = [r.n for r in spark.read.format("binaryFile").load(path).selectExpr("length as n").collect()]
    assert len(sizes) > 5 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_shards_empty(empty, spark, tokenizer):
    assert sstable.read_shards(spark, sstable.write_shards(empty, tokenizer)).collect() == []


def test_shard_get_and_bloom():
    w = sstable.ShardWriter(2, block_bytes=300)
    out = bytearray()
    for i in [None, *range(-50, 400, 3)]:
        block = w.add(sstable.key_of(i), np.arange(abs(i or 0) % 7, dtype="<u2").tobytes())
        out += block + b"\n" if block is not None else b""
    for part in w.finish():
        out += part + b"\n"
    shard = sstable.Shard(bytes(out))
    assert len(shard.blocks) > 3 and shard.docs == 151
    for i in [None, -50, 1, 397]:
        assert len(shard.get(i)) == (1 if i is None or (i + 50) % 3 == 0 else 0)
    assert sum(bool(shard.get(i)) for i in range(1000, 1300)) == 0
    assert sum(shard.may_have(sstable.key_of(i)) for i in range(1000, 2000)) < 50


def test_token_tree_follows_edits(tokenizer, ids_of, small):
    rng = random.Random(3)
    enc = WordEncoder.open(tokenizer)
    texts = [r.text for r in small.limit(25).collect()] + ["", "a" * 3000, "ab " * 900, " \n "]
    for text in texts:
        tree = counting.TokenTree(text, enc, leaf_chars=64)
        for _ in range(10):
            a = rng.randrange(len(text) + 1)
            b = rng.randrange(a, min(len(text), a + 90) + 1)
            new = rng.choice(["", "q r", " ", "\n", "zz", "some more words"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == len(ids_of(text))
            assert tree.tokens_before_leaf(len(tree.blocks) - 1) == sum(tree.counts[:-1])


def test_count_edits(odd, empty, tokenizer, ids_of):
    want = sorted(
        (d.doc_id or -1, len(ids_of(d.text)), len(ids_of(counting.apply_edits(d.text or "", counting.edits_of(d.text or ""))))) for d in odd.collect()
    )
    got = counting.count_edits(odd, tokenizer).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_tokens_edited) for r in got) == want
    long = next(r for r in got if r.doc_id == 5)
    assert long.reencoded_chars < long.n_chars / 20
    assert counting.count_edits(empty, tokenizer).collect() == []
