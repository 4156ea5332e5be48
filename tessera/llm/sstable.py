"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, a sparse block index, a Bloom filter and a
fixed footer.  Every section is followed by one newline byte (the text writer's
row end), which the offsets count.

* key: empty for a null id, else the id as 8 big-endian bytes with the sign bit
  turned, so that bytes sort as numbers and null comes first;
* block: zstd of entries ``varint shared, varint unshared, varint value bytes,
  key suffix, value``; keys share a prefix with the entry before, a block's first
  entry shares nothing;
* index: for each block ``first key (varint length, bytes), varint offset, length,
  documents, tokens``;
* footer: struct ``<4sHHQQQQQQQ``: magic, version, id bytes, index offset, index
  length, Bloom offset, Bloom length, documents, tokens, the shard's number.  Shards
  stand in the order of their numbers, whatever their files are called.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import arrow_schema, batch, crc_u32, docs_view, fresh_path, persist, struct_of, text_slices, write_blobs
from .tokens import WordEncoder

MAGIC, VERSION = b"TSST", 2
FOOTER = struct.Struct("<4sHHQQQQQQQ")
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Beyond so many shards they grow instead, so that their ranges and bases stay small.
MOST_SHARDS = 100_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of each key's bits, by double hashing of one 64-bit hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    i = np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None]
    return (hashes[None, :] + i * step[None, :]) % np.uint64(n_bits)


class ShardWriter:
    """Turns entries in key order into the sections of one shard, as they fill."""

    def __init__(self, id_bytes: int, block_bytes: int = 1 << 16, number: int = 0):
        self.id_bytes, self.block_bytes, self.number = id_bytes, block_bytes, number
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.at = self.docs = self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.body, self.first, self.last, self.n, self.t = bytearray(), None, b"", 0, 0

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """The finished block, if this entry filled one."""
        shared = 0
        if self.first is None:
            self.first = key
        else:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.n += 1
        self.t += len(value) // self.id_bytes
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        return self._block() if len(self.body) >= self.block_bytes else None

    def _block(self) -> bytes:
        data = zstandard.ZstdCompressor(level=1).compress(bytes(self.body))
        self.index.append(b"".join((_varint(len(self.first)), self.first, *map(_varint, (self.at, len(data), self.n, self.t)))))
        self.at += len(data) + 1
        self.docs, self.tokens = self.docs + self.n, self.tokens + self.t
        self._open()
        return data

    def finish(self) -> list[bytes]:
        """The sections still to write: last block, index, Bloom filter, footer."""
        out = [self._block()] if self.n else []
        index = b"".join(self.index)
        n_bits = max(64, -(-len(self.hashes) * BLOOM_BITS // 64) * 64)
        bits = np.zeros(n_bits, dtype=np.uint8)
        if self.hashes:
            bits[_bloom_bits(np.array(self.hashes, dtype=np.uint64), n_bits).ravel().astype(np.int64)] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        at = self.at
        foot = FOOTER.pack(MAGIC, VERSION, self.id_bytes, at, len(index), at + len(index) + 1, len(bloom), self.docs, self.tokens, self.number)
        return [*out, index, bloom, foot]


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data):
        self.data = memoryview(data)
        end = len(self.data) - 1  # the newline after the footer
        fields = FOOTER.unpack(self.data[end - FOOTER.size : end])
        if fields[0] != MAGIC or fields[1] != VERSION:
            raise ValueError("not a shard of this format")
        self.id_bytes, self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.docs, self.tokens, self.number = fields[2:]
        self._blocks: list[tuple[bytes, int, int, int, int]] | None = None

    @property
    def blocks(self) -> list[tuple[bytes, int, int, int, int]]:
        """first key, offset, length, documents, tokens of each block."""
        if self._blocks is None:
            self._blocks, at, data = [], 0, bytes(self.data[self.index_at : self.index_at + self.index_len])
            while at < len(data):
                n, at = _read_varint(data, at)
                key, at, rest = data[at : at + n], at + n, []
                for _ in range(4):
                    v, at = _read_varint(data, at)
                    rest.append(v)
                self._blocks.append((key, *rest))
        return self._blocks

    def may_have(self, key: bytes) -> bool:
        bits = _bloom_bits(np.array([xxhash.xxh3_64_intdigest(key)], dtype=np.uint64), self.bloom_len * 8).ravel()
        bloom = np.frombuffer(self.data[self.bloom_at : self.bloom_at + self.bloom_len], dtype=np.uint8)
        return bool(np.all(bloom[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1))

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, _, _ = self.blocks[block]
        body, at, key = zstandard.ZstdDecompressor().decompress(self.data[offset : offset + length]), 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            unshared, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + unshared]
            at += unshared
            yield key, body[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.entries(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that id: Bloom filter, then binary search in the
        block index, then one block (or more, where equal keys cross blocks)."""
        key = key_of(doc_id)
        if not self.docs or not self.may_have(key):
            return []
        firsts = [b[0] for b in self.blocks]
        found, i = [], max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(firsts) and firsts[i] <= key:
            found += [np.frombuffer(v, dtype=f"<u{self.id_bytes}") for k, v in self.entries(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_bytes: int = 32 << 20, path: str | None = None) -> str:
    """Encode whole texts (null: empty), add ``end_id``, and write shards in
    ascending order of doc_id (null first); shard i holds smaller keys than shard
    i + 1.  Rows of one doc_id stay as they are, ordered by their text; where very many
    rows are equal in both (or have neither), they are dealt over several shards by their
    place.  The number of shards follows the table's bytes up to ``MOST_SHARDS``, so a
    shard's size does not grow before.  A very long text is one entry, in a block of its
    own size.  An empty table gives one empty shard; extra columns are ignored, whatever
    their names.  Returns the folder."""
    path = path or fresh_path(docs.sparkSession, "sstable")
    rows = docs_view(docs, "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(-(-size // shard_bytes), MOST_SHARDS))
    # Spark draws at most a million rows' keys for the ranges, whatever n is
    placed = rows.repartitionByRange(int(n), F.col("doc_id").asc(), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc())
    placed = placed.sortWithinPartitions(F.col("doc_id").asc(), F.xxhash64("text").asc(), F.col("text").asc())
    out = struct_of("blob binary")
    schema = arrow_schema(out)

    def run(batches):
        enc = WordEncoder.open(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        writer = ShardWriter(enc.dtype.itemsize, number=TaskContext.get().partitionId())
        for part, texts in text_slices(batches, 4 << 20):
            ids = enc.encode_batch(texts)
            blocks = [writer.add(key_of(k), x.tobytes() + end) for k, x in zip(part.column(0).to_pylist(), ids)]
            yield batch(schema, [[b for b in blocks if b is not None]])
        for section in writer.finish():
            yield batch(schema, [[section]])

    write_blobs(placed.mapInArrow(run, out), "blob", path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    ``with_ids``, the ids, from the files alone.

    Every file is read once; its rows carry the number in its footer.  Starts come from
    the shards' totals, summed in the order of their numbers (one small row a shard, of
    which there are ``MOST_SHARDS`` at most), and each document's place in its shard.
    Repeated ids give a row each; empty shards give none."""
    out = struct_of("shard bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))
    schema = arrow_schema(out)

    def documents(batches):
        for b in batches:
            for content in b.column(0):
                shard, at, n = Shard(content.as_buffer()), 0, 0
                for i in range(len(shard.blocks)):
                    cols: list[list] = [[] for _ in schema]
                    for key, value in shard.entries(i):
                        ids = np.frombuffer(value, dtype=f"<u{shard.id_bytes}")
                        for c, v in zip(cols, (shard.number, id_of(key), at, len(ids), crc_u32(ids), value)):
                            c.append(v)
                        at += len(ids)
                    n += len(cols[0])
                    yield batch(schema, cols)
                if (n, at) != (shard.docs, shard.tokens):
                    raise ValueError("a shard does not hold what its footer says")

    rows = persist(_files(spark, path).select("content").mapInArrow(documents, out), "sstable-rows")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    bases = totals.select("shard", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("base"))
    if totals.count() <= MOST_SHARDS:
        bases = F.broadcast(bases)
    joined = rows.join(bases, "shard")
    cols = ["doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"]
    return joined.select(*cols, *(["ids"] if with_ids else []))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the asked documents (every one of a repeated id; none for an id that
    is not there); a shard whose Bloom filter knows none of them is not decoded."""
    out = struct_of("doc_id bigint, ids binary")
    schema = arrow_schema(out)

    def run(batches):
        for b in batches:
            for content in b.column(1):
                shard = Shard(content.as_buffer())
                hits = [(d, ids.tobytes()) for d in doc_ids for ids in shard.get(d)]
                yield batch(schema, [[h[0] for h in hits], [h[1] for h in hits]])

    return _files(spark, path).mapInArrow(run, out)
