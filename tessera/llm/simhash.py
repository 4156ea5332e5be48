"""SimHash near-duplicates found through the binary Golay code.

Two 64-bit fingerprints with at most four differing bits, cut into segments of 22,
21 and 21 bits, differ in a way that the pigeonhole principle limits: either some
segment is equal, or two segments differ in exactly one bit each.  The first case
needs one key a segment.  For the second, each segment (padded to 23 bits) is
decoded to the codewords of the [23,12,7] code within four bits of it, one or six;
words that differ in one bit have the nearest codeword of either in common, so a
key from two segments' codeword indices brings the pair together.  Fingerprints
that share a key are verified by counting bits, and only the spanning stars of
what is linked leave the bucket, so a bucket of copies gives no pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_schema, batch, docs_view, persist, struct_of, text_slices
from .components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GOLAY_POLY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: A bucket's fingerprints are compared in blocks of this many, each pair of blocks in a task of its own beyond one block.
BLOCK = 4096


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial (11 bits)."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> np.uint32(bit) & np.uint32(1), np.uint32(GOLAY_POLY << (bit - 11)), np.uint32(0))
    return r


@lru_cache(maxsize=1)
def _coset_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome its error patterns of weight up to 4, at most 6, the lightest
    first, and how many there are.  Made by enumerating error patterns."""
    bits = [1 << i for i in range(23)]
    table = np.zeros((2048, 6), dtype=np.uint32)
    count = np.zeros(2048, dtype=np.int64)
    patterns = [0]
    for weight in range(5):
        if weight:
            patterns = sorted({p | b for p in patterns for b in bits if not p & b})
        arr = np.array(patterns, dtype=np.uint32)
        syn = _syndromes(arr)
        for p, s in zip(arr.tolist(), syn.tolist()):
            if count[s] < 6:
                table[s, count[s]] = p
                count[s] += 1
    return table, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices (12 bits) of the codewords within four bits of each 23-bit
    word, and how many of the six are used (1 or 6)."""
    table, count = _coset_table()
    syn = _syndromes(words)
    near = words.astype(np.uint32)[:, None] ^ table[syn]
    return near >> np.uint32(11), count[syn]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket that each fingerprint goes to."""
    rows, keys = [], []
    n = np.arange(len(fps))
    seg = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    for i, s in enumerate(seg):
        rows.append(n)
        keys.append(np.uint64(i << 60) | s)
    golay = [golay_keys(s) for s in seg]
    for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, ca), (kb, cb) = golay[a], golay[b]
        for x in range(6):
            for y in range(6):
                ok = np.flatnonzero((ca > x) & (cb > y))
                rows.append(ok)
                keys.append(np.uint64((3 + i) << 60) | ka[ok, x].astype(np.uint64) << np.uint64(12) | kb[ok, y].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of shingles of ``width`` words, repeats included."""
    return _majority(_shingle_hashes(text, width, seed))


def _shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], stops[:-1]))
    ends = stops[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


_PRINTS = struct_of("doc_id bigint, fp bigint, text_key bigint")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_key (hash of the text)."""
    schema = arrow_schema(_PRINTS)

    def run(batches):
        for rows, texts in text_slices(batches):
            fps = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64)
            yield batch(schema, [rows.column(0), fps.view(np.int64), rows.column(2)])

    return docs_view(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text")).mapInArrow(run, _PRINTS)


def _stars(fps: np.ndarray, reps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (a, b), b the smallest representative linked to a inside the given set;
    as many as there are fingerprints at most."""
    n = len(fps)
    label = np.arange(n)
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order], reps[order]
    near: list[np.ndarray] = []
    for i in range(0, n, 512):
        hit = np.bitwise_count(fps[i : i + 512, None] ^ fps[None, :]) <= most
        near.append(np.packbits(hit, axis=1))
    done = np.zeros(n, dtype=bool)
    for root in range(n):  # breadth first; each fingerprint's row of links is read once
        if done[root]:
            continue
        done[root] = True
        front = [root]
        while front:
            row = near[front[-1] // 512][front.pop() % 512]
            new = np.flatnonzero(np.unpackbits(row, count=n).astype(bool) & ~done)
            done[new] = True
            label[new] = root
            front += new.tolist()
    return [(int(reps[i]), int(reps[label[i]])) for i in np.flatnonzero(label != np.arange(n))]


_EDGE = struct_of("a bigint, b bigint, key bigint, fp bigint, rep bigint, block bigint")


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """a, b: spanning links between the fingerprints of ``prints`` (fp, rep: distinct
    fingerprints with a representative each) that differ in at most ``most`` (0 to 4) bits.

    Keys are made and grouped in one shuffle.  A bucket that reaches ``BLOCK``
    fingerprints is not compared there: its rows leave in blocks as they come and are
    dealt again, a task for each pair of blocks, so no bucket is too large for a task.
    """
    if not 0 <= most <= 4:
        raise ValueError("segments are cut for at most four differing bits")
    keyed = struct_of("key bigint, fp bigint, rep bigint")
    key_schema, edge_schema = arrow_schema(keyed), arrow_schema(_EDGE)

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fps, reps = (np.asarray(part.column(i)) for i in (0, 1))
                rows, keys = bucket_keys(fps.view(np.uint64))
                yield batch(key_schema, [keys.view(np.int64), fps[rows], reps[rows]])

    def compare(batches):
        """Links inside whole buckets of a batch; a bucket that fills a block leaves as
        numbered blocks, one at a time, so a task never holds more than one of it."""
        now, held, size, block = None, [], 0, 0  # the last bucket: key, rows not sent yet, blocks that went before

        def rows_of(links=(), late=None):
            links, cols = list(set(links)), late or [np.zeros(0, dtype=np.int64)] * 4
            none, gap = [None] * len(cols[0]), [None] * len(links)
            ends = [[*(e[k] for e in links), *none] for k in (0, 1)]
            return batch(edge_schema, [*ends, *[pa.array([*gap, *c.tolist()], pa.int64()) for c in cols]])

        def finish():
            keys, fps, reps = (np.concatenate(c) for c in zip(*held))
            if block:
                return rows_of(late=[keys, fps, reps, np.full(len(keys), block)])
            return rows_of(_stars(fps.view(np.uint64), reps, most))

        def inside(keys, fps, reps):
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((new, [len(keys)])))
            edges: list[tuple[int, int]] = []
            pair = new[sizes == 2]
            close = pair[np.bitwise_count(fps[pair].view(np.uint64) ^ fps[pair + 1].view(np.uint64)) <= most]
            edges += zip(np.maximum(reps[close], reps[close + 1]).tolist(), np.minimum(reps[close], reps[close + 1]).tolist())
            for i, n in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                edges += _stars(fps[i : i + n].view(np.uint64), reps[i : i + n], most)
            return rows_of(edges)

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                cols = [np.asarray(b.column(i).slice(at, BLOCK)) for i in range(3)]
                keys, start = cols[0], 0
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                last = int(ends[-1]) if len(ends) else 0
                if keys[0] == now:
                    start = int(ends[0]) if len(ends) else len(keys)
                    held.append([c[:start] for c in cols])
                    size += start
                if keys[-1] != now:
                    if now is not None:
                        yield finish()
                    if last > start:
                        yield inside(*[c[start:last] for c in cols])
                    now, held, size, block = keys[-1], [[c[last:] for c in cols]], len(keys) - last, 0
                if size >= BLOCK:
                    whole = [np.concatenate(c) for c in zip(*held)]
                    yield rows_of(late=[*[c[:BLOCK] for c in whole], np.full(BLOCK, block)])
                    held, size, block = [[c[BLOCK:] for c in whole]], size - BLOCK, block + 1
        if now is not None:
            yield finish()

    # keys are many to a fingerprint: they are made by all tasks
    rows = prints.select("fp", "rep").repartition("fp").mapInArrow(spread, keyed)
    found = persist(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, _EDGE), "simhash-links")
    near = found.where(F.col("a").isNotNull()).select("a", "b")
    late = found.where(F.col("a").isNull())
    if late.isEmpty():
        return near
    pair = struct_of("a bigint, b bigint")
    pair_schema = arrow_schema(pair)
    blocks = late.groupBy("key").agg(F.max("block").alias("last"))
    dealt = late.join(blocks, "key").select("key", "fp", "rep", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("with"))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "fp", "rep")

    def two_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps, reps = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("rep"))
        edges = _stars(fps, reps, most)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())}, schema=pair_schema)

    return near.union(dealt.groupBy("key", "i", "j").applyInArrow(two_blocks, pair))


def _labelled(docs: DataFrame, width: int, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (a written table), and them with component_id."""
    prints = persist(fingerprints(docs, width, seed), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = persist(distinct.withColumn("rep", F.coalesce("first", F.xxhash64("fp").bitwiseOR(F.lit(-(1 << 63))))), "simhash-distinct")
    comps = connected_components(links(distinct, most))
    # of single fingerprints too: the representative stands for its component
    named = distinct.join(comps, distinct["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("c"), "first", "rep")
    # null ids have negative stand-ins, which are smaller: a component's name is its least true id
    names = named.groupBy("c").agg(F.min("first").alias("component_id"))
    label = named.join(names, "c").select(F.col("fp").alias("_fp"), "component_id")
    return prints, prints.join(label, prints["fp"] == label["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, text_key, component_id for every row: the smallest doc_id that links of at
    most ``most`` differing fingerprint bits reach.

    Null, empty and blank texts have fingerprint zero and link like any other;
    repeated rows share a fingerprint; a null doc_id never names a component unless
    all its members' ids are null, which then have a null component_id; an empty
    table gives no rows; extra columns are ignored; a very long text is hashed whole, its
    bits counted 16,384 shingles at a time.
    """
    return _labelled(docs, width, most, seed)[1]


def hex_of(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """The documents, one of each component: that of the smallest doc_id (null last), of
    rows that share it the one of the smallest text hash, and of rows equal in both any
    one.  All columns stay."""
    prints, found = _labelled(docs, width, most, seed)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    one = found.groupBy(F.coalesce("component_id", F.col("fp")).alias("c"), F.col("component_id").isNull().alias("n")).agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("_d"), F.col("p.text_key").alias("_k"))
    keyed = docs.withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(one, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).drop("_d", "_k")
    if not prints.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():  # only then another shuffle of texts
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.drop("_key")
