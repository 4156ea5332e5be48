"""Substring deduplication by content-defined chunking.

A gear rolling hash over the bytes chooses cuts at word starts, by a bound and where
it is least among the neighbouring words (repeated words or lines, which may never
fall below the bound, are so cut once a period), and inside long stretches without a
cut (scripts without spaces, encoded data) at any character.  Chunks depend on near
context only and find their places again after an insertion.

What is compared is a passage: the chunks from a cut on that together hold at least
``min_words`` words.  A passage is a repeat if an equal one (by 96 bits of its digest)
comes earlier, in order of doc_id and place, and repeats are removed.  Passages overlap,
so a longer repetition goes as a whole; a row of common phrases that are each known but
never stood side by side is no repeat and stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_schema, batch, struct_of, text_slices

#: Bytes that the rolling hash sees, and the share of word starts that become cuts.
GEAR_BYTES, WORDS_A_CUT = 16, 6
#: A word start whose hash is least among so many before and after it is a cut too.
NEAR_WORDS = 4
#: Stretches of over LONG bytes without a cut are cut at one character in BYTES_A_CUT, by the
#: hash, and what is still over MAX_CHUNK at every MAX_CHUNK-th byte.
LONG, BYTES_A_CUT, MAX_CHUNK = 256, 48, 1024
#: Bytes that count as a word where words are longer than that.
WORD_BYTES = 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _gear_table() -> np.ndarray:
    """256 fixed 32-bit values from a seeded hash."""
    return np.array([xxhash.xxh32_intdigest(bytes([i]), seed=20) for i in range(256)], dtype=np.uint32)


_GEAR = _gear_table()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - k]] << k over the last 16 bytes, mod 2^32, by
    doubling the window four times."""
    h, width = _GEAR[data], 1
    while width < GEAR_BYTES:
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """Whether each hash is the least, or one of the least, of those near it."""
    wide = np.full(len(h) + 2 * NEAR_WORDS, 2**32 - 1, dtype=np.uint32)
    wide[NEAR_WORDS : len(h) + NEAR_WORDS] = h
    low = h
    for i in range(2 * NEAR_WORDS + 1):
        low = np.minimum(low, wide[i : i + len(h)])
    return h == low


def chunk_edges(data: np.ndarray) -> np.ndarray:
    """Edges of a text's chunks as byte places, 0 and the length included.

    A cut stands at a word's start where the hash of the bytes before it is in the
    lowest 1/6 of its range or least among the hashes of four word starts before and
    after it; in stretches of over 256 bytes without one, at each start of a UTF-8
    character where the hash of the bytes before is in the lowest 1/48; and what is
    over 1,024 bytes then (one byte or a short period over and over) is cut at every
    1,024th byte, moved back to the start of a character."""
    n = len(data)
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    starts = starts[starts >= GEAR_BYTES]
    rolled = rolling_hash(data)
    h = rolled[starts - 1]
    edges = np.concatenate(([0], starts[(h < np.uint32((1 << 32) // WORDS_A_CUT)) | _least(h)], [n]))
    gaps = np.diff(edges)
    if gaps.max() > LONG:
        # a cut for spaces alone would depend on nothing: a cut's byte is no space
        inner = [edges]
        bound = np.uint32((1 << 32) // BYTES_A_CUT)
        for i in np.flatnonzero(gaps > LONG):
            a, b = max(int(edges[i]) + 1, GEAR_BYTES), int(edges[i + 1])
            here = rolled[a - 1 : b - 1] < bound
            inner.append(np.flatnonzero(here & (data[a:b] & 0xC0 != 0x80) & ~space[a:b]) + a)
        edges = np.unique(np.concatenate(inner))
        gaps = np.diff(edges)
    if gaps.max() > MAX_CHUNK:
        extra = []
        for i in np.flatnonzero(gaps > MAX_CHUNK):
            for p in range(int(edges[i]) + MAX_CHUNK, int(edges[i + 1]), MAX_CHUNK):
                while p > edges[i] and data[p] & 0xC0 == 0x80:
                    p -= 1
                extra.append(p)
        edges = np.unique(np.concatenate((edges, extra)))
    return edges


def passages(data: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of a text's passages: from each cut to the first later one with
    at least ``min_words`` words between, and from the last cut that leaves so many to
    the end.  A chunk's words are its words, or a sixteenth of its bytes (without white
    space) if that is more."""
    edges = chunk_edges(data)
    if len(edges) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    words = np.add.reduceat(begins.astype(np.int64), edges[:-1])
    words = np.maximum(words, np.add.reduceat(solid.astype(np.int64), edges[:-1]) // WORD_BYTES)
    before = np.concatenate(([0], np.cumsum(words)))
    to = np.searchsorted(before, before[:-1] + min_words, side="left")
    first = np.flatnonzero((to < len(edges)) & (words > 0))
    if not len(first):
        return first, first
    starts, stops = edges[first], edges[to[first]]
    tail = first[-1]  # its passage may end before the text does
    if stops[-1] != edges[-1]:
        starts, stops = np.append(starts, edges[tail]), np.append(stops, edges[-1])
    return starts, stops


_MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
#: hi and the upper half of lo_tag: the digest; id, tag and the lower half: the row; span: one long, so that few bytes are shuffled.
_PASSAGE = struct_of("hi bigint, lo_tag bigint, id bigint, tag bigint, span bigint")
#: Of a span, start, then 31 bits of length, 1 of again.  A text has less than 2^31 bytes.
_START_AT = 32
#: The id that stands for null; the tag tells them apart.
_NO_ID = -(1 << 63)


def _named(docs: DataFrame) -> list:
    """id, tag, tag2: 160 bits that name a row by doc_id and text; null sorts first."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    tag = F.xxhash64(text, doc_id.isNull())
    return [F.coalesce(doc_id, F.lit(_NO_ID)).alias("id"), tag.alias("tag"), F.hash(text, doc_id).alias("tag2")]


def found_passages(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each passage: 96 bits of its digest, the row's name and the span.

    Equal passages of one batch meet here: only the first of them has to meet those of
    other batches, so a digest brings at most one row a batch to its task however common
    it is; the rest are repeats already (the span's last bit) and carry a number of their
    own for the digest, which deals them evenly."""
    schema = arrow_schema(_PASSAGE)

    def run(batches):
        for rows, texts in text_slices(batches, 8 << 20):
            digests, refs, spans = [], [], []
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                starts, stops = passages(np.frombuffer(raw, dtype=np.uint8), min_words)
                if not len(starts):
                    continue
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                refs.append(np.full(len(starts), i))
                spans.append(np.stack((starts, stops)))
            if not digests:
                continue
            ref, span = np.concatenate(refs), np.concatenate(spans, axis=1)
            two = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2).copy()
            two[:, 1] >>= 32
            ids, tags, more = (np.asarray(rows.column(k))[ref] for k in (0, 1, 2))
            order = np.lexsort((span[0], more, tags, ids, two[:, 1], two[:, 0]))
            span, two, ids, tags, more = span[:, order], two[order], ids[order], tags[order], more[order]
            new = np.concatenate(([True], np.any(two[1:] != two[:-1], axis=1)))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = (ids != ids[lead]) | (tags != tags[lead]) | (more != more[lead]) | (span[0] != span[0][lead])
            with np.errstate(over="ignore"):
                own = (ids * _MIX ^ tags) * _MIX + span[0] * 2 + 1
                two[:, 0] = np.where(again, two[:, 0] ^ (own * _MIX), two[:, 0])
            packed = span[0] << _START_AT | (span[1] - span[0]) << 1 | again
            yield batch(schema, [two[:, 0], two[:, 1] << 32 | more.astype(np.int64) & 0xFFFFFFFF, ids, tags, packed])

    return docs.select(*_named(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, _PASSAGE)


_REPEAT = struct_of("id bigint, tag bigint, tag2 int, span bigint")


def repeats(docs: DataFrame, min_words: int = 16) -> DataFrame:
    """id, tag, tag2, span (start << 32 | bytes << 1) of every passage with an equal one
    before it.  A task reads its digests in order and holds the first place of one."""
    schema = arrow_schema(_REPEAT)

    def later(batches):
        first = None  # of the digest at hand: hi, lo, id, tag, tag2, start
        for b in batches:
            if not b.num_rows:
                continue
            hi, lo, ids, tags, span = (np.asarray(b.column(k)) for k in range(5))
            lo, more = lo >> 32, lo.astype(np.int32)
            cols = [hi, lo, ids, tags, more, span >> _START_AT]
            if first is not None:
                cols = [np.concatenate(([f], c)) for f, c in zip(first, cols)]
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = np.zeros(len(new), dtype=bool)
            for c in cols[2:]:
                gone |= c != c[lead]
            first, gone = [c[lead[-1]] for c in cols], gone[len(new) - len(hi) :] | (span & 1 == 1)
            yield batch(schema, [ids[gone], tags[gone], more[gone], span[gone] & ~np.int64(1)])

    dealt = found_passages(docs, min_words).repartition("hi")
    # lower halves sort as numbers with a sign or without, alike in every task
    placed = dealt.sortWithinPartitions("hi", F.shiftright("lo_tag", 32), "id", "tag", "lo_tag", "span")
    return placed.mapInArrow(later, _REPEAT)


def _joined(spans: list[int]) -> list[tuple[int, int]]:
    """Ranges that packed spans cover, neighbours and overlaps joined."""
    out: list[list[int]] = []
    for packed in sorted(spans):
        start, stop = packed >> _START_AT, (packed >> _START_AT) + (packed >> 1 & (1 << _START_AT - 1) - 1)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, min_words: int = 16, slice_bytes: int = 8 << 20) -> DataFrame:
    """The documents, with all their columns and repeated passages removed from
    ``text``, and the columns removed_bytes (of UTF-8) and removed_spans
    (array<struct<start, stop>> in bytes of the old text).

    The first place of a passage keeps it: the smallest doc_id (null first), then
    the hash of the text, then the place; where a passage overlaps itself (a period over
    and over) one period stays.  Rows equal in doc_id and text are one document: all or
    none lose a passage; rows that share a doc_id only, or have none, are told apart by
    160 bits of id and text.  Null texts stay null; empty texts and texts of fewer than
    ``min_words`` words have no passages; an empty table stays empty.  Extra columns
    pass through, but those named like the two results are replaced.  Very long texts
    are read whole; a task holds ``slice_bytes`` of texts, or one text, at a time.
    """
    found = repeats(docs, min_words).groupBy("id", "tag", "tag2").agg(F.collect_set("span").alias("_spans"))
    found = found.select(F.col("id").alias("_i"), F.col("tag").alias("_t"), F.col("tag2").alias("_u"), "_spans")
    own = docs.drop("removed_bytes", "removed_spans")
    at = own.columns.index("text")
    kept = [c for i, c in enumerate(own.columns) if i != at]
    # the texts are shuffled once, packed
    small = T.StructType([*own.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *struct_of("_i bigint, _t bigint, _u int, _packed binary").fields])
    small_schema = arrow_schema(small)
    named = own.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for c, n in zip(_named(own), ("_i", "_t", "_u"))], F.col("text").cast("string").alias("_text"))

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            packed = [None if not t.is_valid else z.compress(t.as_buffer()) if len(t.as_buffer()) else b"" for t in texts]
            yield batch(small_schema, [*[b.column(i).cast(f.type) for i, f in enumerate(small_schema) if i < b.num_columns - 1], pa.array(packed, pa.binary())])

    joined = named.mapInArrow(pack, small).join(found, ["_i", "_t", "_u"], "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in kept], "_packed", "_spans")
    text_type = own.schema.fields[at]
    out = T.StructType([*[own.schema[c] for c in kept], T.StructField("text", T.StringType()), *struct_of("removed_bytes bigint, removed_spans array<struct<start: bigint, stop: bigint>>").fields])
    schema = arrow_schema(out)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, last, size = b.num_columns, 0, 0
            new, cut, gone = [], [], []
            for i, (raw, spans) in enumerate(zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist())):
                raw = z.decompress(raw) if raw else raw
                ranges, parts, end = _joined(spans or ()), [], 0
                for a, e in ranges:
                    parts.append(raw[end:a])
                    end = e
                if ranges:
                    raw = b"".join([*parts, raw[end:]])
                new.append(raw)
                cut.append(sum(e - a for a, e in ranges))
                gone.append([{"start": a, "stop": e} for a, e in ranges])
                size += len(raw or b"")
                if size > slice_bytes or i == b.num_rows - 1:
                    cols = [b.column(k).slice(last, len(new)).cast(schema.field(k).type) for k in range(n - 2)]
                    yield batch(schema, [*cols, pa.array(new, pa.binary()).cast(pa.string()), pa.array(cut, pa.int64()), pa.array(gone, schema.field(len(schema) - 1).type)])
                    last, size, new, cut, gone = i + 1, 0, [], [], []

    done = joined.mapInArrow(run, out)
    text = F.col("text") if isinstance(text_type.dataType, T.StringType) else F.col("text").cast(text_type.dataType)
    return done.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in own.columns], "removed_bytes", "removed_spans")
