"""Packing by concatenating and cutting.

Pass one encodes every document and writes ids with their start inside the
partition; the partitions' token totals are then summed in order, which gives
every document its place in one endless stream without moving a token.  Pass two
cuts the stream at multiples of the sequence length: a document that crosses a
window's edge leaves boundary records in both windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_schema, batch, crc_u32, docs_view, persist, struct_of, text_slices
from .tokens import WordEncoder

#: Partition totals (16 bytes each) are broadcast up to this many partitions, else joined by key.
BROADCAST_PARTS = 1_000_000

_ENCODED = struct_of("part bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids binary")
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, doc_id, local_start, n_tokens, ids: the ids with ``end_id`` after them
    and the number of ids before them in their partition."""
    schema = arrow_schema(_ENCODED)

    def run(batches):
        enc, part, at = WordEncoder.open(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for rows, texts in text_slices(batches):
            ids = [x.tobytes() + end for x in enc.encode_batch(texts)]
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield batch(schema, [np.full(len(n), part), rows.column(0), starts, n, pa.array(ids, pa.binary())])

    return docs_view(docs, "doc_id", "text").mapInArrow(run, _ENCODED)


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of ``seq_len`` tokens; only the last has padding.

    Returns doc_id, start (ids of the document before the piece), length,
    ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, the piece's ids
    as little-endian integers of the tokenizer's width.  Null and empty texts are
    documents of the end id alone; repeated rows are packed as often as they come;
    an empty table gives no pieces; extra columns are ignored; a very long text is one
    row of ids, cut into as many pieces as it fills windows.
    """
    table = persist(encode_documents(docs, tokenizer, end_id), "packing-ids")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    if table.select("part").distinct().count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    placed = table.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "ids")
    out = struct_of(_PIECE + (", ids binary" if with_ids else ""))
    schema = arrow_schema(out)

    def cut(batches):
        dtype = WordEncoder.open(tokenizer).dtype
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = np.frombuffer(raw.as_buffer(), dtype=dtype)
                edges = [0, *range(seq_len - at % seq_len, len(ids), seq_len), len(ids)]
                for lo, hi in zip(edges, edges[1:]):
                    piece = ids[lo:hi]
                    row = (doc, lo, hi - lo, crc_u32(piece), len(ids), (at + lo) // seq_len, (at + lo) % seq_len)
                    for c, v in zip(cols, row + ((piece.tobytes(),) if with_ids else ())):
                        c.append(v)
            yield batch(schema, cols)

    return placed.mapInArrow(cut, out)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, n_pieces, ids: the windows put together.  A group is
    at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), joined.alias("ids"))
