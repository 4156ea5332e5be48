"""Storage shared by driver and executors, and small Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_TYPES = {"doc_id": "bigint", "text": "string"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is empty and the master is local (tests), a temporary
    folder is made and the setting is filled in; a cluster must name one, since
    its machines share no local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it: cuts lineage,
    outlives lost executors, and fixes rows whose order or content must not
    change between passes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """Write raw bytes through Spark's own text writer, one file a partition.

    Rows follow each other in the partition's order and each is followed by one
    newline byte, which formats on top must count.  Going through the writer
    gives any Hadoop file system, task commits and safe retries.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("compression", "none").text(path)


def docs_view(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in their types: clashing extra columns never matter."""
    return docs.select(*[F.col(f"`{c}`").cast(DOC_TYPES.get(c, "string")).alias(c) for c in columns])


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


_TYPES = {"bigint": T.LongType, "int": T.IntegerType, "string": T.StringType, "binary": T.BinaryType, "double": T.DoubleType, "boolean": T.BooleanType}


def struct_of(spec: str) -> T.StructType:
    """Schema from "name type, ..." with flat types and `x` of them;
    unlike ``fromDDL`` it needs no session, so workers can import what it defines."""
    fields = []
    for name, kind in re.findall(r"(\w+):? ((?:array<struct<.*?>>)|\w+)", spec):
        nested = re.fullmatch(r"array<struct<(.*)>>", kind)
        fields.append(T.StructField(name, T.ArrayType(struct_of(nested[1])) if nested else _TYPES[kind]()))
    return T.StructType(fields)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def text_slices(batches, max_chars: int = 8 << 20):
    """(batch slice, texts as str with null as None), at most about ``max_chars``
    of text at a time, so that memory does not depend on how rows are batched.  What
    Arrow's pool keeps of a batch's temporaries goes back to the system after it."""
    pool = pa.default_memory_pool()
    for b in batches:
        column = b.column(b.schema.get_field_index("text"))
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + max_chars, side="right")))
            part = b.slice(start, stop - start)
            yield part, column.slice(start, stop - start).to_pylist()
            start = stop
        pool.release_unused()


def quiet_env() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


import pyarrow.compute  # noqa: E402,F401  (pa.compute is used above)
