"""Array files: NPY, PNG, TIFF, MAT, PNM (P2, P3, P5, P6) and raw dumps, one file a task record.

Files are read through Spark's ``binaryFile`` source and decoded in Arrow batches, and
written by tasks' results through the driver for single arrays.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import F32, F64, I8, I16, I32, I64, U8, U16, U32, ElementType
from ..operators.table import ArrayTable
from ..plans.region import Range
from . import formats

_TYPES = {"u1": U8, "u2": U16, "u4": U32, "i1": I8, "i2": I16, "i4": I32, "i8": I64, "f4": F32, "f8": F64}
#: Type codes of the raw format's header (fixed, in this order).
_RAW = ("f4", "f8", "u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8")


def decode(name: str, data: bytes) -> np.ndarray:
    """Axes in the order of coordinates: x first."""
    if name.endswith(".npy"):
        return np.load(io.BytesIO(data), allow_pickle=False).T
    if name.endswith(".tmp"):
        *shape, code = struct.unpack_from("<5i", data)
        return np.frombuffer(data, dtype="<" + _RAW[code], offset=20).reshape(shape[::-1]).T
    if re.search(r"\.p[gpn]m$", name):
        return _decode_pnm(data)
    if name.endswith(".png"):
        return formats.decode_png(data)
    if name.endswith((".tif", ".tiff")):
        return formats.decode_tiff(data)
    if name.endswith(".mat"):
        return formats.decode_mat(data)
    raise ValueError(f"no decoder for {name}")


def _decode_pnm(data: bytes) -> np.ndarray:
    head = re.match(rb"(P[2356])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("not a PNM file")
    kind, w, h, top = head[1], int(head[2]), int(head[3]), int(head[4])
    c = 3 if kind in (b"P3", b"P6") else 1
    dtype = np.dtype(">u2" if top > 255 else "u1")
    if kind in (b"P2", b"P3"):
        flat = np.array(data[head.end() :].split()[: w * h * c], dtype=int).astype(dtype.newbyteorder("="))
    else:
        flat = np.frombuffer(data, dtype=dtype, count=w * h * c, offset=head.end()).astype(dtype.newbyteorder("="))
    a = flat.reshape(h, w, c)
    return a[:, :, 0].T if c == 1 else a.transpose(1, 0, 2)


def encode(name: str, a: np.ndarray) -> bytes:
    if name.endswith(".npy"):
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(a.T))
        return out.getvalue()
    if name.endswith(".tmp"):
        shape = (*a.shape, 1, 1, 1, 1)[:4]
        code = _RAW.index(a.dtype.str[1:])
        return struct.pack("<5i", *shape, code) + np.ascontiguousarray(a.T).tobytes()
    if name.endswith((".pgm", ".ppm")):
        top = 255 if a.dtype.itemsize == 1 else 65535
        rows = a.T if a.ndim == 2 else a.transpose(1, 0, 2)
        head = f"{'P5' if a.ndim == 2 else 'P6'}\n{a.shape[0]} {a.shape[1]}\n{top}\n".encode()
        return head + np.ascontiguousarray(rows.astype(">u2" if top > 255 else "u1")).tobytes()
    if name.endswith(".png"):
        return formats.encode_png(a)
    if name.endswith((".tif", ".tiff")):
        return formats.encode_tiff(a)
    if name.endswith(".mat"):
        return formats.encode_mat(a)
    raise ValueError(f"no encoder for {name}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """file, c0, c1, c2, c3, v of every point of the files that match the path; absent
    coordinates are 0."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                a = decode(name, bytes(content))
                at = np.indices(a.shape).reshape(a.ndim, -1)
                cols = {f"c{i}": at[i] if i < a.ndim else np.zeros(a.size, dtype=int) for i in range(4)}
                yield pd.DataFrame({"file": name, **cols, "v": a.reshape(-1).astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, c0 int, c1 int, c2 int, c3 int, v double")


def load_array(spark: SparkSession, path: str, dims: tuple[str, ...], type: ElementType) -> ArrayTable:
    df = load(spark, path)
    top = df.agg(*[F.max(f"c{i}") for i in range(len(dims))]).first()
    r = tuple(Range(0, (t if t is not None else -1) + 1) for t in top)
    return ArrayTable(df.select(*[F.col(f"c{i}").alias(d) for i, d in enumerate(dims)], F.col("v").cast(type.spark).alias("v")), dims, ("v",), (type,), r)


def from_numpy(spark: SparkSession, a: np.ndarray, dims: tuple[str, ...], reverse_axes: bool = True) -> ArrayTable:
    """An array in memory; numpy's last axis is the first coordinate."""
    import pandas as pd

    a = a.T if reverse_axes else a
    at = np.indices(a.shape).reshape(a.ndim, -1)
    pdf = pd.DataFrame({**{d: at[i].astype("int32") for i, d in enumerate(dims)}, "v": a.reshape(-1)})
    type = _TYPES[a.dtype.str[1:]]
    df = spark.createDataFrame(pdf).withColumn("v", F.col("v").cast(type.spark))
    return ArrayTable(df, dims, ("v",), (type,), tuple(Range(0, n) for n in a.shape))


def to_numpy(a: ArrayTable) -> np.ndarray:
    """A small array on the driver; x is the last axis."""
    pdf = a.df.select(*a.dims, *a.values).toPandas()
    out = np.zeros([r.extent for r in a.region])
    out[tuple(pdf[d].to_numpy() - r.min for d, r in zip(a.dims, a.region))] = pdf[a.values[0]]
    return out.T


def save(a: ArrayTable, path: str) -> None:
    kind = {v: k for k, v in _TYPES.items()}[a.types[0]]
    with open(path, "wb") as f:
        f.write(encode(path, to_numpy(a).T.astype(kind)))


def write_bands(a: ArrayTable, format: str, rows: int, path: str | None = None) -> DataFrame:
    """file, y0, content: a two-dimensional array cut into bands of ``rows`` rows, each a file
    of the format, encoded where it is; written below ``path`` (a folder that all machines
    share, as Parquet of names and bytes) if there is one."""
    kind = np.dtype({v: k for k, v in _TYPES.items()}[a.types[0]])
    x, y = a.dims
    x0, width = a.region[0].min, a.region[0].extent

    def run(frame):
        import pandas as pd

        y0 = int(frame["_b"].iloc[0]) * rows
        out = np.zeros((width, int(frame[y].max()) - y0 + 1), dtype=kind)
        out[frame[x].to_numpy() - x0, frame[y].to_numpy() - y0] = frame["v"].to_numpy()
        name = f"band-{y0:09d}.{format}"
        return pd.DataFrame({"file": [name], "y0": [y0], "content": [encode(name, out)]})

    bands = a.df.select(x, y, F.col(a.values[0]).alias("v"), F.floor(F.col(y) / rows).cast("int").alias("_b"))
    out = bands.groupBy("_b").applyInPandas(run, "file string, y0 int, content binary")
    if path is not None:
        out.write.parquet(path)
        out = a.df.sparkSession.read.schema("file string, y0 int, content binary").parquet(path)
    return out


def load_bands(files: DataFrame, format: str) -> DataFrame:
    """x, y, v of the bands."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for name, y0, content in zip(f["file"], f["y0"], f["content"]):
                a = decode(name, bytes(content))
                at = np.indices(a.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"x": at[0].astype("int32"), "y": (at[1] + y0).astype("int32"), "v": a.reshape(a.shape[0] * a.shape[1], -1)[:, 0].astype(float)})

    return files.mapInPandas(run, "x int, y int, v double")


def convert_image(a: ArrayTable, to: ElementType) -> ArrayTable:
    """Full range to full range: 1.0 of a float is an integer's greatest value."""
    frm, v = a.types[0], F.col(a.values[0])
    if frm == to:
        return a
    if to.is_float:
        new = v if frm.is_float else v.cast("double") / float(frm.max)
    elif frm.is_float:
        new = F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)).cast("double") * float(to.max) + 0.5)
    else:
        new = F.floor(v.cast("double") * float(to.max) / float(frm.max) + 0.5)
    return a._with(a.df.withColumn(a.values[0], new.cast(to.spark)), types=(to, *a.types[1:]))
