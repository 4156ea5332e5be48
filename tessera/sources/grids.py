"""Grids over the star-schema tables, and generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.types import F32, I64, ElementType
from ..operators.table import ArrayTable, domain
from ..plans.region import Range, box

WIDTH = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str, region: bool = False) -> ArrayTable:
    """events as an image 100 wide: v = least(255, floor(value / 2)).  ``region``: also
    find its height (one small aggregate)."""
    e = read(spark, sf_dir, "events")
    df = e.select(F.pmod("event_id", F.lit(WIDTH)).cast("int").alias("x"), F.call_function("div", F.col("event_id"), F.lit(WIDTH)).cast("int").alias("y"), F.least(F.lit(255), F.floor(F.col("value") / 2)).cast("bigint").alias("v"))
    r = None
    if region:
        top = e.agg(F.max("event_id")).first()[0]
        r = (Range(0, WIDTH), Range(0, (top or 0) // WIDTH + 1))
    return ArrayTable(df, ("x", "y"), ("v",), (I64,), r)


def embedding(spark: SparkSession, sf_dir: str) -> ArrayTable:
    e = read(spark, sf_dir, "embeddings")
    return ArrayTable(e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("d", "v")).withColumn("v", F.col("v").cast("double")), ("i", "d"))


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by key: k, cents."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("size"))


def synthetic(spark: SparkSession, spec: str, dims: tuple[str, ...], region) -> ArrayTable:
    """``zero:``, ``constant:VALUE``, ``identity:`` (1 on the diagonal) or ``random:SEED``
    over a box."""
    kind, _, arg = spec.partition(":")
    r = box(*region)
    points = domain(spark, list(dims), r)
    if kind == "random":
        v = E.random_float([E.col(d, ElementType("int", 32)) for d in dims], int(arg or 0)).column()
    elif kind == "identity":
        v = F.lit(True)
        for d in dims[1:]:
            v = v & (F.col(d) == F.col(dims[0]))
        v = v.cast("int")
    elif kind in ("zero", "constant"):
        v = F.lit(float(arg) if kind == "constant" else 0.0)
    else:
        raise ValueError(f"no source {kind!r}")
    return ArrayTable(points.withColumn("v", v.cast("float")), dims, ("v",), (F32,), r)
