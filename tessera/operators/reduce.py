"""Reductions, histograms, scans and scatters over arrays.

Associative updates become ``groupBy`` aggregates, which Spark computes partially
before the shuffle; order-dependent ones become windows whose partitions are the
coordinates that stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import I64, ElementType, clamp_to, wrap
from ..plans.region import box
from .table import ArrayTable, domain


def grouped(a: DataFrame, keys: list[str], aggs: list[Column], over: DataFrame | None = None, empty: dict | None = None) -> DataFrame:
    """``groupBy(keys).agg``; with ``over``, a row for each of its keys, and ``empty``
    values where a group has no rows."""
    out = a.groupBy(*keys).agg(*aggs)
    if over is not None:
        out = over.join(out, keys, "left").fillna(empty or {}) if keys else out
    return out


def sum_(v: Column, type: ElementType = I64) -> Column:
    """Sum in the element's type: integers wrap, an empty sum is 0."""
    if type.is_float:
        return F.coalesce(F.sum(v), F.lit(0.0)).cast(type.spark)
    return wrap(F.coalesce(F.sum(v.cast("decimal(20,0)" if type.bits > 32 else "bigint")), F.lit(0)), type)


def saturating_sum(v: Column, type: ElementType) -> Column:
    """For values of one sign, where the order cannot matter."""
    return clamp_to(F.coalesce(F.sum(v.cast("bigint")), F.lit(0)), type)


def saturating_fold(v: Column, order: Column, type: ElementType) -> Column:
    """Saturating at each step, in order; for values of mixed signs.  A group is folded in
    one task's memory."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.cast("bigint").alias("v")))), lambda s: s["v"])
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: clamp_to(acc + x, type).cast("bigint")).cast(type.spark)


#: Values folded together at a time; also the reach of one level of ``associative``.
_FOLD_BITS = 12


def associative(df: DataFrame, keys: list[str], fields: dict[str, Column], identity: dict[str, Column], combine) -> DataFrame:
    """keys and, for each group, the fold of its rows by an associative and commutative
    operation: ``combine(a, b)`` takes two structs of the fields and gives the columns of
    theirs, starting from ``identity``.

    A group is never gathered: 4,096 rows that were read together are folded at a time,
    then 4,096 of their results, then what is left (a row for each 16 million rows), so
    the parts of a hot key are dealt over all tasks."""
    names = list(fields)
    types = {k: df.select(c.alias(k)).schema[k].dataType for k, c in identity.items()}
    now = df.select(*keys, *[c.cast(types[k]).alias(k) for k, c in fields.items()], F.monotonically_increasing_id().alias("_id"))
    start = F.struct(*[c.cast(types[k]).alias(k) for k, c in identity.items()])

    def step(acc: Column, x: Column) -> Column:
        new = combine(acc, x)
        return F.struct(*[new[k].cast(types[k]).alias(k) for k in names])

    for level in (1, 2, 3):
        part = [] if level == 3 else [F.shiftright("_id", _FOLD_BITS).alias("_id")]
        grouped = now.groupBy(*keys, *part).agg(F.collect_list(F.struct(*names)).alias("_l"))
        folded = grouped.withColumn("_s", F.aggregate("_l", start, step))
        now = folded.select(*keys, *([] if level == 3 else ["_id"]), *[F.col(f"_s.{k}").alias(k) for k in names])
    return now


def times(a: Column, b: Column, type: ElementType) -> Column:
    """Product of two whole numbers modulo 2^bits, exact on the way: 64 by 64 bits fits
    38 digits when both are taken as signed."""
    if type.bits <= 32:
        low = lambda c: wrap(c, ElementType("int", 32)).cast("bigint")
        return wrap(low(a) * low(b), type)
    signed = [wrap(c, I64).cast("decimal(38,0)") for c in (a, b)]
    return wrap(signed[0] * signed[1], type)


def product_by(df: DataFrame, keys: list[str], v: Column, type: ElementType = I64, out: str = "v") -> DataFrame:
    """Products of groups in the element's type: integers wrap, an empty product is 1."""
    if type.is_float:
        return df.groupBy(*keys).agg(F.product(v).cast(type.spark).alias(out))
    one = F.lit(1).cast(type.spark)
    return associative(df, keys, {out: v}, {out: one}, lambda a, b: {out: times(a[out], b[out], type)})


def complex_product_by(df: DataFrame, keys: list[str], re: Column, im: Column) -> DataFrame:
    """Products of complex numbers: columns re and im, as doubles."""
    def mul(a, b):
        return {"re": a["re"] * b["re"] - a["im"] * b["im"], "im": a["re"] * b["im"] + a["im"] * b["re"]}

    return associative(df, keys, {"re": re, "im": im}, {"re": F.lit(1.0), "im": F.lit(0.0)}, mul)


def product(v: Column, type: ElementType = I64) -> Column:
    """As an aggregate column, for floats, and for integers whose products stay below
    2^53; ``product_by`` is exact for all."""
    if type.is_float:
        return F.coalesce(F.product(v), F.lit(1.0)).cast(type.spark)
    whole = F.coalesce(F.product(v.cast("double")), F.lit(1.0))
    return F.when(F.abs(whole) < float(1 << 53), whole).otherwise(F.raise_error(F.lit("a long product: use product_by")).cast("double")).cast("bigint").cast(type.spark)


def maximum(v: Column, type: ElementType) -> Column:
    return F.coalesce(F.max(v), F.lit(type.min).cast(type.spark))


def minimum(v: Column, type: ElementType) -> Column:
    return F.coalesce(F.min(v), F.lit(type.max).cast(type.spark))


def maximum_nan(v: Column) -> Column:
    """Greatest float; nan if any is (Spark counts nan as the greatest)."""
    return F.max(v)


def minimum_nan(v: Column) -> Column:
    """Least float; nan if any is."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


def maximum_number(v: Column) -> Column:
    """Greatest of the floats that are numbers; nan if none is."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def argmax(v: Column, order: list[Column]) -> Column:
    """Struct of the first greatest value: v and the order columns o0, o1, ... (compared
    as given, negated so that the first wins)."""
    return F.max(F.struct(v.alias("v"), *[(-o).alias(f"n{i}") for i, o in enumerate(order)]))


def argmin(v: Column, order: list[Column]) -> Column:
    return F.min(F.struct(v.alias("v"), *[o.alias(f"o{i}") for i, o in enumerate(order)]))


def histogram(df: DataFrame, bins: dict[str, tuple[Column, int]], weight: Column | None = None) -> DataFrame:
    """Counts (or summed weights) ``n`` in every bin of a box: ``bins`` names columns with
    their index and number; indices are clamped into it."""
    keyed = df.select(*[F.greatest(F.least(c, F.lit(n - 1)), F.lit(0)).cast("int").alias(k) for k, (c, n) in bins.items()], (F.lit(1) if weight is None else weight).alias("_w"))
    counts = keyed.groupBy(*bins).agg(F.sum("_w").cast("bigint").alias("n"))
    every = domain(df.sparkSession, list(bins), box(*[n for _, n in bins.values()]))
    return every.join(counts, list(bins), "left").fillna({"n": 0})


def rfactor_sum(df: DataFrame, keys: list[str], part: Column, value: Column, type: ElementType = I64) -> DataFrame:
    """Two explicit levels: partial sums by (keys, part), then by keys.  ``part`` splits
    hot keys over tasks."""
    partial = df.withColumn("_u", part).groupBy(*keys, "_u").agg(F.sum(value).alias("_p"))
    return partial.groupBy(*keys).agg(sum_(F.col("_p"), type).alias("v"))


def scan(a: ArrayTable, d, agg=F.sum, reverse: bool = False, out: str = "v") -> ArrayTable:
    """Running aggregate along a dimension, the others in place."""
    c = a.dims[a._at(d)]
    order = F.col(c).desc() if reverse else F.col(c).asc()
    w = Window.partitionBy(*[x for x in a.dims if x != c]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return a._with(a.df.withColumn(out, agg(a.values[0]).over(w)), values=(out,), types=(I64,) if agg is F.sum and not a.types[0].is_float else a.types[:1])


def long_scan(df: DataFrame, order: str, value: Column, block: int, out: str = "v", most_blocks: int = 100_000) -> DataFrame:
    """Prefix sums over one long dimension without one task for all rows: blocks of the
    coordinate are summed, the block sums are scanned, and each block adds its own base.
    Where there can be more than ``most_blocks`` blocks their sums are scanned the same
    way, block by block.  ``order`` is a whole-number column."""
    b = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_x", value)
    sums = b.groupBy("_b").agg(F.sum("_x").alias("_s"))
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is not None and (hi - lo) // block >= most_blocks:
        below = long_scan(sums.select(F.col("_b").alias("_o"), F.col("_s").alias("_own")), "_o", F.col("_own"), block, "_sum", most_blocks)
        base = below.select(F.col("_o").alias("_b"), (F.col("_sum") - F.col("_own")).alias("_base"))
    else:
        base = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(base, "_b").withColumn(out, (F.col("_base") + F.sum("_x").over(inside))).drop("_b", "_x", "_base")


#: Places of a line that one task scans.
_SCAN_BLOCK = 1 << 17


def wrapped_scan(df: DataFrame, keys: list[str], order: str, value: Column, type: ElementType, extent: int, out: str = "v") -> DataFrame:
    """Running sums in an integer type along a whole-number ``order`` of up to ``extent``
    places within each group; null from the first null value on.

    64-bit values are summed as two halves, so that nothing overflows and no decimals are
    needed.  A line of more than ``_SCAN_BLOCK`` places is cut into blocks: each is scanned
    by itself and adds the sums of those before it."""
    wide, mask = type.bits > 32, F.lit((1 << 32) - 1)
    v = F.col("_x")
    parts = {"_h": F.shiftright(v, 32), "_l": v.bitwiseAND(mask)} if wide else {"_l": v}
    rows = df.withColumn("_x", wrap(value, I64) if wide and type.is_uint else value.cast("bigint"))
    aggs = {k: F.sum(F.coalesce(c, F.lit(0).cast("bigint"))) for k, c in parts.items()} | {"_n": F.max(v.isNull())}
    none = {k: F.lit(False) if k == "_n" else F.lit(0).cast("bigint") for k in aggs}
    long = extent > _SCAN_BLOCK
    if long:
        rows = rows.withColumn("_b", F.floor(F.col(order) / _SCAN_BLOCK))
        ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*keys, "_b").agg(*[a.alias(f"_s{k}") for k, a in aggs.items()])
        base = sums.select(*keys, "_b", *[F.coalesce((F.max if k == "_n" else F.sum)(f"_s{k}").over(ahead), none[k]).alias(f"_a{k}") for k in aggs])
    inside = Window.partitionBy(*keys, *(["_b"] if long else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[a.over(inside).alias(k) for k, a in aggs.items()])
    got = {k: F.col(k) for k in aggs}
    if long:
        rows = rows.join(base, [*keys, "_b"])
        got = {k: c | F.col(f"_a{k}") if k == "_n" else c + F.col(f"_a{k}") for k, c in got.items()}
    if wide:
        whole = F.shiftleft(got["_h"] + F.shiftright(got["_l"], 32), 32).bitwiseOR(got["_l"].bitwiseAND(mask))
        whole = wrap(whole, type) if type.is_uint else whole
    else:
        whole = wrap(got["_l"], type)
    return rows.select(*[c for c in df.columns if c != out], F.when(~got["_n"], whole).alias(out))


def moving(a: ArrayTable, d, before: int, after: int, agg=F.sum, block: int = 4096) -> ArrayTable:
    """Aggregate over [x - before, x + after] along a dimension; ``agg`` may be a dict of
    result names and aggregates, computed in one pass.  A long dimension is cut
    into blocks whose edge rows are copied to the neighbour, so windows stay short."""
    c = a.dims[a._at(d)]
    aggs = agg if isinstance(agg, dict) else {a.values[0]: agg}
    reach = max(before, after)
    own = F.floor(F.col(c) / block)
    copies = F.array_distinct(F.array(F.floor((F.col(c) - reach) / block), own, F.floor((F.col(c) + reach) / block)))
    dealt = a.df.select(*a.dims, F.col(a.values[0]).alias("_v"), own.alias("_own"), F.explode(copies).alias("_b"))
    w = Window.partitionBy(*[x for x in a.dims if x != c], "_b").orderBy(c).rangeBetween(-before, after)
    out = dealt.select("*", *[f("_v").over(w).alias(k) for k, f in aggs.items()]).where("_b = _own")
    return a._with(out.select(*a.dims, *aggs), values=tuple(aggs), types=a.types[:1] * len(aggs))


def summed_area(a: ArrayTable) -> ArrayTable:
    return scan(scan(a, 0), 1)


def compact(df: DataFrame, keep: Column, order: str, block: int = 100_000) -> DataFrame:
    """Rows with ``keep``, with their place among them in column ``slot``."""
    kept = df.where(keep).withColumn("_one", F.lit(1).cast("bigint"))
    return long_scan(kept, order, F.col("_one"), block, "slot").withColumn("slot", F.col("slot") - 1).drop("_one")


def scatter(init: DataFrame, updates: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Last writer wins: of the updates of a point that with the greatest ``order`` is
    stored; other points keep what ``init`` has."""
    last = updates.groupBy(*keys).agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_new"))
    return init.join(last, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def affine_scan(df: DataFrame, keys: list[str], order: str, value: Column, factor: Column, block: int = 512, reverse: bool = False, out: str = "v") -> DataFrame:
    """Linear recurrence acc = factor * acc + value along a whole-number ``order``, from 0,
    within each group: keys, order, out as doubles.

    A block of ``block`` places is one map of the value before it, acc -> m * acc + s.
    Blocks are scanned inside, each in a task of its own; then each one folds the maps of
    those before it, which is all that one task sees of a series, and every row adds what
    its block began with."""
    sign = -1 if reverse else 1
    rows = df.select(*keys, order, value.cast("double").alias("_x"), factor.cast("double").alias("_f"), F.floor(F.col(order) * sign / block).alias("_b"))
    steps = F.array_sort(F.collect_list(F.struct((F.col(order) * sign).alias("o"), F.col("_x").alias("x"), F.col("_f").alias("f"))))
    inside = rows.groupBy(*keys, "_b").agg(steps.alias("_i"))
    start = F.expr("named_struct('m', 1D, 's', 0D, 'all', cast(array() as array<struct<m:double,s:double>>))")

    def one(acc: Column, it: Column) -> Column:
        m, s = acc["m"] * it["f"], acc["s"] * it["f"] + it["x"]
        return F.struct(m.alias("m"), s.alias("s"), F.concat(acc["all"], F.array(F.struct(m.alias("m"), s.alias("s")))).alias("all"))

    inside = inside.withColumn("_r", F.aggregate("_i", start, one))
    inside = inside.select(*keys, "_b", "_i", F.col("_r.m").alias("_m"), F.col("_r.s").alias("_s"), F.col("_r.all").alias("_all"))
    # one pass over the blocks in order: each takes the maps of those before it
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    done = inside.withColumn("_before", F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_s").alias("s"))).over(ahead))
    done = done.withColumn("_base", F.aggregate("_before", F.lit(0.0), lambda acc, it: it["m"] * acc + it["s"]))
    pairs = F.zip_with("_i", "_all", lambda i, r: F.struct((i["o"] * sign).alias(order), r["m"].alias("m"), r["s"].alias("s")))
    return done.select(*keys, "_base", F.inline(pairs)).select(*keys, order, (F.col("m") * F.col("_base") + F.col("s")).alias(out))


def fold(df: DataFrame, keys: list[str], order: str, value: Column, init: Column, step, out: str = "v", block: int = 256) -> DataFrame:
    """Recurrence along ``order`` within each group: acc = step(acc, value); a row with
    the accumulator after each step.  A group's rows are put together in pieces of
    ``block``; a piece's history is copied at each of its steps, the whole one's never.
    A group is one array, so groups stay within a task's memory (rows of an image, series
    of a sensor); for linear steps ``affine_scan`` has no such bound."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("x"))))
    g = df.groupBy(*keys).agg(items.alias("_i"))
    kind = df.select(init.alias("i")).schema["i"].dataType
    whole = f"cast(array() as array<array<{kind.simpleString()}>>)"
    start = F.struct(init.cast(kind).alias("acc"), F.expr(whole).alias("all"))
    own = F.expr(f"cast(array() as array<{kind.simpleString()}>)")

    def one(acc, it):
        new = step(acc["acc"], it["x"]).cast(kind)
        return F.struct(new.alias("acc"), F.concat(acc["all"], F.array(new)).alias("all"))

    def piece(acc, at):
        part = F.aggregate(F.slice("_i", at * block + 1, block), F.struct(acc["acc"].alias("acc"), own.alias("all")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["acc"].alias("acc"), F.concat(acc["all"], F.array(p["all"])).alias("all")))[0]

    pieces = F.sequence(F.lit(0), F.floor((F.size("_i") - 1) / block).cast("int"))
    runs = F.aggregate(pieces, start, piece, lambda acc: F.flatten(acc["all"]))
    pairs = F.arrays_zip(F.transform("_i", lambda s: s["o"]).alias(order), runs.alias(out))
    return g.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col(f"_p.{order}").alias(order), F.col(f"_p.{out}").alias(out))
