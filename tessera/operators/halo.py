"""Reads at constant distances by one exchange.

Points and the arrays that they read are cut into tiles; a cell goes to its own tile and,
near an edge, to the neighbours whose points read it.  In a tile each array is packed
densely, and every read is an access by position, so any number of reads costs one shuffle
of the points and of (1 + halo / tile) times the cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge of a tile, by the number of dimensions (about 4,096 points).
TILE = {1: 4096, 2: 64, 3: 16}


def _tile(c: Column, edge: int) -> Column:
    return F.floor(c / edge).cast("int")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _dense(cells: Column, total: int) -> Column:
    """Values by position from structs (i, v) in order; null where there is no cell."""

    def filled(c: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(c, lambda s: s["i"]))
        gaps = F.zip_with(c, F.slice(before, 1, F.size(c)), lambda s, b: F.concat(F.array_repeat(F.lit(None), s["i"] - b - 1), F.array(s["v"])))
        return F.flatten(gaps)

    return _let(F.array_sort(cells), lambda c: F.when(F.size(c) == total, F.transform(c, lambda s: s["v"])).otherwise(filled(c)))


def gather(points: DataFrame, dims: list[str], reads: list[tuple[DataFrame, str, list[tuple[tuple[int, ...], str]]]], edge: int | None = None) -> DataFrame:
    """``points`` with a column for each read; null where the cell does not exist.

    A read is (cells, value, [(offset, name), ...]): ``cells`` has the columns ``dims``, each
    place once, and a point p gets the value at p + offset as ``name``."""
    edge = edge or TILE.get(len(dims), 8)
    keys = [f"_t{i}" for i in range(len(dims))]
    own = points.select(*[_tile(F.col(d), edge).alias(k) for d, k in zip(dims, keys)], F.struct(*points.columns).alias("_own"), *[F.lit(None).alias(f"_s{r}") for r in range(len(reads))])
    parts, sizes, lows = [own], [], []
    kinds = [cells.schema[value].dataType for cells, value, _ in reads]
    for r, (cells, value, taps) in enumerate(reads):
        lo = [min(o[i] for o, _ in taps) for i in range(len(dims))]
        hi = [max(o[i] for o, _ in taps) for i in range(len(dims))]
        lows.append(lo)
        sizes.append([edge + b - a for a, b in zip(lo, hi)])
        dealt = cells.select(*dims, F.col(value).alias("_v"))
        for d, k, a, b in zip(dims, keys, lo, hi):
            first, last = _tile(F.col(d) - b, edge), _tile(F.col(d) - a, edge)
            dealt = dealt.withColumn(k, first if a == b else F.explode(F.sequence(first, last)))
        at, step = F.lit(0), 1
        for d, k, a, n in zip(dims, keys, lo, sizes[-1]):
            at = at + (F.col(d) - F.col(k) * edge - a) * step
            step *= n
        cell = F.struct(at.cast("int").alias("i"), F.col("_v").alias("v"))
        parts.append(dealt.select(*keys, F.lit(None).alias("_own"), *[cell.alias(f"_s{r}") if q == r else F.lit(None).alias(f"_s{q}") for q in range(len(reads))]))
    both = reduce(DataFrame.union, parts)
    tiles = both.groupBy(*keys).agg(F.collect_list("_own").alias("_own"), *[F.collect_list(f"_s{r}").alias(f"_s{r}") for r in range(len(reads))])
    tiles = tiles.select(*keys, "_own", *[_dense(F.col(f"_s{r}"), reduce(lambda a, b: a * b, sizes[r])).alias(f"_d{r}") for r in range(len(reads))])

    def rows(packed: list[Column]) -> Column:
        def one(p: Column) -> Column:
            out = []
            for r, (_, _, taps) in enumerate(reads):
                at, steps, step = F.lit(0), [], 1
                for d, k, a, n in zip(dims, keys, lows[r], sizes[r]):
                    at = at + (p[d] - F.col(k) * edge - a) * step
                    steps.append(step)
                    step *= n
                by = {name: sum(o * s for o, s in zip(off, steps)) for off, name in taps}
                out.append((r, at, by))

            def read(bases: Column) -> Column:
                cells = [F.get(packed[r], bases[q] + shift).cast(kinds[r]).alias(name) for q, (r, _, by) in enumerate(out) for name, shift in by.items()]
                return F.struct(*[p[c].alias(c) for c in points.columns], *cells)

            return _let(F.array(*[at.cast("int") for _, at, _ in out]), read)

        return F.transform("_own", one)

    names = [*points.columns, *[name for _, _, taps in reads for _, name in taps]]
    return tiles.where(F.size("_own") > 0).select(F.inline(rows([F.col(f"_d{r}") for r in range(len(reads))]))).select(*names)
