"""Array-style operators on dense lattices: convolution, running sums, reductions along axes, argmax, bins."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..meta import Grid
from .tiles import tiled

#: Cells of a line that are summed in one window.
RUN = 4096


def convolve(df: DataFrame, grid: Grid, weights: dict[tuple[int, ...], float], value: str = "v", out: str = "convolved", batch: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of neighbours at offsets (one number an axis), by the boundary rule; one shuffle for any kernel."""
    axes = grid.axes
    widths = {a: (max(0, -min(o[k] for o in weights)), max(0, max(o[k] for o in weights))) for k, a in enumerate(axes)}
    t = tiled(df, grid, widths, (value,), batch)
    rows, names = t.df, {(): value}
    for k, a in enumerate(axes):
        # partial offsets that some weight needs
        need = sorted({o[: k + 1] for o in weights})
        new = {o: f"_c{'_'.join(str(x).replace('-', 'm') for x in o)}" for o in need}
        rows = rows.withColumns({name: t.neighbour(names[o[:-1]], a, o[-1]) for o, name in new.items()})
        names = new
    total = reduce(lambda p, q: p + q, [F.col(names[o]) * F.lit(float(w)) for o, w in weights.items()])
    return t.own(rows.withColumn(out, total)).select(*batch, *grid.keys, out)


def box_kernel(*sizes: int) -> dict[tuple[int, ...], float]:
    """Equal weights over a centered box."""
    offsets = list(product(*[range(-(n // 2), n - n // 2) for n in sizes]))
    return {o: 1 / len(offsets) for o in offsets}


def running_sum(df: DataFrame, grid: Grid, axis: str, value: str = "v", out: str = "running", batch: tuple[str, ...] = (), run: int = RUN) -> DataFrame:
    """Sum of the values up to each cell along an axis.

    Sums within runs of ``run`` cells, then over the runs' totals, so a line of any length is many tasks.
    """
    keys = [*batch, *[k for k in grid.keys if k != f"i{axis}"]]
    rows = df.withColumn("_run", F.floor(F.col(f"i{axis}") / run).cast("int"))
    within = Window.partitionBy(*keys, "_run").orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(value).over(within))
    totals = df.groupBy(*keys, F.floor(F.col(f"i{axis}") / run).cast("int").alias("_run")).agg(F.sum(value).alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0.0))).drop("_all")
    return rows.join(totals, [*keys, "_run"]).withColumn(out, F.col("_sum") + F.col("_before")).drop("_sum", "_before", "_run")


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def statistics(df: DataFrame, value: str = "v", along: tuple[str, ...] = ()) -> DataFrame:
    """Sum, mean, deviation (of the population), least, greatest, product of non-zero magnitudes' logs, any and all; of finite values."""
    v = finite(F.col(value))
    return df.groupBy(*along).agg(
        F.sum(v).alias("sum"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(v * v / 2).alias("l2"),
        F.max((v != 0).cast("int")).alias("any"),
        F.min((v != 0).cast("int")).alias("all"),
    )


def extreme(df: DataFrame, grid: Grid, value: str = "v", largest: bool = True, along: tuple[str, ...] = ()) -> DataFrame:
    """Indices and value of the greatest or least value; the lowest index of equals."""
    rest = [k for k in grid.keys if k not in along]
    order = F.struct((-F.col(value) if largest else F.col(value)).alias("o"), *rest)
    best = df.where(F.col(value).isNotNull()).groupBy(*along).agg(F.min(order).alias("b"))
    sign = -F.col("b.o") if largest else F.col("b.o")
    return best.select(*along, *[F.col(f"b.{k}").alias(k) for k in rest], sign.alias(value))


def bin_counts(df: DataFrame, value: str, count: int) -> DataFrame:
    """How often each integer from 0 to ``count - 1`` occurs."""
    found = df.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").na.fill(0, ["n"])


def linear_index(grid: Grid) -> Column:
    """One number for each cell, the last axis fastest."""
    out = F.lit(0).cast("long")
    for a, n in grid.resolution.items():
        out = out * n + F.col(f"i{a}")
    return out


def transpose(df: DataFrame, grid: Grid, **axes: str) -> DataFrame:
    """Axes renamed among each other."""
    return df.select(*[F.col(f"i{a}").alias(f"i{axes.get(a, a)}") for a in grid.axes], *[c for c in df.columns if c not in grid.keys])


def flip(df: DataFrame, grid: Grid, *axes: str) -> DataFrame:
    return df.withColumns({f"i{a}": F.lit(grid.resolution[a] - 1) - F.col(f"i{a}") for a in axes})
