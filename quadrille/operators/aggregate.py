"""Reductions of fields and curves: plain aggregations that combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..meta import Grid
from .lattice import centers
from .solve import cut

#: Rows of a curve that are averaged in one window.
RUN = 4096


def mean(df: DataFrame, value: str = "v", volume: str | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """Mean over cells or elements, weighted by a volume column off grids."""
    v = F.col(value)
    out = F.avg(v) if volume is None else F.sum(v * F.col(volume)) / F.sum(volume)
    return df.groupBy(*batch).agg(out.alias("mean"))


def center_of_mass(df: DataFrame, grid: Grid, density: str = "v", batch: tuple[str, ...] = ()) -> DataFrame:
    """Density-weighted mean position; null where the density sums to 0."""
    total = F.sum(density)
    parts = [F.when(total != 0, F.sum(c * F.col(density)) / total).alias(a) for a, c in centers(grid).items()]
    return df.groupBy(*batch).agg(*parts)


def integrate(df: DataFrame, grid: Grid, inside: Column | None = None, value: str = "v", batch: tuple[str, ...] = ()) -> DataFrame:
    """Integral over the cells whose center is ``inside`` (a condition on x, y, z), or over all."""
    rows = df.withColumns(centers(grid))
    rows = rows.where(inside) if inside is not None else rows
    return rows.groupBy(*batch).agg((F.coalesce(F.sum(value), F.lit(0.0)) * F.lit(grid.cell_volume)).alias("integral"))


def discretize(df: DataFrame, grid: Grid, fraction: float = 0.25, value: str = "v", batch: tuple[str, ...] = ()) -> DataFrame:
    """1 for the ``fraction`` of cells with the largest values, else 0; ties go to the lower index.

    The rank is global, yet rows are not brought together: cells are counted by
    value, and only the values' counts are accumulated, in two levels.
    """
    count = int(fraction * grid.size)
    at = [F.col(k) for k in grid.keys]
    linear = F.lit(0).cast("long")
    for k, n in zip(grid.keys, grid.resolution.values(), strict=True):
        linear = linear * n + F.col(k)
    df = df.withColumn("_at", linear)
    cut = threshold_of_rank(df.select(*batch, value, "_at"), value, "_at", count, batch)
    joined = df.join(F.broadcast(cut), list(batch)) if batch else df.crossJoin(F.broadcast(cut))  # one row a batch
    top = (F.col(value) > F.col("_cut")) | ((F.col(value) == F.col("_cut")) & (F.col("_at") <= F.col("_tie")))
    return joined.select(*batch, *at, F.when(F.col("_n") > 0, top.cast("int")).otherwise(0).alias("mark"))


def running_total(df: DataFrame, order: Sequence[Column], weight: Column, out: str, batch: tuple[str, ...] = ()) -> DataFrame:
    """The sum of ``weight`` over all rows up to each in an order without ties, per batch.

    Rows are dealt by ranges of the order and summed within them; the ranges'
    totals (a row a partition and batch) give what lies before each.  The dealt
    rows are kept with their range in the checkpoint folder: ranges come from a
    sample, so dealt twice, a row could be in another one.
    """
    ranged = cut(df.repartitionByRange(*[F.col(b) for b in batch], *order).withColumn("_p", F.spark_partition_id()))
    within = Window.partitionBy("_p", *batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("_in", F.sum(weight).over(within)).withColumn("_w", weight)
    heads = run.groupBy("_p", *batch).agg(F.sum("_w").alias("_all"))
    before = Window.partitionBy(*batch).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_p", *batch, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in ("_p", *batch)]
    both = run.alias("_l").join(F.broadcast(heads).alias("_h"), reduce(lambda a, b: a & b, same))
    return both.select(*[F.col(f"_l.`{c}`") for c in df.columns], (F.col("_in") + F.col("_before")).alias(out))


def threshold_of_rank(df: DataFrame, value: str, tie: str, count: int, batch: tuple[str, ...] = ()) -> DataFrame:
    """Per batch the value (``_cut``) and tie-breaker (``_tie``) of the row with rank ``count`` from the top."""
    counts = df.groupBy(*batch, value).agg(F.count("*").alias("n"))
    # how many rows have a larger value: a running count over distinct values
    ranks = running_total(counts, [F.desc(value)], F.col("n"), "_to", batch).withColumn("_from", F.col("_to") - F.col("n"))
    cut = ranks.where((F.col("_from") < count) & (F.col("_to") >= count)).select(
        *batch, F.col(value).alias("_cut"), (F.lit(count) - F.col("_from")).alias("_n")
    )
    ties = df.join(F.broadcast(cut), list(batch)) if batch else df.crossJoin(F.broadcast(cut))  # one row a batch
    # a constant field is one tie, so ties are counted by ranges too
    ranked = running_total(ties.where(F.col(value) == F.col("_cut")), [F.col(tie)], F.lit(1), "_r", batch).where("_r = _n")
    return ranked.select(*batch, "_cut", F.col(tie).alias("_tie"), "_n")


def normalize(df: DataFrame, reference: DataFrame, value: str = "v", epsilon: float = 1e-5) -> DataFrame:
    """Scaled so that the sum equals the reference's."""
    sums = df.agg(F.sum(value).alias("_own")).crossJoin(F.broadcast(reference.agg(F.sum(value).alias("_ref"))))  # one row each
    scaled = F.col(value) * (F.col("_ref") / F.greatest(F.col("_own"), F.lit(epsilon)))
    return df.crossJoin(F.broadcast(sums)).withColumn(value, scaled).drop("_own", "_ref")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """Count (or summed weight) in each of ``bins`` equal bins; the upper end belongs to the last. Empty bins have a row.

    No row is left out, so weights sum to the whole: bin -1 has what is below
    ``low``, bin ``bins`` what is above ``high``, and a null bin the nulls and
    NaNs.  These three have a row only if something is in them.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    inside = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    index = F.when(v < low, -1).when(v > high, bins).when(v.isNotNull(), inside)
    w = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    found = df.groupBy(index.alias("bin")).agg(w.alias("weight"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "full").na.fill(0.0, ["weight"])


def smooth(df: DataFrame, order: str, value: str, n: int, batch: tuple[str, ...] = (), run: int = RUN) -> DataFrame:
    """Centered moving average over ``n`` rows of a curve, over those there are near the ends.

    A curve is cut into runs of ``run`` rows, which get the rows beside them, so one of any length is many tasks.
    """
    before, after = n // 2, (n - 1) // 2
    at = F.col("_r") - 1
    ranked = running_total(df, [F.col(order)], F.lit(1), "_r", batch)
    runs = F.sequence(F.floor((at - after) / run), F.floor((at + before) / run))
    copies = ranked.withColumn("_run", F.explode(runs))
    w = Window.partitionBy(*batch, "_run").orderBy("_r").rowsBetween(-before, after)
    smoothed = copies.withColumn("smooth", F.avg(value).over(w))
    return smoothed.where(F.col("_run") == F.floor(at / run)).drop("_r", "_run")


def down_sample(df: DataFrame, order: str, every: int, batch: tuple[str, ...] = ()) -> DataFrame:
    """Every ``every``-th row of a curve, and the last."""
    ranked = running_total(df, [F.col(order)], F.lit(1), "_r", batch)
    last = df.groupBy(*batch).agg(F.count("*").alias("_last"))
    if batch:
        same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in batch])
        ranked = ranked.alias("_l").join(last.alias("_h"), same).select(*[F.col(f"_l.`{c}`") for c in ranked.columns], "_last")
    else:
        ranked = ranked.crossJoin(F.broadcast(last))  # one row
    return ranked.where(((F.col("_r") - 1) % every == 0) | (F.col("_r") == F.col("_last"))).drop("_r", "_last")


def bounding_box(df: DataFrame, axes: tuple[str, ...], half: str | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """Lower and upper corner of all elements, whose half extent may be a column."""
    h = F.col(half) if half else F.lit(0.0)
    parts = [(F.min(F.col(a) - h).alias(f"lower_{a}"), F.max(F.col(a) + h).alias(f"upper_{a}")) for a in axes]
    return df.groupBy(*batch).agg(*[c for pair in parts for c in pair])


def plot_limits(df: DataFrame, axes: tuple[str, ...], half: str | None = None, log: tuple[str, ...] = ()) -> DataFrame:
    """One row with lower_<axis> and upper_<axis> that leave a margin around all finite elements and their half extents (0.1 if 0).

    Linear axes grow by a tenth about their middle.  Logarithmic ones grow by 5 %
    on both sides; a lower end that is not positive is set from the least and greatest values.
    """
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    reach = F.lit(0.1) if half is None else F.when(F.col(half) == 0, 0.1).otherwise(F.col(half))
    sums = []
    for a in axes:
        v = F.col(a).cast("double")
        sums += [F.min(finite(v - reach)).alias(f"_l{a}"), F.max(finite(v + reach)).alias(f"_u{a}"), F.min(finite(v)).alias(f"_c{a}")]
    out = []
    for a in axes:
        low, high, least = F.col(f"_l{a}"), F.col(f"_u{a}"), F.col(f"_c{a}")
        if a in log:
            lower, upper = F.when(low > 0, low * 0.95).otherwise(least * F.pow(least / high, F.lit(0.1))), high * 1.05
        else:
            middle, size = (low + high) / 2, (high - low) * 0.55
            lower, upper = middle - size, middle + size
        out += [lower.alias(f"lower_{a}"), upper.alias(f"upper_{a}")]
    return df.agg(*sums).select(*out)


def farthest_points(df: DataFrame, axes: tuple[str, ...], count: int, element: str = "elem_id") -> DataFrame:
    """Greedy farthest-point sampling, from the smallest id on; ties go to the smaller id.

    One aggregation for each point asked for; only the chosen points pass the driver.
    """
    first = df.orderBy(element).limit(1).collect()
    chosen = list(first)
    while first and len(chosen) < count:
        near = [sum((F.col(a) - F.lit(c[a])) ** 2 for a in axes) for c in chosen]
        distance = F.least(*near) if len(near) > 1 else near[0]
        best = df.select(element, *axes, distance.alias("d")).orderBy(F.desc("d"), element).limit(1).collect()
        if not best or best[0]["d"] == 0:
            break
        chosen += best
    schema = df.select(element, *axes).schema
    return df.sparkSession.createDataFrame([tuple(c[k] for k in (element, *axes)) for c in chosen], schema)
