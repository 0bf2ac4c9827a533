"""Queries of array-style operators on the line-item lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lattice, tensors
from .grids import nb, r6
from .tables import G_SQL, NX, NY, line_field, line_grid, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_MEAN = " + ".join(nb("v", i, j, "edge", "edge") for i in (-1, 0, 1) for j in (-1, 0, 1))


@query(f"with {G_SQL} select a.ix, a.iy, {r6(f'({_MEAN}) / 9', 'convolved')} from g a")
def convolve_mean(spark, sf_dir):
    return rounded(tensors.convolve(line_field(spark, sf_dir), line_grid("edge"), tensors.box_kernel(3, 3)))


_SHARP = f"1.5 * v - 0.25 * {nb('v', 1, 1, 'periodic', 'periodic')} + 0.125 * {nb('v', -2, 0, 'periodic', 'periodic')}"


@query(f"with {G_SQL} select a.ix, a.iy, round({_SHARP}, 8) + 0.0 as convolved from g a")
def convolve_periodic(spark, sf_dir):
    weights = {(0, 0): 1.5, (1, 1): -0.25, (-2, 0): 0.125}
    return rounded(tensors.convolve(line_field(spark, sf_dir), line_grid("periodic"), weights), 8)


@query(f"with {G_SQL} select ix, iy, {r6('sum(v) over (partition by iy order by ix)', 'running')} from g")
def running_sum(spark, sf_dir):
    df = line_field(spark, sf_dir).select("ix", "iy", "v")
    return rounded(tensors.running_sum(df, line_grid(), "x", run=8).select("ix", "iy", "running"))


@query(f"""with {G_SQL} select iy, {r6('sum(v)', 'sum')}, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, {r6('min(v)', 'min')}, {r6('max(v)', 'max')}, {r6('sum(v * v / 2)', 'l2')},
max((v <> 0)::int) as any, min((v <> 0)::int) as all from g group by iy""")
def axis_statistics(spark, sf_dir):
    return rounded(tensors.statistics(line_field(spark, sf_dir), "v", ("iy",)))


@query(f"""with {G_SQL}, r as (select *, row_number() over (partition by iy order by w desc, ix) as k from g) select iy, ix, {r6('w', 'w')} from r where k = 1""")
def axis_argmax(spark, sf_dir):
    return rounded(tensors.extreme(line_field(spark, sf_dir), line_grid(), "w", along=("iy",)))


@query("select range::int as bin, coalesce(n, 0) as n from range(12) left join (select l_linenumber as b, count(*) as n from lineitem group by 1) on b = range")
def bin_counts(spark, sf_dir):
    from .tables import table

    return tensors.bin_counts(table(spark, sf_dir, "lineitem"), "l_linenumber", 12)


@query(f"with {G_SQL} select (ix * {NY} + iy)::bigint as cell, ({NX - 1} - ix)::int as ix, iy, {r6('v', 'v')} from g")
def flip_axis(spark, sf_dir):
    df = line_field(spark, sf_dir).select("ix", "iy", "v").withColumn("cell", tensors.linear_index(line_grid()))
    return rounded(tensors.flip(df, line_grid(), "x"))


@query(f"""with {G_SQL} select ix, iy, round(-(2 * (iy + 0.5 - 5) - 0.5 * (iy + 0.5 - 2)), 6) + 0.0 as vx, round(2 * (ix + 0.5 - 20) - 0.5 * (ix + 0.5 - 30), 6) + 0.0 as vy from lat""")
def vortex_velocity(spark, sf_dir):
    grid = line_grid()
    places = [{"x": 20.0, "y": 5.0}, {"x": 30.0, "y": 2.0}]
    return rounded(lattice.vortices(lattice.lattice(spark, grid), grid, places, [2.0, -0.5]))


@query(f"""with {G_SQL} select ix + 0.5::double as x, iy + 0.5::double as y, {r6('v', 'v')} from g where v > 0.04""")
def support_points(spark, sf_dir):
    grid = line_grid()
    df = line_field(spark, sf_dir).select("ix", "iy", F.when(F.col("v") > 0.04, F.col("v")).otherwise(0.0).alias("v"))
    return rounded(lattice.nonzero(df, grid))
