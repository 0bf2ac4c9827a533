"""Fields made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Grid

#: Lattice of line items: quantity 1..50 by discount 0..10 percent.
NX, NY = 50, 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_grid(boundary=0.0) -> Grid:
    return Grid.of(boundary, x=NX, y=NY)


def line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, iy, v, w, u): mean tax, mean price in hundred thousands, mean discount by quantity and discount, rounded to 9 digits."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity").cast("int") - 1).alias("ix"),
        F.round(F.col("l_discount") * 100).cast("int").alias("iy"),
        "l_tax",
        "l_extendedprice",
        "l_discount",
    )
    found = rows.groupBy("ix", "iy").agg(
        F.round(F.avg("l_tax"), 9).alias("v"),
        F.round(F.avg("l_extendedprice") / 100000, 9).alias("w"),
        F.round(F.avg("l_discount"), 9).alias("u"),
    )
    from ..operators.lattice import lattice

    return lattice(spark, line_grid()).join(found, ["ix", "iy"], "left").na.fill(0.0)


G_SQL = f"""lat as (select (i.range // {NY})::int as ix, (i.range % {NY})::int as iy from range({NX * NY}) i),
raw as (select cast(l_quantity as int) - 1 as ix, cast(round(100 * l_discount) as int) as iy, round(avg(l_tax), 9) as v,
  round(avg(l_extendedprice) / 100000, 9) as w, round(avg(l_discount), 9) as u from lineitem group by 1, 2),
g as (select ix, iy, coalesce(v, 0.0) as v, coalesce(w, 0.0) as w, coalesce(u, 0.0) as u from lat left join raw using (ix, iy))"""


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(elem_id, x, y): size, and the price over 900 spread over the line lattice."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("elem_id"),
        (F.col("p_size") - 0.37).cast("double").alias("x"),
        ((F.col("p_retailprice") - 900) / 100 * NY).cast("double").alias("y"),
    )


Q_SQL = f"q as (select p_partkey as elem_id, (p_size - 0.37)::double as x, ((p_retailprice - 900) / 100 * {NY})::double as y from part)"


def part_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, iy, v): mean price over 900 in hundreds of all parts by size and price on the line lattice, rounded to 9 digits; 0 without parts."""
    from ..operators.resample import scatter

    points = part_points(spark, sf_dir).withColumn("v", F.col("y") / NY)
    return scatter(points, line_grid(), "v", outside="clamp").withColumn("v", F.round("v", 9))


def plain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(elem_id, x, y): size and price over 900 of parts."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("elem_id"),
        F.col("p_size").cast("double").alias("x"),
        (F.col("p_retailprice") - 900).cast("double").alias("y"),
    )


P_SQL = "p as (select p_partkey as elem_id, p_size::double as x, (p_retailprice - 900)::double as y from part)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
