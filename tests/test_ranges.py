"""Ranks and curves by ranges, blocks one after another, and signed distances of surfaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.meta import Grid
from quadrille.operators import aggregate, graph, lattice, triangles
from quadrille.operators.geometry import Box
from quadrille.sources import scene


def test_running_total_and_curves(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    df = spark.createDataFrame([(int(k), float(x), "ab"[k % 2]) for k, x in enumerate(v)], "frame int, v double, part string").repartition(7)
    got = {r.frame: r.time for r in scene.cumulative_time(df, "v").collect()}
    assert np.allclose([got[k] for k in range(500)], np.cumsum(v))
    each = {r.frame: r.t for r in aggregate.running_total(df, [F.desc("frame")], F.col("v"), "t", ("part",)).collect()}
    assert np.allclose([each[k] for k in range(0, 500, 2)], np.cumsum(v[::2][::-1])[::-1])
    for n in (1, 2, 5, 40):
        want = [v[max(0, k - n // 2) : k + (n - 1) // 2 + 1].mean() for k in range(500)]
        for run in (7, 4096):
            curve = {r.frame: r.smooth for r in aggregate.smooth(df, "frame", "v", n, run=run).collect()}
            assert len(curve) == 500 and np.allclose([curve[k] for k in range(500)], want)
    assert sorted(r.frame for r in aggregate.down_sample(df, "frame", 100).collect()) == [0, 100, 200, 300, 400, 499]
    assert sorted(r.frame for r in aggregate.down_sample(df, "frame", 100, ("part",)).collect()) == [0, 1, 200, 201, 400, 401, 498, 499]
    assert aggregate.smooth(df.limit(0), "frame", "v", 3).count() == aggregate.down_sample(df.limit(0), "frame", 3).count() == 0
    nulls = df.withColumn("part", F.lit(None).cast("string"))
    assert aggregate.down_sample(nulls, "frame", 250, ("part",)).count() == 3


def test_ranges_of_many_rows_are_dealt_once(spark, tmp_path):
    n = 200_000  # far more rows than are sampled for the ranges
    rows = spark.range(0, n, 1, 12).select("id", (F.col("id") % 1000).cast("double").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    rows.write.parquet(f"{tmp_path}/rows")
    df, v = spark.read.parquet(f"{tmp_path}/rows"), np.arange(n) % 1000.0
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    for k, x in held.items():
        spark.conf.set(k, x)
    try:
        got = {r.id: r.t for r in aggregate.running_total(df, [F.col("id")], F.lit(1), "t").select("id", "t").collect()}
        curve = {r.id: r.smooth for r in aggregate.smooth(df, "id", "v", 3).select("id", "smooth").collect()}
    finally:
        for k in held:
            spark.conf.unset(k)
    assert len(got) == n and all(got[k] == k + 1 for k in range(n))
    assert len(curve) == n and np.allclose([curve[k] for k in range(1, n - 1)], (v[:-2] + v[1:-1] + v[2:]) / 3)


def test_a_constant_field_is_one_tie(spark):
    grid = Grid.of(0.0, x=20, y=30)
    df = lattice.lattice(spark, grid, v=2.0)
    marked = {(r.ix, r.iy) for r in aggregate.discretize(df, grid, 0.25).where("mark = 1").collect()}
    assert marked == {(i, j) for i in range(5) for j in range(30)}


def test_blocks_one_after_another(spark):
    rng = np.random.default_rng(4)
    at, m = rng.normal(size=(30, 2)), rng.random(30)
    bodies = spark.createDataFrame([(k, float(x), float(y), float(w)) for k, ((x, y), w) in enumerate(zip(at, m, strict=True))], "elem_id long, x double, y double, m double")
    one, many = ({r.elem_id: (r.ax, r.ay) for r in graph.pairwise_accelerations(bodies, ("x", "y"), "m", block=b).collect()} for b in (100, 7))
    assert len(one) == 30 and all(one[k] == pytest.approx(many[k]) for k in one)
    vectors = bodies.select("elem_id", F.array("x", "y").alias("v"))
    queries = vectors.where("elem_id % 3 = 0").select(F.col("elem_id").alias("query"), "v")
    near = [sorted(map(tuple, graph.nearest_in_blocks(queries, vectors, "v", "elem_id", b).collect())) for b in (100, 3)]
    assert near[0] == near[1] and len(near[0]) == 10
    assert graph.as_points(bodies.withColumnRenamed("elem_id", "node"), ("x", "y")).columns == ["elem_id", "x", "y"]


def test_signed_distance_of_a_surface(spark):
    box = Box({"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 2.0, "y": 1.0, "z": 3.0})
    mesh = triangles.box_surface(spark, box)
    grid = Grid.of("edge", {"x": -1.0, "y": -1.0, "z": -1.0}, {"x": 3.0, "y": 2.0, "z": 4.0}, x=8, y=6, z=5)
    want = lattice.lattice(spark, grid).withColumn("w", box.sdf(lattice.centers(grid)))
    # the distance of a box as a shape is to its sides; of the surface it is to the nearest point
    for block in (1000, 100):
        both = triangles.mesh_sdf(spark, mesh, grid, block=block).join(want, grid.keys).collect()
        assert len(both) == grid.size
        for r in both:
            p = np.array([grid.lower[a] + (r[f"i{a}"] + 0.5) * grid.dx[a] for a in "xyz"])
            q = np.maximum(np.maximum(-p, p - np.array([2.0, 1.0, 3.0])), 0)
            assert r.d == pytest.approx(np.linalg.norm(q) if r.w > 0 else r.w)
