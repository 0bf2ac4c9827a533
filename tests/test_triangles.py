from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.meta import Grid
from quadrille.operators import lattice, mesh, triangles
from quadrille.operators.geometry import Box, Sphere

BOX = Box({"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 2.0, "y": 1.0, "z": 3.0})


def test_box_surface(spark, tmp_path):
    m = triangles.box_surface(spark, BOX)
    n = triangles.normals(m).join(triangles.corners(m), "eid").collect()
    assert sum(r.area for r in n) == pytest.approx(22)
    for r in n:
        out = (r.ax - 1) * r.nx + (r.ay - 0.5) * r.ny + (r.az - 1.5) * r.nz
        assert out > 0
    bigger = triangles.displaced(m, 0.1).vertices.agg(F.max("x"), F.min("z")).first()
    assert bigger[0] > 2 and bigger[1] < 0
    spots = spark.createDataFrame([(0, 1.0, 0.5, 4.0), (1, 3.0, 2.0, 1.0)], "elem_id long, x double, y double, z double")
    got = {r.elem_id: r.distance for r in triangles.closest_surface(spots, m, block=1).collect()}
    assert got == {0: pytest.approx(1), 1: pytest.approx(2**0.5)}
    triangles.save_triangles(m, f"{tmp_path}/m")
    assert triangles.normals(triangles.load_triangles(spark, f"{tmp_path}/m")).count() == 12


def test_surface_points_and_rings(spark):
    rows = triangles.surface_points(spark, BOX, 4000).collect()
    p = np.array([[r.x / 2, r.y, r.z / 3] for r in rows])
    on = np.isclose(p, 0) | np.isclose(p, 1)
    assert on.any(axis=1).all()
    assert on[:, 0].mean() == pytest.approx(6 / 22, abs=0.05) and on[:, 1].mean() == pytest.approx(12 / 22, abs=0.05)
    r = triangles.ring(spark, {"x": 1.0, "y": 2.0}, 3.0, 5.0, 8).collect()
    assert all((v.x - 1) ** 2 + (v.y - 2) ** 2 == pytest.approx(9) for v in r)
    quads = spark.range(8).select(triangles.quads_between(8, 2, closed=True).alias("q")).collect()
    assert list(quads[7].q) == [7, 0, 8, 15]


def test_obstacle_mesh_and_walk(spark):
    g = Grid.of(0.0, x=6, y=6)
    m = triangles.obstacle_mesh(spark, g, Sphere({"x": 3.0, "y": 3.0}, 1.0))
    assert m.elements.count() == 32 and m.boundaries.where("name = 'obstacle'").count() == 8 and m.vertices.count() == 48
    whole = mesh.quad_mesh(spark, g)
    faces = mesh.faces(whole).cache()
    pts = spark.createDataFrame([(0, 4.5, 3.5, 0), (1, -2.0, 0.5, 7)], "elem_id long, x double, y double, eid long")
    got = {r.elem_id: r.eid for r in triangles.walk(pts, faces, 8).collect()}
    assert got == {0: 4 * 6 + 3, 1: 0}
    near = {r.elem_id: r.vid for r in triangles.closest_vertex(pts.drop("eid"), whole, 3.0).collect()}
    assert near[0] in {4 * 7 + 3, 4 * 7 + 4, 5 * 7 + 3, 5 * 7 + 4} and near[1] == 0


def test_more_lattice_operators(spark):
    g = Grid.of("edge", x=8, y=8)
    df = lattice.lattice(spark, g, v=lambda x, y: x + 10 * y)
    spin = lattice.vortices(df, g, [{"x": 4.0, "y": 4.0}], [2.0]).where("ix = 5 and iy = 4").first()
    assert (spin.vx, spin.vy) == (-1.0, 3.0)
    assert lattice.spheres(df, g).first().radius == pytest.approx((1 / pi) ** 0.5)
    inner = Grid.of(0.0, {"x": 2.0, "y": 2.0}, {"x": 4.0, "y": 4.0}, x=4, y=4)
    out = lattice.embedded(lattice.lattice(spark, inner, v=-1.0), inner, df, g)
    assert out.count() == 36 and out.where("v = -1").count() == 16
    corner = out.where("ix = 0 and iy = 0").first().v
    assert corner == pytest.approx(1.75 + 17.5)
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (4.0, 2.0, 3.0)], "x double, y double, v double")
    cells, around = lattice.points_to_grid(pts, ("x", "y"), 50)
    assert around.lower["x"] < 0 and around.upper["y"] > 2 and cells.where("v is not null").count() == 2
