"""Surfaces made from fields and shapes, sheets, curvature, mesh sets and the mesh builder."""

from collections import Counter
from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.meta import Grid
from quadrille.operators import lattice, mesh, surfaces, triangles
from quadrille.operators.geometry import Cylinder, Sphere

BALL = Sphere({"x": 0.1, "y": -0.2, "z": 0.05}, 1.3)
SPACE = Grid.of("edge", {a: -2.0 for a in "xyz"}, {a: 2.0 for a in "xyz"}, x=20, y=20, z=20)
SHEET = [[{"x": float(i), "y": float(j), "z": float((i - 1) * (j - 1) + 0.3 * i)} for j in range(4)] for i in range(3)]


def test_surface_net_of_a_ball(spark, monkeypatch):
    from quadrille.operators import tiles

    want = None
    for size in (40, 7):
        monkeypatch.setitem(tiles.TILE, 3, size)
        m = surfaces.surface_mesh(spark, BALL, SPACE)
        at = {r.vid: np.array([r.x, r.y, r.z]) for r in m.vertices.collect()}
        tri = sorted(tuple(r.vids) for r in m.elements.collect())
        assert want in (None, (sorted(at), tri))
        want = sorted(at), tri
    center = np.array([0.1, -0.2, 0.05])
    assert all(abs(np.linalg.norm(p - center) - 1.3) < 0.03 for p in at.values())
    edges = Counter(frozenset((t[k], t[(k + 1) % 3])) for t in tri for k in range(3))
    assert set(edges.values()) == {2} and len(at) - len(edges) + len(tri) == 2
    area = 0.0
    for t in tri:
        a, b, c = (at[k] for k in t)
        n = np.cross(b - a, c - a) / 2
        area += np.linalg.norm(n)
        assert n @ ((a + b + c) / 3 - center) > 0
    assert area == pytest.approx(4 * pi * 1.3**2, rel=0.03)
    corners = {r.eid: r for r in triangles.corners(m).collect()}
    shares = []
    for r in triangles.curvature(m).collect():
        a, b, c = (np.array([corners[r.eid][f"{n}{x}"] for x in "xyz"]) for n in "abc")
        edges = sum(np.sum((q - p) ** 2) for p, q in ((a, b), (b, c), (c, a)))
        shares.append(r.scalar / (edges / np.linalg.norm(np.cross(b - a, c - a)) / 1.3))
    assert len(shares) == len(tri) and np.mean(shares) == pytest.approx(1, abs=0.05)


def test_surface_net_at_the_rim_and_of_nothing(spark):
    flat = lattice.lattice(spark, SPACE).withColumn("d", F.col("iz") - 4.25)
    m = surfaces.surface_net(flat, SPACE)
    assert m.vertices.count() == 19 * 19 and m.elements.count() == 2 * 18 * 18
    assert {round(r.z, 9) for r in m.vertices.collect()} == {round(-2 + 4.75 * 0.2, 9)}
    assert surfaces.surface_net(flat.withColumn("d", F.lit(1.0)), SPACE).elements.count() == 0
    holes = flat.withColumn("d", F.when(F.col("ix") != 9, F.col("d")))
    assert surfaces.surface_net(holes, SPACE).vertices.count() == 17 * 19


def test_onto_surface(spark):
    pts = spark.createDataFrame([(0.9, 0.2, 0.4), (-3.0, 1.0, 2.0)], "x double, y double, z double")
    for r in surfaces.onto_surface(pts, BALL).collect():
        p = np.array([r.x, r.y, r.z]) - [0.1, -0.2, 0.05]
        assert np.linalg.norm(p) == pytest.approx(1.3, abs=1e-5)


def test_height_planes(spark):
    g = Grid.of("edge", {"x": 1.0, "y": 0.0}, {"x": 5.0, "y": 2.0}, x=8, y=4)
    h = lattice.lattice(spark, g, h=lambda x, y: 2 * x - 3 * y + 1)
    rows = surfaces.height_planes(h, g, "z").collect()
    unit = np.array([-2.0, 3.0, 1.0]) / 14**0.5
    assert len(rows) == 7 * 3
    for r in rows:
        assert np.allclose([r.nx, r.ny, r.nz], unit) and r.cz == pytest.approx(2 * r.cx - 3 * r.cy + 1)
        assert r.offset == pytest.approx(-unit @ [r.cx, r.cy, r.cz]) and r.highest - r.lowest == pytest.approx(2.5)
    assert np.allclose([r.nz for r in surfaces.height_planes(h, g, "z", fill_below=False).collect()], -unit[2])
    assert surfaces.height_vertices(h, g, "z").where("abs(z - (2 * x - 3 * y + 1)) > 1e-9").count() == 0


def test_sheet_slopes_and_closest(spark):
    uv = spark.createDataFrame([(0.3, 0.6), (0.0, 1.0), (0.55, 0.25)], "u double, v double")
    step = 1e-6
    weights = [[1.0 + 0.2 * i + 0.1 * j for j in range(4)] for i in range(3)]
    for w in (None, weights):
        base = surfaces.sheet_surface(uv, SHEET, weights=w).collect()
        for d in "uv":
            inner = uv.withColumn(d, F.col(d) + F.when(F.col(d) == 1, -step).otherwise(step))
            for r, q in zip(base, surfaces.sheet_surface(inner, SHEET, weights=w).collect(), strict=True):
                sign = -1 if r[d] == 1 else 1
                assert np.allclose([(q[x] - r[x]) / step * sign for x in "xyz"], [r[f"{d}{x}"] for x in "xyz"], atol=1e-4)
        for r in base:
            n = np.array([r.nx, r.ny, r.nz])
            assert np.linalg.norm(n) == pytest.approx(1) and abs(n @ [r.ux, r.uy, r.uz]) < 1e-9
    plain = surfaces.sheet_at(uv, SHEET).collect()
    assert all(np.allclose([p[x] for x in "xyz"], [q[x] for x in "xyz"]) for p, q in zip(plain, surfaces.sheet_surface(uv, SHEET).collect(), strict=True))
    off = [(0.4, "n"), (-0.3, "n")]
    for distance, n in off:
        pts = surfaces.sheet_surface(uv.where("u > 0"), SHEET).select(
            F.col("u").alias("u0"), F.col("v").alias("v0"), *[(F.col(x) + distance * F.col(f"{n}{x}")).alias(x) for x in "xyz"]
        )
        for r in surfaces.closest_on_sheet(pts, SHEET, steps=6).collect():
            assert r.distance == pytest.approx(distance, abs=1e-3) and (r.u, r.v) == (pytest.approx(r.u0, abs=0.01), pytest.approx(r.v0, abs=0.01))
    odd = spark.createDataFrame([(1, 0.5, None, 1.0), (2, 1.0, 1.0, 0.5)], "k long, x double, y double, z double")
    got = {r.k: r for r in surfaces.closest_on_sheet(odd, SHEET).collect()}
    assert got[1].distance is None and got[2].distance is not None
    t = np.linspace(0, 1, 11)
    rows = spark.createDataFrame([(float(q),) for q in t], "t double")
    for degree, knots in ((2, surfaces.clamped_knots(5, 2)), (3, surfaces.clamped_knots(6, 3)), (1, surfaces.clamped_knots(3, 1))):
        for f, want in zip((surfaces.basis, surfaces.basis_slopes), surfaces._bases(t, knots, degree), strict=True):
            assert np.allclose(np.array(rows.select(*f(F.col("t"), knots, degree)).collect()), want)
    m = surfaces.sheet_mesh(spark, SHEET, res_u=5, res_v=6)
    assert m.vertices.count() == 30 and m.elements.count() == 20
    front, back = surfaces.double_cover([[{"x": float(i), "y": float(j), "z": 0.0} for j in range(4)] for i in range(4)], np.full((4, 4), 0.5))
    assert front[1][1]["z"] == 0.5 and back[2][1]["z"] == -0.5 and front[0][2] == back[0][2]


def test_named_sets_and_builder(spark):
    m = mesh.quad_mesh(spark, Grid.of(0.0, x=3, y=2))
    assert [mesh.points_of(m, n).count() for n in ("center", "face", "vertex")] == [6, 17, 12]
    assert [mesh.boundary_of(m, n).count() for n in ("center", "face")] == [0, 10]
    assert mesh.boundary_of(m, "vertex").select("vid").distinct().count() == 10
    for f in (mesh.points_of, mesh.boundary_of):
        with pytest.raises(ValueError):
            f(m, "edge")
    assert Cylinder({"x": 0.0, "y": 0.0, "z": 0.0}, 1.0, "y").up == {"x": 0.0, "y": 1.0, "z": 0.0}
    b = triangles.MeshBuilder(spark)
    low, high = (triangles.ring(spark, {"x": 0.0, "y": 0.0}, 1.0, z, 6) for z in (0.0, 1.0))
    b.new_quads(low.union(high.withColumn("vid", F.col("vid") + 6)), 6, closed=True)
    at = b.add_vertices(spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double"))
    b.add_triangles(spark.createDataFrame([([12, k, (k + 1) % 6],) for k in range(6)], "vids array<long>"))
    built = b.build()
    assert at == 12 and built.vertices.count() == 13 and sorted(r.eid for r in built.elements.collect()) == list(range(12))
