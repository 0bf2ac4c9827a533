"""Solids around sheets against the shapes they are made from."""

from collections import Counter
from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import solids
from quadrille.operators.geometry import Box, Cylinder, Point, Sphere

BOX = Box({"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 2.0, "y": 1.0, "z": 3.0})
TUBE = Cylinder({"x": 0.5, "y": 0.0, "z": 1.0}, 0.7, "z", 2.0)
BALL = Sphere({"x": 0.1, "y": 0.2, "z": 0.3}, 1.2)


def hull(mesh):
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in mesh.vertices.collect()}
    quads = [r.vids for r in mesh.elements.collect()]
    edges = Counter((q[k], q[(k + 1) % 4]) for q in quads for k in range(4))
    assert set(edges.values()) == {1} and all((b, a) in edges for a, b in edges)
    assert len(at) - len(edges) // 2 + len(quads) == 2
    return sum(at[q[0]] @ np.cross(at[q[k]], at[q[k + 1]]) for q in quads for k in (1, 2)) / 6


def test_meshes_are_closed(spark):
    assert hull(solids.solid_mesh(spark, solids.to_spline(BOX), 3, 2)) == pytest.approx(6)
    assert hull(solids.solid_mesh(spark, solids.to_spline(TUBE), 2, 40)) == pytest.approx(pi * 0.49 * 2, rel=0.02)
    assert solids.solid_points(spark, solids.to_spline(BOX), 1, 1).columns == ["elem_id", "x", "y", "z"]
    with pytest.raises(ValueError):
        solids.to_spline(Point({"x": 0.0, "y": 0.0, "z": 0.0}))


def test_distances(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.uniform(-2, 4, (150, 3)))], "k long, x double, y double, z double")
    p = {a: F.col(a) for a in "xyz"}
    for shape in (TUBE, BALL):
        rows = solids.solid_distance(pts, solids.to_spline(shape)).withColumn("want", shape.sdf(p)).collect()
        assert len(rows) == 150 and all(r.distance == pytest.approx(r.want, abs=1e-3) for r in rows)
    for r in solids.solid_distance(pts, solids.to_spline(BOX)).collect():
        q = np.array([r.x, r.y, r.z])
        out = np.maximum(np.maximum(-q, q - [2, 1, 3]), 0)
        want = np.linalg.norm(out) if out.any() else -min(*q, *(np.array([2, 1, 3]) - q))
        assert r.distance == pytest.approx(want, abs=1e-6)
    assert solids.solid_distance(pts.limit(0), solids.to_spline(BOX)).count() == 0


def test_parameters_and_moving(spark):
    solid = solids.SplineSolid([[{"x": float(i), "y": float(j), "z": 0.0} for j in range(2)] for i in range(3)], [[1.0, 3.0]] * 3)
    uv = spark.createDataFrame([(0.5, 0.5), (2.0, 1.0), (9.0, -1.0)], "u double, v double")
    assert [(r.x, r.y) for r in solid.center_at(uv).collect()] == [(0.5, 0.5), (2, 1), (2, 0)]
    assert [r.thickness for r in solid.thickness_at(uv).collect()] == [2, 3, 1]
    plate = solids.SplineSolid([[{"x": float(i), "y": float(j), "z": 0.0} for j in range(2)] for i in range(2)], [[1.0] * 2] * 2)
    moved = solids.SplineSolid([[{"x": 5.0 + 2 * i, "y": 0.0, "z": float(j)} for j in range(2)] for i in range(2)], [[1.5] * 2] * 2)
    pts = spark.createDataFrame([(1, 0.25, 0.5, 0.3)], "k long, x double, y double, z double")
    r = solids.carried_over(pts, plate, moved).first()
    assert (r.x, r.y, r.z) == (pytest.approx(5.5), pytest.approx(-0.8), pytest.approx(0.5))
    skew = solids.SplineSolid([[{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 2.0, "z": 0.0}], [{"x": 3.0, "y": 4.0, "z": 0.0}, {"x": 9.0, "y": 9.0, "z": 9.0}]], [[-1.0] * 2] * 2, dict.fromkeys(solids.RIMS, 1.7))
    fixed = skew.rectified()
    assert fixed.points[1][0] == {"x": 5.0, "y": 0.0, "z": 0.0} and fixed.points[1][1] == {"x": 5.0, "y": 2.0, "z": 0.0}
    assert fixed.thickness[0][0] == 1e-5 and fixed.fillet["u+"] == 1
    with pytest.raises(ValueError):
        solid.rectified()
