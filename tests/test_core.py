"""Fields, stencils, geometry, solves, storage: known values and laws."""

import json
from math import pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.field import Field, concat, maximum, minimum, stack, where
from quadrille.functions import kernels, text
from quadrille.functions import vector as vec
from quadrille.meta import EDGE, PERIODIC, ZERO, Boundary, Grid, margin_resolution
from quadrille.operators import aggregate, graph, lattice, mesh, physics, resample, solve, stencil, surfaces, tiles
from quadrille.operators.geometry import Box, Cylinder, Extruded, Geometry, Sphere, Union, line_trace
from quadrille.sources import meshfiles, npz, scene


def grid_of(spark, a, boundary=0.0, **bounds):
    axes = "xyz"[: a.ndim]
    grid = Grid.of(boundary, **bounds, **dict(zip(axes, a.shape, strict=True)))
    rows = [(*map(int, k), float(v) if v == v else None) for k, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ", ".join(f"i{x} int" for x in axes) + ", v double"), grid


def array(df, grid, column="v"):
    out = np.full(tuple(grid.resolution.values()), np.nan)
    for r in df.select(*grid.keys, column).collect():
        out[tuple(r[k] for k in grid.keys)] = r[column]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(size=(13, 9))


def test_stencil_of_a_spike(spark):
    a = np.zeros((3, 3))
    a[1, 1] = 1
    df, g = grid_of(spark, a)
    assert array(physics.diffuse_explicit(df, g, 1.0, 1.0, substeps=4), g).sum() <= 1
    lap = array(stencil.laplace(df, g), g, "laplace")
    assert (a + lap).round(9).tolist() == [[0, 1, 0], [1, -3, 1], [0, 1, 0]]
    lap = array(stencil.laplace(df, g, weights={"x": 1.0, "y": 2.0}), g, "laplace")
    assert (a + lap).round(9).tolist() == [[0, 1, 0], [2, -5, 2], [0, 1, 0]]


def test_divergence_at_the_rim(spark):
    df, g = grid_of(spark, np.ones((3, 3)), upper={"x": 1, "y": 1})
    out = array(stencil.divergence_centered(df.withColumn("w", F.lit(0.0)), g, {"x": "v", "y": "w"}), g, "divergence")
    assert out[:, 0].round(9).tolist() == [1.5, 0, -1.5]


@pytest.mark.parametrize("tile", [256, 4])
@pytest.mark.parametrize("rule,mode", [("periodic", {"mode": "wrap"}), ("edge", {"mode": "edge"}), (2.0, {"constant_values": 2.0})])
def test_tiles_and_boundaries(spark, noise, monkeypatch, tile, rule, mode):
    monkeypatch.setitem(tiles.TILE, 2, tile)
    df, g = grid_of(spark, noise, rule)
    p = np.pad(noise, 2, **mode)
    want = p[3:-1, 2:-2] + p[1:-3, 2:-2] + p[2:-2, 3:-1] + p[2:-2, 1:-3] - 4 * noise
    assert np.allclose(array(stencil.laplace(df, g), g, "laplace"), want)
    assert np.allclose(array(stencil.pad(df, g, {"x": 2, "y": 2}), g.padded(x=2, y=2)), p)
    at = array(stencil.shift(df, g, (-2, 1)), g, "x_m2")
    assert np.allclose(at, p[:-4, 2:-2])


@pytest.mark.parametrize("order", [2, 4, 6])
def test_orders_of_convergence(spark, order):
    error = []
    for n in (16, 32):
        x = (np.arange(n) + 0.5) / n * 2 * pi
        df, g = grid_of(spark, np.sin(x), "periodic", upper={"x": 2 * pi})
        error.append(abs(array(stencil.laplace(df, g, order=order), g, "laplace") + np.sin(x)).max())
    assert np.log2(error[0] / error[1]) > order - 0.3


@pytest.mark.parametrize("rule,faces", [(0.0, 19), ("periodic", 20), ("edge", 21)])
def test_face_counts(spark, rule, faces):
    g = Grid.of(rule, x=20, y=10)
    assert lattice.face_lattice(spark, g).where("axis = 'x'").count() == faces * 10
    first, last = g.face_range("x")
    assert last - first == faces


def test_grid_metadata():
    g = Grid.of(0.0, upper={"x": 2, "y": 2}, x=10, y=20)
    assert (g.dx, g.size, g.cell_volume) == ({"x": 0.2, "y": 0.1}, 200, pytest.approx(0.02))
    assert g.padded(x=(1, 2)).resolution["x"] == 13 and g.scaled(0.5).resolution == {"x": 5, "y": 10}
    assert margin_resolution({"x": 2.0, "y": 1.0}, 200, 1) == {"x": 22, "y": 12}
    with pytest.raises(ValueError):
        Grid.of({"x": (PERIODIC, ZERO)}, x=3)
    with pytest.raises(ValueError):
        Boundary("odd")


def test_face_operators_agree_with_centers(spark, noise):
    for rule in ("periodic", "edge"):
        df, g = grid_of(spark, noise, rule)
        div = array(stencil.divergence(stencil.face_gradient(df, g), g), g, "divergence")
        assert np.allclose(div, array(stencil.laplace(df, g), g, "laplace"))
    df, g = grid_of(spark, np.full((6, 5), 3.0), 3.0)
    back = stencil.at_centers(stencil.at_faces(df, g), g)
    assert np.allclose(array(back, g, "vx"), 3) and np.allclose(array(back, g, "vy"), 3)


def test_curl_of_a_rotation(spark):
    x, y = np.meshgrid(np.arange(6) + 0.5, np.arange(5) + 0.5, indexing="ij")
    df, g = grid_of(spark, -y)
    df = df.join(grid_of(spark, x)[0].withColumnRenamed("v", "w"), ["ix", "iy"])
    out = array(stencil.curl_centered(df, g, {"x": "v", "y": "w"}), g, "curl")
    assert np.allclose(out[1:-1, 1:-1], 2)


def test_resampling_laws(spark):
    df, g = grid_of(spark, np.arange(4.0), "edge")
    up, fine = stencil.upsample2x(df, g)
    down, coarse = stencil.downsample2x(up, fine)
    assert coarse.resolution == g.resolution and array(down, g)[1:-1].tolist() == [1, 2]
    points = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 3.9), (3, -5.0)], "elem_id int, x double")
    got = {r.elem_id: r.v for r in resample.interpolate(points, df, g, ["v"]).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 3.0, 3: 0.0}
    assert {r.elem_id: r.v for r in resample.nearest(points, df, g, ["v"]).collect()} == {0: 1.0, 1: 0.0, 2: 3.0, 3: 0.0}
    same = resample.to_grid(df, g, g, ["v"])
    assert same is df


def test_interpolation_in_space(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 5, 3))
    df, g = grid_of(spark, a, "periodic")
    spots = rng.uniform(-2, 8, size=(30, 3))
    points = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(spots)], "elem_id int, x double, y double, z double")
    got = {r.elem_id: r.v for r in resample.interpolate(points, df, g, ["v"]).collect()}
    for k, s in enumerate(spots):
        u = s - 0.5
        b = np.floor(u).astype(int)
        f, want = u - b, 0
        for c in np.ndindex(2, 2, 2):
            want += a[tuple((b + c) % a.shape)] * np.prod(np.where(c, f, 1 - f))
        assert got[k] == pytest.approx(want)


def test_scatter(spark):
    points = spark.createDataFrame([(0.2, 1.0), (0.8, 3.0), (2.5, 5.0), (9.0, 7.0), (-1.0, 9.0)], "x double, v double")
    g = Grid.of(0.0, x=4)
    run = lambda **k: array(resample.scatter(points, g, **k), g).tolist()
    assert run(base=-1.0) == [2, -1, 5, -1]
    assert run(mode="add") == [4, 0, 5, 0]
    assert run(outside="clamp") == [pytest.approx(13 / 3), 0, 5, 7]
    assert run(outside="periodic") == [2, 7, 5, 9]


def test_field_algebra(spark, noise):
    df, g = grid_of(spark, noise)
    f = Field(df, g)
    assert np.allclose(array(((2 * f - f / 4 + 1) ** 2).df, g), (2 * noise - noise / 4 + 1) ** 2)
    other = -f
    assert np.allclose(array(maximum(f, other).df, g), abs(noise)) and np.allclose(array(minimum(f, other).df, g), -abs(noise))
    assert np.allclose(array(where(f > 0, f, f * 0).df, g), np.maximum(noise, 0))
    assert f.close_to(abs(maximum(f, other)) * 1.0) is False and f.close_to(f)
    assert (-f.with_boundary(2.0)).grid.boundary["x"][0].value == -2.0
    both = concat([f, f], "x")
    assert both.grid.resolution["x"] == 26 and np.allclose(array(both.df, both.grid), np.concatenate([noise, noise]))
    cut = f.window(x=(2, 5))
    assert np.allclose(array(cut.df, cut.grid), noise[2:5]) and cut.grid.lower["x"] == 2
    row = f.at_index(x=-1)
    assert np.allclose(array(row.df, row.grid), noise[-1])
    pair = stack({"a": f, "b": other}, "run")
    means = {r.run: r["mean"] for r in pair.mean().collect()}
    assert means["a"] == pytest.approx(noise.mean()) and means["b"] == pytest.approx(-noise.mean())
    lap = pair.laplace()
    assert np.allclose(array(lap.df.where("run = 'b'"), g), -array(f.laplace().df, g))


def test_reductions(spark, noise):
    df, g = grid_of(spark, abs(noise))
    com = aggregate.center_of_mass(df, g).first()
    x = np.arange(13)[:, None] + 0.5
    assert com.x == pytest.approx((x * abs(noise)).sum() / abs(noise).sum())
    assert array(aggregate.discretize(df, g, 0.25), g, "mark").sum() == int(0.25 * 117)
    ties = df.withColumn("v", F.lit(1.0))
    assert np.nansum(array(aggregate.discretize(ties, g, 0.25), g, "mark")) == int(0.25 * 117)
    holes = abs(noise).copy()
    holes[3, 3] = holes[3, 4] = np.nan
    hole, g2 = grid_of(spark, holes, "none")
    filled = array(stencil.finite_fill(hole, g2), g2)
    assert filled[3, 3] == pytest.approx(np.nanmean(holes[2:5, 2:5])) and filled[0, 0] == holes[0, 0]
    line = array(stencil.finite_fill(hole, g2, diagonal=False), g2)
    assert line[3, 3] == pytest.approx(np.nanmean([holes[2, 3], holes[4, 3], holes[3, 2]]))
    pts = spark.createDataFrame([(k, float(k * k % 7), float(k)) for k in range(9)], "elem_id long, x double, y double")
    far = aggregate.farthest_points(pts, ("x", "y"), 3).collect()
    assert [r.elem_id for r in far][:2] == [0, 8] and len(far) == 3


def test_advection_laws(spark, noise):
    df, g = grid_of(spark, noise, "edge")
    still = df.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    moving = df.withColumns({"a": F.lit(1.0), "b": F.lit(0.0)})
    for rows, dt in ((still, 1.0), (moving, 0.0)):
        assert np.allclose(array(physics.semi_lagrangian(rows, g, ["v"], {"x": "a", "y": "b"}, dt), g), noise)
        assert np.allclose(array(physics.mac_cormack(rows, g, "v", {"x": "a", "y": "b"}, dt), g), noise)
    one = array(physics.semi_lagrangian(moving, g, ["v"], {"x": "a", "y": "b"}, 1.0), g)
    assert np.allclose(one[1:], noise[:-1]) and np.allclose(one[0], noise[0])
    points = spark.createDataFrame([(1, 5.0, 5.0)], "elem_id int, x double, y double")
    for how in ("euler", "rk4", "finite_rk4"):
        r = physics.advect_points(points, moving, g, {"x": "a", "y": "b"}, 2.0, how).first()
        assert (r.x, r.y) == (7.0, 5.0)


def test_diffusion_methods_agree(spark):
    step = np.r_[np.ones(50), np.zeros(50)]
    df, g = grid_of(spark, step, "periodic")
    exact = array(physics.diffuse_fourier(df, g, 0.5, 1.0), g)
    assert abs(array(physics.diffuse_explicit(df, g, 0.5, 1.0, substeps=10), g) - exact).max() < 0.1
    implicit = array(physics.diffuse_implicit(df, g, 0.5, 1.0), g)
    assert abs(implicit - exact).max() < 0.1 and implicit.sum() == pytest.approx(50)
    ones, g = grid_of(spark, np.ones((5, 5)), "periodic")
    for out in (physics.diffuse_fourier(ones, g, 1.0, 1.0), physics.diffuse_implicit(ones, g, 1.0, 1.0), physics.diffuse_explicit(ones, g, 0.2, 1.0)):
        assert np.allclose(array(out, g), 1)
    with pytest.raises(ValueError):
        physics.diffuse_explicit(ones, g, 5.0, 1.0)


@pytest.mark.parametrize("rule", [0.0, "edge", "periodic", {"x": 0.0, "y": "edge"}])
def test_projection(spark, rule):
    g = Grid.of(rule, upper={"x": 16, "y": 20}, x=8, y=10)
    faces = lattice.face_lattice(spark, g).withColumn("v", F.sin(F.col("ix") * 1.7 + F.col("iy") * 0.9 + F.when(F.col("axis") == "x", 0).otherwise(1)))
    out, pressure = physics.make_incompressible(faces, g, 1e-9)
    assert stencil.divergence(out, g).agg(F.max(F.abs("divergence"))).first()[0] < 5e-5
    assert pressure.count() == 80 and out.count() == faces.count()


def test_distributed_solver_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    df, g = grid_of(spark, rng.normal(size=(5, 4)), {"x": "edge", "y": 0.0})
    df = df.withColumnRenamed("v", "b")
    near = array(solve.solve_lattice(df, g, relative=1e-10), g, "x")
    far = array(solve.solve_lattice(df, g, relative=1e-8, distributed=True), g, "x")
    assert np.allclose(near, far, atol=1e-6)


def test_spectral(spark):
    n = 16
    x = np.arange(n) / n * 2 * pi
    a = np.sin(x)[:, None] * np.cos(2 * x)[None]
    df, g = grid_of(spark, a, "periodic", upper={"x": 2 * pi, "y": 2 * pi})
    assert np.allclose(array(solve.fourier_laplace(df, g), g), -5 * a)
    assert np.allclose(array(solve.fourier_poisson(df, g), g), -a / 5)
    draw = array(solve.noise(df, g, seed=1), g)
    assert abs(draw.mean()) < 1e-9 and draw.std() == pytest.approx(1) and not np.allclose(draw, array(solve.noise(df, g, seed=2), g))


def test_shapes(spark):
    at = lambda shape, p, f="lies_inside": spark.range(1).select(getattr(shape, f)({a: F.lit(float(v)) for a, v in p.items()}).alias("r")).first().r
    assert (Sphere({"x": 0.0, "y": 0.0}, 1.0).volume, Sphere({"x": 0.0, "y": 0.0, "z": 0.0}, 2.0).volume) == (pytest.approx(pi), pytest.approx(32 / 3 * pi))
    assert Sphere({"x": 0.0, "y": 0.0, "z": 0.0}, 2.0).surface_area == pytest.approx(16 * pi)
    assert Sphere.of_volume({"x": 0.0, "y": 0.0}, pi * 4).radius == pytest.approx(2)
    box = Box({"x": 0.0, "y": 0.0}, {"x": 30.0, "y": 30.0})
    assert box.rotated(pi / 4).bounds()[1]["x"] - 15 == pytest.approx(21.213, abs=1e-3)
    half = Box({"x": -float("inf")}, {"x": 1.0})
    assert at(half, {"x": -1e9}) and not at(half, {"x": 1.5})
    tube = Extruded(Sphere({"x": 0.0, "y": 0.0}, 0.5), ("x", "y"))
    assert not at(tube, {"x": 0.5, "y": 0.5, "z": 9}) and at(tube, {"x": 0, "y": 0, "z": -50})
    assert at(tube, {"x": 0.5, "y": 0.5, "z": 0}, "sdf") == pytest.approx(sqrt(2) / 2 - 0.5)
    both = Union((box, Sphere({"x": 40.0, "y": 0.0}, 2.0)))
    assert at(both, {"x": 41, "y": 0}) and at(~both, {"x": 35, "y": 0}) and not at(both & ~box, {"x": 3, "y": 3})
    can = Cylinder({"x": 0.0, "y": 0.0, "z": 0.0}, 1.0, "z", 2.0)
    assert can.volume == pytest.approx(2 * pi) and at(can, {"x": 2, "y": 0, "z": 2}, "sdf") == pytest.approx(sqrt(2))
    assert Box.largest([box, box.shifted(x=5.0)]).upper["x"] == 35 and box.contains(box.scaled(0.5))
    p = {"x": F.lit(10.0), "y": F.lit(3.0)}
    moved = spark.range(1).select(*[c.alias(a) for a, c in Geometry.push(Sphere({"x": 10.0, "y": 0.0}, 4.0), p, 1.0).items()]).first()
    assert (round(moved.x, 6), round(moved.y, 4)) == (10.0, 5.0)
    hit = line_trace(Sphere({"x": 5.0, "y": 0.0}, 1.0), {"x": F.lit(0.0), "y": F.lit(0.0)}, {"x": F.lit(1.0), "y": F.lit(0.0)}, 48)
    assert spark.range(1).select(hit.alias("r")).first().r == pytest.approx(4, abs=2e-3)


def test_vectors(spark):
    a, b, c = ({k: F.lit(float(v)) for k, v in zip("xyz", t, strict=True)} for t in ((1, 2, 3), (-2, 0.5, 4), (0, 0, 1)))
    ev = lambda *cols: [round(v, 9) for v in spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(cols)]).first()]
    x, y = np.array([1, 2, 3.0]), np.array([-2, 0.5, 4])
    assert ev(*vec.cross(a, b).values()) == np.cross(x, y).round(9).tolist()
    turned = ev(*vec.rotate_axis(a, c, pi / 2).values())
    assert np.allclose(turned, [-2, 1, 3])
    assert ev(vec.dot(vec.orthogonal(a), a), vec.length(vec.normalize(b))) == [0, 1]
    axis, angle = vec.rotation_between(a, b)
    want = y / np.linalg.norm(y) * np.linalg.norm(x)
    assert np.allclose(ev(*vec.rotate_axis(a, axis, angle).values()), want)
    p, q = vec.closest_between_lines(a, b, {k: F.lit(0.0) for k in "xyz"}, c)
    d = np.array(ev(*p.values())) - np.array(ev(*q.values()))
    assert abs(d @ y) < 1e-6 and abs(d[2]) < 1e-6
    tri = [{k: F.lit(float(v)) for k, v in zip("xyz", t, strict=True)} for t in ((0, 0, 0), (1, 0, 0), (0, 1, 0))]
    assert ev(*vec.closest_on_triangle(*tri, {"x": F.lit(0.2), "y": F.lit(0.3), "z": F.lit(5.0)}).values()) == [0.2, 0.3, 0]
    assert ev(*vec.closest_on_triangle(*tri, {"x": F.lit(1.0), "y": F.lit(1.0), "z": F.lit(0.0)}).values()) == [0.5, 0.5, 0]
    assert ev(*vec.solve2x2(2, 1, 1, 3, 5, 10)) == [1, 3] and ev(vec.divide(1, 0), vec.product(0, float("inf"))) == [0, 0]
    z = vec.complex_multiply(vec.complex_(1, 2), vec.complex_(3, -1))
    assert ev(z["re"], z["im"], vec.complex_abs(vec.complex_(3, 4))) == [5, 5, 5]


@pytest.mark.parametrize("kind", ["poly6", "wendland-c2", "quintic-spline"])
@pytest.mark.parametrize("rank", [1, 2, 3])
def test_kernels(spark, kind, rank):
    n, h = 4000, 2.0
    k = kernels.kernel((F.col("id") + 0.5) / n * h, h, rank, kind)
    rows = spark.range(n).orderBy("id").select(k["kernel"].alias("w"), k["grad"].alias("g")).collect()
    r = (np.arange(n) + 0.5) / n * h
    w, g = np.array([x.w for x in rows]), np.array([x.g for x in rows])
    shell = {1: 2 * np.ones(n), 2: 2 * pi * r, 3: 4 * pi * r**2}[rank]
    assert (w * shell).sum() * h / n == pytest.approx(1, abs=1e-3)
    assert np.allclose(np.gradient(w, r)[2:-2], g[2:-2], atol=1e-3)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 10, size=(120, 2))
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "elem_id long, x double, y double")
    d = p[None] - p[:, None]
    got = {(r.src, r.dst) for r in graph.neighbours(df, ("x", "y"), 1.3).collect()}
    assert got == {(i, j) for i, j in zip(*np.where(np.hypot(*d.T).T <= 1.3), strict=True) if i != j}
    d -= np.round(d / 10) * 10
    got = {(r.src, r.dst) for r in graph.neighbours(df, ("x", "y"), 1.3, period={"x": 10.0, "y": 10.0}).collect()}
    assert got == {(i, j) for i, j in zip(*np.where(np.hypot(*d.T).T <= 1.3), strict=True) if i != j}
    small = graph.neighbours(df, ("x", "y"), 6.0, period={"x": 10.0, "y": 10.0})
    assert small.count() == (np.hypot(*d.T) <= 6.0).sum() - 120


def test_meshes(spark):
    m = mesh.from_lists(spark, [(0, 0), (1, 0), (1, 1), (0, 1)], [[0, 1, 2], [0, 2, 3]], {"x": [(1, 2), (3, 0)], "y": [(0, 1), (2, 3)]})
    faces = mesh.faces(m).cache()
    assert faces.where("nb is not null").count() == 2 and {r.boundary for r in faces.where("nb is null").collect()} == {"x", "y"}
    assert {r.volume for r in mesh.geometry(m).collect()} == {0.5}
    flux = {r.eid: round(r.flux, 9) for r in mesh.integrate_flux(faces, F.lit(1.0), F.lit(2.0)).collect()}
    assert flux == {0: 0, 1: 0}
    assert mesh.element_connectivity(m.elements, 2).count() == 2 and mesh.vertex_connectivity(m.elements).count() == 10
    values = spark.createDataFrame([(0, 1.0), (1, 1.0)], "eid long, v double")
    g = mesh.green_gauss(m, faces, values, {}).collect()
    assert all(abs(r.dx) < 1e-9 and abs(r.dy) < 1e-9 for r in g)
    two = mesh.join_meshes(m, m, 4, 2)
    assert two.vertices.count() == 8 and mesh.geometry(two).count() == 4
    near = mesh.sample_nearest(m, values, mesh.green_gauss(m, faces, values, {}), spark.createDataFrame([(0, 0.6, 0.3), (1, 9.0, 9.0)], "elem_id long, x double, y double"), 0.5)
    assert {r.elem_id: r.v for r in near.collect()} == {0: pytest.approx(1.0), 1: None}


def test_surfaces(spark):
    df, g = grid_of(spark, np.arange(5.0) + 1)
    df = df.withColumnRenamed("v", "h")
    pts = spark.createDataFrame([(0, 2.5, 2.9), (1, 2.5, 3.1), (2, 9.0, 0.0)], "elem_id int, x double, up double")
    assert {r.elem_id: r.inside for r in surfaces.height_inside(pts, df, g, "up").collect()} == {0: True, 1: False, 2: False}
    d = {r.elem_id: r.distance for r in surfaces.height_distance(pts, df, g, "up").collect()}
    assert d[1] == pytest.approx(0.1 / sqrt(2))
    ball = Sphere({"x": 5.0, "y": 5.0}, 3.0)
    box = Grid.of(0.0, x=20, y=20, upper={"x": 10, "y": 10})
    field = surfaces.sample_sdf(spark, ball, box)
    spots = spark.createDataFrame([(0, 5.1, 5.2), (1, 9.0, 9.0), (2, 5.0, 12.0)], "elem_id int, x double, y double")
    for r in surfaces.sdf_at(spots, field, box).collect():
        assert r.distance == pytest.approx(np.hypot(r.x - 5, r.y - 5) - 3, abs=0.3)
    share = surfaces.occupancy(field, box).agg(F.sum("share")).first()[0] * box.cell_volume
    assert share == pytest.approx(ball.volume, rel=0.02)
    far = field.withColumn("d", F.when(F.abs("d") > 0.5, F.signum("d") * 99).otherwise(F.col("d")))
    fixed = array(surfaces.rebuild_sdf(far, box, 12), box, "d")
    assert abs(fixed).max() < 10
    mask = surfaces.occupancy(field, box).withColumn("mask", F.col("share") > 0.5).withColumn("mask", F.col("mask").cast("int"))
    assert {r.elem_id: r.inside for r in surfaces.voxel_inside(spots, mask, box).collect()} == {0: True, 1: False, 2: False}
    controls = [[{"x": i, "y": j, "z": i + 2 * j} for j in range(4)] for i in range(5)]
    uv = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.3, 0.6)], "u double, v double")
    for r in surfaces.sheet_at(uv, controls).collect():
        assert r.z == pytest.approx(r.x + 2 * r.y)
    assert surfaces.clamped_knots(5, 2) == [0, 0, 0, 1 / 3, 2 / 3, 1, 1, 1]


def test_scenes(spark, tmp_path):
    parent = f"file://{tmp_path}/runs"
    first, second = scene.Scene.create(spark, parent), scene.Scene.create(spark, parent)
    assert [s.path[-6:] for s in scene.Scene.list(spark, parent)] == ["000000", "000001"]
    assert scene.Scene.at(spark, parent, -1).path == second.path
    with pytest.raises(FileNotFoundError):
        scene.Scene.at(spark, parent, 7)
    df, g = grid_of(spark, np.arange(6.0).reshape(2, 3))
    for frame in (0, 1):
        first.write("smoke", frame, df)
    first.write("velocity", 1, df)
    first.write("smoke", 1, df.withColumn("v", F.col("v") + 1))
    assert array(first.read("smoke", 1), g).tolist() == [[1, 2, 3], [4, 5, 6]]
    catalog = first.catalog()
    assert [r.frame for r in scene.complete_frames(catalog).collect()] == [1] and scene.frames(catalog).count() == 2
    first.put_properties(dt=np.float64(0.1), n=3)
    first.put_properties(n=4)
    second.put_properties(dt=0.1, n=5)
    assert first.properties == {"dt": 0.1, "n": 4}
    assert scene.merge_properties(spark, [first, second]) == {"dt": 0.1, "n": [4, 5]}
    second.put_properties(extra=1)
    with pytest.raises(KeyError):
        scene.merge_properties(spark, [first, second])
    logs = spark.createDataFrame([(0, 0.5), (1, 0.25)], "frame int, step_time double")
    scene.write_scalars(logs, f"{parent}/log_a")
    back = scene.cumulative_time(scene.read_scalars(spark, f"{parent}/log_a", ["step_time"]), "step_time")
    assert sorted((r.frame, r.time) for r in back.collect()) == [(0, 0.5), (1, 0.75)]
    moved = second.rename(f"{parent}/sim_000009")
    assert moved.exists() and not second.exists()
    moved.remove()
    assert not moved.exists()


def test_npz_round_trip(spark, tmp_path, noise):
    df, g = grid_of(spark, noise, {"x": "periodic", "y": (2.0, "edge")})
    both = df.withColumn("run", F.lit("a")).union(df.withColumn("v", -F.col("v")).withColumn("run", F.lit("b")))
    assert npz.write(both, g, f"file://{tmp_path}/out", "smoke", batch="run").count() == 2
    rows = npz.read(spark, f"file://{tmp_path}/out/*.npz")
    assert np.allclose(array(rows.where("file like '%_a.npz'"), g), noise) and rows.where("iz is not null").count() == 0
    assert npz.decode((tmp_path / "out" / "smoke_a.npz").read_bytes())[1] == g
    spark.dataSource.register(npz.FieldNpz)
    again = spark.read.format("field_npz").load(f"{tmp_path}/out")
    assert again.count() == 2 * noise.size and np.allclose(array(again.where("file like '%_b.npz'"), g), -noise)


SU2 = """NDIME= 2
NELEM= 2
5 0 1 2 0
5 0 2 3 1
NPOIN= 4
0 0 0
1 0 1
1 1 2
0 1 3
NMARK= 1
MARKER_TAG= wall
MARKER_ELEMS= 2
3 0 1
3 2 3
"""
MSH = """$MeshFormat
2.2 0 8
$EndMeshFormat
$PhysicalNames
1
1 7 "wall"
$EndPhysicalNames
$Nodes
4
1 0 0 0
2 1 0 0
3 1 1 0
4 0 1 0
$EndNodes
$Elements
4
1 1 2 7 1 1 2
2 1 2 7 1 3 4
3 2 2 1 1 1 2 3
4 2 2 1 1 1 3 4
$EndElements
"""
STL = "solid s\n" + "".join(
    "facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {x} {y} 0\n" for x, y in t) + "endloop\nendfacet\n" for t in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))
) + "endsolid s\n"


@pytest.mark.parametrize("name,content", [("a.su2", SU2), ("a.msh", MSH), ("a.stl", STL)])
def test_mesh_files(spark, tmp_path, name, content):
    (tmp_path / name).write_text(content)
    m = meshfiles.load_mesh(spark, f"file://{tmp_path}/{name}")
    assert m.vertices.count() == 4
    assert sorted(r.volume for r in mesh.geometry(m).collect()) == [0.5, 0.5]
    assert m.boundaries.where("name = 'wall'").count() == (0 if name.endswith("stl") else 2)


def test_names(spark):
    rows = spark.createDataFrame([("  Hello, World! ",), ("ω-β  field",), ("Σx",), (None,)], "s string")
    assert [r.s for r in rows.select(text.slugify(F.col("s")).alias("s")).collect()] == ["hello-world", "omega-beta-field", "sigmax", None]
    assert rows.limit(1).select(text.field_file_name(F.lit("_a.b")).alias("s")).first().s == "a_b"


def test_obstacles_and_points(spark):
    g = Grid.of(0.0, x=64, y=64)
    mask = lattice.lattice(spark, g, m=1.0)
    pts = lattice.distribute_points(mask, g, "m", 1, center=True)
    assert pts.count() == 4096
    ball = Sphere({"x": 20.0, "y": 20.0}, 6.0)
    out = physics.boundary_push(pts, g, [ball], 0.5)
    pos = {"x": F.col("x"), "y": F.col("y")}
    assert out.where(ball.lies_inside(pos)).count() == 0 and out.where("x < 0.5 or y < 0.5 or x > 63.5 or y > 63.5").count() == 0
    jitter = lattice.distribute_points(mask, g, "m", 2, seed=4)
    assert jitter.select("elem_id").distinct().count() == 8192 and jitter.where("x < 0 or x > 64").count() == 0
    faces = physics.apply_obstacle(lattice.face_lattice(spark, g, x=1.0, y=1.0), g, ball)
    assert faces.where("ix = 20 and iy = 20 and v <> 0").count() == 0
    states = physics.iterate(lambda d: d.withColumn("m", F.col("m") * 2), mask.limit(1), 3)
    assert sorted(r.m for r in states.collect()) == [1, 2, 4, 8]


def test_streams(spark, tmp_path):
    from quadrille.streaming.scatter import scatter_stream

    data = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 600) as ts, id % 4 + 0.5 as x, id * 1.0D as v from range(300)")
    data.repartition(3).write.parquet(f"{tmp_path}/in")
    g = Grid.of(0.0, x=3)
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    q = scatter_stream(stream, g, "ts").writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.ix): (r.v, r.n) for r in scatter_stream(data, g, "ts").collect()}
    assert {(r.start, r.ix): (r.v, r.n) for r in spark.table("cells").collect()} == want and len(want) == 9


def test_catalog_has_sql_for_most():
    from quadrille import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.ORACLE_SQL) >= 55
    assert json.dumps(sorted(catalog.QUERIES))
