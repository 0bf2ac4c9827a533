"""Sampled shapes: height maps, signed-distance lattices, voxels, and B-spline sheets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vector as vec
from ..meta import EDGE, Grid
from .geometry import Geometry
from .lattice import cell_of, centers, lattice
from .mesh import Mesh
from .resample import interpolate
from .stencil import gradient
from .tensors import linear_index
from .tiles import tiled

#: Control points of a sheet by row and column, each a dict by axis.
Controls = list[list[dict[str, float]]]

# --- height maps -----------------------------------------------------------------------------------


def height_at(points: DataFrame, heights: DataFrame, grid: Grid, value: str = "h", out: str = "height") -> DataFrame:
    """The height under each point, linear between cell centers and constant beyond the outer ones."""
    return interpolate(points, heights, grid.with_boundary(EDGE), [value], suffix="_at").withColumnRenamed(f"{value}_at", out)


def height_inside(points: DataFrame, heights: DataFrame, grid: Grid, up: str, value: str = "h", fill_below: bool = True) -> DataFrame:
    """Adds ``inside``: at or under the surface, or with ``fill_below`` False at or over it; outside the box it is False."""
    rows = height_at(points, heights, grid, value)
    within = reduce(lambda a, b: a & b, [(F.col(a) >= grid.lower[a]) & (F.col(a) <= grid.upper[a]) for a in grid.axes])
    test = F.col(up) <= F.col("height") if fill_below else F.col(up) >= F.col("height")
    return rows.withColumn("inside", within & test).drop("height")


def height_distance(points: DataFrame, heights: DataFrame, grid: Grid, up: str, value: str = "h") -> DataFrame:
    """Adds ``distance``: to the tangent plane under each point, so exact for planes."""
    slope = gradient(heights.select(*grid.keys, value), grid.with_boundary(EDGE), value)
    names = [value, *[f"d{a}" for a in grid.axes]]
    rows = interpolate(points, slope, grid.with_boundary(EDGE), names, suffix="_at")
    steep = reduce(lambda a, b: a + b, [F.col(f"d{a}_at") ** 2 for a in grid.axes])
    out = (F.col(up) - F.col(f"{value}_at")) / F.sqrt(1 + steep)
    return rows.withColumn("distance", out).drop(*[f"{n}_at" for n in names])


def height_vertices(heights: DataFrame, grid: Grid, up: str, value: str = "h") -> DataFrame:
    """The places of the surface over cell centers: keys, the grid's axes, and ``up``."""
    return heights.withColumns(centers(grid)).select(*grid.keys, *grid.axes, F.col(value).alias(up))


def height_planes(heights: DataFrame, grid: Grid, up: str, value: str = "h", fill_below: bool = True) -> DataFrame:
    """The plane of each square (in two axes; else segment) between neighbouring centers, by its lower cell.

    Columns: keys; the middle c<axis>; the normal n<axis>, which points away from
    the filled side; ``offset``, so that normal times place plus offset is the
    distance; ``lowest`` and ``highest`` of its corners.
    """
    t = tiled(heights, grid.with_boundary("none"), {a: (0, 1) for a in grid.axes}, (value,))
    rows, names = t.df, {(): value}
    for axis in grid.axes:
        new = {(*o, k): f"_h{''.join(map(str, o))}{k}" for o in names for k in (0, 1)}
        rows = rows.withColumns({n: t.neighbour(names[o[:-1]], axis, o[-1]) for o, n in new.items()})
        names = new
    inner = reduce(lambda a, b: a & b, [F.col(f"i{a}") < n - 1 for a, n in grid.resolution.items()])
    rows = t.own(rows).where(inner)
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    half = len(names) // 2
    slope = {
        a: total([F.col(n) * (1 if o[k] else -1) for o, n in names.items()]) / (half * F.lit(grid.dx[a])) for k, a in enumerate(grid.axes)
    }
    middle = {a: c + F.lit(grid.dx[a] / 2) for a, c in centers(grid).items()} | {up: total([F.col(n) for n in names.values()]) / len(names)}
    normal, offset = vec.plane_from_slope(slope, up, middle)
    side = 1.0 if fill_below else -1.0
    corners = [F.col(n) for n in names.values()]
    return rows.select(
        *grid.keys,
        *[c.alias(f"c{a}") for a, c in middle.items()],
        *[(c * side).alias(f"n{a}") for a, c in normal.items()],
        (-offset * side).alias("offset"),
        F.least(*corners).alias("lowest"),
        F.greatest(*corners).alias("highest"),
    )


# --- signed-distance lattices ----------------------------------------------------------------------


def sample_sdf(spark: SparkSession, shape: Geometry, grid: Grid, out: str = "d") -> DataFrame:
    """A shape's signed distance at cell centers."""
    return lattice(spark, grid).withColumn(out, shape.sdf(centers(grid)).cast("double"))


def sdf_at(points: DataFrame, distances: DataFrame, grid: Grid, value: str = "d", out: str = "distance") -> DataFrame:
    """The distance at points, linear between cells; beyond the box, that of the nearest place in it plus the way there."""
    beyond = F.sqrt(
        reduce(
            lambda a, b: a + b,
            [F.greatest(F.lit(grid.lower[a]) - F.col(a), F.col(a) - F.lit(grid.upper[a]), F.lit(0.0)) ** 2 for a in grid.axes],
        )
    )
    rows = interpolate(points, distances, grid.with_boundary(EDGE), [value], suffix="_at")
    return rows.withColumn(out, F.col(f"{value}_at") + beyond).drop(f"{value}_at")


def occupancy(distances: DataFrame, grid: Grid, value: str = "d", out: str = "share") -> DataFrame:
    """How much of each cell is inside, from the distance of its center."""
    size = max(grid.dx.values())
    return distances.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - F.col(value) / size)))


def rebuild_sdf(distances: DataFrame, grid: Grid, steps: int, value: str = "d") -> DataFrame:
    """Distances off the surface made consistent: each is at most a neighbour's plus the way, ``steps`` times.

    Cells within one cell of the surface stay.
    """
    near = max(grid.dx.values())
    open_grid = grid.with_boundary("none")
    for _ in range(steps):
        t = tiled(distances, open_grid, {a: 1 for a in grid.axes}, (value,))
        v, sign = F.col(value), F.signum(value)
        around = [F.abs(t.neighbour(value, a, o)) + F.lit(grid.dx[a]) for a in grid.axes for o in (-1, 1)]
        least = F.least(*[F.coalesce(x, F.lit(float("inf"))) for x in around])
        new = F.when(F.abs(v) <= near, v).otherwise(sign * F.least(F.abs(v), least))
        distances = t.own(t.df.withColumn("_n", new)).select(*grid.keys, F.col("_n").alias(value))
    return distances


def surface_net(distances: DataFrame, grid: Grid, value: str = "d") -> Mesh:
    """The surface where a field over cell centers passes 0, as triangles whose normals point to larger values.

    Each cube of eight centers that lie on both sides (below 0, and 0 or more)
    has a vertex, the mean of where its edges cross; each inner edge that crosses
    joins its four cubes.  Centers without a value are on no side.  One shuffle
    with a thin halo; where the surface leaves the lattice it is open.
    """
    t = tiled(distances, grid.with_boundary("none"), {a: (0, 1) for a in grid.axes}, (value,))
    rows, names = t.df, {(): value}
    for axis in grid.axes:
        new = {(*o, k): f"_v{''.join(map(str, o))}{k}" for o in names for k in (0, 1)}
        rows = rows.withColumns({n: t.neighbour(names[o[:-1]], axis, o[-1]) for o, n in new.items()})
        names = new
    rows = t.own(rows).withColumn("_at", linear_index(grid))
    x, y, z = grid.axes

    places = []
    for low in names:
        for k in range(3):
            if not low[k]:
                a, b = F.col(names[low]), F.col(names[(*low[:k], 1, *low[k + 1 :])])
                spot = [F.lit(float(q)) if j != k else a / (a - b) for j, q in enumerate(low)]
                places.append(F.when((a < 0) != (b < 0), F.struct(*[c.alias(n) for c, n in zip(spot, "xyz", strict=True)])))
    whole = reduce(lambda p, q: p & q, [F.col(n).isNotNull() for n in names.values()])
    cubes = rows.where(whole).withColumn("_c", F.array_compact(F.array(*places))).where(F.size("_c") > 0)
    middle = centers(grid)
    mean = lambda n: F.aggregate("_c", F.lit(0.0), lambda s, c: s + c[n]) / F.size("_c")
    vertices = cubes.select(
        F.col("_at").alias("vid"), *[(middle[a] + mean(n) * F.lit(grid.dx[a])).alias(n) for a, n in zip((x, y, z), "xyz", strict=True)]
    )

    stride = {x: grid.resolution[y] * grid.resolution[z], y: grid.resolution[z], z: 1}
    quads = []
    for k, axis in enumerate(grid.axes):
        u, v = grid.axes[(k + 1) % 3], grid.axes[(k + 2) % 3]
        a, b = F.col(value), F.col(names[tuple(int(j == k) for j in range(3))])
        inner = reduce(lambda p, q: p & q, [(F.col(f"i{w}") > 0) & (F.col(f"i{w}") < grid.resolution[w] - 1) for w in (u, v)])
        ring = [F.col("_at") - d for d in (stride[u] + stride[v], stride[v], 0, stride[u])]  # turns right-handed about the axis
        up = [F.array(ring[0], ring[1], ring[2]), F.array(ring[0], ring[2], ring[3])]
        down = [F.array(ring[2], ring[1], ring[0]), F.array(ring[3], ring[2], ring[0])]
        for j in range(2):
            name = (F.col("_at") * 6 + 2 * k + j).alias("eid")
            quads.append(F.when(inner & ((a < 0) != (b < 0)), F.struct(name, F.when(a < 0, up[j]).otherwise(down[j]).alias("vids"))))
    elements = rows.select(F.explode(F.array_compact(F.array(*quads))).alias("e")).select("e.*")
    # a quad stands only if its four cubes have all their values
    kept = elements.select("eid", F.explode("vids").alias("vid")).join(vertices.select("vid"), "vid", "left_anti").select("eid").distinct()
    return Mesh(vertices, elements.join(kept, "eid", "left_anti"))


def surface_mesh(spark: SparkSession, shape: Geometry, grid: Grid) -> Mesh:
    """Any shape's surface as triangles, from its distance at the centers of a lattice."""
    return surface_net(sample_sdf(spark, shape, grid), grid)


def onto_surface(points: DataFrame, shape: Geometry, steps: int = 4, step: float = 1e-4) -> DataFrame:
    """Points moved onto a shape's surface along the distance's gradient; a step is a projection of its own, so plans stay small."""
    axes = list(shape.bounds()[0])
    for _ in range(steps):
        p = {a: F.col(a) for a in axes}
        d = shape.sdf(p)
        slope = {a: (shape.sdf({**p, a: x + step}) - shape.sdf({**p, a: x - step})) / (2 * step) for a, x in p.items()}
        points = points.withColumns({"_d": d} | {f"_g{a}": c for a, c in slope.items()})
        square = reduce(lambda q, r: q + r, [F.col(f"_g{a}") ** 2 for a in axes])
        points = points.withColumns({a: F.col(a) - vec.divide(F.col("_d") * F.col(f"_g{a}"), square) for a in axes}).drop("_d", *[f"_g{a}" for a in axes])
    return points


# --- voxels ----------------------------------------------------------------------------------------


def voxel_inside(points: DataFrame, mask: DataFrame, grid: Grid, value: str = "mask") -> DataFrame:
    """Adds ``inside``: whether the point's cell is set; False outside the box."""
    cells = cell_of(grid, False, **{a: F.col(a) for a in grid.axes})
    rows = points.withColumns(cells).join(mask.where(F.col(value) != 0).select(*grid.keys, F.lit(True).alias("_set")), grid.keys, "left")
    return rows.withColumn("inside", F.coalesce("_set", F.lit(False))).drop("_set", *grid.keys)


# --- B-splines -------------------------------------------------------------------------------------


def clamped_knots(bases: int, degree: int) -> list[float]:
    """Knots from 0 to 1 that repeat at the ends, so the curve starts and ends in its outer points."""
    inner = bases - degree - 1
    return [0.0] * (degree + 1) + [k / (inner + 1) for k in range(1, inner + 1)] + [1.0] * (degree + 1)


def open_knots(bases: int, degree: int) -> list[float]:
    n = bases + degree + 1
    return [k / (n - 1) for k in range(n)]


def basis(t: Column, knots: list[float], degree: int) -> list[Column]:
    """All basis functions at ``t`` by the recursion of Cox and de Boor, as expressions; the last knot belongs to the last span."""
    last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
    level = []
    for k in range(len(knots) - 1):
        lo, hi = F.lit(knots[k]), F.lit(knots[k + 1])
        level.append(F.when((t >= lo) & ((t <= hi) if k == last else (t < hi)), 1.0).otherwise(0.0))
    for d in range(1, degree + 1):
        new = []
        for k in range(len(knots) - d - 1):
            a, b = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            left = (t - F.lit(knots[k])) / F.lit(a) * level[k] if a else F.lit(0.0)
            right = (F.lit(knots[k + d + 1]) - t) / F.lit(b) * level[k + 1] if b else F.lit(0.0)
            new.append(left + right)
        level = new
    return level


def basis_slopes(t: Column, knots: list[float], degree: int) -> list[Column]:
    """Derivatives of all basis functions at ``t``."""
    if not degree:
        return [F.lit(0.0)] * (len(knots) - 1)
    low, out = basis(t, knots, degree - 1), []
    for k in range(len(knots) - degree - 1):
        a, b = knots[k + degree] - knots[k], knots[k + degree + 1] - knots[k + 1]
        out.append((low[k] * (degree / a) if a else F.lit(0.0)) - (low[k + 1] * (degree / b) if b else F.lit(0.0)))
    return out


def sheet_at(points: DataFrame, controls: list[list[dict[str, float]]], degree: int = 2, u: str = "u", v: str = "v") -> DataFrame:
    """Adds x, y, z of a clamped B-spline sheet at parameters u, v (0 to 1); control points are given by row and column."""
    nu, nv = len(controls), len(controls[0])
    bu, bv = basis(F.col(u), clamped_knots(nu, degree), degree), basis(F.col(v), clamped_knots(nv, degree), degree)
    rows = points.withColumns({f"_u{i}": b for i, b in enumerate(bu)} | {f"_v{j}": b for j, b in enumerate(bv)})
    out = {}
    for a in controls[0][0]:
        terms = [F.col(f"_u{i}") * F.col(f"_v{j}") * F.lit(float(controls[i][j][a])) for i in range(nu) for j in range(nv)]
        out[a] = reduce(lambda x, y: x + y, terms)
    return rows.withColumns(out).drop(*[f"_u{i}" for i in range(nu)], *[f"_v{j}" for j in range(nv)])


def sheet_surface(
    points: DataFrame, controls: Controls, degree: int = 2, weights: list[list[float]] | None = None, u: str = "u", v: str = "v"
) -> DataFrame:
    """Adds the place x, y, z of a clamped sheet at u, v, its tangents ux.., vx.., and its unit normal nx.. (along u before v).

    With ``weights`` of the control points the sheet is rational.
    """
    nu, nv = len(controls), len(controls[0])
    ku, kv = clamped_knots(nu, degree), clamped_knots(nv, degree)
    parts = {"_b": basis(F.col(u), ku, degree), "_s": basis_slopes(F.col(u), ku, degree), "_c": basis(F.col(v), kv, degree), "_t": basis_slopes(F.col(v), kv, degree)}
    rows = points.withColumns({f"{n}{i}": c for n, cols in parts.items() for i, c in enumerate(cols)})
    weight = weights or [[1.0] * nv for _ in range(nu)]

    def total(p: str, q: str, f) -> Column:
        terms = [F.col(f"{p}{i}") * F.col(f"{q}{j}") * F.lit(float(f(i, j))) for i in range(nu) for j in range(nv)]
        return reduce(lambda x, y: x + y, terms)

    sums = {"": ("_b", "_c"), "u": ("_s", "_c"), "v": ("_b", "_t")}
    wide = {f"_w{d}": total(*at, lambda i, j: weight[i][j]) for d, at in sums.items()}
    for x in "xyz":
        wide |= {f"_{x}{d}": total(*at, lambda i, j, x=x: weight[i][j] * controls[i][j][x]) for d, at in sums.items()}
    rows = rows.withColumns(wide)
    place = {x: F.col(f"_{x}") / F.col("_w") for x in "xyz"}
    slopes = {f"{d}{x}": (F.col(f"_{x}{d}") - place[x] * F.col(f"_w{d}")) / F.col("_w") for d in "uv" for x in "xyz"}
    rows = rows.withColumns(place | slopes)
    normal = vec.normalize(vec.cross(*[{x: F.col(f"{d}{x}") for x in "xyz"} for d in "uv"]))
    used = [*wide, *[f"{n}{i}" for n, cols in parts.items() for i in range(len(cols))]]
    return rows.withColumns({f"n{x}": c for x, c in normal.items()}).drop(*used)


def sheet_lattice(spark: SparkSession, res_u: int, res_v: int, margin: float = 0.0) -> DataFrame:
    """(vid, u, v): parameters from ``margin`` to 1 - ``margin``."""
    along = lambda k, n: F.lit(margin) + k * ((1 - 2 * margin) / max(1, n - 1))
    i, j = F.floor(F.col("id") / res_v), F.pmod(F.col("id"), F.lit(res_v))
    return spark.range(res_u * res_v).select(F.col("id").alias("vid"), along(i, res_u).alias("u"), along(j, res_v).alias("v"))


def sheet_mesh(spark: SparkSession, controls: Controls, degree: int = 2, res_u: int = 32, res_v: int = 32) -> Mesh:
    """The sheet as quadrilaterals between parameters in equal steps."""
    vertices = sheet_at(sheet_lattice(spark, res_u, res_v), controls, degree).select("vid", "x", "y", "z")
    r, c = F.floor(F.col("id") / (res_v - 1)), F.pmod(F.col("id"), F.lit(res_v - 1))
    at = lambda a, b: (r + a) * res_v + c + b
    elements = spark.range((res_u - 1) * (res_v - 1)).select(F.col("id").alias("eid"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("vids"))
    return Mesh(vertices, elements)


def _bases(t: np.ndarray, knots: list[float], degree: int) -> tuple[np.ndarray, np.ndarray]:
    """``basis`` and ``basis_slopes`` of many parameters: arrays of parameters by functions."""
    k = np.asarray(knots)
    last = max(i for i in range(len(k) - 1) if k[i] < k[i + 1])
    at = np.clip(np.searchsorted(k, t, "right") - 1, degree, last)
    level = (at[:, None] == np.arange(len(k) - 1)).astype(float)
    slopes = np.zeros_like(level)
    for d in range(1, degree + 1):
        n = len(k) - d - 1
        left, right = k[d : d + n] - k[:n], k[d + 1 : d + 1 + n] - k[1 : n + 1]
        below = np.divide(level[:, :n], left, out=np.zeros((len(t), n)), where=left > 0)
        above = np.divide(level[:, 1 : n + 1], right, out=np.zeros((len(t), n)), where=right > 0)
        slopes = d * (below - above)
        level = (t[:, None] - k[:n]) * below + (k[d + 1 : d + 1 + n] - t[:, None]) * above
    return level, slopes


def closest_on_sheet(points: DataFrame, controls: Controls, degree: int = 2, samples: int = 16, steps: int = 3) -> DataFrame:
    """Adds u, v of the sheet's nearest place, that place sx, sy, sz, and ``distance``, negative on the side the normal points from.

    From the nearest of ``samples`` squared places, damped Gauss-Newton steps
    along the tangents; a step moves u and v by half a sample at most.  Rows are
    independent, so they run in Arrow batches (as expressions the steps outgrow
    generated code).  Points without a coordinate get nulls.
    """
    knots = [clamped_knots(n, degree) for n in (len(controls), len(controls[0]))]
    c = np.array([[[q[x] for x in "xyz"] for q in row] for row in controls], float)
    gap = 1 / (2 * samples)

    def evaluate(uv: np.ndarray):
        (bu, du), (bv, dv) = (_bases(uv[:, k], knots[k], degree) for k in range(2))
        return [np.einsum("pi,pj,ijx->px", a, b, c, optimize=True) for a, b in ((bu, bv), (du, bv), (bu, dv))]

    line = np.linspace(gap, 1 - gap, samples)
    known = np.stack(np.meshgrid(line, line, indexing="ij"), -1).reshape(-1, 2)
    places = evaluate(known)[0]

    def nearest(p: np.ndarray) -> np.ndarray:
        best = [((q[:, None] - places) ** 2).sum(-1).argmin(1) for q in np.array_split(p, -(-len(p) // 1024))]
        return known[np.concatenate(best)].copy()

    def run(batches):
        for rows in batches:
            p = rows[["x", "y", "z"]].to_numpy(float)
            out = np.full((len(p), 6), np.nan)
            there = np.isfinite(p).all(1)
            if there.any():
                p = p[there]
                uv = nearest(p)
                for k in range(steps):
                    at, tu, tv = evaluate(uv)
                    uu, vv, both = (tu * tu).sum(1), (tv * tv).sum(1), (tu * tv).sum(1)
                    pu, pv = ((p - at) * tu).sum(1), ((p - at) * tv).sum(1)
                    det = uu * vv - both * both
                    move = np.stack([vv * pu - both * pv, uu * pv - both * pu], 1)
                    move = np.divide(move, det[:, None], out=np.zeros_like(move), where=det[:, None] > 0)
                    uv = np.clip(uv + np.clip(move, -gap, gap) * 0.8**k, 0, 1)
                at, tu, tv = evaluate(uv)
                side = np.where(((p - at) * np.cross(tu, tv)).sum(1) < 0, -1.0, 1.0)
                out[there] = np.column_stack([uv, at, side * np.linalg.norm(p - at, axis=1)])
            found = dict(zip(names, out.T, strict=True))
            yield rows.assign(**{n: pd.Series(a, rows.index).astype(object).where(np.isfinite(a), None) for n, a in found.items()})

    names = ["u", "v", "sx", "sy", "sz", "distance"]
    kept = points.drop(*names)
    schema = StructType([*kept.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return kept.mapInPandas(run, schema)


def double_cover(controls: Controls, radius: list[list[float]]) -> tuple[Controls, Controls]:
    """Front and back control points: moved along the control lattice's normals by plus and minus the radius; rows at the rim stay, so the sheets meet.

    Driver-side: control lattices are small.
    """
    p = np.array([[[c[x] for x in "xyz"] for c in row] for row in controls], float)
    normal = np.cross(np.gradient(p, axis=0), np.gradient(p, axis=1))
    size = np.linalg.norm(normal, axis=2, keepdims=True)
    move = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0) * np.asarray(radius, float)[..., None]
    move[[0, -1]] = 0
    move[:, [0, -1]] = 0
    as_controls = lambda q: [[dict(zip("xyz", map(float, c), strict=True)) for c in row] for row in q]
    return as_controls(p + move), as_controls(p - move)
