"""Solids around a sheet of control points: a skeleton that is linear between them, with a thickness and rounded rims.

Control lattices are small and stay on the driver; points and mesh rows are DataFrames.
Parameters u, v run from 0 to the number of control points less one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as vec
from .geometry import Box, Cylinder, Geometry, Sphere
from .mesh import Mesh
from .surfaces import Controls, closest_on_sheet, sheet_at, sheet_surface

RIMS = ("u-", "u+", "v-", "v+")


@dataclass(frozen=True)
class SplineSolid:
    """``fillet`` by rim: 1 rounds it with a half circle, 0 leaves a flat end."""

    points: Controls
    thickness: list[list[float]]
    fillet: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RIMS, 0.0))

    @property
    def resolution(self) -> tuple[int, int]:
        return len(self.points), len(self.points[0])

    def _unit(self, rows: DataFrame, u: str, v: str) -> DataFrame:
        nu, nv = self.resolution
        inside = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / max(1, n - 1)))
        return rows.withColumns({"_u": inside(u, nu), "_v": inside(v, nv)})

    def center_at(self, rows: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
        """Adds the skeleton's place x, y, z; beyond the rims, that at the rim."""
        return sheet_at(self._unit(rows, u, v), self.points, 1, "_u", "_v").drop("_u", "_v")

    def thickness_at(self, rows: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
        """Adds the interpolated ``thickness``."""
        values = [[{"thickness": t} for t in row] for row in self.thickness]
        return sheet_at(self._unit(rows, u, v), values, 1, "_u", "_v").drop("_u", "_v")

    def rectified(self, least: float = 1e-5) -> SplineSolid:
        """A solid of two by two points made a rectangle, its thickness at least ``least`` and fillets from 0 to 1."""
        if self.resolution != (2, 2):
            raise ValueError("only solids of two by two control points have a rectangle")
        p = np.array([[[c[x] for x in "xyz"] for c in row] for row in self.points], float)
        along, across = p[0, 1] - p[0, 0], p[1, 0] - p[0, 0]
        size = along @ along
        straight = across - along * ((across @ along) / size if size else 0.0)
        norm = np.linalg.norm(straight)
        straight = straight * (np.linalg.norm(across) / norm) if norm else straight
        q = [[p[0, 0], p[0, 0] + along], [p[0, 0] + straight, p[0, 0] + along + straight]]
        points = [[dict(zip("xyz", map(float, c), strict=True)) for c in row] for row in q]
        fillet = {k: min(1.0, max(0.0, f)) for k, f in self.fillet.items()}
        return replace(self, points=points, thickness=[[max(least, t) for t in row] for row in self.thickness], fillet=fillet)


def to_spline(shape: Geometry, separation: float = 1e-5) -> SplineSolid:
    """A box, a cylinder of finite depth, or a ball as a solid; ``separation`` keeps the control points of a line or point apart."""
    if isinstance(shape, Box) and len(shape.size) == 3:
        size, middle = shape.size, shape.center
        thin = min("xyz", key=lambda a: size[a])
        u, v = ("xyz"[("xyz".index(thin) + k) % 3] for k in (1, 2))
        offsets = [[{u: (i - 0.5) * size[u], v: (j - 0.5) * size[v]} for j in range(2)] for i in range(2)]
        thickness, fillet = size[thin], dict.fromkeys(RIMS, 0.0)
    elif isinstance(shape, Cylinder) and shape.depth is not None and len(shape.center) == 3:
        middle, thickness = shape.center, 2 * shape.radius
        side = "xyz"[("xyz".index(shape.axis) + 1) % 3]
        gap = shape.depth * separation
        offsets = [[{shape.axis: (i - 0.5) * shape.depth, side: (2 * j - 1) * gap} for j in range(2)] for i in range(2)]
        fillet = {"u-": 0.0, "u+": 0.0, "v-": 1.0, "v+": 1.0}
    elif isinstance(shape, Sphere) and len(shape.center) == 3:
        middle, thickness = shape.center, 2 * shape.radius
        gap = separation * thickness
        offsets = [[{"x": (i - 0.5) * gap, "y": (j - 0.5) * gap} for j in range(2)] for i in range(2)]
        fillet = dict.fromkeys(RIMS, 1.0)
    else:
        raise ValueError(f"{type(shape).__name__} has no skeleton here: boxes, cylinders and balls in space have")
    points = [[{a: middle[a] + o.get(a, 0.0) for a in "xyz"} for o in row] for row in offsets]
    return SplineSolid(points, [[thickness] * 2 for _ in range(2)], fillet)


def _frames(solid: SplineSolid, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, unit tangents along u and v, unit normals, and radii on the skeleton, ``fine`` steps between control points."""
    p = np.array([[[c[x] for x in "xyz"] for c in row] for row in solid.points], float)
    r = np.array(solid.thickness, float)[..., None] / 2

    def finer(a: np.ndarray, axis: int) -> np.ndarray:
        at = np.linspace(0, a.shape[axis] - 1, (a.shape[axis] - 1) * fine + 1)
        low = np.minimum(at.astype(int), max(0, a.shape[axis] - 2))
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
        return np.take(a, low, axis) * (1 - share) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis) * share

    p, r = (finer(finer(a, 0), 1) for a in (p, r))
    unit = lambda a: np.divide(a, np.linalg.norm(a, axis=-1, keepdims=True), out=np.zeros_like(a), where=np.linalg.norm(a, axis=-1, keepdims=True) > 0)
    tu, tv = unit(np.gradient(p, axis=0)), unit(np.gradient(p, axis=1))
    return p, tu, tv, unit(np.cross(tu, tv)), r[..., 0]


def solid_mesh(spark: SparkSession, solid: SplineSolid, fine: int = 4, segments: int = 5) -> Mesh:
    """The closed surface: the skeleton moved to both sides by half the thickness, and the rim between them in ``segments`` steps.

    Quadrilaterals turn outward.  At a corner the rim points along both rims' ways out, each as far as its fillet says.
    """
    p, tu, tv, n, r = _frames(solid, fine)
    nu, nv = r.shape
    out = np.zeros_like(p)
    for rim, part, way in (("u-", np.s_[0, :], -tu), ("u+", np.s_[-1, :], tu), ("v-", np.s_[:, 0], -tv), ("v+", np.s_[:, -1], tv)):
        out[part] += solid.fillet[rim] * way[part]
    number = np.arange(nu * nv).reshape(nu, nv)
    places = [*(p + n * r[..., None]).reshape(-1, 3), *(p - n * r[..., None]).reshape(-1, 3)]
    back = nu * nv
    quads = []
    for i in range(nu - 1):
        for j in range(nv - 1):
            ring = [number[i, j], number[i + 1, j], number[i + 1, j + 1], number[i, j + 1]]
            quads += [ring, [q + back for q in ring[::-1]]]
    loop = [(i, 0) for i in range(nu)] + [(nu - 1, j) for j in range(1, nv)] + [(i, nv - 1) for i in range(nu - 2, -1, -1)] + [(0, j) for j in range(nv - 2, 0, -1)]
    columns = []
    for at in loop:
        column = [number[at]]
        for turn in np.pi * np.arange(1, segments) / segments:
            column.append(len(places))
            places.append(p[at] + r[at] * (np.cos(turn) * n[at] + np.sin(turn) * out[at]))
        columns.append([*column, number[at] + back])
    for a, b in zip(columns, columns[1:] + columns[:1], strict=True):
        quads += [[b[k], a[k], a[k + 1], b[k + 1]] for k in range(segments)]
    vertices = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(places)], "vid long, x double, y double, z double")
    elements = spark.createDataFrame([(k, [int(v) for v in q]) for k, q in enumerate(quads)], "eid long, vids array<long>")
    return Mesh(vertices, elements)


def solid_points(spark: SparkSession, solid: SplineSolid, fine: int = 4, segments: int = 5) -> DataFrame:
    """(elem_id, x, y, z): points on the surface."""
    return solid_mesh(spark, solid, fine, segments).vertices.withColumnRenamed("vid", "elem_id")


def _skeleton(points: DataFrame, solid: SplineSolid, samples: int, steps: int) -> DataFrame:
    """Adds u, v (0 to 1) of the nearest place of the skeleton, and its place and frame there."""
    found = closest_on_sheet(points, solid.points, 1, samples, steps).withColumnsRenamed({x: f"_p{x}" for x in "xyz"})
    return sheet_surface(found.drop("sx", "sy", "sz", "distance"), solid.points, 1)


def _parts(normal: str = "n", along: str = "u"):
    n = {x: F.col(f"{normal}{x}") for x in "xyz"}
    t = vec.normalize({x: F.col(f"{along}{x}") for x in "xyz"})
    return n, t, vec.cross(n, t)


_FRAME = [f"{d}{x}" for d in "uvn" for x in "xyz"]


def _thickness(rows: DataFrame, solid: SplineSolid, name: str) -> DataFrame:
    values = [[{name: t} for t in row] for row in solid.thickness]
    return sheet_at(rows, values, 1)


def solid_distance(points: DataFrame, solid: SplineSolid, samples: int = 16, steps: int = 8) -> DataFrame:
    """Adds ``distance``: how far outside (negative: inside) of the solid points x, y, z are.

    Exact for flat rectangular skeletons of one thickness whose rims are round
    (1) or flat (0); a fillet between is the mean of both by its share.
    """
    if {"u", "v"} & set(points.columns):
        raise ValueError("points must not have columns u and v")
    rows = _thickness(_skeleton(points, solid, samples, steps), solid, "_t")
    way = {x: F.col(f"_p{x}") - F.col(x) for x in "xyz"}
    high, along, across = (F.abs(vec.dot(way, axis)) for axis in _parts())
    rows = rows.withColumns({"_h": high, "_eu": along, "_ev": across})
    half, zero = F.col("_t") / 2, F.lit(0.0)
    total = F.lit(0.0)
    share, flat = {}, {}
    for d, length in zip("uv", _extent(solid), strict=True):
        t, beyond = F.col(d), F.col(f"_e{d}")
        share[d] = F.when(t < 0.5, float(solid.fillet[f"{d}-"])).otherwise(float(solid.fillet[f"{d}+"]))
        # over the sheet, the way to the rim counts as inside
        flat[d] = F.when(beyond > 1e-9, beyond).otherwise(-F.least(t, 1 - t) * length)
    for rounded in ((), ("u",), ("v",), ("u", "v")):
        ball = F.sqrt(sum((F.col(f"_e{d}") ** 2 for d in rounded), F.col("_h") ** 2)) - half
        sides = [ball, *[flat[d] for d in "uv" if d not in rounded]]
        outside = F.sqrt(sum((F.greatest(c, zero) ** 2 for c in sides), zero))
        inside = F.least(zero, F.greatest(*sides)) if len(sides) > 1 else F.least(zero, ball)
        weight = F.lit(1.0)
        for d in "uv":
            weight = weight * (share[d] if d in rounded else 1 - share[d])
        total = total + weight * (outside + inside)
    rows = rows.withColumn("distance", total).drop("x", "y", "z", "u", "v", "_t", "_h", "_eu", "_ev", *_FRAME)
    return rows.withColumnsRenamed({f"_p{x}": x for x in "xyz"})


def _extent(solid: SplineSolid) -> tuple[float, float]:
    """The skeleton's length along u and v, at its first rims."""
    nu, nv = solid.resolution
    p = solid.points
    length = lambda a, b: sum((b[x] - a[x]) ** 2 for x in "xyz") ** 0.5
    return sum(length(p[i][0], p[i + 1][0]) for i in range(nu - 1)), sum(length(p[0][j], p[0][j + 1]) for j in range(nv - 1))


def carried_over(points: DataFrame, source: SplineSolid, target: SplineSolid, samples: int = 16, steps: int = 8) -> DataFrame:
    """Points x, y, z moved from one solid to where they are in another: same u, v, and the same offset in the skeleton's frame.

    Along the normal, the offset grows by the difference of the thicknesses.
    """
    if {"u", "v"} & set(points.columns):
        raise ValueError("points must not have columns u and v")
    rows = _thickness(_skeleton(points, source, samples, steps), source, "_t")
    way = {x: F.col(f"_p{x}") - F.col(x) for x in "xyz"}
    rows = rows.withColumns({f"_o{k}": vec.dot(way, axis) for k, axis in enumerate(_parts())})
    rows = rows.drop("x", "y", "z", *[f"_p{x}" for x in "xyz"], *_FRAME)
    rows = _thickness(sheet_surface(rows, target.points, 1), target, "_s")
    rows = rows.withColumn("_o0", F.col("_o0") + F.signum("_o0") * (F.col("_s") - F.col("_t")))
    parts = _parts()
    place = {x: F.col(x) + sum((F.col(f"_o{k}") * axis[x] for k, axis in enumerate(parts)), F.lit(0.0)) for x in "xyz"}
    moved = rows.withColumns(place)
    return moved.drop("u", "v", "_t", "_s", "_o0", "_o1", "_o2", *_FRAME).select(*points.columns)
