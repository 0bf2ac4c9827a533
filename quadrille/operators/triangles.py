"""Surfaces of triangles in space, obstacles cut from quadrilateral meshes, and walks over mesh cells."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as vec
from ..meta import Grid
from .geometry import Box, Geometry
from .lattice import centers, lattice
from .mesh import Mesh, filter_unused, geometry, polygon_edges, quad_mesh
from .solve import one_after_another
from .tensors import linear_index


def corners(mesh: Mesh) -> DataFrame:
    """(eid, ax, ay, az, bx, ..., cz): the three corners of each triangle."""
    out = mesh.elements.select("eid", *[F.get("vids", F.lit(k)).alias(f"_{n}") for k, n in enumerate("abc")])
    for n in "abc":
        v = mesh.vertices.select(F.col("vid").alias(f"_{n}"), *[F.col(x).alias(f"{n}{x}") for x in "xyz"])
        out = out.join(v, f"_{n}")
    return out.drop("_a", "_b", "_c")


def _corner(n: str) -> dict[str, Column]:
    return {x: F.col(f"{n}{x}") for x in "xyz"}


def normals(mesh: Mesh) -> DataFrame:
    """(eid, nx, ny, nz, area) of triangles, by the right-hand rule."""
    a, b, c = map(_corner, "abc")
    n = vec.cross(vec.subtract(b, a), vec.subtract(c, a))
    length = vec.length(n)
    return corners(mesh).select("eid", *[vec.divide(v, length).alias(f"n{x}") for x, v in n.items()], (length / 2).alias("area"))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """(vid, nx, ny, nz): the mean direction of the triangles at each vertex."""
    at = mesh.elements.select("eid", F.explode("vids").alias("vid")).join(normals(mesh), "eid")
    sums = at.groupBy("vid").agg(*[F.sum(f"n{x}").alias(f"_{x}") for x in "xyz"])
    unit = vec.normalize({x: F.col(f"_{x}") for x in "xyz"})
    return sums.select("vid", *[v.alias(f"n{x}") for x, v in unit.items()])


def curvature(mesh: Mesh) -> DataFrame:
    """(eid, cxx, cxy, ..., czz, scalar): how the vertex normals change along each triangle's edges, over twice its area; ``scalar`` is the trace.

    On a ball of radius r the trace is the sum of the squared edges over twice the area and r.
    """
    at = mesh.elements.select("eid", F.posexplode("vids").alias("_k", "vid")).join(mesh.vertices, "vid").join(vertex_normals(mesh), "vid")
    packed = F.array_sort(F.collect_list(F.struct("_k", "x", "y", "z", "nx", "ny", "nz")))  # three rows
    t = at.groupBy("eid").agg(packed.alias("t")).join(normals(mesh).select("eid", "area"), "eid")
    corner = lambda k, n: F.get("t", F.lit(k % 3))[n]
    step = lambda k, n: corner(k + 1, n) - corner(k, n)
    out = {f"c{x}{y}": reduce(lambda a, b: a + b, [step(k, x) * step(k, f"n{y}") for k in range(3)]) / (2 * F.col("area")) for x in "xyz" for y in "xyz"}
    rows = t.select("eid", *[c.alias(n) for n, c in out.items()])
    return rows.withColumn("scalar", F.col("cxx") + F.col("cyy") + F.col("czz"))


def displaced(mesh: Mesh, distance: float) -> Mesh:
    """Vertices moved along their normals."""
    n = vertex_normals(mesh)
    moved = mesh.vertices.join(n, "vid", "left").select("vid", *[(F.col(x) + F.coalesce(f"n{x}", F.lit(0.0)) * distance).alias(x) for x in "xyz"])
    return Mesh(moved, mesh.elements, mesh.boundaries)


def closest_surface(points: DataFrame, mesh: Mesh, block: int = 2048, signed: bool = False) -> DataFrame:
    """(elem_id, eid, distance) of the nearest triangle of each point; points are the query set, taken in blocks.

    ``signed``: negative inside a closed surface whose normals point outward.  Of
    triangles that are equally near (at an edge or corner), the one that faces the point most says on which side it is.
    """
    tri = corners(mesh)
    blocks = max(1, -(-points.count() // block))
    a, b, c, p = _corner("a"), _corner("b"), _corner("c"), {x: F.col(x) for x in "xyz"}
    way = vec.subtract(p, vec.closest_on_triangle(a, b, c, p))
    d = vec.length(way)
    if signed:
        tri = tri.withColumns({f"n{x}": v for x, v in vec.normalize(vec.cross(vec.subtract(b, a), vec.subtract(c, a))).items()})
        facing = reduce(lambda s, t: s + t, [way[x] * F.col(f"n{x}") for x in "xyz"])
        key = [F.round(d, 9), -F.abs(F.round(facing, 9)), F.col("eid"), F.when(facing < 0, -d).otherwise(d).alias("distance")]
    else:
        key = [d.alias("distance"), F.col("eid")]

    def best(k: int) -> DataFrame:
        part = points.where(F.pmod(F.xxhash64("elem_id"), F.lit(blocks)) == k).select("elem_id", "x", "y", "z")
        pairs = tri.crossJoin(F.broadcast(part))  # about ``block`` rows
        found = pairs.groupBy("elem_id").agg(F.min(F.struct(*key)).alias("b"))
        return found.select("elem_id", "b.eid", "b.distance")

    return best(0) if blocks == 1 else one_after_another(map(best, range(blocks)))


def mesh_sdf(spark: SparkSession, mesh: Mesh, grid: Grid, out: str = "d", block: int = 2048) -> DataFrame:
    """The signed distance of a closed surface at cell centers."""
    where = lattice(spark, grid).withColumn("elem_id", linear_index(grid)).withColumns(centers(grid))
    found = closest_surface(where, mesh, block, signed=True).select("elem_id", F.col("distance").alias(out))
    return where.join(found, "elem_id").select(*grid.keys, out)


def box_surface(spark: SparkSession, box: Box) -> Mesh:
    """A box as twelve triangles; normals point outward."""
    side = lambda bit, a: box.upper[a] if bit else box.lower[a]
    points = [(k, *(float(side(k >> j & 1, a)) for j, a in enumerate("xyz"))) for k in range(8)]
    triangles = []
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        for base, turn in ((0, True), (1 << axis, False)):
            quad = [base, base + u, base + u + v, base + v]
            quad = quad[::-1] if turn else quad
            triangles += [quad[:3], [quad[0], quad[2], quad[3]]]
    vertices = spark.createDataFrame(points, "vid long, x double, y double, z double")
    return Mesh(vertices, spark.createDataFrame(list(enumerate(triangles)), "eid long, vids array<long>"))


def surface_points(spark: SparkSession, box: Box, count: int, seed: int = 0) -> DataFrame:
    """Points on a box's surface, uniform by area, hashed from their number."""
    u = lambda j: F.pmod(F.xxhash64("id", F.lit(j), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    size, axes = box.size, list(box.lower)
    area = {a: 2.0 * box.volume / size[a] for a in axes}
    total, at, pick = sum(area.values()), 0.0, F.lit(axes[-1])
    for a in reversed(axes[:-1]):
        pick = F.when(u(0) < sum(area[b] for b in axes[: axes.index(a) + 1]) / total, F.lit(a)).otherwise(pick)
    spot = {}
    for j, a in enumerate(axes):
        free = F.lit(box.lower[a]) + u(j + 1) * F.lit(size[a])
        face = F.when(u(9) < 0.5, F.lit(box.lower[a])).otherwise(F.lit(box.upper[a]))
        spot[a] = F.when(pick == a, face).otherwise(free)
    return spark.range(count).select(F.col("id").alias("elem_id"), *[c.alias(a) for a, c in spot.items()])


def ring(spark: SparkSession, center: dict[str, float], radius: float, height: float, count: int) -> DataFrame:
    """``count`` points on a circle across z at a height."""
    turn = F.col("id") * (2 * pi / count)
    return spark.range(count).select(
        F.col("id").alias("vid"), (center["x"] + radius * F.cos(turn)).alias("x"), (center["y"] + radius * F.sin(turn)).alias("y"), F.lit(float(height)).alias("z")
    )


def quads_between(elements: int, rows: int, closed: bool = False) -> Column:
    """Vertex ids of quad ``id`` between rows of ``elements`` vertices each."""
    per = elements if closed else elements - 1
    r, c = F.floor(F.col("id") / per), F.pmod(F.col("id"), F.lit(per))
    after = F.pmod(c + 1, F.lit(elements))
    return F.array(r * elements + c, r * elements + after, (r + 1) * elements + after, (r + 1) * elements + c)


def obstacle_mesh(spark: SparkSession, grid: Grid, obstacle: Geometry) -> Mesh:
    """A quadrilateral mesh without the cells whose center is inside an obstacle; the new rim is named ``obstacle``."""
    mesh = quad_mesh(spark, grid)
    centre = geometry(mesh)
    free = centre.where(~obstacle.lies_inside({"x": F.col("cx"), "y": F.col("cy")})).select("eid")
    elements = mesh.elements.join(free, "eid", "left_semi")
    edges = polygon_edges(elements).select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"))
    rim = edges.groupBy("v1", "v2").agg(F.count("*").alias("n")).where("n = 1").select("v1", "v2")
    named = mesh.boundaries.select("name", F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"))
    names = rim.join(named, ["v1", "v2"], "left").select(F.coalesce("name", F.lit("obstacle")).alias("name"), "v1", "v2")
    return filter_unused(Mesh(mesh.vertices, elements, names))


def closest_vertex(points: DataFrame, mesh: Mesh, radius: float) -> DataFrame:
    """(elem_id, vid, distance) of the nearest vertex within a radius, the smaller id of equals."""
    from .graph import neighbours

    both = mesh.vertices.select((-F.col("vid") - 1).alias("elem_id"), "x", "y").union(points.select("elem_id", "x", "y"))
    edges = neighbours(both, ("x", "y"), radius).where("src >= 0 and dst < 0")
    best = edges.groupBy("src").agg(F.min(F.struct("distance", (-F.col("dst") - 1).alias("vid"))).alias("b"))
    return best.select(F.col("src").alias("elem_id"), "b.vid", "b.distance")


def walk(points: DataFrame, face_rows: DataFrame, steps: int) -> DataFrame:
    """Points (elem_id, x, y, eid) moved from cell to cell through the face they are farthest beyond, at most ``steps`` times.

    A point beyond the rim ends in a cell at it.
    """
    faces = face_rows.select("eid", "nb", "cx", "cy", "nx", "ny")
    for _ in range(steps):
        out = (F.col("x") - F.col("cx")) * F.col("nx") + (F.col("y") - F.col("cy")) * F.col("ny")
        inner = F.when(F.col("nb").isNotNull(), F.struct(out.alias("d"), "nb"))
        best = points.join(faces, "eid").groupBy("elem_id").agg(F.max(inner).alias("b"))
        step = F.when(F.col("b.d") > 0, F.col("b.nb")).otherwise(F.col("eid"))
        points = points.join(best, "elem_id").select("elem_id", "x", "y", step.alias("eid"))
    return points


def save_triangles(mesh: Mesh, path: str) -> None:
    mesh.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    mesh.elements.write.mode("overwrite").parquet(f"{path}/elements")


def load_triangles(spark: SparkSession, path: str) -> Mesh:
    return Mesh(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/elements"))


class MeshBuilder:
    """Collects vertices and elements; numbers run on over all that is added."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._vertices, self._elements = [], []
        self._next = 0

    def add_vertices(self, vertices: DataFrame) -> int:
        """Vertices (vid from 0 on, x, y, z); returns the number that is added to their ids."""
        offset = self._next
        self._vertices.append(vertices.withColumn("vid", F.col("vid") + offset))
        self._next += vertices.count()
        return offset

    def add_elements(self, elements: DataFrame, offset: int = 0) -> None:
        """Elements (vids) of vertices whose ids are moved by ``offset``: triangles, quadrilaterals or more."""
        self._elements.append(elements.select(F.transform("vids", lambda v: v + offset).alias("vids")))

    add_triangles = add_quads = add_elements

    def new_quads(self, vertices: DataFrame, columns: int, closed: bool = False) -> int:
        """Vertices that stand in rows of ``columns``, and the quadrilaterals between them."""
        rows = vertices.count() // columns
        offset = self.add_vertices(vertices)
        per = columns if closed else columns - 1
        self.add_quads(self.spark.range(max(0, rows - 1) * per).select(quads_between(columns, rows, closed).alias("vids")), offset)
        return offset

    def build(self) -> Mesh:
        """The mesh; elements are numbered by their vertices, so equal input gives equal numbers."""
        from .aggregate import running_total

        vertices = reduce(DataFrame.unionByName, self._vertices)
        elements = reduce(DataFrame.unionByName, self._elements)
        numbered = running_total(elements.distinct(), [F.col("vids")], F.lit(1), "_n")
        return Mesh(vertices, numbered.select((F.col("_n") - 1).alias("eid"), "vids"))
