"""Unstructured meshes: vertices, elements with vertex lists, faces between elements, finite volumes.

Tables: ``vertices(vid, x, y)``, ``elements(eid, vids)``,
``faces(eid, nb, v1, v2, cx, cy, nx, ny, area, boundary)`` with one row for each
side of a face; ``nb`` is null and ``boundary`` set at the rim.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Grid


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    elements: DataFrame
    #: Boundary edges by name: name, v1, v2. None names every rim edge ``outer``.
    boundaries: DataFrame | None = None


def quad_mesh(spark: SparkSession, grid: Grid) -> Mesh:
    """A lattice as quadrilaterals, with boundaries x-, x+, y-, y+."""
    nx, ny = grid.resolution["x"], grid.resolution["y"]
    dx, dy = grid.dx["x"], grid.dx["y"]
    i, j = F.floor(F.col("id") / (ny + 1)), F.pmod(F.col("id"), F.lit(ny + 1))
    vertices = spark.range((nx + 1) * (ny + 1)).select(
        F.col("id").alias("vid"), (grid.lower["x"] + i * F.lit(dx)).alias("x"), (grid.lower["y"] + j * F.lit(dy)).alias("y")
    )
    ci, cj = F.floor(F.col("id") / ny), F.pmod(F.col("id"), F.lit(ny))
    corner = lambda a, b: (ci + a) * (ny + 1) + cj + b
    elements = spark.range(nx * ny).select(
        F.col("id").alias("eid"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("vids")
    )
    along_y = spark.range(ny).select(F.col("id").alias("k"))
    along_x = spark.range(nx).select(F.col("id").alias("k"))
    k = F.col("k")
    parts = [
        along_y.select(F.lit("x-").alias("name"), k.alias("v1"), (k + 1).alias("v2")),
        along_y.select(F.lit("x+"), k + nx * (ny + 1), k + 1 + nx * (ny + 1)),
        along_x.select(F.lit("y-"), k * (ny + 1), (k + 1) * (ny + 1)),
        along_x.select(F.lit("y+"), k * (ny + 1) + ny, (k + 1) * (ny + 1) + ny),
    ]
    boundaries = parts[0]
    for p in parts[1:]:
        boundaries = boundaries.union(p)
    return Mesh(vertices, elements, boundaries)


def from_lists(spark: SparkSession, points: list[tuple], polygons: list[list[int]], boundaries: dict[str, list[tuple[int, int]]] | None = None) -> Mesh:
    vertices = spark.createDataFrame([(k, float(p[0]), float(p[1])) for k, p in enumerate(points)], "vid long, x double, y double")
    elements = spark.createDataFrame([(k, list(map(int, p))) for k, p in enumerate(polygons)], "eid long, vids array<long>")
    if not boundaries:
        return Mesh(vertices, elements)
    rows = [(n, int(a), int(b)) for n, edges in boundaries.items() for a, b in edges]
    return Mesh(vertices, elements, spark.createDataFrame(rows, "name string, v1 long, v2 long"))


def polygon_edges(elements: DataFrame) -> DataFrame:
    """(eid, pos, v1, v2) for consecutive vertices of each element, around it."""
    n = F.size("vids")
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(k.alias("pos"), F.get("vids", k).alias("v1"), F.get("vids", F.pmod(k + 1, n)).alias("v2")),
    )
    return elements.select("eid", F.explode(edges).alias("e")).select("eid", "e.*")


def geometry(mesh: Mesh) -> DataFrame:
    """(eid, cx, cy, volume): centroid and area of each polygon."""
    corners = _with_positions(mesh, polygon_edges(mesh.elements))
    w = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = corners.groupBy("eid").agg(
        F.sum(w).alias("w"), F.sum((F.col("x1") + F.col("x2")) * w).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * w).alias("sy")
    )
    return sums.select("eid", (F.col("sx") / (3 * F.col("w"))).alias("cx"), (F.col("sy") / (3 * F.col("w"))).alias("cy"), F.abs(F.col("w") / 2).alias("volume"))


def _with_positions(mesh: Mesh, edges: DataFrame) -> DataFrame:
    a = mesh.vertices.select(F.col("vid").alias("v1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = mesh.vertices.select(F.col("vid").alias("v2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "v1").join(b, "v2")


def faces(mesh: Mesh) -> DataFrame:
    """Both sides of every face: the neighbour, center, outward unit normal and length.

    Sides pair up by the sorted vertex pair, in one aggregation.
    """
    edges = polygon_edges(mesh.elements).withColumns({"lo": F.least("v1", "v2"), "hi": F.greatest("v1", "v2")})
    sides = edges.groupBy("lo", "hi").agg(F.collect_list(F.struct("eid", "v1", "v2")).alias("s"))  # a face has two sides at most
    both = sides.select("lo", "hi", "s", F.explode("s").alias("own"))
    other = F.filter("s", lambda x: x["eid"] != F.col("own.eid"))
    out = both.select("lo", "hi", F.col("own.eid").alias("eid"), F.col("own.v1").alias("v1"), F.col("own.v2").alias("v2"), F.get(other, F.lit(0))["eid"].alias("nb"))
    if mesh.boundaries is not None:
        names = mesh.boundaries.select(F.least("v1", "v2").alias("lo"), F.greatest("v1", "v2").alias("hi"), F.col("name").alias("_name"))
        out = out.join(names, ["lo", "hi"], "left")
    else:
        out = out.withColumn("_name", F.lit("outer"))
    out = _with_positions(mesh, out.withColumn("boundary", F.when(F.col("nb").isNull(), F.coalesce("_name", F.lit("outer")))))
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = F.sqrt(ex**2 + ey**2)
    out = out.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "area": area})
    centre = geometry(mesh).select("eid", F.col("cx").alias("_mx"), F.col("cy").alias("_my"))
    out = out.join(centre, "eid")
    turn = F.when((F.col("cx") - F.col("_mx")) * ey - (F.col("cy") - F.col("_my")) * ex >= 0, 1.0).otherwise(-1.0)
    out = out.withColumns({"nx": turn * ey / F.col("area"), "ny": -turn * ex / F.col("area")})
    return out.select("eid", "nb", "v1", "v2", "cx", "cy", "nx", "ny", "area", "boundary")


def neighbour_values(face_rows: DataFrame, values: DataFrame, rules: dict[str, float | str], value: str = "v") -> DataFrame:
    """Faces with the owner's value ``own`` and the other side's ``other``; at the rim by the rule: a number, or ``edge``."""
    own = values.select("eid", F.col(value).alias("own"))
    far = values.select(F.col("eid").alias("nb"), F.col(value).alias("_far"))
    both = face_rows.join(own, "eid").join(far, "nb", "left")
    outer = F.col("own")
    for name, rule in rules.items():
        if rule != "edge":
            outer = F.when(F.col("boundary") == name, F.lit(float(rule))).otherwise(outer)
    return both.withColumn("other", F.when(F.col("nb").isNotNull(), F.col("_far")).otherwise(outer)).drop("_far")


def face_values(sides: DataFrame, flux: Column | None = None) -> DataFrame:
    """Value at each face as ``at``: the mean of both sides (of the rim: the outer value), or upwind by the sign of a flux."""
    linear = F.when(F.col("nb").isNull(), F.col("other")).otherwise((F.col("own") + F.col("other")) / 2)
    return sides.withColumn("at", linear if flux is None else F.when(flux >= 0, F.col("own")).otherwise(F.col("other")))


def green_gauss(mesh: Mesh, face_rows: DataFrame, values: DataFrame, rules: dict[str, float | str], value: str = "v") -> DataFrame:
    """(eid, dx, dy): the gradient as the mean of normal times face value over the surface."""
    at = face_values(neighbour_values(face_rows, values, rules, value))
    sums = at.groupBy("eid").agg(*[F.sum(F.col(f"n{a}") * F.col("at") * F.col("area")).alias(f"s{a}") for a in "xy"])
    return sums.join(geometry(mesh), "eid").select("eid", (F.col("sx") / F.col("volume")).alias("dx"), (F.col("sy") / F.col("volume")).alias("dy"))


def integrate_flux(face_rows: DataFrame, fx: Column, fy: Column) -> DataFrame:
    """(eid, flux): what flows out of each element through all faces."""
    return face_rows.groupBy("eid").agg(F.sum((fx * F.col("nx") + fy * F.col("ny")) * F.col("area")).alias("flux"))


def integrate_surface(face_rows: DataFrame, value: Column) -> DataFrame:
    return face_rows.groupBy("eid").agg(F.sum(value * F.col("area")).alias("surface"))


def mesh_laplace(mesh: Mesh, face_rows: DataFrame, values: DataFrame, rules: dict[str, float | str], value: str = "v") -> DataFrame:
    """(eid, laplace) from differences over the distance of centers; at the rim, to the face."""
    centre = geometry(mesh)
    sides = neighbour_values(face_rows, values, rules, value)
    a = centre.select("eid", F.col("cx").alias("_ax"), F.col("cy").alias("_ay"), "volume")
    b = centre.select(F.col("eid").alias("nb"), F.col("cx").alias("_bx"), F.col("cy").alias("_by"))
    rows = sides.join(a, "eid").join(b, "nb", "left")
    far_x, far_y = F.coalesce("_bx", "cx"), F.coalesce("_by", "cy")
    distance = F.sqrt((far_x - F.col("_ax")) ** 2 + (far_y - F.col("_ay")) ** 2)
    flow = (F.col("other") - F.col("own")) / distance * F.col("area")
    return rows.groupBy("eid").agg((F.sum(flow) / F.first("volume")).alias("laplace"))


def cell_connectivity(face_rows: DataFrame) -> DataFrame:
    return face_rows.where("nb is not null").select("eid", "nb").distinct()


def boundary_connectivity(face_rows: DataFrame) -> DataFrame:
    return face_rows.where("nb is null").select("eid", "boundary", "v1", "v2")


def vertex_connectivity(elements: DataFrame) -> DataFrame:
    edges = polygon_edges(elements)
    return edges.select("v1", "v2").union(edges.select("v2", "v1")).distinct()


def element_connectivity(elements: DataFrame, shared: int = 1) -> DataFrame:
    """Pairs of elements with at least ``shared`` vertices in common."""
    at = elements.select("eid", F.explode("vids").alias("vid"))
    pairs = at.toDF("a", "vid").join(at.toDF("b", "vid"), "vid").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("a", "b")


def faces_to_vertices(face_rows: DataFrame, value: Column) -> DataFrame:
    """Sum of face values at each vertex; a face between two elements counts once."""
    once = face_rows.where(F.col("nb").isNull() | (F.col("eid") < F.col("nb")))
    return once.select(F.explode(F.array("v1", "v2")).alias("vid"), value.alias("_v")).groupBy("vid").agg(F.sum("_v").alias("v"))


def filter_unused(mesh: Mesh) -> Mesh:
    """Without vertices that no element has; ids stay."""
    used = mesh.elements.select(F.explode("vids").alias("vid")).distinct()
    return Mesh(mesh.vertices.join(used, "vid", "left_semi"), mesh.elements, mesh.boundaries)


def join_meshes(a: Mesh, b: Mesh, vertex_offset: int, element_offset: int) -> Mesh:
    """Both meshes as one, with the boundaries of both; the second's ids are moved by the offsets.

    If one of them names no boundaries, its rim is ``outer`` like that of any mesh without names.
    """
    moved = F.transform("vids", lambda v: v + vertex_offset)
    vertices = a.vertices.unionByName(b.vertices.withColumn("vid", F.col("vid") + vertex_offset))
    elements = a.elements.unionByName(b.elements.select((F.col("eid") + element_offset).alias("eid"), moved.alias("vids")))
    moved_rim = b.boundaries and b.boundaries.select("name", (F.col("v1") + vertex_offset).alias("v1"), (F.col("v2") + vertex_offset).alias("v2"))
    rims = [r for r in (a.boundaries, moved_rim) if r is not None]
    return Mesh(vertices, elements, rims[0].unionByName(rims[1]) if len(rims) == 2 else rims[0] if rims else None)


def bounds(mesh: Mesh) -> DataFrame:
    """One row with the least and greatest coordinates of the vertices."""
    from .aggregate import bounding_box

    return bounding_box(mesh.vertices, ("x", "y"))


def points_of(mesh: Mesh, name: str) -> DataFrame:
    """Points of a named set: ``center`` (of elements), ``face`` (of faces, those between two elements once) or ``vertex``."""
    if name == "center":
        return geometry(mesh).select("eid", F.col("cx").alias("x"), F.col("cy").alias("y"))
    if name == "face":
        once = faces(mesh).where(F.col("nb").isNull() | (F.col("eid") < F.col("nb")))
        return once.select("eid", "nb", "boundary", F.col("cx").alias("x"), F.col("cy").alias("y"))
    if name == "vertex":
        return mesh.vertices
    raise ValueError(f"no set {name!r}")


def boundary_of(mesh: Mesh, name: str) -> DataFrame:
    """What of a named set is at the rim, with the name of the boundary; ``center`` has nothing there."""
    if name == "face":
        return points_of(mesh, "face").where("nb is null").drop("nb")
    if name == "vertex":
        return boundary_connectivity(faces(mesh)).select(F.explode(F.array("v1", "v2")).alias("vid"), "boundary").distinct()
    if name == "center":
        return points_of(mesh, "center").withColumn("boundary", F.lit(None).cast("string")).limit(0)
    raise ValueError(f"no set {name!r}")


def distance_matrix(mesh: Mesh, face_rows: DataFrame) -> DataFrame:
    """(eid, nb, distance) of the centers of neighbouring elements."""
    centre = geometry(mesh).select("eid", "cx", "cy")
    pairs = cell_connectivity(face_rows).join(centre.toDF("eid", "_ax", "_ay"), "eid").join(centre.toDF("nb", "_bx", "_by"), "nb")
    return pairs.select("eid", "nb", F.sqrt((F.col("_bx") - F.col("_ax")) ** 2 + (F.col("_by") - F.col("_ay")) ** 2).alias("distance"))


def least_squares_gradient(mesh: Mesh, face_rows: DataFrame, values: DataFrame, rules: dict, value: str = "v") -> DataFrame:
    """(eid, dx, dy): the slope that fits the differences to all neighbours best, nearer ones counting more.

    Weights are one over the squared distance; across the rim the face's value and center count.
    """
    centre = geometry(mesh).select("eid", "cx", "cy")
    sides = neighbour_values(face_rows, values, rules, value).join(centre.toDF("eid", "_ax", "_ay"), "eid")
    rows = sides.join(centre.toDF("nb", "_bx", "_by"), "nb", "left")
    dx, dy = F.coalesce("_bx", "cx") - F.col("_ax"), F.coalesce("_by", "cy") - F.col("_ay")
    rows = rows.select("eid", dx.alias("_dx"), dy.alias("_dy"), (F.col("other") - F.col("own")).alias("_dv"))
    w = 1 / (F.col("_dx") ** 2 + F.col("_dy") ** 2)
    total = lambda c: F.sum(w * c)
    x, y, v = F.col("_dx"), F.col("_dy"), F.col("_dv")
    sums = rows.groupBy("eid").agg(
        total(x * x).alias("xx"), total(x * y).alias("xy"), total(y * y).alias("yy"), total(x * v).alias("xv"), total(y * v).alias("yv")
    )
    from ..functions.vector import solve2x2

    gx, gy = solve2x2(F.col("xx"), F.col("xy"), F.col("xy"), F.col("yy"), F.col("xv"), F.col("yv"))
    return sums.select("eid", gx.alias("dx"), gy.alias("dy"))


def sample_nearest(mesh: Mesh, values: DataFrame, gradient: DataFrame, points: DataFrame, radius: float, value: str = "v") -> DataFrame:
    """Value at points from the nearest centroid within a radius, with its gradient; null farther off."""
    from .graph import neighbours

    centre = geometry(mesh).select(F.col("eid").alias("elem_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    both = centre.select((-F.col("elem_id") - 1).alias("elem_id"), "x", "y").union(points.select("elem_id", "x", "y"))
    edges = neighbours(both, ("x", "y"), radius).where("src >= 0 and dst < 0")
    best = edges.groupBy("src").agg(F.min(F.struct("distance", F.col("dst"), "dx", "dy")).alias("b"))
    best = best.select(F.col("src").alias("elem_id"), (-F.col("b.dst") - 1).alias("eid"), F.col("b.dx").alias("ox"), F.col("b.dy").alias("oy"))
    found = best.join(values.select("eid", value), "eid").join(gradient, "eid")
    out = found.select("elem_id", (F.col(value) - F.col("dx") * F.col("ox") - F.col("dy") * F.col("oy")).alias(value))
    return points.join(out, "elem_id", "left")
