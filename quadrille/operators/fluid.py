"""Obstacles, and the pressure projection around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as vec
from ..meta import Grid, accessible_boundary, pressure_boundary
from . import solve
from .geometry import Geometry, Union
from .lattice import centers, lattice
from .stencil import divergence, face_gradient, gradient
from .tiles import shifted


@dataclass(frozen=True)
class Obstacle:
    """A shape that moves with a velocity and turns about its center (in the plane, counter-clockwise)."""

    geometry: Geometry
    velocity: dict[str, float] = field(default_factory=dict)
    angular_velocity: float = 0.0

    @property
    def is_rotating(self) -> bool:
        return self.angular_velocity != 0

    @property
    def is_moving(self) -> bool:
        return any(self.velocity.values())

    @property
    def is_stationary(self) -> bool:
        return not (self.is_moving or self.is_rotating)

    def with_geometry(self, geometry: Geometry) -> Obstacle:
        return replace(self, geometry=geometry)

    def shifted(self, **delta: float) -> Obstacle:
        return self.with_geometry(self.geometry.shifted(**delta))

    def rotated(self, angle: float) -> Obstacle:
        return self.with_geometry(self.geometry.rotated(angle))

    def at(self, **position: float) -> Obstacle:
        here = self.geometry.center
        return self.shifted(**{a: x - here[a] for a, x in position.items()})

    def velocity_at(self, p: dict[str, Column]) -> dict[str, Column]:
        """The velocity of the obstacle's material at a place."""
        out = {a: F.lit(float(self.velocity.get(a, 0.0))) for a in p}
        if self.is_rotating:
            arm = vec.subtract(p, {a: self.geometry.center[a] for a in p})
            out = vec.add(out, {"x": -arm["y"] * self.angular_velocity, "y": arm["x"] * self.angular_velocity})
        return out


def as_obstacle(shape: Obstacle | Geometry) -> Obstacle:
    return shape if isinstance(shape, Obstacle) else Obstacle(shape)


def face_centers(grid: Grid) -> dict[str, Column]:
    """Positions of faces (rows axis, indices)."""
    half = {a: F.when(F.col("axis") == a, F.lit(0.0)).otherwise(0.5) for a in grid.axes}
    return {a: F.lit(grid.lower[a]) + (F.col(f"i{a}") + half[a]) * F.lit(grid.dx[a]) for a in grid.axes}


def apply_boundary_conditions(faces: DataFrame, grid: Grid, obstacles: Sequence[Obstacle | Geometry], balance: float = 1.0) -> DataFrame:
    """Faces inside an obstacle take the velocity of its material, in part where it covers them in part."""
    spot, v = face_centers(grid), F.col("v")
    radius = F.lit(sum((d / 2) ** 2 for d in grid.dx.values()) ** 0.5)
    for o in map(as_obstacle, obstacles):
        share = o.geometry.fraction_inside(spot, radius, balance)
        moving = o.velocity_at(spot)
        own = F.coalesce(*[F.when(F.col("axis") == a, moving[a]) for a in grid.axes])
        v = vec.product(1 - share, v) + vec.product(share, own)
    return faces.withColumn("v", v)


def balance_divergence(df: DataFrame, value: str, active: str) -> DataFrame:
    """``value`` less its mean, which is taken off active cells alone; only two sums pass the driver."""
    total, n = df.agg(F.sum(value), F.sum(active)).first()
    return df.withColumn(value, F.col(value) - F.col(active) * F.lit((total or 0.0) / (n or 1.0)))


def open_faces(cells: DataFrame, grid: Grid, accessible: str) -> DataFrame:
    """Adds open_lo_<axis> and open_hi_<axis>: 1 where the cell and its neighbour are accessible, the boundary's rule beyond."""
    rule = grid.map_boundary(accessible_boundary)
    names = {f"_{s}{a}": (accessible, a, o) for a in grid.axes for s, o in (("lo", -1), ("hi", 1))}
    near = shifted(cells, rule, names)
    opened = {f"open_{n[1:3]}_{n[3:]}": F.least(F.col(accessible), F.col(n)) for n in names}
    return near.withColumns(opened).drop(*names)


def make_incompressible(
    faces: DataFrame, grid: Grid, obstacles: Sequence[Obstacle | Geometry] = (), active: DataFrame | None = None, relative: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """The staggered field (axis, indices, v) without its divergence, and the pressure (indices, p).

    ``grid`` carries the velocity's boundary.  Obstacles (distinct shapes or
    moving ones) fix the velocity at their faces, and no fluid crosses them.
    ``active`` (indices, active 0 or 1) names the cells that hold fluid, by
    default all outside of obstacles; elsewhere the pressure is 0, so the fluid
    has a free surface there.  A closed domain's divergence is balanced first.

    Masks, divergence and solve are stencils over tiles, so a lattice of any
    size will do.
    """
    spark, keys = faces.sparkSession, grid.keys
    shapes = [as_obstacle(o).geometry for o in obstacles]
    inside = Union(tuple(shapes)).lies_inside(centers(grid)) if shapes else F.lit(False)
    cells = lattice(spark, grid).withColumn("accessible", F.when(inside, 0.0).otherwise(1.0))
    if active is None:
        cells = cells.withColumn("active", F.col("accessible"))
    else:
        cells = cells.join(active.select(*keys, F.col("active").cast("double").alias("active")), keys, "left").na.fill(0.0, ["active"])
    cells = open_faces(cells, grid, "accessible")
    faces = apply_boundary_conditions(faces, grid, obstacles)
    pressure_grid = grid.map_boundary(pressure_boundary)
    closed = active is None and all(b.kind != "constant" for pair in pressure_grid.boundary.values() for b in pair)
    rows = cells.join(divergence(faces, grid, "b"), keys, "left").na.fill(0.0, ["b"])
    rows = solve.cut(rows.withColumn("b", F.col("b") * F.col("active")))
    if closed:
        rows = balance_divergence(rows, "b", "active")
    solved = solve.cut(solve.solve_masked(rows, pressure_grid, "b", "p", "active", relative))
    slope = face_gradient(solved.select(*keys, "p"), pressure_grid, "p", boundary=grid).withColumnRenamed("v", "_g")
    # a face is open as its upper cell sees it; the last face of an axis as its lower cell does
    sides = []
    for a, n in grid.resolution.items():
        index = [(F.col(k) if k != f"i{a}" else F.col(k) + 1).cast("int").alias(k) for k in keys]
        sides.append(F.struct(F.lit(a).alias("axis"), *[F.col(k).cast("int").alias(k) for k in keys], F.col(f"open_lo_{a}").alias("_o")))
        sides.append(F.when(F.col(f"i{a}") == n - 1, F.struct(F.lit(a).alias("axis"), *index, F.col(f"open_hi_{a}").alias("_o"))))
    opened = solved.select(F.explode(F.array_compact(F.array(*sides))).alias("f")).select("f.*")
    at = ["axis", *keys]
    out = faces.join(slope, at, "left").join(opened, at, "left")
    out = out.withColumn("v", F.col("v") - F.coalesce(F.col("_g") * F.col("_o"), F.lit(0.0))).drop("_g", "_o")
    return out, solved.select(*keys, "p")


def add_fields(a: DataFrame, b: DataFrame, keys: list[str], value: str, factor: float) -> DataFrame:
    """a + factor * b, row by row."""
    other = b.select(*keys, F.col(value).alias("_other"))
    return a.join(other, keys, "left").withColumn(value, F.col(value) + F.coalesce(F.col("_other"), F.lit(0.0)) * factor).drop("_other")


def incompressible_rk4(
    rate: Callable[[DataFrame], DataFrame], faces: DataFrame, pressure: DataFrame, grid: Grid, dt: float, relative: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """One Runge-Kutta step of a staggered velocity with a projection after each stage.

    ``rate`` gives the velocity's rate (axis, indices, v) without the pressure.
    Stages follow the half-point scheme in which each projection's pressure,
    over dt, corrects the next stage's.
    """
    at, keys = ["axis", *grid.keys], grid.keys
    rule = grid.map_boundary(pressure_boundary)

    def momentum(v: DataFrame, p: DataFrame) -> DataFrame:
        return solve.cut(add_fields(rate(v), face_gradient(p, rule, "p", boundary=grid), at, "v", -1.0))

    def project(v: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
        free, change = make_incompressible(v, grid, relative=relative)
        return solve.cut(free), solve.cut(add_fields(p, change, keys, "p", 1 / dt))

    k1 = momentum(faces, pressure)
    v2, p2 = project(add_fields(faces, k1, at, "v", dt / 2), pressure)
    k2 = momentum(v2, p2)
    v3, p3 = project(add_fields(faces, k2, at, "v", dt / 2), p2)
    k3 = momentum(v3, p3)
    v4, p4 = project(add_fields(faces, k2, at, "v", dt), p3)
    k4 = momentum(v4, p4)
    total, mean = faces, pressure.withColumn("p", F.col("p") / 6)
    for k, weight in ((k1, 1), (k2, 2), (k3, 2), (k4, 1)):
        total = add_fields(total, k, at, "v", dt * weight / 6)
    for p, weight in ((p2, 2), (p3, 2), (p4, 1)):
        mean = add_fields(mean, p, keys, "p", weight / 6)
    return project(total, mean)


def slope_at_cells(df: DataFrame, grid: Grid, value: str = "p") -> DataFrame:
    """Central differences of a pressure, for velocities at cells."""
    return gradient(df, grid.map_boundary(pressure_boundary), value)
