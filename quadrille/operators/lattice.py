"""Constructors: lattices of cells and faces, scattered points, and masks of geometries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Grid


def _indices(grid: Grid, id_column: Column) -> dict[str, Column]:
    out, stride = {}, 1
    for a, n in reversed(grid.resolution.items()):
        out[f"i{a}"] = F.pmod(F.floor(id_column / stride), F.lit(n)).cast("int")
        stride *= n
    return {k: out[k] for k in grid.keys}


def centers(grid: Grid) -> dict[str, Column]:
    """Positions of cell centers from the index columns."""
    return {a: F.lit(grid.lower[a]) + (F.col(f"i{a}") + 0.5) * F.lit(grid.dx[a]) for a in grid.axes}


def lattice(spark: SparkSession, grid: Grid, **values: Column | float | Callable) -> DataFrame:
    """One row a cell: indices and values, each a number, a Column, or a function of the center's coordinates."""
    df = spark.range(grid.size).select(*[c.alias(k) for k, c in _indices(grid, F.col("id")).items()])
    return df.withColumns({k: value_at(v, centers(grid)) for k, v in values.items()}) if values else df


def value_at(value, position: dict[str, Column]) -> Column:
    if callable(value):
        value = value(**position)
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def face_lattice(spark: SparkSession, grid: Grid, **components) -> DataFrame:
    """One row a stored face: axis, indices, v; components by axis as for ``lattice``."""
    out = None
    for a in grid.axes:
        first, _ = grid.face_range(a)
        faces = grid.faces(a)
        part = lattice(spark, faces, v=components.get(a, 0.0))
        part = part.withColumn(f"i{a}", F.col(f"i{a}") + first)
        part = part.select(F.lit(a).alias("axis"), *grid.keys, "v")
        out = part if out is None else out.unionByName(part)
    return out


def cell_of(grid: Grid, clamp: bool = True, **position: Column) -> dict[str, Column]:
    """Index columns of the cells that hold the positions; clamped into the lattice, or as they come."""
    out = {}
    for a, x in position.items():
        i = F.floor((x - F.lit(grid.lower[a])) / F.lit(grid.dx[a])).cast("int")
        out[f"i{a}"] = F.greatest(F.lit(0), F.least(i, F.lit(grid.resolution[a] - 1))) if clamp else i
    return out


def distribute_points(df: DataFrame, grid: Grid, mask: str, per_cell: int = 8, center: bool = False, seed: int = 0) -> DataFrame:
    """``per_cell`` points in each cell where ``mask`` is not 0: elem_id and positions, at the center or jittered.

    The jitter is hashed from cell and number, so it does not depend on how rows are dealt.
    """
    cells = df.where(F.col(mask) != 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))))
    number, linear = F.lit(0).cast("long"), F.lit(0).cast("long")
    for a, n in grid.resolution.items():
        linear = linear * n + F.col(f"i{a}")
    number = linear * per_cell + F.col("k")
    spot = {}
    for j, a in enumerate(grid.axes):
        u = F.lit(0.5) if center else F.pmod(F.xxhash64(number, F.lit(j), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        spot[a] = F.lit(grid.lower[a]) + (F.col(f"i{a}") + u) * F.lit(grid.dx[a])
    return cells.select(number.alias("elem_id"), *[c.alias(a) for a, c in spot.items()])


def nonzero(df: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """Centers of the cells whose value is not 0, with the value."""
    return df.where(F.col(value) != 0).select(*[c.alias(a) for a, c in centers(grid).items()], value)


def vortices(df: DataFrame, grid: Grid, places: list[dict[str, float]], strength: list[float], falloff=None) -> DataFrame:
    """Adds ``vx, vy``: the velocity of vortices in the plane, each strength times falloff times the way from its place, turned.

    ``falloff`` is a function of the squared distance to a Column, by default none.
    The vortices are a stated list and become one expression.
    """
    here = centers(grid)
    vx = vy = F.lit(0.0)
    for p, s in zip(places, strength, strict=True):
        dx, dy = here["x"] - p["x"], here["y"] - p["y"]
        w = F.lit(float(s)) * (falloff(dx * dx + dy * dy) if falloff else F.lit(1.0))
        vx, vy = vx - w * dy, vy + w * dx
    return df.withColumns({"vx": vx, "vy": vy})


def enclosing_grid(points: DataFrame, axes: tuple[str, ...], voxels: int, margin: float = 0.1, margin_cells: int = 0) -> Grid:
    """A lattice of cubes around all points with about ``voxels`` cells; only the box's corners pass the driver."""
    from ..meta import margin_resolution
    from .aggregate import bounding_box

    box = bounding_box(points, axes).first()
    low, high = {a: box[f"lower_{a}"] for a in axes}, {a: box[f"upper_{a}"] for a in axes}
    wide = {a: (high[a] - low[a]) * (1 + 2 * margin) or 1.0 for a in axes}
    resolution = margin_resolution(wide, voxels, margin_cells)
    side = {a: wide[a] / (resolution[a] - 2 * margin_cells) for a in axes}
    middle = {a: (low[a] + high[a]) / 2 for a in axes}
    half = {a: side[a] * resolution[a] / 2 for a in axes}
    return Grid.of(0.0, {a: middle[a] - half[a] for a in axes}, {a: middle[a] + half[a] for a in axes}, **resolution)


def spheres(df: DataFrame, grid: Grid) -> DataFrame:
    """Cells as balls of the same volume: centers and ``radius``."""
    from ..functions.kernels import ball_volume

    rank = len(grid.axes)
    radius = (grid.cell_volume / ball_volume(rank)) ** (1 / rank)
    rest = [c for c in df.columns if c not in grid.keys]
    return df.withColumns(centers(grid)).withColumn("radius", F.lit(radius)).select(*grid.axes, "radius", *rest)


def points_to_grid(points: DataFrame, axes: tuple[str, ...], voxels: int, value: str = "v") -> tuple[DataFrame, Grid]:
    """Points scattered to a lattice around them; cells without points are null."""
    from .resample import scatter

    grid = enclosing_grid(points, axes, voxels)
    every = lattice(points.sparkSession, grid)
    return every.join(scatter(points, grid, value, base=None), grid.keys, "left"), grid


def embedded(inner: DataFrame, inner_grid: Grid, outer: DataFrame, outer_grid: Grid, width: int = 1, value: str = "v") -> DataFrame:
    """The inner lattice with ghost cells sampled from an outer field; indices count from the new lower corner."""
    from .resample import interpolate

    wide = inner_grid.padded(**{a: width for a in inner_grid.axes})
    cells = lattice(inner.sparkSession, wide)
    ghost = F.lit(False)
    for a, n in wide.resolution.items():
        ghost = ghost | (F.col(f"i{a}") < width) | (F.col(f"i{a}") >= n - width)
    outside = interpolate(cells.where(ghost), outer, outer_grid, [value], centers(wide))
    own = inner.select(*[(F.col(k) + width).cast("int").alias(k) for k in inner_grid.keys], value)
    return own.unionByName(outside.select(*wide.keys, value))
