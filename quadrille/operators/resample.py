"""Resampling: points to cells, cells to points, and between lattices.

Points find their cell by arithmetic, so every join is an equi-join on cell
indices.  For interpolation each base cell's 2^d corner values are brought
together once, by the tile layout; then a point needs one row of that table.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import NONE, Grid
from .lattice import cell_of, centers, lattice
from .tiles import padded, tiled


def scatter(
    points: DataFrame,
    grid: Grid,
    value: str = "v",
    mode: str = "mean",
    outside: str = "discard",
    base: float | None = 0.0,
    batch: tuple[str, ...] = (),
) -> DataFrame:
    """Mean or sum (``add``) of the points in each cell; cells without points have ``base``.

    Points outside the box are left out (``discard``), moved to the nearest
    cell (``clamp``), or wrapped (``periodic``).  With ``base`` None only cells that have points come.
    """
    cells = cell_of(grid, outside == "clamp", **{a: F.col(a) for a in grid.axes})
    rows = points.select(*batch, value, *[c.alias(k) for k, c in cells.items()])
    if outside == "discard":
        for k, n in zip(grid.keys, grid.resolution.values(), strict=True):
            rows = rows.where((F.col(k) >= 0) & (F.col(k) < n))
    elif outside == "periodic":
        rows = rows.withColumns({f"i{a}": F.pmod(F.col(f"i{a}"), F.lit(n)) for a, n in grid.resolution.items()})
    reduce_ = {"mean": F.avg, "add": F.sum}[mode]
    found = rows.groupBy(*batch, *grid.keys).agg(reduce_(value).alias(value))
    if base is None:
        return found
    every = lattice(points.sparkSession, grid)
    if batch:
        every = points.select(*batch).distinct().crossJoin(every)  # the result has a row for each of these
    return every.join(found, [*batch, *grid.keys], "left").na.fill(base, [value])


def corners(df: DataFrame, grid: Grid, values: list[str], batch: tuple[str, ...] = ()) -> DataFrame:
    """For each base cell, indices from -1 on, the values at its 2^d corners: ``<value>_<bits>``, one bit an axis."""
    wide = padded(df, grid, {a: (1, 1) for a in grid.axes if grid.boundary[a][0].kind != "none"}, values, batch)
    moved = {f"i{a}": (F.col(f"i{a}") + 1).cast("int") for a in grid.axes}
    around = Grid.of(NONE, **{a: n + 2 for a, n in grid.resolution.items()})
    t = tiled(wide.withColumns(moved), around, {a: (0, 1) for a in grid.axes}, values, batch)
    out, names = t.df.withColumns({f"{v}_": F.col(v) for v in values}), [f"{v}_" for v in values]
    for a in grid.axes:
        new = {}
        for name in names:
            new[f"{name}0"], new[f"{name}1"] = F.col(name), t.neighbour(name, a, 1)
        out, names = out.withColumns(new).drop(*names), list(new)
    out = t.own(out).withColumns({f"i{a}": (F.col(f"i{a}") - 1).cast("int") for a in grid.axes})
    return out.select(*batch, *grid.keys, *names)


def base_cell(grid: Grid, position: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Base cell and fraction of positions along each axis; beyond the boundary layer positions are moved to it."""
    index, part = {}, {}
    for a, x in position.items():
        n = grid.resolution[a]
        u = (x - F.lit(grid.lower[a])) / F.lit(grid.dx[a]) - 0.5
        if grid.boundary[a][0].kind == "periodic":
            u = F.pmod(u, F.lit(float(n)))
        else:
            u = F.greatest(F.lit(-1.0), F.least(u, F.lit(float(n))))
        index[a] = F.least(F.floor(u), F.lit(n - 1)).cast("int")
        part[a] = u - index[a]
    return index, part


def interpolate(
    points: DataFrame,
    df: DataFrame,
    grid: Grid,
    values: list[str],
    position: dict[str, Column] | None = None,
    suffix: str = "",
    bounds: bool = False,
    batch: tuple[str, ...] = (),
) -> DataFrame:
    """Points with d-linear interpolated values, named ``<value><suffix>``.

    ``position`` gives coordinates by axis, by default the columns x, y, z.
    With ``bounds`` also the least and greatest corner value, ``<value><suffix>_min`` and ``_max``.
    """
    index, part = base_cell(grid, position or {a: F.col(a) for a in grid.axes})
    table = corners(df, grid, values, batch)
    table = table.toDF(*[f"_c_{c}" if c not in batch else c for c in table.columns])
    keep = [c for c in points.columns if c not in [f"{v}{suffix}" for v in values]]
    points = points.select(*[F.col(c) for c in keep], *[c.alias(f"_b{a}") for a, c in index.items()], *[c.alias(f"_f{a}") for a, c in part.items()])
    same = reduce(lambda a, b: a & b, [F.col(f"_b{a}") == F.col(f"_c_i{a}") for a in grid.axes])
    for b in batch:
        table = table.withColumnRenamed(b, f"_k_{b}")
        same = same & (F.col(b) == F.col(f"_k_{b}"))
    joined = points.join(table, same, "left")
    out = {}
    for v in values:
        terms, every = [], []
        for bits in product("01", repeat=len(grid.axes)):
            name = f"_c_{v}_{''.join(bits)}"
            weight = reduce(lambda a, b: a * b, [F.col(f"_f{a}") if k == "1" else 1 - F.col(f"_f{a}") for a, k in zip(grid.axes, bits, strict=True)])
            terms.append(F.col(name) * weight)
            every.append(F.col(name))
        out[f"{v}{suffix}"] = reduce(lambda a, b: a + b, terms)
        if bounds:
            out[f"{v}{suffix}_min"], out[f"{v}{suffix}_max"] = F.least(*every), F.greatest(*every)
    return joined.select(*[F.col(c) for c in keep], *[c.alias(k) for k, c in out.items()])


def nearest(points: DataFrame, df: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    """Points with the values of the cell that holds them, of the nearest cell outside the box."""
    cells = cell_of(grid, True, **{a: F.col(a) for a in grid.axes})
    return points.withColumns(cells).join(df.select(*grid.keys, *values), grid.keys, "left").drop(*grid.keys)


def to_grid(df: DataFrame, grid: Grid, target: Grid, values: list[str]) -> DataFrame:
    """Resampled to another lattice; the same lattice is left as it is."""
    if grid.same_lattice(target):
        return df
    points = lattice(df.sparkSession, target)
    return interpolate(points, df, grid, values, centers(target))


def mask_lattice(df: DataFrame, grid: Grid, fraction: Column, name: str = "mask") -> DataFrame:
    """A geometry (a Column on x, y, z: 0 to 1) sampled at cell centers."""
    return df.withColumns(centers(grid)).withColumn(name, fraction.cast("double")).drop(*grid.axes)
