"""Tiles with halos: the physical layout behind every stencil.

A lattice is cut into tiles of bounded size.  Rows near a tile's edge are also
sent to the neighbour tile, and rows at the lattice's edge produce the ghost
cells of the boundary rule.  All of that is a map-side ``explode``; then one
shuffle by tile brings a tile together, and windows over a tile's lines need no
further one, as hashing by tile also clusters by tile and line.  So a stencil
along any number of axes costs one shuffle of the rows plus a thin halo, a line
of any length is spread over tasks, and boundary kinds need no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..meta import Grid

#: Cells along each axis of a tile, by the number of axes: at most 65,536 cells.
TILE = {1: 65536, 2: 256, 3: 40}


@dataclass(frozen=True)
class Tiled:
    """Rows of tiles with halos; ``own`` says which are the tile's cells."""

    df: DataFrame
    grid: Grid
    batch: tuple[str, ...]
    values: tuple[str, ...]

    def neighbour(self, column: str | Column, axis: str, offset: int) -> Column:
        """The value ``offset`` cells farther along an axis."""
        column = F.col(column) if isinstance(column, str) else column
        if offset == 0:
            return column
        line = [f"_t{a}" for a in self.grid.axes] + [f"i{a}" for a in self.grid.axes if a != axis]
        window = Window.partitionBy(*self.batch, *line).orderBy(f"i{axis}")
        return F.lead(column, offset).over(window) if offset > 0 else F.lag(column, -offset).over(window)

    def own(self, df: DataFrame) -> DataFrame:
        """Without halos and tile columns."""
        return df.where("_own").drop("_own", *[f"_t{a}" for a in self.grid.axes])


def _halo(
    grid: Grid, axis: str, width: tuple[int, int], tile: int, values: tuple[str, ...], carried: tuple[str, ...] = ()
) -> Column:
    """All places of a row along one axis: structs of tile, index, whether it is the row's own, and the values there.

    ``carried`` columns are not subject to a constant boundary.
    """
    n, i = grid.resolution[axis], F.col(f"i{axis}")
    lo, hi = grid.boundary[axis]
    below, above = width  # ghosts needed under and over a tile
    last = (n - 1) // tile
    own_tile = F.floor(i / tile).cast("int")
    own_tile = F.greatest(F.lit(0), F.least(own_tile, F.lit(last)))

    def place(t: Column, at: Column, own: bool, constant: float | None = None) -> Column:
        fixed = F.lit(constant).cast("double") if constant is not None else None
        held = [(F.col(v) if fixed is None or v in carried else fixed).alias(v) for v in values]
        return F.struct(t.cast("int").alias("t"), at.cast("int").alias("i"), F.lit(own).alias("own"), *held)

    nothing = F.filter(F.array(place(own_tile, i, False)), lambda _: F.lit(False))
    parts = [F.array(place(own_tile, i, True))]
    if last:
        if below:
            up = (F.pmod(i, F.lit(tile)) >= tile - below) & (own_tile < last)
            parts.append(F.when(up, F.array(place(own_tile + 1, i, False))).otherwise(nothing))
        if above:
            down = (F.pmod(i, F.lit(tile)) < above) & (own_tile > 0)
            parts.append(F.when(down, F.array(place(own_tile - 1, i, False))).otherwise(nothing))
    for rule, size, side in ((lo, below, -1), (hi, above, 1)):
        if not size or rule.kind == "none":
            continue
        edge_tile = F.lit(0 if side < 0 else last)
        if rule.kind == "periodic":
            # a lattice narrower than the halo wraps more than once
            for k in range(1, -(-size // n) + 1):
                wrapped = i + side * k * n
                near = wrapped >= -size if side < 0 else wrapped < n + size
                parts.append(F.when(near, F.array(place(edge_tile, wrapped, False))).otherwise(nothing))
        else:
            edge = i == (0 if side < 0 else n - 1)
            constant = rule.value if rule.kind == "constant" else None
            ghosts = [place(edge_tile, i + side * k, False, constant) for k in range(1, size + 1)]
            parts.append(F.when(edge, F.array(*ghosts)).otherwise(nothing))
    return F.concat(*parts)


def tiled(
    df: DataFrame,
    grid: Grid,
    widths: dict[str, int | tuple[int, int]],
    values: tuple[str, ...] | list[str],
    batch: tuple[str, ...] = (),
    tile: int | None = None,
    carried: tuple[str, ...] = (),
) -> Tiled:
    """Deal the rows of a dense lattice into tiles with halos of the given widths along each axis."""
    values = tuple(values)
    size = tile or TILE[len(grid.axes)]
    df = df.select(*batch, *grid.keys, *values, F.lit(True).alias("_own"))
    for a in grid.axes:
        w = widths.get(a, 0)
        w = w if isinstance(w, tuple) else (w, w)
        if max(w) > size:
            raise ValueError(f"a stencil of {w} cells does not fit tiles of {size}")
        df = _spread(df, grid, a, w, size, values, carried)
    df = df.repartition(*batch, *[f"_t{a}" for a in grid.axes])
    return Tiled(df, grid, tuple(batch), values)


def _spread(df, grid, axis, width, size, values, carried) -> DataFrame:
    others = [k for k in df.columns if k not in (f"i{axis}", "_own", *values)]
    df = df.select(*others, "_own", F.explode(_halo(grid, axis, width, size, values, carried)).alias("_p"))
    return df.select(
        *others,
        F.col("_p.t").alias(f"_t{axis}"),
        F.col("_p.i").alias(f"i{axis}"),
        (F.col("_own") & F.col("_p.own")).alias("_own"),
        *[F.col(f"_p.{v}").alias(v) for v in values],
    )


def padded(df: DataFrame, grid: Grid, widths: dict[str, tuple[int, int]], values: list[str], batch: tuple[str, ...] = ()) -> DataFrame:
    """The lattice with ghost cells of the boundary rule as rows, indices from ``-lower`` on; no shuffle."""
    df = df.select(*batch, *grid.keys, *values, F.lit(True).alias("_own"))
    for a, w in widths.items():
        df = _spread(df, grid, a, w, max(grid.resolution[a], *w) + 1, tuple(values), ()).drop(f"_t{a}")
    return df.select(*batch, *grid.keys, *values)


def shifted(df: DataFrame, grid: Grid, columns: dict[str, tuple[str, str, int]], batch: tuple[str, ...] = ()) -> DataFrame:
    """Add columns ``name: (value, axis, offset)``: neighbours' values, by the boundary beyond the lattice."""
    widths: dict[str, tuple[int, int]] = {}
    for _, axis, k in columns.values():
        lo, hi = widths.get(axis, (0, 0))
        widths[axis] = max(lo, -k), max(hi, k)
    values = tuple(dict.fromkeys(v for v, _, _ in columns.values()))
    rest = tuple(c for c in df.columns if c not in (*batch, *grid.keys))
    keep = tuple(dict.fromkeys((*rest, *values)))
    t = tiled(df, grid, widths, keep, batch, carried=tuple(c for c in rest if c not in values))
    return t.own(t.df.withColumns({name: t.neighbour(v, a, k) for name, (v, a, k) in columns.items()}))
