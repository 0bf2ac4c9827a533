"""Differential operators on lattices, as windows over tiles (see ``tiles``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import Grid
from .tiles import padded, shifted, tiled


def coefficients(offsets: list[float], derivative: int) -> list[float]:
    """Weights of values at ``offsets`` (in cells) for a derivative, from the Taylor conditions."""
    n = len(offsets)
    powers = np.array([[o**k for o in offsets] for k in range(n)], float)
    right = np.zeros(n)
    right[derivative] = float(np.prod(range(1, derivative + 1)))
    return np.linalg.solve(powers, right).tolist()


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def laplace(
    df: DataFrame,
    grid: Grid,
    value: str = "v",
    out: str = "laplace",
    axes: tuple[str, ...] | None = None,
    weights: dict[str, float] | None = None,
    order: int = 2,
    batch: tuple[str, ...] = (),
) -> DataFrame:
    """Sum over axes of the second derivative (order 2, 4, 6, ...), optionally weighted by axis."""
    axes = axes or grid.axes
    reach = order // 2
    offsets = list(range(-reach, reach + 1))
    t = tiled(df, grid, {a: reach for a in axes}, (value,), batch)
    c = coefficients(offsets, 2)
    parts = []
    for a in axes:
        terms = [t.neighbour(value, a, o) * F.lit(k) for o, k in zip(offsets, c, strict=True)]
        parts.append(_total(terms) * F.lit((weights or {}).get(a, 1.0) / grid.dx[a] ** 2))
    return t.own(t.df.withColumn(out, _total(parts)))


def gradient(
    df: DataFrame, grid: Grid, value: str = "v", axes: tuple[str, ...] | None = None, order: int = 2, batch: tuple[str, ...] = ()
) -> DataFrame:
    """Central differences at cells, one column ``d<axis>`` for each axis."""
    reach = order // 2
    offsets = [o for o in range(-reach, reach + 1) if o]
    c = coefficients([*offsets, 0], 1)[:-1]
    axes = axes or grid.axes
    t = tiled(df, grid, {a: reach for a in axes}, (value,), batch)
    out = {
        f"d{a}": _total([t.neighbour(value, a, o) * F.lit(k) for o, k in zip(offsets, c, strict=True)]) / F.lit(grid.dx[a])
        for a in axes
    }
    return t.own(t.df.withColumns(out))


def upwind_gradient(
    df: DataFrame, grid: Grid, velocity: dict[str, str], value: str = "v", order: int = 1, batch: tuple[str, ...] = ()
) -> DataFrame:
    """Adds d<axis>: the one-sided difference towards where the velocity comes from; of order 1 or 2.

    ``velocity`` names a column for each axis wanted.  Where it is 0 the slope is the mean of both sides.
    """
    if order not in (1, 2):
        raise ValueError(f"one-sided differences have order 1 or 2, not {order}")
    flow = tuple(dict.fromkeys(velocity.values()))
    t = tiled(df, grid, {a: (order, order) for a in velocity}, (value, *flow), batch, carried=flow)
    weights = {1: (1.0, -1.0), 2: (1.5, -2.0, 0.5)}[order]
    out = {}
    for a, name in velocity.items():
        back, ahead = (
            _total([t.neighbour(value, a, side * k) * F.lit(-side * w) for k, w in enumerate(weights)]) / F.lit(grid.dx[a]) for side in (-1, 1)
        )
        u = F.col(name)
        out[f"d{a}"] = F.when(u > 0, back).when(u < 0, ahead).when(u == 0, (back + ahead) / 2)
    return t.own(t.df.withColumns(out))


#: Compact schemes of order 6 (fixed values): the neighbours' weight on the left side, and on the right those of
#: differences over one and two cells, for the first derivative, the second, and the value half a cell up.
COMPACT = {"first": (1 / 3, 14 / 9, 1 / 9), "second": (2 / 11, 12 / 11, 3 / 11), "half": (3 / 10, 3 / 4, 1 / 20)}


def compact_weights(kind: str, precision: float = 1e-13) -> dict[int, float]:
    """Weights by offset of a compact scheme's solution.

    The left side has 1 in the middle and ``a`` beside it; its inverse falls off
    by a factor from cell to cell, so beyond a few dozen cells it is below the
    precision, and the solve becomes a stencil of bounded width that needs no
    line in one place.
    """
    a, one, two = COMPACT[kind]
    falls = ((1 - 4 * a * a) ** 0.5 - 1) / (2 * a)
    reach = int(np.ceil(np.log(precision) / np.log(abs(falls))))
    inverse = {k: falls ** abs(k) / (1 - 4 * a * a) ** 0.5 for k in range(-reach, reach + 1)}
    if kind == "first":
        right = {1: one / 2, -1: -one / 2, 2: two / 4, -2: -two / 4}
    elif kind == "second":
        right = {1: one, -1: one, 2: two / 4, -2: two / 4, 0: -2 * (one + two / 4)}
    else:
        right = {0: one, 1: one, -1: two, 2: two}
    out: dict[int, float] = {}
    for k, x in inverse.items():
        for j, y in right.items():
            out[k + j] = out.get(k + j, 0.0) + x * y
    return {k: w for k, w in sorted(out.items()) if abs(w) > precision}


def _weighted(df: DataFrame, grid: Grid, value: str, names: dict[str, str], weights: dict[int, float], scale, batch) -> DataFrame:
    reach = max(map(abs, weights))
    t = tiled(df, grid, {a: reach for a in names}, (value,), batch)
    return t.own(
        t.df.withColumns({n: _total([t.neighbour(value, a, o) * F.lit(w) for o, w in weights.items()]) * F.lit(scale(a)) for a, n in names.items()})
    )


def compact_gradient(df: DataFrame, grid: Grid, value: str = "v", axes: tuple[str, ...] | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """First derivatives of order 6 at cells, one column ``d<axis>`` for each axis.

    The line is taken on beyond its ends by the boundary rule, as by any other stencil.
    """
    names = {a: f"d{a}" for a in axes or grid.axes}
    return _weighted(df, grid, value, names, compact_weights("first"), lambda a: 1 / grid.dx[a], batch)


def compact_laplace(df: DataFrame, grid: Grid, value: str = "v", out: str = "laplace", axes: tuple[str, ...] | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """Sum of second derivatives of order 6."""
    names = {a: f"_l{a}" for a in axes or grid.axes}
    rows = _weighted(df, grid, value, names, compact_weights("second"), lambda a: 1 / grid.dx[a] ** 2, batch)
    return rows.withColumn(out, _total([F.col(n) for n in names.values()])).drop(*names.values())


def compact_half_up(df: DataFrame, grid: Grid, axis: str, value: str = "v", out: str = "half", batch: tuple[str, ...] = ()) -> DataFrame:
    """Values half a cell farther along an axis, of order 6."""
    return _weighted(df, grid, value, {axis: out}, compact_weights("half"), lambda _: 1.0, batch)


def stagger(
    df: DataFrame,
    grid: Grid,
    function: Callable[[Column, Column], Column],
    value: str = "v",
    boundary: Grid | None = None,
    axes: tuple[str, ...] | None = None,
    batch: tuple[str, ...] = (),
) -> DataFrame:
    """``function(lower, upper)`` of the two cells at each face, as rows axis, indices, v.

    ``boundary`` (a grid) says which outer faces are stored; by default ``grid``.
    """
    boundary = boundary or grid
    axes = axes or grid.axes
    t = tiled(df, grid, {a: 1 for a in axes}, (value,), batch)
    places = []
    wide = t.df.withColumns({f"_lo{a}": t.neighbour(value, a, -1) for a in axes} | {f"_hi{a}": t.neighbour(value, a, 1) for a in axes})
    for a in axes:
        first, last = boundary.face_range(a)
        n, i = grid.resolution[a], F.col(f"i{a}")
        index = lambda j, a=a: [(F.col(k) if k != f"i{a}" else j).cast("int").alias(k) for k in grid.keys]
        own = F.struct(F.lit(a).alias("axis"), *index(i), function(F.col(f"_lo{a}"), F.col(value)).alias("v"))
        places.append(F.when(i >= first, own))
        if last > n:
            top = F.struct(F.lit(a).alias("axis"), *index(i + 1), function(F.col(value), F.col(f"_hi{a}")).alias("v"))
            places.append(F.when(i == n - 1, top))
    rows = wide.where("_own").select(*batch, F.explode(F.array_compact(F.array(*places))).alias("f"))
    return rows.select(*batch, "f.*")


def face_gradient(df: DataFrame, grid: Grid, value: str = "v", boundary: Grid | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """One-cell differences at the stored faces: axis, indices, v."""
    dx = F.coalesce(*[F.when(F.col("axis") == a, F.lit(d)) for a, d in grid.dx.items()])
    faces = stagger(df, grid, lambda lo, hi: hi - lo, value, boundary, batch=batch)
    return faces.withColumn("v", F.col("v") / dx)


def at_faces(df: DataFrame, grid: Grid, value: str = "v", boundary: Grid | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """Cell values averaged to the stored faces."""
    return stagger(df, grid, lambda lo, hi: (lo + hi) / 2, value, boundary, batch=batch)


def _edge_rows(spark, grid: Grid, axis: str) -> DataFrame | None:
    """Outer faces of an axis whose value a constant boundary other than 0 fixes."""
    from .lattice import lattice

    flat = Grid.of(**{a: (1 if a == axis else n) for a, n in grid.resolution.items()})
    out = None
    for at, rule in zip((0, grid.resolution[axis]), grid.boundary[axis], strict=True):
        if rule.kind == "constant" and rule.value != 0:
            rows = lattice(spark, flat).select(
                F.lit(axis).alias("axis"), *[(F.col(k) if k != f"i{axis}" else F.lit(at)).cast("int").alias(k) for k in grid.keys],
                F.lit(rule.value).alias("v"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def all_faces(faces: DataFrame, grid: Grid) -> DataFrame:
    """The stored faces, and those that a constant boundary other than 0 fixes (not for batches)."""
    for a in grid.axes:
        more = _edge_rows(faces.sparkSession, grid, a)
        faces = faces.unionByName(more) if more is not None else faces
    return faces


def from_faces(
    faces: DataFrame, grid: Grid, weight_lower: dict[str, float], weight_upper: dict[str, float], batch: tuple[str, ...] = (), group: bool = False
) -> DataFrame:
    """Per cell the weighted sum of its faces' values: each face gives a share to the two cells beside it.

    Shares are combined before the shuffle, and no join is needed.  With ``group``, by axis.
    """
    places = []
    for a, n in grid.resolution.items():
        i, periodic = F.col(f"i{a}"), grid.boundary[a][0].kind == "periodic"
        for cell, w in ((i, weight_lower[a]), (F.pmod(i - 1, F.lit(n)) if periodic else i - 1, weight_upper[a])):
            index = [(F.col(k) if k != f"i{a}" else cell).cast("int").alias(k) for k in grid.keys]
            inside = (F.col("axis") == a) & (cell >= 0) & (cell < n)
            places.append(F.when(inside, F.struct(F.lit(a).alias("axis"), *index, (F.col("v") * F.lit(w)).alias("v"))))
    keys = [*batch, *(["axis"] if group else []), *grid.keys]
    rows = faces.select(*batch, F.explode(F.array_compact(F.array(*places))).alias("p")).select(*batch, "p.*")
    return rows.groupBy(*keys).agg(F.sum("v").alias("v"))


def divergence(faces: DataFrame, grid: Grid, out: str = "divergence", batch: tuple[str, ...] = ()) -> DataFrame:
    """Divergence at cells of a staggered field (rows axis, indices, v).

    A cell all of whose faces the boundary fixes at 0 has no row.
    """
    rows = from_faces(
        all_faces(faces, grid), grid, {a: -1 / d for a, d in grid.dx.items()}, {a: 1 / d for a, d in grid.dx.items()}, batch
    )
    return rows.withColumnRenamed("v", out)


def at_centers(faces: DataFrame, grid: Grid, batch: tuple[str, ...] = ()) -> DataFrame:
    """A staggered field averaged to cells: one column ``v<axis>`` for each axis."""
    half = {a: 0.5 for a in grid.axes}
    rows = from_faces(all_faces(faces, grid), grid, half, half, batch, group=True)
    parts = [F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("v"))), F.lit(0.0)).alias(f"v{a}") for a in grid.axes]
    return rows.groupBy(*batch, *grid.keys).agg(*parts)


def divergence_centered(df: DataFrame, grid: Grid, components: dict[str, str], out: str = "divergence", batch: tuple[str, ...] = ()) -> DataFrame:
    """Divergence of a centered field by central differences."""
    t = tiled(df, grid, {a: 1 for a in components}, tuple(components.values()), batch)
    parts = [(t.neighbour(v, a, 1) - t.neighbour(v, a, -1)) / F.lit(2 * grid.dx[a]) for a, v in components.items()]
    return t.own(t.df.withColumn(out, _total(parts)))


def curl_centered(df: DataFrame, grid: Grid, components: dict[str, str], batch: tuple[str, ...] = ()) -> DataFrame:
    """Curl of a centered field by central differences: ``curl`` in two dimensions, ``curl_x``... in three."""
    t = tiled(df, grid, {a: 1 for a in grid.axes}, tuple(components.values()), batch)
    d = lambda v, a: (t.neighbour(components[v], a, 1) - t.neighbour(components[v], a, -1)) / F.lit(2 * grid.dx[a])
    if len(grid.axes) == 2:
        out = {"curl": d("y", "x") - d("x", "y")}
    else:
        out = {"curl_x": d("z", "y") - d("y", "z"), "curl_y": d("x", "z") - d("z", "x"), "curl_z": d("y", "x") - d("x", "y")}
    return t.own(t.df.withColumns(out))


def curl_corners(faces: DataFrame, grid: Grid, batch: tuple[str, ...] = ()) -> DataFrame:
    """Curl of a two-dimensional staggered field at the inner corners; corner ``(i, j)`` is the lower one of cell ``(i, j)``."""
    x, y = grid.axes
    i, j = F.col(f"i{x}"), F.col(f"i{y}")
    place = lambda a, b, w: F.struct(a.cast("int").alias(f"i{x}"), b.cast("int").alias(f"i{y}"), (F.col("v") * F.lit(w)).alias("v"))
    dx, dy = grid.dx[x], grid.dx[y]
    of_y = F.array(place(i, j, 1 / dx), place(i + 1, j, -1 / dx))
    of_x = F.array(place(i, j, -1 / dy), place(i, j + 1, 1 / dy))
    rows = faces.select(*batch, F.explode(F.when(F.col("axis") == y, of_y).otherwise(of_x)).alias("p")).select(*batch, "p.*")
    nx, ny = grid.resolution[x], grid.resolution[y]
    inner = rows.where((F.col(f"i{x}") > 0) & (F.col(f"i{x}") < nx) & (F.col(f"i{y}") > 0) & (F.col(f"i{y}") < ny))
    return inner.groupBy(*batch, *grid.keys).agg(F.sum("v").alias("curl"))


def shift(df: DataFrame, grid: Grid, offsets: tuple[int, ...], axes: tuple[str, ...] | None = None, value: str = "v", batch: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours' values at integer offsets: columns ``<axis>_<offset>``, ``m`` for minus."""
    name = lambda a, o: f"{a}_{'m' if o < 0 else 'p'}{abs(o)}"
    return shifted(df, grid, {name(a, o): (value, a, o) for a in axes or grid.axes for o in offsets}, batch)


def pad(df: DataFrame, grid: Grid, widths: dict[str, int | tuple[int, int]], value: str = "v", batch: tuple[str, ...] = ()) -> DataFrame:
    """Grown by ghost cells of the boundary rule; indices count from the new lower corner."""
    both = {a: w if isinstance(w, tuple) else (w, w) for a, w in widths.items()}
    rows = padded(df, grid, both, [value], batch)
    return rows.withColumns({f"i{a}": (F.col(f"i{a}") + lo).cast("int") for a, (lo, _) in both.items()})


def bake(df: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """The boundary as one layer of cells on every side."""
    return pad(df, grid, {a: 1 for a in grid.axes}, value)


def finite_fill(df: DataFrame, grid: Grid, value: str = "v", distance: int = 1, diagonal: bool = True, batch: tuple[str, ...] = ()) -> DataFrame:
    """Null or non-finite cells take the mean of their finite neighbours, ``distance`` times; the others stay."""
    v = F.col(value)
    df = df.withColumn(value, F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v))
    open_grid = grid.with_boundary("none")
    for _ in range(distance):
        t = tiled(df, open_grid, {a: 1 for a in grid.axes}, (value,), batch)
        work, sums = t.df, {}
        if diagonal:
            # one axis after the other: sums of lines, then of lines' sums, so corners are counted too
            work = work.withColumns({"_s": F.coalesce(v, F.lit(0.0)), "_n": F.when(v.isNull(), 0.0).otherwise(1.0)})
            for a in grid.axes:
                add = {}
                for c in ("_s", "_n"):
                    around = [F.coalesce(t.neighbour(c, a, o), F.lit(0.0)) for o in (-1, 1)]
                    add[c] = F.col(c) + around[0] + around[1]
                work = work.withColumns(add)
            sums = {"s": F.col("_s"), "n": F.col("_n")}
        else:
            near = [t.neighbour(value, a, o) for a in grid.axes for o in (-1, 1)]
            sums = {"s": _total([F.coalesce(x, F.lit(0.0)) for x in near]), "n": _total([F.when(x.isNull(), 0.0).otherwise(1.0) for x in near])}
        filled = F.when(v.isNotNull(), v).when(sums["n"] > 0, sums["s"] / sums["n"])
        df = t.own(work.withColumn("_f", filled)).select(*batch, *grid.keys, F.col("_f").alias(value))
    return df


def downsample2x(df: DataFrame, grid: Grid, value: str = "v", batch: tuple[str, ...] = ()) -> tuple[DataFrame, Grid]:
    """Half the resolution: the mean of two cells along each axis (of one at an odd upper end)."""
    keys = [F.floor(F.col(k) / 2).cast("int").alias(k) for k in grid.keys]
    coarse = grid.with_resolution(**{a: -(-n // 2) for a, n in grid.resolution.items()})
    return df.groupBy(*batch, *keys).agg(F.avg(value).alias(value)), coarse


def upsample2x(df: DataFrame, grid: Grid, value: str = "v", batch: tuple[str, ...] = ()) -> tuple[DataFrame, Grid]:
    """Twice the resolution by linear interpolation: three quarters of the cell, one of the neighbour."""
    for a in grid.axes:
        near = shifted(df, grid, {"_m": (value, a, -1), "_p": (value, a, 1)}, batch)
        pair = F.array(
            F.struct((F.col(f"i{a}") * 2).alias("i"), (F.col(value) * 0.75 + F.col("_m") * 0.25).alias("v")),
            F.struct((F.col(f"i{a}") * 2 + 1).alias("i"), (F.col(value) * 0.75 + F.col("_p") * 0.25).alias("v")),
        )
        others = [k for k in grid.keys if k != f"i{a}"]
        df = near.select(*batch, *others, F.explode(pair).alias("p")).select(
            *batch, *others, F.col("p.i").cast("int").alias(f"i{a}"), F.col("p.v").alias(value)
        )
        grid = grid.with_resolution(**{a: 2 * grid.resolution[a]})
    return df.select(*batch, *grid.keys, value), grid
