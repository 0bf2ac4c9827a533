"""Advection, diffusion, pressure projection and time integration, composed of resampling, stencils and solves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import Grid, accessible_boundary, pressure_boundary
from . import solve
from .geometry import Geometry
from .lattice import centers, lattice
from .resample import interpolate
from .stencil import divergence, face_gradient, laplace, stagger
from .tiles import shifted

# --- advection -----------------------------------------------------------------------------------


def velocities(points: DataFrame, field: DataFrame, grid: Grid, components: dict[str, str], position: dict[str, Column], suffix: str) -> DataFrame:
    return interpolate(points, field, grid, list(components.values()), position, suffix)


def trace(points: DataFrame, field: DataFrame, grid: Grid, components: dict[str, str], dt: float, integrator: str = "euler") -> DataFrame:
    """Points (columns x, y, z) moved along a velocity field for ``dt``; new positions as ``new_<axis>``.

    ``euler`` takes one sample of the velocity, ``rk4`` four; ``finite_rk4``
    falls back to the first where a later one is not finite.
    """
    axes = grid.axes
    here = {a: F.col(a) for a in axes}
    out = velocities(points, field, grid, components, here, "_1")
    k1 = {a: F.col(f"{components[a]}_1") for a in axes}
    if integrator == "euler":
        moved = {f"new_{a}": F.col(a) + k1[a] * dt for a in axes}
        names = [f"{v}_1" for v in components.values()]
    else:
        for step, (before, part) in enumerate((("_1", dt / 2), ("_2", dt / 2), ("_3", dt)), 2):
            spot = {a: F.col(a) + F.col(f"{components[a]}{before}") * part for a in axes}
            out = velocities(out, field, grid, components, spot, f"_{step}")
        k = lambda a, s: F.col(f"{components[a]}_{s}")
        total = {a: (k(a, 1) + 2 * k(a, 2) + 2 * k(a, 3) + k(a, 4)) / 6 for a in axes}
        if integrator == "finite_rk4":
            bad = {a: total[a].isNull() | F.isnan(total[a]) for a in axes}
            total = {a: F.when(bad[a], k1[a]).otherwise(total[a]) for a in axes}
        moved = {f"new_{a}": F.col(a) + total[a] * dt for a in axes}
        names = [f"{v}_{s}" for v in components.values() for s in (1, 2, 3, 4)]
    return out.withColumns(moved).drop(*names)


def advect_points(points: DataFrame, field: DataFrame, grid: Grid, components: dict[str, str], dt: float, integrator: str = "euler") -> DataFrame:
    out = trace(points, field, grid, components, dt, integrator)
    return out.withColumns({a: F.col(f"new_{a}") for a in grid.axes}).drop(*[f"new_{a}" for a in grid.axes])


def _origins(df: DataFrame, grid: Grid, components: dict[str, str], dt: float, integrator: str, name: str) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Where cells' centers get to in ``dt``: rows with helper columns, the positions, and the helpers' names."""
    if integrator == "euler":
        return df, {a: c + F.col(components[a]) * dt for a, c in centers(grid).items()}, []
    kept = {a: f"{name}{a}" for a in grid.axes}
    start = df.withColumns({a: c for a, c in centers(grid).items()})
    moved = trace(start, df.select(*grid.keys, *components.values()), grid, components, dt, integrator)
    moved = moved.withColumns({kept[a]: F.col(f"new_{a}") for a in grid.axes}).drop(*grid.axes, *[f"new_{a}" for a in grid.axes])
    return moved, {a: F.col(c) for a, c in kept.items()}, list(kept.values())


def semi_lagrangian(
    df: DataFrame, grid: Grid, values: list[str], components: dict[str, str], dt: float, bounds: bool = False, suffix: str = "",
    integrator: str = "euler",
) -> DataFrame:
    """Values at the places that the velocity (columns of the same rows) comes from; other columns stay.

    The way back is traced by an integrator of ``trace``.
    """
    rows, back, helpers = _origins(df, grid, components, -dt, integrator, "_back_")
    return interpolate(rows, df.select(*grid.keys, *values), grid, values, back, suffix, bounds).drop(*helpers)


def mac_cormack(
    df: DataFrame, grid: Grid, value: str, components: dict[str, str], dt: float, strength: float = 1.0, integrator: str = "euler"
) -> DataFrame:
    """Semi-Lagrangian step with its error corrected, limited to the values around the origin."""
    there = semi_lagrangian(df, grid, [value], components, dt, True, "_f", integrator)
    forward = there.select(*grid.keys, F.col(f"{value}_f").alias("_v"))
    rows, ahead, helpers = _origins(there, grid, components, dt, integrator, "_ahead_")
    both = interpolate(rows, forward, grid, ["_v"], ahead, "_b").drop(*helpers)
    fixed = F.col(f"{value}_f") + (F.col(value) - F.col("_v_b")) * (0.5 * strength)
    limited = F.greatest(F.col(f"{value}_f_min"), F.least(fixed, F.col(f"{value}_f_max")))
    return both.withColumn(value, limited).drop(f"{value}_f", f"{value}_f_min", f"{value}_f_max", "_v_b")


def advect(
    df: DataFrame, velocity: DataFrame, grid: Grid, components: dict[str, str], dt: float, values: list[str] | None = None, integrator: str = "euler"
) -> DataFrame:
    """Points (rows with columns x, y, z) move along the velocity; lattice rows take the values that arrive (semi-Lagrangian)."""
    if set(grid.axes) <= set(df.columns):
        return advect_points(df, velocity, grid, components, dt, integrator)
    own = values or [c for c in df.columns if c not in (*grid.keys, *components.values())]
    if not set(components.values()) <= set(df.columns):
        df = df.join(velocity.select(*grid.keys, *components.values()), grid.keys)
    out = semi_lagrangian(df, grid, own, components, dt, False, "_new", integrator)
    return out.withColumns({v: F.col(f"{v}_new") for v in own}).drop(*[f"{v}_new" for v in own])


def advection_rate(df: DataFrame, grid: Grid, value: str, components: dict[str, str], out: str = "rate", order: int = 2, compact: bool = False) -> DataFrame:
    """-u . grad(value) by central differences of an order, or by the compact scheme of order 6."""
    from .stencil import compact_gradient, gradient

    rows = df.select(*grid.keys, value)
    near = (compact_gradient(rows, grid, value) if compact else gradient(rows, grid, value, order=order)).drop(value)
    rate = sum((F.col(v) * F.col(f"d{a}") for a, v in components.items()), F.lit(0.0))
    return df.join(near, grid.keys).withColumn(out, -rate).drop(*[f"d{a}" for a in components])


# --- diffusion -----------------------------------------------------------------------------------


def diffuse_explicit(df: DataFrame, grid: Grid, diffusivity: float | dict[str, float], dt: float, substeps: int = 1, value: str = "v", order: int = 2) -> DataFrame:
    """Explicit Euler steps; refuses steps too long to be stable."""
    weights = diffusivity if isinstance(diffusivity, dict) else {a: diffusivity for a in grid.axes}
    step = dt / substeps
    if sum(abs(w) * abs(step) / grid.dx[a] ** 2 for a, w in weights.items()) > 1.0:
        raise ValueError("step too long for explicit diffusion; use more substeps")
    for k in range(substeps):
        df = laplace(df, grid, value, "_l", weights=weights, order=order)
        df = df.withColumn(value, F.col(value) + F.col("_l") * step).drop("_l")
        if (k + 1) % solve.CUT_EVERY == 0 and k + 1 < substeps:
            df = solve.cut(df)
    return df


def diffusion_rate(df: DataFrame, grid: Grid, value: str, diffusivity: str, out: str = "rate") -> DataFrame:
    """div(D grad value) with a diffusivity that varies; at a face it is the smaller one of the two cells."""
    columns = {}
    for a in grid.axes:
        for o, s in ((-1, "m"), (1, "p")):
            columns[f"_v{a}{s}"] = (value, a, o)
            columns[f"_d{a}{s}"] = (diffusivity, a, o)
    near = shifted(df, grid, columns)
    v, d = F.col(value), F.col(diffusivity)
    total = F.lit(0.0)
    for a in grid.axes:
        upper = F.least(d, F.col(f"_d{a}p")) * (F.col(f"_v{a}p") - v)
        lower = F.least(d, F.col(f"_d{a}m")) * (v - F.col(f"_v{a}m"))
        total = total + (upper - lower) / F.lit(grid.dx[a] ** 2)
    return near.withColumn(out, total).drop(*columns)


def diffuse_implicit(df: DataFrame, grid: Grid, diffusivity: float, dt: float, value: str = "v", relative: float = 1e-6) -> DataFrame:
    """Backward Euler: solves (1 - dt D laplace) u = value by conjugate gradients.

    A constant boundary other than 0 is a known neighbour, so its share goes to the right side.
    """
    known = F.lit(0.0)
    for a, n in grid.resolution.items():
        for at, rule in zip((0, n - 1), grid.boundary[a], strict=True):
            if rule.kind == "constant" and rule.value:
                share = dt * diffusivity * rule.value / grid.dx[a] ** 2
                known = known + F.when(F.col(f"i{a}") == at, F.lit(share)).otherwise(0.0)
    rows = df.select(*grid.keys, (F.col(value) + known).alias("b"))
    return solve.solve_lattice(rows, grid, "b", value, 1.0, dt * diffusivity, relative)


def diffuse_fourier(df: DataFrame, grid: Grid, diffusivity: float, dt: float, value: str = "v", batch: tuple[str, ...] = (), distributed: bool | None = None) -> DataFrame:
    """Exact diffusion of a periodic field in frequency space."""
    return solve.spectral_filter(df, grid, lambda k2: np.exp(-k2 * diffusivity * dt), value, batch, distributed)


# --- fluids --------------------------------------------------------------------------------------


def make_incompressible(faces: DataFrame, grid: Grid, relative: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The staggered field (axis, indices, v) without its divergence, and the pressure (indices, p).

    ``grid`` carries the velocity's boundary.  A domain closed on all sides has
    a pressure up to a constant, which is taken with mean 0.
    """
    pressure_grid = grid.map_boundary(pressure_boundary)
    closed = all(b.kind != "constant" for pair in pressure_grid.boundary.values() for b in pair)
    div = divergence(faces, grid, "b")
    div = lattice(faces.sparkSession, grid).join(div, grid.keys, "left").na.fill(0.0, ["b"])

    div = div.withColumn("b", -F.col("b"))
    pressure = solve.solve_lattice(div, pressure_grid, "b", "p", relative=relative, project=closed)
    slope = face_gradient(pressure, pressure_grid, "p", boundary=grid).withColumnRenamed("v", "_g")
    keys = ["axis", *grid.keys]
    out = faces.join(slope, keys, "left").withColumn("v", F.col("v") - F.coalesce("_g", F.lit(0.0))).drop("_g")
    return out, pressure


def apply_obstacle(faces: DataFrame, grid: Grid, obstacle: Geometry, velocity: dict[str, float] | None = None) -> DataFrame:
    """Faces inside an obstacle take its velocity, in part where it covers them in part."""
    out = faces
    spot = {}
    for a in grid.axes:
        half = F.when(F.col("axis") == a, F.lit(0.0)).otherwise(0.5)
        spot[a] = F.lit(grid.lower[a]) + (F.col(f"i{a}") + half) * F.lit(grid.dx[a])
    share = obstacle.fraction_inside(spot, F.lit(max(grid.dx.values()) / 2))
    own = F.coalesce(*[F.when(F.col("axis") == a, F.lit(float((velocity or {}).get(a, 0.0)))) for a in grid.axes])
    return out.withColumn("v", F.col("v") * (1 - share) + own * share)


def accessible_faces(cells: DataFrame, grid: Grid, accessible: str = "free") -> DataFrame:
    """1 for faces both of whose cells are accessible, else 0."""
    return stagger(cells, grid.map_boundary(accessible_boundary), F.least, accessible, boundary=grid)


def boundary_push(points: DataFrame, grid: Grid, obstacles: list[Geometry], separation: float = 0.5) -> DataFrame:
    """Particles moved out of obstacles and into the domain, ``separation`` away from surfaces."""
    position = {a: F.col(a) for a in grid.axes}
    for o in obstacles:
        position = o.push(position, separation)
    inside = {
        a: F.greatest(F.lit(grid.lower[a] + separation), F.least(position[a], F.lit(grid.upper[a] - separation))) for a in grid.axes
    }
    return points.withColumns(inside)


# --- time integration ------------------------------------------------------------------------------


def iterate(step: Callable[[DataFrame], DataFrame], state: DataFrame, steps: int, every: int = 1) -> DataFrame:
    """The states after 0, every, 2 every, ... steps, told apart by the column ``step``."""
    out = state.withColumn("step", F.lit(0))
    for k in range(1, steps + 1):
        state = step(state)
        if k % solve.CUT_EVERY == 0:
            state = solve.cut(state)
        if k % every == 0:
            out = out.unionByName(state.withColumn("step", F.lit(k)))
    return out


def rk4(rate: Callable[[DataFrame, str, str], DataFrame], df: DataFrame, value: str, dt: float) -> DataFrame:
    """Classic Runge-Kutta step; ``rate(df, column, name)`` adds the rate of a column."""
    df = rate(df, value, "_k1")
    for k, (before, part) in enumerate((("_k1", dt / 2), ("_k2", dt / 2), ("_k3", dt)), 2):
        df = rate(df.withColumn("_s", F.col(value) + F.col(before) * part), "_s", f"_k{k}")
    total = (F.col("_k1") + 2 * F.col("_k2") + 2 * F.col("_k3") + F.col("_k4")) / 6
    return df.withColumn(value, F.col(value) + total * dt).drop("_k1", "_k2", "_k3", "_k4", "_s")


def euler(rate: Callable[[DataFrame, str, str], DataFrame], df: DataFrame, value: str, dt: float) -> DataFrame:
    return rate(df, value, "_k").withColumn(value, F.col(value) + F.col("_k") * dt).drop("_k")
