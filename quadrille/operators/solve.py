"""Linear solves on lattices: conjugate gradients, and dense or spectral kernels for lattices that fit a worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Grid
from . import spectral
from .tiles import shifted

#: Largest lattice that one worker may hold as an array: 2^22 cells are 32 MB of doubles.
KERNEL_CELLS = 1 << 22
#: Iterations between two cuts of the lineage.
CUT_EVERY = 5


class NotConverged(RuntimeError):
    pass


def _folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/step-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder, so a loop's plan does not grow."""
    return one_after_another([df])


def one_after_another(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of some tables, each written in turn to one folder, so the plan is one scan however many there are."""
    where = None
    for part in parts:
        where = where or _folder(part.sparkSession)
        part.write.mode("append").parquet(where)
    return part.sparkSession.read.schema(part.schema).parquet(where)


def conjugate_gradients(
    df: DataFrame,
    apply: Callable[[DataFrame, str, str], DataFrame],
    right: str = "b",
    out: str = "x",
    relative: float = 1e-6,
    absolute: float = 1e-12,
    iterations: int = 1000,
    project: bool = False,
) -> DataFrame:
    """Solve ``A x = b`` for a symmetric definite operator; rows keep their other columns.

    ``apply(df, column, name)`` adds ``A column`` as ``name``.  ``project`` works
    in the space of mean 0, for operators that map constants to 0.  Each
    iteration is one application (a shuffle) and one aggregation; scalars alone
    pass the driver.
    """
    if project:
        mean = df.agg(F.avg(right)).first()[0] or 0.0
        df = df.withColumn(right, F.col(right) - F.lit(mean))
    df = df.withColumns({out: F.lit(0.0), "_r": F.col(right), "_p": F.col(right)})
    rr = df.agg(F.sum(F.col("_r") ** 2)).first()[0] or 0.0
    goal = max(relative**2 * rr, absolute**2)
    k = 0
    while rr > goal:
        if k == iterations:
            raise NotConverged(f"residual {rr**0.5:.3g} after {k} iterations")
        df = cut(apply(df, "_p", "_q"))
        pq = df.agg(F.sum(F.col("_p") * F.col("_q"))).first()[0]
        if not pq:
            break
        alpha = rr / pq
        df = df.withColumns({out: F.col(out) + F.col("_p") * alpha, "_r": F.col("_r") - F.col("_q") * alpha})
        new = df.agg(F.sum(F.col("_r") ** 2)).first()[0]
        df = df.withColumn("_p", F.col("_r") + F.col("_p") * (new / rr)).drop("_q")
        rr, k = new, k + 1
    return df.drop("_r", "_p")


def fits_worker(grid: Grid) -> bool:
    return grid.size <= KERNEL_CELLS


def grid_kernel(
    df: DataFrame,
    grid: Grid,
    function: Callable[[np.ndarray], np.ndarray],
    value: str = "v",
    out: str | None = None,
    batch: tuple[str, ...] = (),
) -> DataFrame:
    """An array function on each batch slice as a whole, in a worker; the lattice must be within ``KERNEL_CELLS``."""
    if not fits_worker(grid):
        raise ValueError(f"{grid.size} cells are more than a worker's {KERNEL_CELLS}")
    out = out or value
    keys, shape = grid.keys, tuple(grid.resolution.values())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(shape)
        at = tuple(rows[k].to_numpy() for k in keys)
        a[at] = rows[value].to_numpy()
        return rows[[*batch, *keys]].assign(**{out: np.asarray(function(a), float)[at]})

    fields = df.select(*batch, *keys, F.col(value).cast("double").alias(value))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.drop(value).schema.fields)
    groups = fields.groupBy(*batch) if batch else fields.withColumn("_all", F.lit(0)).groupBy("_all")
    return groups.applyInPandas(run, f"{schema}, {out} double")


def laplace_array(a: np.ndarray, grid: Grid) -> np.ndarray:
    """The Laplacian of an array by the boundary rules of a lattice, constants taken as 0."""
    out = np.zeros_like(a)
    for k, axis in enumerate(grid.axes):
        lo, hi = grid.boundary[axis]
        last = a.shape[k] - 1
        side = {"periodic": lambda i: np.take(a, [i], k), "edge": lambda i: np.take(a, [last - i], k)}
        below = side[lo.kind](last) if lo.kind in side else np.zeros_like(np.take(a, [0], k))
        above = side[hi.kind](0) if hi.kind in side else np.zeros_like(np.take(a, [0], k))
        wide = np.concatenate([below, a, above], k)
        out += (np.take(wide, range(2, last + 3), k) + np.take(wide, range(last + 1), k) - 2 * a) / grid.dx[axis] ** 2
    return out


def solve_array(b: np.ndarray, grid: Grid, alpha: float, beta: float, relative: float, iterations: int, project: bool) -> np.ndarray:
    """(alpha - beta laplace) x = b by conjugate gradients on an array."""
    r = b - b.mean() if project else b.copy()
    x, p, rr = np.zeros_like(b), r.copy(), float((r * r).sum())
    goal, k = max(relative**2 * rr, 1e-24), 0
    while rr > goal:
        if k == iterations:
            raise NotConverged(f"residual {rr**0.5:.3g} after {k} iterations")
        q = alpha * p - beta * laplace_array(p, grid)
        step = rr / float((p * q).sum())
        x, r = x + step * p, r - step * q
        new = float((r * r).sum())
        p, rr, k = r + (new / rr) * p, new, k + 1
    return x - x.mean() if project else x


def solve_lattice(
    df: DataFrame, grid: Grid, right: str = "b", out: str = "x", alpha: float = 0.0, beta: float = 1.0, relative: float = 1e-6,
    iterations: int = 1000, project: bool = False, batch: tuple[str, ...] = (), distributed: bool | None = None,
) -> DataFrame:
    """Solve (alpha - beta laplace) x = b; constants of the boundary count as 0.

    A lattice that fits a worker is solved there, each batch slice in its own
    task; a larger one by distributed conjugate gradients (one batch slice).
    """
    if not (fits_worker(grid) if distributed is None else not distributed):
        from .stencil import laplace

        if batch:
            raise ValueError("a lattice beyond one worker is solved without batch columns; solve its slices one by one")

        zero = grid.map_boundary(lambda b: b.map(lambda _: 0.0))

        def apply(rows: DataFrame, column: str, name: str) -> DataFrame:
            near = laplace(rows.select(*grid.keys, column), zero, column, "_l").select(*grid.keys, "_l")
            return rows.join(near, grid.keys).withColumn(name, F.col(column) * alpha - F.col("_l") * beta).drop("_l")

        rows = df.select(*grid.keys, F.col(right).alias("b"))
        done = conjugate_gradients(rows, apply, "b", "x", relative, 1e-12, iterations, project)
        return done.select(*grid.keys, F.col("x").alias(out))
    return grid_kernel(df, grid, lambda b: solve_array(b, grid, alpha, beta, relative, iterations, project), right, out, batch)


def masked_laplace(df: DataFrame, grid: Grid, value: str, out: str, active: str = "active") -> DataFrame:
    """Divergence of the gradient through open faces: per axis, open_lo_<axis> and open_hi_<axis> (0 or 1) say which are.

    ``grid`` carries the value's boundary.  Where ``active`` is 0 the value itself is returned.
    """
    near = shifted(df, grid, {f"_{s}{a}": (value, a, o) for a in grid.axes for s, o in (("m", -1), ("p", 1))})
    total = F.lit(0.0)
    for a in grid.axes:
        up = F.col(f"open_hi_{a}") * (F.col(f"_p{a}") - F.col(value))
        down = F.col(f"open_lo_{a}") * (F.col(value) - F.col(f"_m{a}"))
        total = total + (up - down) / F.lit(grid.dx[a] ** 2)
    names = [f"_{s}{a}" for a in grid.axes for s in "mp"]
    return near.withColumn(out, F.when(F.col(active) != 0, total).otherwise(F.col(value))).drop(*names)


def masked_array(a: np.ndarray, grid: Grid, opened: dict[str, np.ndarray], active: np.ndarray) -> np.ndarray:
    """``masked_laplace`` of an array, constants of the boundary taken as 0; 0 where not active."""
    out = np.zeros_like(a)
    for k, axis in enumerate(grid.axes):
        lo, hi = grid.boundary[axis]
        first, last = np.take(a, [0], k), np.take(a, [a.shape[k] - 1], k)
        below = {"periodic": last, "edge": first}.get(lo.kind, np.zeros_like(first))
        above = {"periodic": first, "edge": last}.get(hi.kind, np.zeros_like(last))
        step = np.diff(np.concatenate([below, a, above], k), axis=k)
        up, down = np.take(step, range(1, a.shape[k] + 1), k), np.take(step, range(a.shape[k]), k)
        out += (opened[f"open_hi_{axis}"] * up - opened[f"open_lo_{axis}"] * down) / grid.dx[axis] ** 2
    return np.where(active != 0, out, 0.0)


def _masked_kernel(grid: Grid, right: str, out: str, active: str, relative: float, iterations: int):
    keys, shape = grid.keys, tuple(grid.resolution.values())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = tuple(rows[k].to_numpy() for k in keys)

        def whole(name: str) -> np.ndarray:
            a = np.zeros(shape)
            a[at] = rows[name].to_numpy(float)
            return a

        opened = {f"open_{s}_{a}": whole(f"open_{s}_{a}") for a in grid.axes for s in ("lo", "hi")}
        mask = whole(active)
        r = np.where(mask != 0, -whole(right), 0.0)
        x, p, rr = np.zeros(shape), r.copy(), float((r * r).sum())
        goal, k = max(relative**2 * rr, 1e-24), 0
        while rr > goal:
            if k == iterations:
                raise NotConverged(f"residual {rr**0.5:.3g} after {k} iterations")
            q = -masked_array(p, grid, opened, mask)
            step = rr / float((p * q).sum())
            x, r = x + step * p, r - step * q
            new = float((r * r).sum())
            p, rr, k = r + (new / rr) * p, new, k + 1
        return rows.drop(columns=["_all"]).assign(**{out: x[at]})

    return run


def solve_masked(
    df: DataFrame, grid: Grid, right: str = "b", out: str = "x", active: str = "active", relative: float = 1e-6, iterations: int = 2000,
    distributed: bool | None = None,
) -> DataFrame:
    """Solve ``masked_laplace x = b`` where ``active`` is not 0; x is 0 elsewhere.

    A lattice that fits a worker is solved there, a larger one by distributed
    conjugate gradients; the right side must be consistent (mean 0 over active
    cells of a closed domain).
    """
    if fits_worker(grid) if distributed is None else not distributed:
        run = _masked_kernel(grid, right, out, active, relative, iterations)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"{schema}, {out} double")
    rows = df.withColumn("_b", F.when(F.col(active) != 0, -F.col(right)).otherwise(0.0))

    def apply(state: DataFrame, column: str, name: str) -> DataFrame:
        near = masked_laplace(state, grid, column, name, active)
        return near.withColumn(name, F.when(F.col(active) != 0, -F.col(name)).otherwise(F.col(name)))

    return conjugate_gradients(rows, apply, "_b", out, relative, 1e-12, iterations).drop("_b")


def frequencies(grid: Grid) -> np.ndarray:
    """Squared wave numbers (2 pi k)^2 of the discrete Fourier transform of a lattice."""
    return sum(k**2 for k in np.meshgrid(*[spectral.wave_numbers(grid, a) for a in grid.axes], indexing="ij"))


def spectral_filter(
    df: DataFrame, grid: Grid, response: Callable[[np.ndarray], np.ndarray], value: str = "v", batch: tuple[str, ...] = (), distributed: bool | None = None
) -> DataFrame:
    """A periodic field with its spectrum multiplied by ``response`` of the squared wave number.

    A lattice that fits a worker is transformed there, a larger one axis by axis in blocks of lines.
    """
    if not (fits_worker(grid) if distributed is None else not distributed):
        return spectral.filtered(df, grid, response, value, batch)
    return grid_kernel(df, grid, lambda a: np.fft.ifftn(np.fft.fftn(a) * response(frequencies(grid))).real, value, batch=batch)


def fourier_laplace(
    df: DataFrame, grid: Grid, value: str = "v", times: int = 1, batch: tuple[str, ...] = (), distributed: bool | None = None
) -> DataFrame:
    """Spectral Laplacian of a periodic field."""
    return spectral_filter(df, grid, lambda k2: (-k2) ** times, value, batch, distributed)


def fourier_poisson(
    df: DataFrame, grid: Grid, value: str = "v", times: int = 1, batch: tuple[str, ...] = (), distributed: bool | None = None
) -> DataFrame:
    """Spectral inverse Laplacian of a periodic field; the result has mean 0."""
    return spectral_filter(df, grid, lambda k2: np.where(k2 == 0, 0, -1 / np.where(k2 == 0, 1, k2)) ** times, value, batch, distributed)


def noise(
    df: DataFrame, grid: Grid, scale: float = 10.0, smoothness: float = 1.0, seed: int = 0, out: str = "v", distributed: bool | None = None
) -> DataFrame:
    """Random field with a power-law spectrum, mean 0 and deviation 1; the seed fixes it, whatever the layout and the way."""
    if not (fits_worker(grid) if distributed is None else not distributed):
        return spectral.noise(df, grid, scale, smoothness, seed, out)

    def draw(a: np.ndarray) -> np.ndarray:
        index = dict(zip(grid.axes, np.indices(a.shape, sparse=True), strict=True))
        x = np.fft.ifftn(spectral.noise_spectrum(index, grid, scale, smoothness, seed)).real
        x = x / (x.std() or 1.0)
        return x - x.mean()

    return grid_kernel(df.withColumn(out, F.lit(0.0)), grid, draw, out)
