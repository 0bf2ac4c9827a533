"""Fourier transforms of periodic lattices of any size, one axis after the other.

A worker holds a block of whole lines along one axis, so a transform along an
axis is one shuffle, and a filter of a field with d axes is 2 d - 1 of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import Grid

#: Cells of the lines that one task holds together; a longer line is a task of its own.
BLOCK_CELLS = 1 << 18
#: Longest line: 2^24 complex numbers are 256 MB.
LINE_CELLS = 1 << 24


def wave_numbers(grid: Grid, axis: str) -> np.ndarray:
    """Angular wave numbers of the discrete Fourier transform along an axis."""
    return 2 * np.pi * np.fft.fftfreq(grid.resolution[axis], grid.dx[axis])


def _lines(df: DataFrame, grid: Grid, axis: str, function: Callable, batch: tuple[str, ...], block: int | None) -> DataFrame:
    """``function(lines, index)`` of every line along ``axis``; ``index`` has each axis' cell indices, broadcast to the lines.

    ``df`` has batch columns, keys, ``_re``, ``_im`` and ``_given``.  Cells that
    are not there count as 0; the result has every cell of a line, those with
    ``_given`` False included.
    """
    n, keys = grid.resolution[axis], grid.keys
    if n > LINE_CELLS:
        raise ValueError(f"a line of {n} cells is more than a worker's {LINE_CELLS}")
    others = [a for a in grid.axes if a != axis]
    line = F.lit(0).cast("long")
    for a in others:
        line = line * grid.resolution[a] + F.col(f"i{a}")
    per = max(1, (block or BLOCK_CELLS) // n)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        which, at = np.unique(rows["_line"].to_numpy(), return_inverse=True)
        i = rows[f"i{axis}"].to_numpy()
        a = np.zeros((len(which), n), complex)
        a[at, i] = rows["_re"].to_numpy() + 1j * rows["_im"].to_numpy()
        given = np.zeros((len(which), n), bool)
        given[at, i] = rows["_given"].to_numpy()
        index, rest = {axis: np.arange(n)[None, :]}, which
        for b in reversed(others):
            index[b], rest = (rest % grid.resolution[b])[:, None], rest // grid.resolution[b]
        a = function(a, index)
        out = {c: np.repeat(rows[c].iloc[:1].to_numpy(), a.size) for c in batch}
        out |= {f"i{b}": np.broadcast_to(index[b], a.shape).reshape(-1).astype(np.int32) for b in grid.axes}
        return pd.DataFrame({**out, "_re": a.real.reshape(-1), "_im": a.imag.reshape(-1), "_given": given.reshape(-1)})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in batch], *[f"{k} int" for k in keys], "_re double, _im double, _given boolean"])
    rows = df.withColumn("_line", line).withColumn("_block", F.floor(F.col("_line") / per))
    return rows.groupBy(*batch, "_block").applyInPandas(run, schema)


def _start(df: DataFrame, grid: Grid, value, batch: tuple[str, ...]) -> DataFrame:
    return df.select(
        *batch, *[F.col(k).cast("int").alias(k) for k in grid.keys], value.cast("double").alias("_re"), F.lit(0.0).alias("_im"), F.lit(True).alias("_given")
    )


def filtered(
    df: DataFrame, grid: Grid, response: Callable[[np.ndarray], np.ndarray], value: str = "v", batch: tuple[str, ...] = (), block: int | None = None
) -> DataFrame:
    """The field whose spectrum is that of ``value`` times ``response`` of the squared wave number; rows as they were given."""
    rows, (*first, last) = _start(df, grid, F.col(value), batch), grid.axes
    forward, inverse = (lambda a, _: np.fft.fft(a, axis=1)), (lambda a, _: np.fft.ifft(a, axis=1))
    waves = {a: wave_numbers(grid, a) ** 2 for a in grid.axes}

    def shape(a: np.ndarray, index: dict[str, np.ndarray]) -> np.ndarray:
        return np.fft.ifft(np.fft.fft(a, axis=1) * response(sum(waves[b][i] for b, i in index.items())), axis=1)

    for axis in first:
        rows = _lines(rows, grid, axis, forward, batch, block)
    rows = _lines(rows, grid, last, shape, batch, block)
    for axis in reversed(first):
        rows = _lines(rows, grid, axis, inverse, batch, block)
    return rows.where("_given").select(*batch, *grid.keys, F.col("_re").alias(value))


def normal_draws(linear: np.ndarray, seed: int) -> np.ndarray:
    """Complex normal numbers that depend on a cell's number and the seed alone, by Box and Muller."""

    def uniform(k: int) -> np.ndarray:
        x = (linear.astype(np.uint64) * np.uint64(2) + np.uint64(k)) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the splitmix64 finaliser
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53

    return np.sqrt(-2 * np.log1p(-uniform(0))) * np.exp(2j * np.pi * uniform(1))


def noise_spectrum(index: dict[str, np.ndarray], grid: Grid, scale: float, smoothness: float, seed: int) -> np.ndarray:
    """Spectrum of the noise at cells: normal draws under a power law, nothing below a least wave number."""
    most = max(grid.resolution.values())
    linear, k2 = np.uint64(0), 0.0
    for a, n in grid.resolution.items():
        linear = linear * np.uint64(n) + index[a].astype(np.uint64)
        k2 = k2 + (np.fft.fftfreq(n)[index[a]] * n * scale / most) ** 2
    keep = k2 >= 0.1 * (scale / most) ** 2
    return normal_draws(linear, seed) * np.where(keep, np.where(keep, k2, 1.0) ** -smoothness, 0.0)


def noise(df: DataFrame, grid: Grid, scale: float, smoothness: float, seed: int, out: str, block: int | None = None) -> DataFrame:
    """``solve.noise`` by lines; the numbers are the same."""
    rows, (first, *rest) = _start(df, grid, F.lit(0.0), ()), grid.axes

    def begin(a: np.ndarray, index: dict[str, np.ndarray]) -> np.ndarray:
        return np.fft.ifft(np.broadcast_to(noise_spectrum(index, grid, scale, smoothness, seed), a.shape), axis=1)

    rows = _lines(rows, grid, first, begin, (), block)
    for axis in rest:
        rows = _lines(rows, grid, axis, lambda a, _: np.fft.ifft(a, axis=1), (), block)
    rows = rows.where("_given").select(*grid.keys, F.col("_re").alias(out))
    size = F.broadcast(rows.agg(F.avg(out).alias("_m"), F.stddev_pop(out).alias("_d")))  # one row
    unit = F.col("_d").isNull() | (F.col("_d") == 0)
    return rows.crossJoin(size).withColumn(out, (F.col(out) - F.col("_m")) / F.when(unit, 1.0).otherwise(F.col("_d"))).drop("_m", "_d")
