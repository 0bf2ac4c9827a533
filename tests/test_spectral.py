"""Transforms axis by axis against numpy's of the whole array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.meta import Grid
from quadrille.operators import lattice, physics, solve, spectral


def to_array(df, grid, value="v"):
    out = np.full(tuple(grid.resolution.values()), np.nan)
    for r in df.select(*grid.keys, value).collect():
        out[tuple(r[:-1])] = r[-1]
    return out


@pytest.mark.parametrize("sizes", [{"x": 13}, {"x": 9, "y": 14}, {"x": 5, "y": 6, "z": 7}])
def test_filters_by_lines_are_those_of_the_array(spark, sizes, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK_CELLS", 20)
    grid = Grid.of("periodic", **sizes)
    df = lattice.lattice(spark, grid).withColumn("v", F.pmod(F.hash(*grid.keys), F.lit(1000)) / 100.0)
    for f in (solve.fourier_laplace, solve.fourier_poisson, lambda d, g, **k: physics.diffuse_fourier(d, g, 0.3, 2.0, **k)):
        assert np.allclose(to_array(f(df, grid, distributed=True), grid), to_array(f(df, grid), grid))
    a, b = (to_array(solve.noise(df, grid, seed=5, distributed=d), grid) for d in (True, False))
    assert np.allclose(a, b) and abs(a.mean()) < 1e-9 and a.std() == pytest.approx(1)
    assert not np.allclose(b, to_array(solve.noise(df, grid, seed=6), grid))


def test_missing_cells_batches_and_blocks(spark):
    grid = Grid.of("periodic", x=6, y=8)
    cells = lattice.lattice(spark, grid).where("iy <> 3 and ix <> 2")
    df = cells.crossJoin(spark.createDataFrame([("a", 1.0), ("b", -2.0)], "part string, s double")).withColumn("v", F.col("s") * (F.col("ix") * 3 + F.col("iy") % 5))
    one = spectral.filtered(df, grid, np.exp, "v", ("part",), block=8).select("part", "ix", "iy", F.round("v", 6).alias("v"))
    two = solve.spectral_filter(df, grid, np.exp, "v", ("part",)).select("part", "ix", "iy", F.round("v", 6).alias("v"))
    assert one.count() == 2 * 35 and {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    assert spectral.filtered(df.limit(0), grid, np.exp, "v", ("part",)).count() == 0


def test_draws_are_normal():
    z = spectral.normal_draws(np.arange(200_000), 7)
    for part in (z.real, z.imag):
        assert abs(part.mean()) < 0.01 and part.std() == pytest.approx(1, abs=0.01)
    assert abs(np.corrcoef(z.real[1:], z.real[:-1])[0, 1]) < 0.01


def test_a_line_beyond_a_worker_is_refused(spark, monkeypatch):
    monkeypatch.setattr(spectral, "LINE_CELLS", 10)
    with pytest.raises(ValueError):
        solve.fourier_laplace(spark.range(1).select(F.lit(0).alias("ix"), F.lit(1.0).alias("v")), Grid.of("periodic", x=11), distributed=True)
