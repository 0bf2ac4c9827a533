"""Registered queries read whole tables: against brute force on small ones."""

import random

import duckdb
import numpy as np
import pytest

from quadrille.operators import aggregate
from quadrille.plans.grids import QUERIES as GRIDS
from quadrille.plans.shapes import ORACLE_SQL
from quadrille.plans.shapes import QUERIES as SHAPES


def test_projection_reads_every_part(spark, tmp_path):
    rng = random.Random(11)
    parts = [(k, rng.randint(1, 50), 900 + rng.randrange(1000) / 10) for k in range(900)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.axis, r.ix, r.iy): r.v for r in GRIDS["incompressible_projection"](spark, str(tmp_path)).collect()}

    cells = {}
    for _, size, price in parts:
        share = (price - 900) / 100
        cells.setdefault((size - 1, min(10, int(share * 11))), []).append(share)
    mean = {k: sum(v) / len(v) for k, v in cells.items()}
    faces = [("x", i, j) for i in range(1, 50) for j in range(11)] + [("y", i, j) for i in range(50) for j in range(1, 11)]
    below = lambda a, i, j: (i - 1, j) if a == "x" else (i, j - 1)
    v = np.array([(mean.get(below(*f), 0) + mean.get(f[1:], 0)) / 2 for f in faces])
    divergence = np.zeros((550, len(faces)))
    for k, f in enumerate(faces):
        (i, j), (m, n) = f[1:], below(*f)
        divergence[i * 11 + j, k], divergence[m * 11 + n, k] = -1, 1
    # the nearest field without divergence
    want = v - np.linalg.pinv(divergence) @ (divergence @ v)
    assert set(got) == set(faces)
    assert np.array([got[f] for f in faces]) == pytest.approx(want, abs=2e-6)


def test_histogram_keeps_rows_beyond_its_bounds(spark, tmp_path):
    values = [0.0, 24.9, 25.0, 499.0, 500.0, 500.1, 9e9, -0.5, float("nan"), None]
    spark.createDataFrame([(v,) for v in values], "value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.bin: r.weight for r in SHAPES["histogram_values"](spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(range(20), 0.0), 0: 2.0, 1: 1.0, 19: 2.0, 20: 2.0, -1: 1.0, None: 2.0}
    df = spark.createDataFrame([(1.0, 2), (7.0, 3), (3.0, 4)], "value double, w int")
    got = {r.bin: r.weight for r in aggregate.histogram(df, "value", 0.0, 4.0, 2, "w").collect()}
    assert got == {0: 2.0, 1: 4.0, 2: 3.0}


def test_histogram_differs_from_its_sql_by_the_rows_that_it_leaves_out(spark, tmp_path):
    edges = [x for k in range(21) for x in (25.0 * k, np.nextafter(25.0 * k, -1e9), np.nextafter(25.0 * k, 1e9))]
    odd = [-0.0, 5e-324, -5e-324, 560.21, 1e308, float("inf"), float("-inf"), float("nan"), None]
    values = [v if v is None else float(v) for v in edges + odd + list(np.random.default_rng(11).exponential(60, 500).round(2))]
    spark.createDataFrame([(v,) for v in values], "value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.bin: r.weight for r in SHAPES["histogram_values"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {k: w for k, w in got.items() if k in range(20)} == dict(c.execute(ORACLE_SQL["histogram_values"]).fetchall())
    below, above = (sum(v is not None and f(v) for v in values) for f in (lambda v: v < 0, lambda v: v > 500))
    assert (got[-1], got[20], got[None]) == (below, above, 2) and sum(got.values()) == len(values)
