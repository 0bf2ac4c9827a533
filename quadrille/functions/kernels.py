"""Smoothing kernels of particle methods, as Column expressions of a distance."""

from __future__ import annotations

from math import gamma, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import lit


def ball_volume(rank: int, radius: float = 1.0) -> float:
    return pi ** (rank / 2) / gamma(rank / 2 + 1) * radius**rank


#: Fixed normalisation factors by number of dimensions, for a support radius of 1.
QUINTIC = {1: 3 / 120, 2: 9 * 7 / (478 * pi), 3: 27 / (120 * pi)}
WENDLAND = {1: 5 / 4, 2: 7 / pi, 3: 21 / (2 * pi)}


def kernel(distance: Column, h, rank: int, kind: str = "poly6") -> dict[str, Column]:
    """Value (``kernel``) and derivative by the distance (``grad``) of a kernel with support radius ``h``; 0 beyond it.

    Kinds: ``poly6``, ``wendland-c2``, ``quintic-spline``.
    """
    h = lit(h)
    q = distance / h
    inside = q < 1
    if kind == "poly6":
        norm = ((rank + 2) * (rank + 4) * (rank + 6)) / (48 * ball_volume(rank))
        value, slope = (1 - q**2) ** 3, -6 * q * (1 - q**2) ** 2
    elif kind == "wendland-c2":
        norm = WENDLAND[rank]
        if rank == 1:
            value, slope = (1 - q) ** 3 * (1 + 3 * q), -12 * q * (1 - q) ** 2
        else:
            value, slope = (1 - q) ** 4 * (1 + 4 * q), -20 * q * (1 - q) ** 3
    elif kind == "quintic-spline":
        norm = QUINTIC[rank]
        u = q * 3
        value = slope = F.lit(0.0)
        for edge, weight in ((3.0, 1.0), (2.0, -6.0), (1.0, 15.0)):
            part = F.when(u < edge, F.lit(edge) - u).otherwise(0.0)
            value, slope = value + weight * part**5, slope - 15 * weight * part**4
    else:
        raise ValueError(f"no kernel {kind!r}")
    return {
        "kernel": F.when(inside, value * norm / h**rank).otherwise(0.0),
        "grad": F.when(inside, slope * norm / h ** (rank + 1)).otherwise(0.0),
    }


def support_radius(volume: Column, neighbours: float, rank: int) -> Column:
    """Radius of the ball that holds ``neighbours`` elements of a volume."""
    return F.pow(lit(volume) * neighbours / ball_volume(rank), F.lit(1 / rank))


def expected_neighbours(volume: Column, radius, rank: int) -> Column:
    return lit(radius) ** rank * ball_volume(rank) / lit(volume)
