"""The registered queries and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import arrays, grids, more, shapes, sheets

_MODULES = (grids, arrays, shapes, more, sheets)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scattered to a lattice, then five steps of diffusion."""
    return QUERIES["diffuse_explicit_5"](spark, sf_dir)
