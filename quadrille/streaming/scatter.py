"""Fields from streams: points are scattered to a lattice in windows of event time.

The state is one row a cell and window; a watermark ends windows and drops
their state, so it does not grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import Grid
from ..operators.lattice import cell_of


def scatter_stream(
    stream: DataFrame, grid: Grid, time: str, value: str = "v", window: str = "1 day", late: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """(start, indices, v, n): mean and count of the points in each cell and window; points outside the box are left out.

    Works on a streaming or a static frame with columns x, y, z.
    """
    cells = cell_of(grid, False, **{a: F.col(a) for a in grid.axes})
    rows = stream.select(time, value, *[c.alias(k) for k, c in cells.items()])
    for k, n in zip(grid.keys, grid.resolution.values(), strict=True):
        rows = rows.where((F.col(k) >= 0) & (F.col(k) < n))
    span = F.window(time, window, slide) if slide else F.window(time, window)
    if stream.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(span.alias("w"), *grid.keys).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *grid.keys, value, "n")


def smooth_stream(stream: DataFrame, time: str, value: str, window: str, slide: str, late: str = "1 hour") -> DataFrame:
    """(start, mean): a moving average of a curve over sliding windows."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, window, slide).alias("w")).agg(F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "mean")
