"""Loops over steps of a simulation that record fields and scalars in a scene."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import count
from statistics import fmean

from pyspark.sql import DataFrame

from .scene import Scene, write_scalars


class Steps:
    """Counts steps; what is recorded goes to a scene, one folder a field and step, one log a scalar."""

    def __init__(self, scene: Scene):
        self.scene = scene
        self.steps = 0
        self.seconds = 0.0

    def range(self, stop: int | None = None, warmup: int = 0, record: Callable[[], dict[str, DataFrame]] | None = None) -> Iterator[int]:
        """Step numbers, after ``warmup`` rounds that are not counted; without ``stop``, no end.

        ``record`` gives fields by name: they are written before the first step
        and after each, as frames of the scene.
        """
        for _ in range(warmup):
            yield self.steps
        self._write(record)
        for _ in count() if stop is None else range(stop):
            start = time.perf_counter()
            yield self.steps
            self.seconds += time.perf_counter() - start
            self.steps += 1
            self._write(record)

    def _write(self, record) -> None:
        for name, df in (record() if record else {}).items():
            self.scene.write(name, self.steps, df)

    def log_scalars(self, reduce: Callable = fmean, **values: float | list[float]) -> None:
        """Appends numbers (of several, their reduction) to the scene's scalar logs, at the step."""
        spark = self.scene.spark
        for name, v in values.items():
            number = float(reduce(v)) if isinstance(v, (list, tuple)) else float(v)
            row = spark.createDataFrame([(self.steps, number)], "frame int, value double")
            write_scalars(row.coalesce(1), self.scene.subpath(f"log_{name}.txt"))


def benchmark(step: Callable[[], DataFrame], times: int) -> float:
    """Seconds that ``times`` runs take, each of which computes every row."""
    start = time.perf_counter()
    for _ in range(times):
        step().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start
