"""Compressed array files of fields, as a Spark data source (``spark.read.format("field_npz")``).

One file holds one lattice: ``data`` with one dimension an axis, ``axes``,
``lower``, ``upper`` and ``boundary``.  Reading gives one partition a file.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..meta import Boundary, Grid


def encode(data: np.ndarray, grid: Grid) -> bytes:
    """The bytes of a file."""
    sides = {a: [[b.kind, b.value] for b in pair] for a, pair in grid.boundary.items()}
    out = io.BytesIO()
    np.savez_compressed(
        out, data=data, axes=np.array(grid.axes), lower=np.array([grid.lower[a] for a in grid.axes]),
        upper=np.array([grid.upper[a] for a in grid.axes]), boundary=np.array(json.dumps(sides)),
    )
    return out.getvalue()


def decode(raw: bytes) -> tuple[np.ndarray, Grid]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        data, axes = f["data"], [str(a) for a in f["axes"]]
        sides = json.loads(str(f["boundary"]))
        rules = {a: tuple(Boundary(k, v) for k, v in sides[a]) for a in axes}
        grid = Grid.of(rules, dict(zip(axes, f["lower"], strict=True)), dict(zip(axes, f["upper"], strict=True)), **dict(zip(axes, data.shape, strict=True)))
    return data, grid


def rows(raw: bytes, name: str, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(file, ix, iy, iz, v); indices of axes that a file lacks are null."""
    data, grid = decode(raw)
    flat = data.astype(float).ravel()
    for k in range(0, len(flat), size):
        index = np.unravel_index(np.arange(k, min(len(flat), k + size)), data.shape)
        at = dict(zip(grid.axes, index, strict=True))
        n = len(index[0])
        columns = [pa.array([name] * n)]
        columns += [pa.array(at[a].astype(np.int32)) if a in at else pa.nulls(n, pa.int32()) for a in "xyz"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(flat[k : k + n])], ["file", "ix", "iy", "iz", "v"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path or pattern, through Spark's own file access, so any store works."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(raw, name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ix int, iy int, iz int, v double")


def write(df: DataFrame, grid: Grid, folder: str, name: str = "field", value: str = "v", batch: str | None = None) -> DataFrame:
    """One file a batch slice, as rows (path, bytes written); a slice is one worker's array."""
    from ..operators.solve import KERNEL_CELLS

    if grid.size > KERNEL_CELLS:
        raise ValueError(f"{grid.size} cells do not fit one file's worker; store the field as Parquet")
    keys, shape = grid.keys, tuple(grid.resolution.values())

    def run(key, frame):
        import pandas as pd
        from pyarrow import fs

        a = np.zeros(shape)
        a[tuple(frame[k].to_numpy() for k in keys)] = frame["v"].to_numpy()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        raw = encode(a, grid)
        path = f"{root}/{name}_{key[0]}.npz"
        with store.open_output_stream(f"{path}.tmp") as out:
            out.write(raw)
        store.move(f"{path}.tmp", path)
        return pd.DataFrame({"path": [path], "bytes": [len(raw)]})

    part = F.col(batch).cast("string") if batch else F.lit("0")
    fields = df.select(part.alias("slice"), *keys, F.col(value).cast("double").alias("v"))
    return fields.groupBy("slice").applyInPandas(run, "path string, bytes long")


class FieldNpz(DataSource):
    """``spark.read.format("field_npz").load(path)`` of a local or mounted folder or file."""

    @classmethod
    def name(cls) -> str:
        return "field_npz"

    def schema(self) -> str:
        return "file string, ix int, iy int, iz int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".npz")]
        else:
            found = [root]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), None)
        with store.open_input_file(partition.value) as f:
            yield from rows(f.read(), partition.value)
