"""Scenes: runs stored as partitioned Parquet, with JSON properties, and scalar logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scene:
    """A folder of fields by name and frame: ``fields/field=<name>/frame=<n>``, and ``properties.json``.

    All access goes through Hadoop's file system, so a scene may be in any store Spark reads.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files ---

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, parent: str, name: str = "sim") -> Scene:
        """A new scene with the next free number."""
        used = [s for s in cls.list(spark, parent, name)]
        last = max((int(s.path.rsplit("_", 1)[1]) for s in used), default=-1)
        scene = cls(spark, f"{parent.rstrip('/')}/{name}_{last + 1:06d}")
        scene._fs().mkdirs(scene._path())
        return scene

    @classmethod
    def list(cls, spark: SparkSession, parent: str, name: str = "sim") -> list[Scene]:
        top = cls(spark, parent)
        fs = top._fs()
        if not fs.exists(top._path()):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(top._path()) if s.isDirectory())
        return [cls(spark, f"{top.path}/{n}") for n in names if n.startswith(f"{name}_") and n[len(name) + 1 :].isdigit()]

    @classmethod
    def at(cls, spark: SparkSession, parent: str, number: int, name: str = "sim") -> Scene:
        """By number; a negative one counts from the end."""
        scenes = cls.list(spark, parent, name)
        found = scenes[number : number + 1 or None] if number < 0 else [s for s in scenes if int(s.path.rsplit("_", 1)[1]) == number]
        if not found:
            raise FileNotFoundError(f"no scene {number} in {parent}")
        return found[0]

    def exists(self) -> bool:
        return bool(self._fs().exists(self._path()))

    def remove(self) -> None:
        self._fs().delete(self._path(), True)

    def rename(self, path: str) -> Scene:
        other = Scene(self.spark, path)
        self._fs().rename(self._path(), other._path())
        return other

    # --- properties ---

    @property
    def properties(self) -> dict:
        if not self._fs().exists(self._path("properties.json")):
            return {}
        rows = self.spark.read.text(f"{self.path}/properties.json", wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else {}

    def put_properties(self, **values) -> None:
        """Adds or replaces properties; numpy scalars become plain numbers."""
        plain = {k: v.item() if hasattr(v, "item") else v for k, v in values.items()}
        text = json.dumps({**self.properties, **plain}, indent=2, sort_keys=True)
        out = self._fs().create(self._path("properties.json"), True)
        out.write(bytearray(text.encode()))
        out.close()

    # --- text, logs and sources ---

    def subpath(self, name: str, create: bool = False) -> str:
        """The path of a file or folder in the scene; with ``create``, the folder is made."""
        if create:
            self._fs().mkdirs(self._path(name))
        return f"{self.path}/{name}"

    def _write_text(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def log(self, *lines: str, name: str = "info") -> None:
        """Lines appended to a log: each call is a file of its own, so calls from anywhere do not meet."""
        import time

        self._write_text("".join(f"{x}\n" for x in lines), "log", name, f"{time.time_ns():020d}.txt")

    def log_lines(self, name: str = "info") -> DataFrame:
        """(file, value) of a log's lines."""
        return self.spark.read.text(self.subpath(f"log/{name}")).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")

    def scalar_curve_names(self) -> list[str]:
        """Names of the scalar logs (files or folders log_<name>.txt)."""
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path())] if self.exists() else []
        return sorted(n[4:-4] for n in found if n.startswith("log_") and n.endswith(".txt"))

    def copy_src_text(self, name: str, text: str) -> None:
        """A program's text beside the data it made."""
        self._write_text(text, "src", name)

    def copy_src(self, script: str) -> None:
        """A copy of a local script."""
        with open(script, encoding="utf-8") as f:
            self.copy_src_text(script.rsplit("/", 1)[-1], f.read())

    def copy_calling_script(self) -> None:
        """A copy of the script that calls this method, if it is a file."""
        import inspect
        import os

        caller = inspect.stack()[1].filename
        if os.path.isfile(caller):
            self.copy_src(caller)

    # --- fields ---

    def write(self, name: str, frame: int, df: DataFrame) -> None:
        """Replaces one field at one frame; others stay."""
        df.write.mode("overwrite").parquet(f"{self.path}/fields/field={name}/frame={int(frame)}")

    def read(self, name: str, frame: int) -> DataFrame:
        """One field at one frame, read from its folder alone."""
        return self.spark.read.parquet(f"{self.path}/fields/field={name}/frame={int(frame)}")

    def catalog(self) -> DataFrame:
        """(field, frame) of everything stored, from the folder names."""
        fs, rows = self._fs(), []
        if fs.exists(self._path("fields")):
            for f in fs.listStatus(self._path("fields")):
                for g in fs.listStatus(f.getPath()):
                    rows.append((f.getPath().getName().split("=", 1)[1], int(g.getPath().getName().split("=", 1)[1])))
        return self.spark.createDataFrame(rows, "field string, frame int")


def frames(catalog: DataFrame) -> DataFrame:
    return catalog.select("frame").distinct()


def complete_frames(catalog: DataFrame, fields: int | None = None) -> DataFrame:
    """Frames for which every field exists."""
    count = catalog.select(F.countDistinct("field").alias("_all")) if fields is None else None
    per = catalog.groupBy("frame").agg(F.countDistinct("field").alias("_n"))
    if count is not None:
        return per.join(F.broadcast(count), F.col("_n") == F.col("_all")).select("frame")  # one row
    return per.where(F.col("_n") == fields).select("frame")


def merge_properties(spark: SparkSession, scenes: list[Scene]) -> dict:
    """Equal values once, different ones as a list; a key must be in all scenes."""
    all_ = [s.properties for s in scenes]
    keys = {k for p in all_ for k in p}
    missing = [k for k in keys if any(k not in p for p in all_)]
    if missing:
        raise KeyError(f"properties {sorted(missing)} are not in all scenes")
    return {k: all_[0][k] if all(p[k] == all_[0][k] for p in all_) else [p[k] for p in all_] for k in keys}


def write_scalars(df: DataFrame, path: str) -> None:
    """Lines ``frame value...`` of columns frame and the rest, appended."""
    cols = [F.col(c).cast("string") for c in ("frame", *[c for c in df.columns if c != "frame"])]
    df.select(F.concat_ws(" ", *cols).alias("value")).write.mode("append").text(path)


def read_scalars(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(frame, names...) from such lines."""
    parts = F.split(F.trim("value"), r"\s+")
    cols = [F.get(parts, F.lit(k + 1)).cast("double").alias(n) for k, n in enumerate(names)]
    return spark.read.text(path).select(F.get(parts, F.lit(0)).cast("int").alias("frame"), *cols)


def cumulative_time(df: DataFrame, step_time: str, order: str = "frame", batch: tuple[str, ...] = ()) -> DataFrame:
    """The running sum of step times as ``time``, by ranges of the order."""
    from ..operators.aggregate import running_total

    return running_total(df, [F.col(order)], F.col(step_time), "time", batch)
