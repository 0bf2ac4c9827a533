"""Fields: a DataFrame of lattice or element values with its metadata, and arithmetic on both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.vector import divide
from .meta import Grid
from .operators import aggregate, resample, stencil
from .operators.lattice import centers, lattice


@dataclass(frozen=True)
class Field:
    """Values of a lattice: rows of cell indices (and batch columns) and a value column.

    Fields are immutable; every method gives a new one and runs no job.
    """

    df: DataFrame
    grid: Grid
    value: str = "v"
    batch: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [*self.batch, *self.grid.keys]

    # --- what it is ---

    @property
    def is_staggered(self) -> bool:
        """Whether the rows are faces (they have a column axis)."""
        return "axis" in self.df.columns

    @property
    def is_centered(self) -> bool:
        return not self.is_staggered

    #: Other kinds of data are DataFrames of their own: point clouds, graphs and meshes are no fields of a lattice.
    is_grid, is_mesh, is_graph, is_point_cloud = True, False, False, False

    @property
    def sampled_at(self) -> str:
        return "face" if self.is_staggered else "center"

    @property
    def boundary(self) -> dict:
        return self.grid.boundary

    extrapolation = boundary

    @property
    def boundary_names(self) -> list[str]:
        return self.grid.boundary_names

    @property
    def resolution(self) -> dict[str, int]:
        return self.grid.resolution

    @property
    def spatial_rank(self) -> int:
        return self.grid.rank

    @property
    def cells(self) -> DataFrame:
        """One row a cell with its corners."""
        rows = lattice(self.df.sparkSession, self.grid)
        g = self.grid
        low = {f"lower_{a}": F.lit(g.lower[a]) + F.col(f"i{a}") * F.lit(g.dx[a]) for a in g.axes}
        return rows.withColumns({**low, **{f"upper_{a}": low[f"lower_{a}"] + F.lit(g.dx[a]) for a in g.axes}})

    def sampled_elements(self) -> DataFrame:
        """Where the values are: indices (and axis) with positions."""
        from .operators.fluid import face_centers

        spot = face_centers(self.grid) if self.is_staggered else centers(self.grid)
        keys = ["axis", *self.grid.keys] if self.is_staggered else self.grid.keys
        return self.df.select(*self.batch, *keys, *[c.alias(a) for a, c in spot.items()])

    def points(self) -> DataFrame:
        return self.sampled_elements()

    # --- making and changing ---

    @classmethod
    def make(cls, spark, grid: Grid, value=0.0) -> Field:
        """From a number, a Column, or a function of x, y, z."""
        return cls(lattice(spark, grid, v=value), grid)

    def with_values(self, column: Column) -> Field:
        return replace(self, df=self.df.select(*self.keys, column.alias(self.value)))

    def with_boundary(self, boundary) -> Field:
        return replace(self, grid=self.grid.with_boundary(boundary))

    def with_bounds(self, lower: dict[str, float], upper: dict[str, float]) -> Field:
        return replace(self, grid=self.grid.with_bounds(lower, upper))

    def shifted(self, **delta: float) -> Field:
        return replace(self, grid=self.grid.shifted(**delta))

    def rename(self, value: str) -> Field:
        return Field(self.df.select(*self.keys, F.col(self.value).alias(value)), self.grid, value, self.batch)

    def at_index(self, **index: int) -> Field:
        """A slice at one index of some axes, which it then lacks."""
        rows = self.df
        for a, i in index.items():
            rows = rows.where(F.col(f"i{a}") == (i if i >= 0 else self.grid.resolution[a] + i))
        rest = [a for a in self.grid.axes if a not in index]
        pick = lambda d: {a: d[a] for a in rest}
        g = self.grid
        grid = Grid(pick(g.resolution), pick(g.lower), pick(g.upper), pick(g.boundary))
        return Field(rows.select(*self.batch, *grid.keys, self.value), grid, self.value, self.batch)

    def window(self, **ranges: tuple[int, int]) -> Field:
        """The cells with indices ``[first, last)``, counted from 0 again."""
        rows, grid, dx = self.df, self.grid, self.grid.dx
        for a, (i, j) in ranges.items():
            k = F.col(f"i{a}")
            rows = rows.where((k >= i) & (k < j)).withColumn(f"i{a}", (k - i).cast("int"))
            grid = replace(
                grid, resolution={**grid.resolution, a: j - i},
                lower={**grid.lower, a: grid.lower[a] + i * dx[a]}, upper={**grid.upper, a: grid.lower[a] + j * dx[a]},
            )
        return replace(self, df=rows, grid=grid)

    def where_dim(self, **values) -> Field:
        """The slice at one value of some batch columns, which it then lacks."""
        rows = self.df
        for dim, v in values.items():
            rows = rows.where(F.col(dim) == v)
        batch = tuple(b for b in self.batch if b not in values)
        return Field(rows.select(*batch, *self.grid.keys, self.value), self.grid, self.value, batch)

    def expanded(self, dim: str, names: list) -> Field:
        """The same values for each of some names of a new batch column."""
        rows = self.df.withColumn(dim, F.explode(F.array(*[F.lit(n) for n in names])))
        return Field(rows.select(dim, *self.keys, self.value), self.grid, self.value, (dim, *self.batch))

    def renamed_dims(self, **names: str) -> Field:
        """Batch columns and axes renamed."""
        new = lambda k: names.get(k, k)
        g, batch = self.grid, tuple(map(new, self.batch))
        side = lambda d: {new(a): v for a, v in d.items()}
        grid = Grid(side(g.resolution), side(g.lower), side(g.upper), side(g.boundary))
        cols = [F.col(b).alias(new(b)) for b in self.batch] + [F.col(f"i{a}").alias(f"i{new(a)}") for a in g.axes]
        return Field(self.df.select(*cols, self.value), grid, self.value, batch)

    def packed(self, dims: tuple[str, ...], into: str) -> Field:
        """Some batch columns as one, a struct of them."""
        rest = tuple(b for b in self.batch if b not in dims)
        packed = F.struct(*dims).alias(into)
        return Field(self.df.select(packed, *rest, *self.grid.keys, self.value), self.grid, self.value, (into, *rest))

    def stored(self) -> Field:
        """Without cells that have no value or 0, as a sparse field stores them."""
        return replace(self, df=self.df.where(F.col(self.value).isNotNull() & (F.col(self.value) != 0)))

    def as_points(self) -> DataFrame:
        return self.df.withColumns(centers(self.grid)).select(*self.batch, *self.grid.axes, self.value)

    def at(self, grid: Grid) -> Field:
        """Resampled to another lattice."""
        if self.grid.same_lattice(grid):
            return self
        return Field(resample.to_grid(self.df, self.grid, grid, [self.value]).select(*grid.keys, self.value), grid, self.value)

    # --- arithmetic ---

    def map(self, f: Callable[[Column], Column], on_boundary: Callable[[float], float] | None = None) -> Field:
        """A function of the value; the boundary's constants change by ``on_boundary``, if given."""
        grid = self.grid.map_boundary(lambda b: b.map(on_boundary)) if on_boundary else self.grid
        return replace(self.with_values(f(F.col(self.value))), grid=grid)

    def combine(self, other: Field | float, f: Callable[[Column, Column], Column]) -> Field:
        """A function of both values; the other field is resampled to this one's lattice.

        Fields of the same rows combine without a join.
        """
        if not isinstance(other, Field):
            return self.with_values(f(F.col(self.value), F.lit(float(other))))
        other = other.at(self.grid)
        right = other.df.select(*self.keys, F.col(other.value).alias("_other"))
        both = self.df.select(*self.keys, self.value).join(right, self.keys)
        return replace(self, df=both.select(*self.keys, f(F.col(self.value), F.col("_other")).alias(self.value)))

    def __add__(self, other):
        return self.combine(other, lambda a, b: a + b)

    __radd__ = __add__

    def __mul__(self, other):
        return self.combine(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __sub__(self, other):
        return self.combine(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self.combine(other, lambda a, b: b - a)

    def __truediv__(self, other):
        """Quotient; null where the divisor is 0."""
        return self.combine(other, lambda a, b: F.when(b != 0, a / b))

    def __rtruediv__(self, other):
        return self.combine(other, lambda a, b: F.when(a != 0, b / a))

    def __pow__(self, power):
        return self.combine(power, F.pow)

    def __neg__(self):
        return self.map(lambda c: -c, lambda x: -x)

    def __abs__(self):
        return self.map(F.abs, abs)

    def __gt__(self, other):
        return self.combine(other, lambda a, b: (a > b).cast("double"))

    def __ge__(self, other):
        return self.combine(other, lambda a, b: (a >= b).cast("double"))

    def __lt__(self, other):
        return self.combine(other, lambda a, b: (a < b).cast("double"))

    def __le__(self, other):
        return self.combine(other, lambda a, b: (a <= b).cast("double"))

    def safe_divide(self, other):
        return self.combine(other, divide)

    # --- operators ---

    def laplace(self, **options) -> Field:
        out = stencil.laplace(self.df, self.grid, self.value, "_l", batch=self.batch, **options)
        return Field(out.select(*self.keys, F.col("_l").alias(self.value)), self.grid.map_boundary(lambda b: b.gradient()), self.value, self.batch)

    def gradient(self, **options) -> dict[str, Field]:
        out = stencil.gradient(self.df, self.grid, self.value, batch=self.batch, **options)
        grid = self.grid.map_boundary(lambda b: b.gradient())
        return {a: Field(out.select(*self.keys, F.col(f"d{a}").alias(self.value)), grid, self.value, self.batch) for a in options.get("axes") or self.grid.axes}

    def pad(self, **widths: int) -> Field:
        return replace(self, df=stencil.pad(self.df, self.grid, widths, self.value, self.batch), grid=self.grid.padded(**widths))

    def downsample2x(self) -> Field:
        df, grid = stencil.downsample2x(self.df, self.grid, self.value, self.batch)
        return replace(self, df=df, grid=grid)

    def downsample(self, factor: int) -> Field:
        out = self
        while factor > 1:
            out, factor = out.downsample2x(), factor // 2
        return out

    def upsample2x(self) -> Field:
        df, grid = stencil.upsample2x(self.df, self.grid, self.value, self.batch)
        return replace(self, df=df, grid=grid)

    def mean(self) -> DataFrame:
        return aggregate.mean(self.df, self.value, batch=self.batch)

    def support(self) -> DataFrame:
        return self.as_points().where(F.col(self.value) != 0)

    def mask(self) -> Field:
        return self.map(lambda c: (c != 0).cast("double"))

    def close_to(self, other: Field, relative: float = 1e-5, absolute: float = 0.0) -> bool:
        """Whether all values agree within the tolerances; runs a job."""
        bad = self.combine(other, lambda a, b: (F.abs(a - b) > absolute + relative * F.abs(b)).cast("double"))
        return not bad.df.where(F.col(self.value) > 0).limit(1).count()


def where(mask: Field, yes: Field, no: Field) -> Field:
    """``yes`` where the mask is not 0, else ``no``; on the lattice of ``yes``."""
    chosen = yes.combine(mask, lambda a, m: F.struct(a.alias("a"), (m != 0).alias("m")))
    return chosen.combine(no, lambda s, b: F.when(s["m"], s["a"]).otherwise(b))


def maximum(a: Field, b: Field | float) -> Field:
    """Null if a value is null."""
    return a.combine(b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)))


def minimum(a: Field, b: Field | float) -> Field:
    return a.combine(b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)))


def stack(fields: dict[str, Field], dim: str) -> Field:
    """Fields of one lattice as slices of a batch column."""
    first = next(iter(fields.values()))
    if any(not f.grid.same_lattice(first.grid) for f in fields.values()):
        raise ValueError("stacked fields need one lattice")
    out = None
    for name, f in fields.items():
        part = f.df.select(F.lit(name).alias(dim), *first.keys, F.col(f.value).alias(first.value))
        out = part if out is None else out.unionByName(part)
    return Field(out, first.grid, first.value, (dim, *first.batch))


def concat(fields: list[Field], axis: str) -> Field:
    """Fields end to end along an axis."""
    out, at = None, 0
    for f in fields:
        part = f.df.withColumn(f"i{axis}", (F.col(f"i{axis}") + at).cast("int"))
        out = part if out is None else out.unionByName(part)
        at += f.grid.resolution[axis]
    grid = fields[0].grid
    upper = grid.lower[axis] + at * grid.dx[axis]
    return replace(fields[0], df=out, grid=replace(grid, resolution={**grid.resolution, axis: at}, upper={**grid.upper, axis: upper}))
