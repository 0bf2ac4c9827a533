"""A factory of fields on one lattice, with boundaries by purpose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import Field
from .meta import Grid, accessible_boundary
from .operators.fluid import as_obstacle
from .operators.geometry import Geometry, Union
from .operators.lattice import centers, distribute_points, face_lattice, lattice
from .operators.stencil import stagger

#: Boundaries of scalars and vectors by the kind of wall.
WALLS = {"open": {"scalar": "edge", "vector": "edge"}, "closed": {"scalar": "edge", "vector": 0.0}, "periodic": {"scalar": "periodic", "vector": "periodic"}}


def combined_boundaries(rules: dict | str, axes: tuple[str, ...], purpose: str) -> dict:
    """Rules by axis of wall kinds: one for all, or by axis, or by axis a pair."""
    kind = lambda name: WALLS[name][purpose]
    given = rules if isinstance(rules, dict) else {a: rules for a in axes}
    return {a: tuple(map(kind, given[a])) if isinstance(given.get(a, "open"), tuple) else kind(given.get(a, "open")) for a in axes}


@dataclass(frozen=True)
class Domain:
    """A lattice's size and box, and the kind of wall of each side."""

    spark: SparkSession
    resolution: dict[str, int]
    walls: dict | str = "open"
    lower: dict[str, float] = field(default_factory=dict)
    upper: dict[str, float] = field(default_factory=dict)

    def lattice(self, purpose: str = "scalar") -> Grid:
        rules = combined_boundaries(self.walls, tuple(self.resolution), purpose)
        return Grid.of(rules, self.lower or None, self.upper or None, **self.resolution)

    def grid(self, value=0.0, staggered: bool = False) -> Field:
        return self.staggered_grid(value) if staggered else self.scalar_grid(value)

    def scalar_grid(self, value=0.0) -> Field:
        return Field.make(self.spark, self.lattice(), value)

    def vector_grid(self, **components) -> dict[str, Field]:
        """A field at cells for each axis."""
        grid = self.lattice("vector")
        return {a: Field.make(self.spark, grid, components.get(a, 0.0)) for a in grid.axes}

    def staggered_grid(self, value=0.0) -> Field:
        """``value`` is a number for all axes, or a dict by axis of what ``lattice`` takes."""
        grid = self.lattice("vector")
        parts = value if isinstance(value, dict) else {a: value for a in grid.axes}
        return Field(face_lattice(self.spark, grid, **parts), grid)

    def vector_potential(self, value=0.0) -> Field:
        """Values at the corners of a plane lattice."""
        grid = self.lattice()
        half = {a: d / 2 for a, d in grid.dx.items()}
        corners = grid.with_resolution(**{a: n + 1 for a, n in grid.resolution.items()}).with_bounds(
            {a: grid.lower[a] - half[a] for a in grid.axes}, {a: grid.upper[a] + half[a] for a in grid.axes}
        )
        return Field.make(self.spark, corners, value)

    def accessible_mask(self, not_accessible: Sequence = (), staggered: bool = False) -> Field:
        """1 outside of obstacles, at faces the smaller one of their cells."""
        grid = self.lattice("vector")
        shapes = tuple(as_obstacle(o).geometry for o in not_accessible)
        inside = Union(shapes).lies_inside(centers(grid)) if shapes else F.lit(False)
        cells = lattice(self.spark, grid).withColumn("v", F.when(inside, 0.0).otherwise(1.0))
        if not staggered:
            return Field(cells, grid)
        return Field(stagger(cells, grid.map_boundary(accessible_boundary), F.least, "v", boundary=grid), grid)

    def points(self, points: DataFrame, radius: float | None = None) -> DataFrame:
        """A point cloud: rows of coordinates, with a radius if one is given."""
        return points if radius is None else points.withColumn("radius", F.lit(float(radius)))

    def distribute_points(self, shapes: Sequence[Geometry], points_per_cell: int = 8, center: bool = False, seed: int = 0) -> DataFrame:
        grid = self.lattice()
        mask = Union(tuple(shapes)).lies_inside(centers(grid)).cast("double")
        return distribute_points(lattice(self.spark, grid).withColumn("m", mask), grid, "m", points_per_cell, center, seed)
