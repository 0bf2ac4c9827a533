"""Shapes as Column expressions: inside tests, signed distances, pushes, and set operations.

A position is a dict of Columns by axis.  Signed distances are positive
outside; the surface counts as inside.  No method runs a job.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from math import inf, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vector as vec
from ..functions.kernels import ball_volume

Position = dict[str, Column]


class Geometry:
    """A shape; subclasses give ``lies_inside`` and ``sdf``."""

    def lies_inside(self, p: Position) -> Column:
        return self.sdf(p) <= 0

    def sdf(self, p: Position) -> Column:
        raise NotImplementedError

    def fraction_inside(self, p: Position, radius: Column, balance: float = 0.5) -> Column:
        """How much of an element with a bounding radius is inside, from the distance of its center."""
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(balance) - self.sdf(p) / radius))

    def push(self, p: Position, separation: float = 0.0, step: float = 1e-4) -> Position:
        """Positions moved along the distance's gradient to at least ``separation`` from the surface."""
        d = self.sdf(p)
        slope = {a: (self.sdf({**p, a: x + step}) - self.sdf({**p, a: x - step})) / (2 * step) for a, x in p.items()}
        unit = vec.normalize(slope)
        return {a: F.when(d < separation, x + unit[a] * (separation - d)).otherwise(x) for a, x in p.items()}

    def bounds(self) -> tuple[dict[str, float], dict[str, float]]:
        raise NotImplementedError

    def rotated(self, angle: float) -> Geometry:
        """Turned about its center; round shapes stay."""
        return self

    def bounding_sphere(self) -> Sphere:
        """The ball around the bounding box."""
        low, high = self.bounds()
        middle = {a: (low[a] + high[a]) / 2 for a in low}
        return Sphere(middle, sum((high[a] - low[a]) ** 2 for a in low) ** 0.5 / 2)

    def shallow_equals(self, other: Geometry) -> bool:
        """Equality by what shapes are made of, without looking at points."""
        return type(self) is type(other) and self == other

    def unstack(self) -> tuple[Geometry, ...]:
        return getattr(self, "parts", (self,))

    def weighted_center(self) -> dict[str, float]:
        """Of several shapes, their centers weighted by volume."""
        parts = self.unstack()
        total = sum(g.volume for g in parts)
        return {a: sum(g.center[a] * g.volume for g in parts) / total for a in parts[0].center}

    def __or__(self, other: Geometry) -> Geometry:
        return Union((self, other))

    def __and__(self, other: Geometry) -> Geometry:
        return Intersection((self, other))

    def __invert__(self) -> Geometry:
        return Inverted(self)


@dataclass(frozen=True)
class Nothing(Geometry):
    """The empty set."""

    def sdf(self, p: Position) -> Column:
        return F.lit(inf)

    @property
    def volume(self) -> float:
        return 0.0


@dataclass(frozen=True)
class Point(Geometry):
    center: dict[str, float]
    volume = 0.0

    def sdf(self, p: Position) -> Column:
        return vec.length(vec.subtract(p, self.center))

    def bounds(self):
        return dict(self.center), dict(self.center)

    def shifted(self, **delta: float) -> Point:
        return Point({a: x + delta.get(a, 0.0) for a, x in self.center.items()})


@dataclass(frozen=True)
class Sphere(Geometry):
    """A ball in as many dimensions as its center has."""

    center: dict[str, float]
    radius: float

    @classmethod
    def of_volume(cls, center: dict[str, float], volume: float) -> Sphere:
        return cls(center, (volume / ball_volume(len(center))) ** (1 / len(center)))

    @property
    def volume(self) -> float:
        return ball_volume(len(self.center), self.radius)

    @property
    def surface_area(self) -> float:
        n = len(self.center)
        return n * ball_volume(n) * self.radius ** (n - 1)

    def sdf(self, p: Position) -> Column:
        return vec.length(vec.subtract({a: p[a] for a in self.center}, self.center)) - self.radius

    def push(self, p: Position, separation: float = 0.0, step: float = 0.0) -> Position:
        """Radially, to the given distance from the surface; the center itself goes along the first axis."""
        d = vec.subtract(p, self.center)
        n = vec.length(d)
        goal = self.radius + separation
        first = next(iter(p))
        unit = {a: F.when(n > 0, d[a] / n).otherwise(1.0 if a == first else 0.0) for a in p}
        return {a: F.when(n < goal, F.lit(self.center[a]) + unit[a] * goal).otherwise(x) for a, x in p.items()}

    def bounds(self):
        return {a: x - self.radius for a, x in self.center.items()}, {a: x + self.radius for a, x in self.center.items()}

    def shifted(self, **delta: float) -> Sphere:
        return replace(self, center={a: x + delta.get(a, 0.0) for a, x in self.center.items()})

    def scaled(self, factor: float) -> Sphere:
        return replace(self, radius=self.radius * factor)


@dataclass(frozen=True)
class Box(Geometry):
    """An axis-aligned box, turned about its center by ``angle`` in the plane; sides may be infinite."""

    lower: dict[str, float]
    upper: dict[str, float]
    angle: float = 0.0

    @classmethod
    def around(cls, center: dict[str, float], half: dict[str, float], angle: float = 0.0) -> Box:
        return cls({a: x - half[a] for a, x in center.items()}, {a: x + half[a] for a, x in center.items()}, angle)

    @property
    def size(self) -> dict[str, float]:
        return {a: self.upper[a] - x for a, x in self.lower.items()}

    @property
    def center(self) -> dict[str, float]:
        return {a: (x + self.upper[a]) / 2 for a, x in self.lower.items()}

    @property
    def volume(self) -> float:
        return prod(self.size.values())

    def _local(self, p: Position) -> Position:
        p = {a: p[a] for a in self.lower}
        if not self.angle:
            return p
        turned = vec.rotate2(vec.subtract(p, self.center), self.angle, invert=True)
        return vec.add(turned, self.center)

    def _sides(self, p: Position) -> list[Column]:
        q = self._local(p)
        return [F.greatest(F.lit(self.lower[a]) - q[a], q[a] - F.lit(self.upper[a])) for a in self.lower]

    def lies_inside(self, p: Position) -> Column:
        return reduce(lambda a, b: a & b, [s <= 0 for s in self._sides(p)])

    def sdf(self, p: Position) -> Column:
        """The largest distance along an axis: exact inside and beside faces, too small beyond corners."""
        sides = self._sides(p)
        return F.greatest(*sides) if len(sides) > 1 else sides[0]

    def exact_sdf(self, p: Position) -> Column:
        sides = self._sides(p)
        outside = F.sqrt(reduce(lambda a, b: a + b, [F.greatest(s, F.lit(0.0)) ** 2 for s in sides]))
        return F.when(self.sdf(p) > 0, outside).otherwise(self.sdf(p))

    def push(self, p: Position, separation: float = 0.0, step: float = 0.0) -> Position:
        """Through the nearest side, the first of equals; for boxes that are not turned."""
        d, centre = self.sdf(p), self.center
        out, done = {}, F.lit(False)
        for a, side in zip(self.lower, self._sides(p), strict=True):
            nearest = (side == d) & ~done & (d < separation)
            goal = F.when(p[a] > centre[a], F.lit(self.upper[a] + separation)).otherwise(self.lower[a] - separation)
            out[a] = F.when(nearest, goal).otherwise(p[a])
            done = done | (side == d)
        return {a: out.get(a, x) for a, x in p.items()}

    def bounds(self):
        if not self.angle:
            return dict(self.lower), dict(self.upper)
        from math import cos, sin

        c, s = abs(cos(self.angle)), abs(sin(self.angle))
        hx, hy = self.size["x"] / 2, self.size["y"] / 2
        half = {"x": c * hx + s * hy, "y": s * hx + c * hy}
        return {a: x - half[a] for a, x in self.center.items()}, {a: x + half[a] for a, x in self.center.items()}

    def contains(self, other: Box) -> bool:
        return all(self.lower[a] <= other.lower[a] and other.upper[a] <= self.upper[a] for a in self.lower)

    def to_local(self, p: Position, scale: bool = True) -> Position:
        """Coordinates from the lower corner, in units of the size."""
        q = self._local(p)
        return {a: (q[a] - F.lit(self.lower[a])) / F.lit(self.size[a] if scale else 1.0) for a in self.lower}

    def to_global(self, p: Position, scale: bool = True) -> Position:
        q = {a: p[a] * F.lit(self.size[a] if scale else 1.0) + F.lit(self.lower[a]) for a in self.lower}
        if not self.angle:
            return q
        return vec.add(vec.rotate2(vec.subtract(q, self.center), self.angle), self.center)

    def without(self, *axes: str) -> Box:
        return Box({a: x for a, x in self.lower.items() if a not in axes}, {a: x for a, x in self.upper.items() if a not in axes})

    def __mul__(self, other: Box) -> Box:
        return Box({**self.lower, **other.lower}, {**self.upper, **other.upper})

    def shifted(self, **delta: float) -> Box:
        move = lambda side: {a: x + delta.get(a, 0.0) for a, x in side.items()}
        return replace(self, lower=move(self.lower), upper=move(self.upper))

    def scaled(self, factor: float) -> Box:
        return Box.around(self.center, {a: s * factor / 2 for a, s in self.size.items()}, self.angle)

    def rotated(self, angle: float) -> Box:
        return replace(self, angle=self.angle + angle)

    @staticmethod
    def largest(boxes: list[Box]) -> Box:
        axes = boxes[0].lower
        return Box({a: min(b.lower[a] for b in boxes) for a in axes}, {a: max(b.upper[a] for b in boxes) for a in axes})

    @staticmethod
    def smallest(boxes: list[Box]) -> Box:
        axes = boxes[0].lower
        return Box({a: max(b.lower[a] for b in boxes) for a in axes}, {a: min(b.upper[a] for b in boxes) for a in axes})


@dataclass(frozen=True)
class Cylinder(Geometry):
    """A solid cylinder along one axis; of infinite depth with ``depth`` None."""

    center: dict[str, float]
    radius: float
    axis: str = "z"
    depth: float | None = None

    @property
    def volume(self) -> float:
        return inf if self.depth is None else ball_volume(len(self.center) - 1, self.radius) * self.depth

    def sdf(self, p: Position) -> Column:
        across = {a: p[a] for a in self.center if a != self.axis}
        side = vec.length(vec.subtract(across, self.center)) - self.radius
        if self.depth is None:
            return side
        top = F.abs(p[self.axis] - self.center[self.axis]) - self.depth / 2
        beyond = F.sqrt(F.greatest(side, F.lit(0.0)) ** 2 + F.greatest(top, F.lit(0.0)) ** 2)
        return F.when((side > 0) | (top > 0), beyond).otherwise(F.greatest(side, top))

    @property
    def up(self) -> dict[str, float]:
        """The unit vector along the axis."""
        return {a: float(a == self.axis) for a in self.center}

    def with_radius(self, radius: float) -> Cylinder:
        return replace(self, radius=radius)

    def with_depth(self, depth: float | None) -> Cylinder:
        return replace(self, depth=depth)


@dataclass(frozen=True)
class Extruded(Geometry):
    """A shape of fewer axes, without end along the others."""

    base: Geometry
    axes: tuple[str, ...]

    def sdf(self, p: Position) -> Column:
        return self.base.sdf({a: p[a] for a in self.axes})

    def lies_inside(self, p: Position) -> Column:
        return self.base.lies_inside({a: p[a] for a in self.axes})


@dataclass(frozen=True)
class HalfSpace(Geometry):
    """The points with normal . p <= offset; the normal has length 1."""

    normal: dict[str, float]
    offset: float

    def sdf(self, p: Position) -> Column:
        return vec.plane_distance(self.offset, self.normal, p)


@dataclass(frozen=True)
class SignedDistance(Geometry):
    """A shape given by a function from a position to its signed distance."""

    function: object = field(repr=False)

    def sdf(self, p: Position) -> Column:
        return self.function(**p)


@dataclass(frozen=True)
class Union(Geometry):
    parts: tuple[Geometry, ...]

    def lies_inside(self, p: Position) -> Column:
        return reduce(lambda a, b: a | b, [g.lies_inside(p) for g in self.parts])

    def sdf(self, p: Position) -> Column:
        return F.least(*[g.sdf(p) for g in self.parts]) if len(self.parts) > 1 else self.parts[0].sdf(p)

    def bounds(self):
        both = [g.bounds() for g in self.parts]
        return {a: min(b[0][a] for b in both) for a in both[0][0]}, {a: max(b[1][a] for b in both) for a in both[0][1]}


@dataclass(frozen=True)
class Intersection(Geometry):
    parts: tuple[Geometry, ...]

    def lies_inside(self, p: Position) -> Column:
        return reduce(lambda a, b: a & b, [g.lies_inside(p) for g in self.parts])

    def sdf(self, p: Position) -> Column:
        return F.greatest(*[g.sdf(p) for g in self.parts]) if len(self.parts) > 1 else self.parts[0].sdf(p)


@dataclass(frozen=True)
class Inverted(Geometry):
    base: Geometry

    def lies_inside(self, p: Position) -> Column:
        return ~self.base.lies_inside(p)

    def sdf(self, p: Position) -> Column:
        return -self.base.sdf(p)


def expel(shape: Geometry, p: Position, separation: float = 0.0, invert: bool = False) -> Position:
    """Positions moved out of a shape, or with ``invert`` into it."""
    return Geometry.push(Inverted(shape), p, separation) if invert else shape.push(p, separation)


def scale_points(p: Position, factor: float, pivot: dict[str, float]) -> Position:
    return {a: F.lit(pivot[a]) + (x - F.lit(pivot[a])) * factor for a, x in p.items()}


def rotate_points(p: Position, angle: float, pivot: dict[str, float]) -> Position:
    return vec.add(vec.rotate2(vec.subtract(p, pivot), angle), pivot)


def line_trace(shape: Geometry, origin: Position, direction: Position, steps: int = 32, factor: float = 0.9) -> Column:
    """Length along unit directions to the first surface, by sphere tracing; null if it is not met.

    The steps are one aggregate over a sequence, so the expression does not grow with them.
    """

    def step(t: Column, _: Column) -> Column:
        return t + shape.sdf({a: origin[a] + direction[a] * t for a in origin}) * factor

    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    left = F.abs(shape.sdf({a: origin[a] + direction[a] * t for a in origin}))
    return F.when(left < 1e-3, t)


def height_inside(height: Column, up: Column, fill_below: bool = True) -> Column:
    """Inside test of a height map from the interpolated height at a point."""
    return up <= height if fill_below else up >= height
