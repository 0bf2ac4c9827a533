"""Metadata of fields: axes, lattice, bounds and boundary rules. Driver-side only; no job is run for any of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import prod

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Boundary:
    """Rule for values outside the lattice on one side: ``constant`` (with ``value``), ``periodic``, ``edge`` or ``none``.

    ``edge`` repeats the nearest value, so the gradient is zero; ``none`` has no value outside.
    """

    kind: str = "constant"
    value: float = 0.0

    def __post_init__(self):
        if self.kind not in ("constant", "periodic", "edge", "none"):
            raise ValueError(f"unknown boundary {self.kind!r}")

    @property
    def stores_outer_face(self) -> bool:
        """Whether the face on this side is a value of the field, rather than fixed by the rule."""
        return self.kind in ("edge", "none")

    def map(self, f) -> Boundary:
        return replace(self, value=float(f(self.value))) if self.kind == "constant" else self

    def gradient(self) -> Boundary:
        """The rule of a derivative of the field."""
        return Boundary("constant", 0.0) if self.kind in ("constant", "edge") else self


ZERO, ONE = Boundary(), Boundary("constant", 1.0)
PERIODIC, EDGE, NONE = Boundary("periodic"), Boundary("edge"), Boundary("none")


def as_boundary(rule) -> Boundary:
    """A boundary from itself, a number, or a name."""
    if isinstance(rule, Boundary):
        return rule
    if isinstance(rule, (int, float)):
        return Boundary("constant", float(rule))
    names = {"periodic": PERIODIC, "edge": EDGE, "zero-gradient": EDGE, "none": NONE, "zero": ZERO}
    if rule in names:
        return names[rule]
    raise ValueError(f"no boundary rule {rule!r}")


def pressure_boundary(rule: Boundary) -> Boundary:
    """Boundary of a pressure from that of the velocity: open sides have pressure 0, closed ones no gradient."""
    return {"edge": ZERO, "none": ZERO, "periodic": PERIODIC, "constant": EDGE}[rule.kind]


def accessible_boundary(rule: Boundary) -> Boundary:
    """Whether fluid can be outside: 1 at open sides, 0 at closed ones."""
    return {"edge": ONE, "none": ONE, "periodic": PERIODIC, "constant": ZERO}[rule.kind]


@dataclass(frozen=True)
class Grid:
    """A uniform lattice: cells along each axis, the box it fills, and a (lower, upper) boundary for each axis.

    Cell ``i`` has its center at ``lower + (i + 0.5) * dx``.
    """

    resolution: dict[str, int]
    lower: dict[str, float] = field(default_factory=dict)
    upper: dict[str, float] = field(default_factory=dict)
    boundary: dict[str, tuple[Boundary, Boundary]] = field(default_factory=dict)

    @classmethod
    def of(cls, boundary=0.0, lower=None, upper=None, **resolution: int) -> Grid:
        """``boundary`` is a rule, or a dict by axis of a rule or of a pair; bounds default to one unit a cell."""
        if not resolution or any(a not in AXES or n < 1 for a, n in resolution.items()):
            raise ValueError(f"resolution {resolution} needs positive sizes of axes among {AXES}")
        rules = {}
        for a in resolution:
            rule = boundary.get(a, 0.0) if isinstance(boundary, dict) else boundary
            low, high = rule if isinstance(rule, tuple) else (rule, rule)
            rules[a] = as_boundary(low), as_boundary(high)
            if (rules[a][0].kind == "periodic") != (rules[a][1].kind == "periodic"):
                raise ValueError(f"axis {a} must be periodic on both sides or on none")
        low = {a: float((lower or {}).get(a, 0.0)) for a in resolution}
        high = {a: float((upper or {}).get(a, low[a] + n)) for a, n in resolution.items()}
        return cls(dict(resolution), low, high, rules)

    @property
    def axes(self) -> tuple[str, ...]:
        return tuple(self.resolution)

    @property
    def keys(self) -> list[str]:
        return [f"i{a}" for a in self.axes]

    @property
    def dx(self) -> dict[str, float]:
        return {a: (self.upper[a] - self.lower[a]) / n for a, n in self.resolution.items()}

    @property
    def size(self) -> int:
        return prod(self.resolution.values())

    @property
    def cell_volume(self) -> float:
        return prod(self.dx.values())

    @property
    def volume(self) -> float:
        return self.cell_volume * self.size

    def with_boundary(self, boundary) -> Grid:
        return Grid.of(boundary, self.lower, self.upper, **self.resolution)

    def map_boundary(self, f) -> Grid:
        return replace(self, boundary={a: (f(lo), f(hi)) for a, (lo, hi) in self.boundary.items()})

    def with_bounds(self, lower, upper) -> Grid:
        return replace(self, lower=dict(lower), upper=dict(upper))

    def with_resolution(self, **resolution: int) -> Grid:
        return replace(self, resolution={**self.resolution, **resolution})

    def scaled(self, factor: float) -> Grid:
        """The same box with ``factor`` times the cells along each axis."""
        return replace(self, resolution={a: max(1, round(n * factor)) for a, n in self.resolution.items()})

    def shifted(self, **delta: float) -> Grid:
        move = lambda side: {a: x + delta.get(a, 0.0) for a, x in side.items()}
        return replace(self, lower=move(self.lower), upper=move(self.upper))

    def padded(self, **widths: int | tuple[int, int]) -> Grid:
        """Grown by cells on the (lower, upper) sides."""
        both = {a: w if isinstance(w, tuple) else (w, w) for a, w in widths.items()}
        out, dx = self, self.dx
        for a, (lo, hi) in both.items():
            out = replace(
                out,
                resolution={**out.resolution, a: out.resolution[a] + lo + hi},
                lower={**out.lower, a: out.lower[a] - lo * dx[a]},
                upper={**out.upper, a: out.upper[a] + hi * dx[a]},
            )
        return out

    def faces(self, axis: str) -> Grid:
        """The lattice of the stored faces across ``axis``; the lower face of a cell has the cell's index.

        Outer faces that the boundary determines are not stored; of a periodic axis only the lower one is.
        """
        n, dx, (lo, hi) = self.resolution[axis], self.dx[axis], self.boundary[axis]
        first, last = self.face_range(axis)
        return replace(
            self,
            resolution={**self.resolution, axis: last - first},
            lower={**self.lower, axis: self.lower[axis] + (first - 0.5) * dx},
            upper={**self.upper, axis: self.lower[axis] + (last - 0.5) * dx},
        )

    def face_range(self, axis: str) -> tuple[int, int]:
        """Indices ``[first, last)`` of the stored faces across an axis."""
        n, (lo, hi) = self.resolution[axis], self.boundary[axis]
        if lo.kind == "periodic":
            return 0, n
        return (0 if lo.stores_outer_face else 1), n + (1 if hi.stores_outer_face else 0)

    @property
    def rank(self) -> int:
        return len(self.resolution)

    @property
    def boundary_names(self) -> list[str]:
        """Names of the sides, like ``x-``; a periodic axis has none."""
        return [f"{a}{s}" for a, pair in self.boundary.items() for s, b in zip("-+", pair, strict=True) if b.kind != "periodic"]

    def determines_boundary_values(self, side: str) -> bool:
        """Whether the rule of a side (``x-``) fixes the outer faces, so that they are not stored."""
        rule = self.boundary[side[:-1]][side[-1] == "+"]
        return not rule.stores_outer_face

    def same_lattice(self, other: Grid) -> bool:
        return (self.resolution, self.lower, self.upper) == (other.resolution, other.lower, other.upper)


def margin_resolution(width: dict[str, float], voxels: int, margin_cells: int = 0) -> dict[str, int]:
    """Cells along each axis so that cubes of one size fill a box with about ``voxels`` cells, margins not counted."""
    rank = len(width)
    side = (prod(width.values()) / voxels) ** (1 / rank)
    return {a: max(1, round(w / side)) + 2 * margin_cells for a, w in width.items()}


def assert_same_rank(a: Grid | int, b: Grid | int, message: str = "ranks differ") -> None:
    first, second = (x.rank if isinstance(x, Grid) else x for x in (a, b))
    if first != second:
        raise ValueError(f"{message}: {first} and {second}")
