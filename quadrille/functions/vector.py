"""Vector algebra on Columns: a vector is a dict of Columns by axis, or a list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = dict[str, Column]


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def add(a: Vector, b: Vector) -> Vector:
    return {k: lit(a[k]) + lit(b[k]) for k in a}


def subtract(a: Vector, b: Vector) -> Vector:
    return {k: lit(a[k]) - lit(b[k]) for k in a}


def multiply(a: Vector, s) -> Vector:
    return {k: lit(v) * lit(s) for k, v in a.items()}


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda x, y: x + y, [lit(a[k]) * lit(b[k]) for k in a])


def squared(a: Vector) -> Column:
    return dot(a, a)


def length(a: Vector, epsilon: float | None = None) -> Column:
    s = squared(a)
    return F.sqrt(F.greatest(s, F.lit(epsilon)) if epsilon is not None else s)


def divide(a, b) -> Column:
    """Quotient; 0 where the divisor is 0."""
    return F.when(lit(b) != 0, lit(a) / lit(b)).otherwise(0.0)


def product(a, b) -> Column:
    """Product; 0 where a factor is 0, even if the other is not finite."""
    return F.when((lit(a) == 0) | (lit(b) == 0), 0.0).otherwise(lit(a) * lit(b))


def normalize(a: Vector) -> Vector:
    """Unit vector; a zero vector stays."""
    n = length(a)
    return {k: divide(v, n) for k, v in a.items()}


def clip_length(a: Vector, low: float = 0.0, high: float = 1.0) -> Vector:
    n = length(a)
    return multiply(a, divide(F.greatest(F.lit(low), F.least(n, F.lit(high))), n))


def cross2(a: Vector, b: Vector) -> Column:
    return lit(a["x"]) * lit(b["y"]) - lit(a["y"]) * lit(b["x"])


def cross(a: Vector, b: Vector) -> Vector:
    out = {}
    for k, (i, j) in {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}.items():
        out[k] = lit(a[i]) * lit(b[j]) - lit(a[j]) * lit(b[i])
    return out


def rotate2(a: Vector, angle, invert: bool = False) -> Vector:
    """Rotated counter-clockwise in the plane."""
    angle = -lit(angle) if invert else lit(angle)
    c, s = F.cos(angle), F.sin(angle)
    return {"x": c * lit(a["x"]) - s * lit(a["y"]), "y": s * lit(a["x"]) + c * lit(a["y"])}


def rotate_axis(a: Vector, axis: Vector, angle) -> Vector:
    """Rotated about an axis (a unit vector) by the right-hand rule."""
    c, s = F.cos(lit(angle)), F.sin(lit(angle))
    along = dot(axis, a)
    side = cross(axis, a)
    return {k: lit(a[k]) * c + side[k] * s + lit(axis[k]) * along * (1 - c) for k in a}


Matrix = dict[str, Vector]  # rows by axis


def unit_matrix(axes: tuple[str, ...] = ("x", "y", "z")) -> Matrix:
    return {a: {b: F.lit(float(a == b)) for b in axes} for a in axes}


def apply_matrix(m: Matrix, a: Vector, invert: bool = False) -> Vector:
    """The vector turned by a rotation matrix, or back by its transpose."""
    return {k: dot({j: m[j][k] for j in m}, a) if invert else dot(m[k], a) for k in m}


def times(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies ``n`` and then ``m``."""
    return {i: {k: dot(m[i], {j: n[j][k] for j in n}) for k in n} for i in m}


def rotation_about(axis: Vector, angle) -> Matrix:
    """The rotation about an axis (a unit vector): its columns are the unit vectors turned."""
    units = unit_matrix()
    turned = {b: rotate_axis(units[b], axis, angle) for b in units}
    return {a: {b: turned[b][a] for b in units} for a in units}


def rotation_matrix(angle) -> Matrix:
    """By an angle in the plane; in space by a vector along the axis that is as long as the angle."""
    if not isinstance(angle, dict):
        c, s = F.cos(lit(angle)), F.sin(lit(angle))
        return {"x": {"x": c, "y": -s}, "y": {"x": s, "y": c}}
    return rotation_about(normalize(angle), length(angle))


def euler_matrix(angles: Vector) -> Matrix:
    """About x first, then y, then z, by the angles of these names."""
    about = {a: rotation_about(unit_matrix()[a], angles[a]) for a in ("x", "y", "z")}
    return times(about["z"], times(about["y"], about["x"]))


def rotation_angles(m: Matrix) -> Column | Vector:
    """The angle of a rotation in the plane; in space angles for ``euler_matrix`` (one of the solutions)."""
    if len(m) == 2:
        return F.atan2(m["y"]["x"], m["x"]["x"])
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m["z"]["x"]))
    # looking along x, the angles about x and z turn the same way; all of it is given to z
    locked = F.abs(sine) > 1 - 1e-12
    return {
        "x": F.when(locked, 0.0).otherwise(F.atan2(m["z"]["y"], m["z"]["z"])),
        "y": F.asin(sine),
        "z": F.when(locked, F.atan2(-m["x"]["y"], m["y"]["y"])).otherwise(F.atan2(m["y"]["x"], m["x"]["x"])),
    }


def rotation_matrix_between(a: Vector, b: Vector) -> Matrix:
    """The rotation that takes direction ``a`` to ``b``."""
    return rotation_about(*rotation_between(a, b))


def matching_rotations(*matrices: Matrix | None) -> list[Matrix | None]:
    """Unit matrices for those that are missing, unless all are."""
    some = next((m for m in matrices if m is not None), None)
    return [m if m is not None or some is None else unit_matrix(tuple(some)) for m in matrices]


def normal_from_slope(slope: Vector, up: str) -> Vector:
    """Unit normal, upwards, of the line or plane that rises along ``up`` by the slopes of the other axes."""
    return normalize({**{a: -lit(s) for a, s in slope.items()}, up: F.lit(1.0)})


def plane_from_slope(slope: Vector, up: str, point: Vector) -> tuple[Vector, Column]:
    """Unit normal and offset of the plane of these slopes through a point."""
    normal = normal_from_slope(slope, up)
    return normal, dot(normal, {a: point[a] for a in normal})


def height_at_zero(slope, x, y) -> Column:
    """Where the line of a slope through (x, y) meets the axis x = 0."""
    return lit(y) - lit(slope) * lit(x)


def angle_between(a: Vector, b: Vector) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), divide(dot(a, b), length(a) * length(b)))))


def rotation_between(a: Vector, b: Vector) -> tuple[Vector, Column]:
    """Axis and angle of the rotation that takes direction ``a`` to ``b``."""
    return normalize(cross(a, b)), angle_between(a, b)


def orthogonal(a: Vector) -> Vector:
    """Some vector at a right angle to a vector in space."""
    near_x = F.abs(lit(a["x"])) > F.abs(lit(a["z"]))
    return {
        "x": F.when(near_x, -lit(a["y"])).otherwise(0.0),
        "y": F.when(near_x, lit(a["x"])).otherwise(-lit(a["z"])),
        "z": F.when(near_x, F.lit(0.0)).otherwise(lit(a["y"])),
    }


def without_part(a: Vector, normal: Vector) -> Vector:
    """``a`` less its part along a unit normal."""
    return subtract(a, multiply(normal, dot(a, normal)))


def plane_distance(offset, normal: Vector, point: Vector) -> Column:
    """Signed distance from the plane of points p with normal . p = offset."""
    return dot(normal, point) - lit(offset)


def closest_on_plane(offset, normal: Vector, point: Vector) -> Vector:
    return subtract(point, multiply(normal, plane_distance(offset, normal, point)))


def closest_on_segment(a: Vector, b: Vector, point: Vector) -> Vector:
    u = subtract(b, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), divide(dot(u, subtract(point, a)), squared(u))))
    return add(a, multiply(u, t))


def closest_on_triangle(a: Vector, b: Vector, c: Vector, point: Vector) -> Vector:
    """The projection where it is inside, else the nearest point of the three edges."""
    u, v, w = subtract(b, a), subtract(c, a), subtract(point, a)
    uu, uv, vv, wu, wv = squared(u), dot(u, v), squared(v), dot(w, u), dot(w, v)
    d = uu * vv - uv * uv
    s, t = divide(vv * wu - uv * wv, d), divide(uu * wv - uv * wu, d)
    inside = (s >= 0) & (t >= 0) & (s + t <= 1) & (d != 0)
    edges = [closest_on_segment(p, q, point) for p, q in ((a, b), (b, c), (c, a))]
    far = [squared(subtract(e, point)) for e in edges]
    first = (far[0] <= far[1]) & (far[0] <= far[2])
    second = far[1] <= far[2]
    plane = add(a, add(multiply(u, s), multiply(v, t)))
    return {k: F.when(inside, plane[k]).when(first, edges[0][k]).when(second, edges[1][k]).otherwise(edges[2][k]) for k in a}


def line_distance(offset: Vector, direction: Vector, point: Vector) -> Column:
    """Distance from a line through ``offset``; the direction need not have length 1."""
    d = subtract(point, offset)
    along = divide(dot(d, direction), squared(direction))
    return length(subtract(d, multiply(direction, along)))


def closest_between_lines(p1: Vector, v1: Vector, p2: Vector, v2: Vector) -> tuple[Vector, Vector]:
    """The nearest points of two infinite lines; of parallel ones, beside the first's offset."""
    d, a, b, c = subtract(p1, p2), squared(v1), dot(v1, v2), squared(v2)
    e, f, m = dot(v1, d), dot(v2, d), squared(v1) * squared(v2) - dot(v1, v2) ** 2
    s = divide(b * f - c * e, m)
    t = F.when(m != 0, divide(a * f - b * e, m)).otherwise(divide(f, c))
    return add(p1, multiply(v1, s)), add(p2, multiply(v2, t))


def solve2x2(a, b, c, d, y1, y2) -> tuple[Column, Column]:
    """x1, x2 of a x1 + b x2 = y1 and c x1 + d x2 = y2; 0 where there is no single solution."""
    det = lit(a) * lit(d) - lit(b) * lit(c)
    return divide(lit(y1) * lit(d) - lit(b) * lit(y2), det), divide(lit(a) * lit(y2) - lit(c) * lit(y1), det)


def helix(offset: Vector, axis: Vector, start: Vector, end_angle, rise, t) -> Vector:
    """Point at ``t`` (0 to 1) of a turn of ``start - offset`` about an axis (a unit vector) with a rise along it."""
    arm = rotate_axis(subtract(start, offset), axis, lit(end_angle) * lit(t))
    return add(offset, add(arm, multiply(axis, lit(rise) * lit(t))))


# --- complex numbers: structs of re and im ---------------------------------------------------------


def complex_(re, im=0.0) -> Column:
    return F.struct(lit(re).alias("re"), lit(im).alias("im"))


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_abs(a: Column) -> Column:
    return F.sqrt(a["re"] ** 2 + a["im"] ** 2)


def complex_exp(a: Column) -> Column:
    return complex_(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))
