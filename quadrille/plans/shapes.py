"""Queries on geometry, particles, graphs, meshes, curves and storage."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..functions import kernels, text
from ..functions import vector as vec
from ..operators import aggregate as agg
from ..operators import graph, mesh
from ..operators.geometry import Box, Cylinder, Extruded, Sphere, expel, line_trace, rotate_points, scale_points
from ..sources import scene
from .grids import r6
from .tables import G_SQL, NY, P_SQL, line_field, line_grid, plain_points, rounded, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BALL = Sphere({"x": 20.0, "y": 40.0}, 15.0)
BOX = Box({"x": 10.0, "y": 50.0}, {"x": 35.0, "y": 80.0})
_BALL = "(sqrt((x - 20) * (x - 20) + (y - 40) * (y - 40)) - 15)"
_BOX = "greatest(greatest(10 - x, x - 35), greatest(50 - y, y - 80))"


def xy() -> dict:
    return {"x": F.col("x"), "y": F.col("y")}


@query(f"with {P_SQL} select elem_id, ({_BALL} <= 0 or {_BOX} <= 0) as inside from p")
def lies_inside_union(spark, sf_dir):
    return plain_points(spark, sf_dir).select("elem_id", (BALL | BOX).lies_inside(xy()).alias("inside"))


@query(f"with {P_SQL} select elem_id, {r6(_BOX, 'box')}, {r6(_BALL, 'ball')}, {r6(f'least({_BALL}, {_BOX})', 'either')}, {r6(f'greatest({_BALL}, {_BOX})', 'both')}, {r6(f'-{_BALL}', 'outside')} from p")
def signed_distances(spark, sf_dir):
    p = xy()
    shapes = {"box": BOX, "ball": BALL, "either": BALL | BOX, "both": BALL & BOX, "outside": ~BALL}
    return rounded(plain_points(spark, sf_dir).select("elem_id", *[s.sdf(p).alias(n) for n, s in shapes.items()]))


@query(f"with {P_SQL} select elem_id, {r6(f'greatest(0.0, least(1.0, 0.5 - {_BALL} / 5))', 'share')} from p")
def fraction_inside(spark, sf_dir):
    return rounded(plain_points(spark, sf_dir).select("elem_id", BALL.fraction_inside(xy(), F.lit(5.0)).alias("share")))


_R = "sqrt((x - 20) * (x - 20) + (y - 40) * (y - 40))"


@query(f"with {P_SQL} select elem_id, {r6(f'case when {_R} = 0 then 36.0 when {_R} < 16 then 20 + (x - 20) / {_R} * 16 else x end', 'x')}, {r6(f'case when {_R} = 0 then 40.0 when {_R} < 16 then 40 + (y - 40) / {_R} * 16 else y end', 'y')} from p")
def push_out_of_sphere(spark, sf_dir):
    out = expel(BALL, xy(), 1.0)
    return rounded(plain_points(spark, sf_dir).select("elem_id", *[c.alias(a) for a, c in out.items()]))


_SX, _SY = "greatest(10 - x, x - 35)", "greatest(50 - y, y - 80)"


@query(f"""with {P_SQL} select elem_id, {r6(f"case when {_BOX} < 0.5 and {_SX} = {_BOX} then case when x > 22.5 then 35.5 else 9.5 end else x end", "x")},
{r6(f"case when {_BOX} < 0.5 and {_SX} <> {_BOX} then case when y > 65 then 80.5 else 49.5 end else y end", "y")} from p""")
def push_out_of_box(spark, sf_dir):
    out = expel(BOX, xy(), 0.5)
    return rounded(plain_points(spark, sf_dir).select("elem_id", *[c.alias(a) for a, c in out.items()]))


@query(f"""with {P_SQL} select elem_id, {r6("25 + cos(0.5) * (x - 25) - sin(0.5) * (y - 50)", "rx")}, {r6("50 + sin(0.5) * (x - 25) + cos(0.5) * (y - 50)", "ry")}, {r6("25 + (x - 25) * 2", "sx")}, {r6("50 + (y - 50) * 2", "sy")} from p""")
def rotate_and_scale(spark, sf_dir):
    pivot = {"x": 25.0, "y": 50.0}
    r, s = rotate_points(xy(), 0.5, pivot), scale_points(xy(), 2.0, pivot)
    cols = {"rx": r["x"], "ry": r["y"], "sx": s["x"], "sy": s["y"]}
    return rounded(plain_points(spark, sf_dir).select("elem_id", *[c.alias(n) for n, c in cols.items()]))


@query(f"""with {P_SQL}, l as (select elem_id, cos(0.3) * (x - 22.5) + sin(0.3) * (y - 65) as a, -sin(0.3) * (x - 22.5) + cos(0.3) * (y - 65) as b from p)
select elem_id, (abs(a) <= 12.5 and abs(b) <= 15) as inside, {r6("greatest(abs(a) - 12.5, abs(b) - 15)", "distance")} from l""")
def rotated_box(spark, sf_dir):
    box = BOX.rotated(0.3)
    return rounded(plain_points(spark, sf_dir).select("elem_id", box.lies_inside(xy()).alias("inside"), box.sdf(xy()).alias("distance")))


@query(f"""with {P_SQL}, l as (select elem_id, {_BALL} as side, abs(elem_id % 7 - 3) - 2 as top from p)
select elem_id, {r6("case when side > 0 or top > 0 then sqrt(greatest(side, 0) * greatest(side, 0) + greatest(top, 0) * greatest(top, 0)) else greatest(side, top) end", "finite")}, {r6("side", "infinite")}, side <= 0 as inside from l""")
def cylinder_distance(spark, sf_dir):
    p = {**xy(), "z": (F.col("elem_id") % 7).cast("double")}
    tube = Cylinder({"x": 20.0, "y": 40.0, "z": 3.0}, 15.0, "z", 4.0)
    endless = Extruded(BALL, ("x", "y"))
    df = plain_points(spark, sf_dir)
    return rounded(df.select("elem_id", tube.sdf(p).alias("finite"), endless.sdf(p).alias("infinite"), endless.lies_inside(p).alias("inside")))


@query("select p_brand as brand, min(p_size)::double as lower_x, max(p_size)::double as upper_x, min(p_retailprice - 900)::double as lower_y, max(p_retailprice - 900)::double as upper_y from part group by 1")
def bounding_box(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    df = p.select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).cast("double").alias("y"))
    return agg.bounding_box(df, ("x", "y"), batch=("brand",))


@query(f"""with {P_SQL}, t as (select elem_id, x, y, greatest(0.0, least(1.0, ((x - 5) * 40 + (y - 10) * 60) / (40 * 40 + 60 * 60))) as t from p)
select elem_id, {r6("sqrt(pow(x - 5 - 40 * t, 2) + pow(y - 10 - 60 * t, 2))", "distance")}, {r6("0.6 * x + 0.8 * y - 30", "plane")}, {r6("3 * y - 4 * x", "turn")} from t""")
def vector_functions(spark, sf_dir):
    p = xy()
    a, b = {"x": F.lit(5.0), "y": F.lit(10.0)}, {"x": F.lit(45.0), "y": F.lit(70.0)}
    near = vec.closest_on_segment(a, b, p)
    cols = {
        "distance": vec.length(vec.subtract(near, p)),
        "plane": vec.plane_distance(30.0, {"x": 0.6, "y": 0.8}, p),
        "turn": vec.cross2({"x": 3.0, "y": 4.0}, p),
    }
    return rounded(plain_points(spark, sf_dir).select("elem_id", *[c.alias(n) for n, c in cols.items()]))


@query()
def sphere_trace(spark, sf_dir):
    """Length of rays along x to the ball."""
    origin = {"x": F.lit(-10.0), "y": F.col("y")}
    hit = line_trace(BALL, origin, {"x": F.lit(1.0), "y": F.lit(0.0)}, steps=96)
    return rounded(plain_points(spark, sf_dir).select("elem_id", hit.alias("length")), 2)


_PAIRS = f"with {P_SQL}, e as (select a.elem_id as src, b.elem_id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a, p b)"


@query(f"{_PAIRS} select src as elem_id, round(sum(pow(1 - d * d / 9, 3) * 4 / (pi() * 9)), 5) + 0.0 as density, count(*) as neighbours from e where d <= 3 group by 1")
def sph_density_poly6(spark, sf_dir):
    return rounded(graph.density(plain_points(spark, sf_dir), ("x", "y"), 3.0), 5)


@query(f"{_PAIRS} select src, dst, {r6('d', 'distance')} from e where src <> dst and d <= 1.5")
def radius_join(spark, sf_dir):
    return graph.neighbours_by_place(plain_points(spark, sf_dir), ("x", "y"), 1.5, digits=6).select("src", "dst", "distance")


@query(f"""with i as (select range as i, range / 100.0::double as q from range(101))
select i, {r6(f"case when q < 1 then pow(1 - q * q, 3) * 4 / {pi} else 0 end", "poly6")}, {r6(f"case when q < 1 then -6 * q * pow(1 - q * q, 2) * 4 / {pi} else 0 end", "poly6_grad")},
{r6(f"case when q < 1 then pow(1 - q, 4) * (1 + 4 * q) * 7 / {pi} else 0 end", "wendland")},
{r6(f"case when q < 1 then (pow(3 - 3 * q, 5) - 6 * pow(greatest(0, 2 - 3 * q), 5) + 15 * pow(greatest(0, 1 - 3 * q), 5)) * {63 / (478 * pi)}::double else 0 end", "quintic")} from i""")
def sph_kernels(spark, sf_dir):
    q = F.col("id") / 100.0
    k = {n: kernels.kernel(q, 1.0, 2, kind) for n, kind in (("poly6", "poly6"), ("wendland", "wendland-c2"), ("quintic", "quintic-spline"))}
    return rounded(spark.range(101).select(F.col("id").alias("i"), k["poly6"]["kernel"].alias("poly6"), k["poly6"]["grad"].alias("poly6_grad"), k["wendland"]["kernel"].alias("wendland"), k["quintic"]["kernel"].alias("quintic")))


@query("""with b as (select s_suppkey as elem_id, s_nationkey::double as x, (s_suppkey % 17)::double as y, abs(s_acctbal) as m from supplier),
e as (select a.elem_id, b.x - a.x as dx, b.y - a.y as dy, b.m, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 0.25 as r2 from b a, b where a.elem_id <> b.elem_id)
select elem_id, round(sum(dx * m / pow(r2, 1.5)), 4) + 0.0 as ax, round(sum(dy * m / pow(r2, 1.5)), 4) + 0.0 as ay from e group by 1""")
def nbody_accelerations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("elem_id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"), F.abs("s_acctbal").alias("m"))
    return rounded(graph.pairwise_accelerations(s, ("x", "y"), "m", softening=0.5), 4)


@query("""with q as (select * from embeddings where vec_id % 50 = 0),
d as (select q.vec_id as query, e.vec_id as nearest, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as distance
from q, embeddings e where q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query order by distance, nearest) as k from d)
select query, nearest, round(distance, 5) + 0.0 as distance from r where k = 1""")
def nearest_neighbour(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    return rounded(graph.nearest_in_blocks(q, e, "embedding", "vec_id"), 5)


@query("select o_custkey as src, count(*) as degree from (select distinct o_custkey, o_orderkey from orders) group by 1")
def graph_degrees(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return graph.degrees(edges)


@query("""with n as (select c_custkey as node, c_nationkey::double as x, c_acctbal / 1000 as y from customer),
e as (select c_custkey as src, c_custkey + 1 as dst from customer)
select src, dst, round(b.x - a.x, 6) + 0.0 as dx, round(b.y - a.y, 6) + 0.0 as dy, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) + 0.0 as distance
from e join n a on a.node = src join n b on b.node = dst""")
def edge_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    edges = c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    return rounded(graph.edges_of(nodes, edges, ("x", "y")))


def _line_mesh(spark):
    return mesh.quad_mesh(spark, line_grid())


@query(f"""with {G_SQL} select (ix * {NY} + iy)::bigint as eid, ix + 0.5::double as cx, iy + 0.5::double as cy, 1.0::double as volume from lat""")
def mesh_volumes(spark, sf_dir):
    return rounded(mesh.geometry(_line_mesh(spark)))


@query(f"""with {G_SQL} select (a.ix * {NY} + a.iy)::bigint as eid, (b.ix * {NY} + b.iy)::bigint as nb from lat a join lat b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1""")
def mesh_face_pairs(spark, sf_dir):
    return mesh.cell_connectivity(mesh.faces(_line_mesh(spark)))


_AT = "coalesce((select (b.v + a.v) / 2 from g b where b.ix = a.ix + {0} and b.iy = a.iy + {1}), {2})"


@query(f"""with {G_SQL} select (a.ix * {NY} + a.iy)::bigint as eid,
{r6(f"{_AT.format(1, 0, '0.02')} - {_AT.format(-1, 0, 'a.v')}", "dx")}, {r6(f"{_AT.format(0, 1, 'a.v')} - {_AT.format(0, -1, 'a.v')}", "dy")} from g a""")
def green_gauss(spark, sf_dir):
    m = _line_mesh(spark)
    values = line_field(spark, sf_dir).select((F.col("ix") * NY + F.col("iy")).cast("long").alias("eid"), "v")
    return rounded(mesh.green_gauss(m, mesh.faces(m), values, {"x-": "edge", "x+": 0.02, "y-": "edge", "y+": "edge"}))


_FAR = "coalesce((select b.v - a.v from g b where b.ix = a.ix + {0} and b.iy = a.iy + {1}), {2})"


@query(f"""with {G_SQL} select (a.ix * {NY} + a.iy)::bigint as eid, {r6(f"{_FAR.format(1, 0, '2 * (0.02 - a.v)')} + {_FAR.format(-1, 0, '0')} + {_FAR.format(0, 1, '0')} + {_FAR.format(0, -1, '0')}", "laplace")} from g a""")
def mesh_laplace(spark, sf_dir):
    m = _line_mesh(spark)
    values = line_field(spark, sf_dir).select((F.col("ix") * NY + F.col("iy")).cast("long").alias("eid"), "v")
    return rounded(mesh.mesh_laplace(m, mesh.faces(m), values, {"x+": 0.02}))


@query(f"""with {G_SQL}, s as (select a.ix, a.iy, a.v, coalesce((select b.v from g b where b.ix = a.ix - 1 and b.iy = a.iy), a.v) as m from g a)
select (ix * {NY} + iy)::bigint as eid, {r6("v - m", "flux")} from s""")
def upwind_flux(spark, sf_dir):
    """What a flow of speed 1 along x carries out of each element, upwind."""
    m = _line_mesh(spark)
    values = line_field(spark, sf_dir).select((F.col("ix") * NY + F.col("iy")).cast("long").alias("eid"), "v")
    sides = mesh.face_values(mesh.neighbour_values(mesh.faces(m), values, {}), F.col("nx"))
    return rounded(mesh.integrate_flux(sides, F.col("at"), F.lit(0.0)))


_DAYS = "d as (select strftime(ts, '%Y-%m-%d') as day, round(avg(value), 6) as v from events group by 1)"


def _daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


@query(f"with {_DAYS} select day, v, round(avg(v) over (order by day rows between 2 preceding and 2 following), 4) + 0.0 as smooth from d")
def smooth_curve(spark, sf_dir):
    df = agg.smooth(_daily(spark, sf_dir), "day", "v", 5)
    return df.select("day", "v", (F.round("smooth", 4) + 0.0).alias("smooth"))


@query(f"with {_DAYS}, r as (select *, row_number() over (order by day) as r, count(*) over () as n from d) select day, v from r where (r - 1) % 4 = 0 or r = n")
def downsample_curve(spark, sf_dir):
    return agg.down_sample(_daily(spark, sf_dir), "day", 4)


@query("""with b as (select least(floor(value / 25), 19)::int as bin, count(*)::double as n from events where value between 0 and 500 group by 1)
select range::int as bin, coalesce(n, 0.0) as weight from range(20) left join b on b.bin = range""")
def histogram_values(spark, sf_dir):
    return agg.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 20)


@query("""with c as (select distinct event_type as field, (date_trunc('day', ts)::date - date '2024-01-01')::int as frame from events)
select frame from c group by 1 having count(*) = (select count(distinct field) from c)""")
def frames_complete(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    catalog = e.select(F.col("event_type").alias("field"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("frame")).distinct()
    return scene.complete_frames(catalog)


@query(f"with {_DAYS} select day, v, round(sum(v) over (order by day rows unbounded preceding), 4) + 0.0 as time from d")
def scalar_log_cumtime(spark, sf_dir):
    df = scene.cumulative_time(_daily(spark, sf_dir), "v", "day")
    return df.select("day", "v", (F.round("time", 4) + 0.0).alias("time"))


@query(r"select p_partkey, regexp_replace(lower(trim(regexp_replace(p_name, '[^\w\s-]', '', 'g'))), '[-\s]+', '-', 'g') as slug, ltrim(replace(p_brand, '.', '_'), '_') as file from part")
def slugify_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), text.field_file_name(F.col("p_brand")).alias("file"))
