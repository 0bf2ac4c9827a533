"""One-sided differences, batch columns of fields, limits, steps and Gmsh files of version 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.field import Field
from quadrille.meta import Grid
from quadrille.operators import aggregate, lattice, stencil
from quadrille.sources import meshfiles, steps
from quadrille.sources.scene import Scene, read_scalars


def test_upwind_gradient_orders(spark):
    errors = {}
    for n in (40, 80):
        g = Grid.of("periodic", {"x": 0.0}, {"x": 2 * np.pi}, x=n)
        df = lattice.lattice(spark, g, v=lambda x: F.sin(x), u=lambda x: F.cos(3 * x))
        for order in (1, 2):
            rows = stencil.upwind_gradient(df, g, {"x": "u"}, order=order).withColumn("x", lattice.centers(g)["x"]).collect()
            errors[n, order] = max(abs(r.dx - np.cos(r.x)) for r in rows)
    assert errors[40, 1] / errors[80, 1] == pytest.approx(2, rel=0.1) and errors[40, 2] / errors[80, 2] == pytest.approx(4, rel=0.1)
    g = Grid.of(5.0, x=4)
    df = lattice.lattice(spark, g, v=lambda x: x, u=1.0)
    assert [r.dx for r in stencil.upwind_gradient(df, g, {"x": "u"}).orderBy("ix").collect()] == [-4.5, 1, 1, 1]
    with pytest.raises(ValueError):
        stencil.upwind_gradient(df, g, {"x": "u"}, order=3)


def test_batch_columns_of_fields(spark):
    g = Grid.of("edge", x=3, y=2)
    f = Field(lattice.lattice(spark, g, v=lambda x, y: x * y - 0.25), g).expanded("part", ["a", "b"]).expanded("run", [1, 2, 3])
    assert f.df.count() == 36 and f.batch == ("run", "part")
    assert f.where_dim(run=2).batch == ("part",) and f.where_dim(run=2, part="a").df.count() == 6
    turned = f.renamed_dims(run="k", x="y", y="x")
    assert turned.batch == ("k", "part") and turned.grid.resolution == {"y": 3, "x": 2}
    packed = f.packed(("run", "part"), "both")
    assert packed.batch == ("both",) and packed.df.select("both").distinct().count() == 6
    assert f.stored().df.count() == 30


def test_plot_limits(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5), (10.0, 100.0, 0.0), (float("inf"), float("nan"), None)], "x double, y double, e double")
    r = aggregate.plot_limits(df, ("x", "y"), "e", log=("y",)).first()
    assert (r.lower_x, r.upper_x) == (pytest.approx(4.8 - 5.3 * 1.1), pytest.approx(4.8 + 5.3 * 1.1))
    assert (r.lower_y, r.upper_y) == (pytest.approx(0.475), pytest.approx(100.1 * 1.05))
    assert aggregate.plot_limits(df.limit(0), ("x",)).first().lower_x is None


def test_steps(spark, tmp_path):
    scene = Scene.create(spark, f"{tmp_path}")
    s, state = steps.Steps(scene), {"n": 0}
    seen = []
    for k in s.range(3, warmup=2, record=lambda: {"v": spark.range(state["n"] + 1)}):
        state["n"] += 1
        seen.append(k)
        if len(seen) > 2:
            s.log_scalars(size=[state["n"], state["n"] + 2])
    assert seen == [0, 0, 0, 1, 2] and s.steps == 3 and s.seconds > 0
    assert sorted(r.frame for r in scene.catalog().collect()) == [0, 1, 2, 3]
    assert [scene.read("v", k).count() for k in range(4)] == [3, 4, 5, 6]
    rows = read_scalars(spark, scene.subpath("log_size.txt"), ["value"]).orderBy("frame").collect()
    assert [(r.frame, r.value) for r in rows] == [(0, 4.0), (1, 5.0), (2, 6.0)] and scene.scalar_curve_names() == ["size"]
    assert steps.benchmark(lambda: spark.range(5), 2) > 0


GMSH4 = """$MeshFormat
4.1 0 8
$EndMeshFormat
$PhysicalNames
2
1 1 "wall"
2 2 "area"
$EndPhysicalNames
$Entities
1 2 1 0
1 0 0 0 0
1 0 0 0 1 0 0 1 1 2 1 -2
2 0 0 0 1 1 0 0 2 2 -3
1 0 0 0 1 1 0 1 2 3 1 2 3
$EndEntities
$Nodes
2 4 1 4
1 1 0 2
1
2
0 0 0
1 0 0
2 1 0 2
3
4
1 1 0
0 1 0
$EndNodes
$Elements
3 4 1 4
1 1 1 1
1 1 2
1 2 1 1
2 2 3
2 1 2 2
3 1 2 3
4 1 3 4
$EndElements
"""


def test_gmsh_version_4(spark, tmp_path):
    (tmp_path / "a.msh").write_text(GMSH4)
    m = meshfiles.load_mesh(spark, f"{tmp_path}/a.msh")
    assert [(r.vid, r.x, r.y) for r in m.vertices.orderBy("vid").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)]
    assert [list(r.vids) for r in m.elements.orderBy("eid").collect()] == [[0, 1, 2], [0, 2, 3]]
    assert {tuple(r) for r in m.boundaries.collect()} == {("wall", 0, 1), ("0", 1, 2)}
    for bad in (GMSH4.replace("4.1 0 8", "4.1 1 8"), GMSH4.replace("2 1 2 2\n3 1 2 3", "3 1 4 2\n3 1 2 3")):
        with pytest.raises(ValueError):
            list(meshfiles.parse_gmsh(bad.encode()))
