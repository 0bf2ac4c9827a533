"""Readers of mesh files: SU2 and Gmsh text, and STL triangles.

Files come through Spark's own file access; each is one row and is parsed in
one task, and elements leave as rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import Mesh

#: Rows of all kinds: a vertex has coordinates, an element or boundary edge has vertex ids and maybe a name.
SCHEMA = "file string, kind string, id long, x double, y double, z double, vids array<long>, name string"

#: VTK types of solids, and Gmsh types of solids.
SU2_SOLIDS, GMSH_SOLIDS = (10, 12, 13, 14), (4, 5, 6, 7)
#: Vertices of element types 1 to 5 and 15 of the Gmsh format.
GMSH_SIZES = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 15: 1}


def parse_su2(raw: bytes) -> Iterator[tuple]:
    """(kind, id, x, y, z, vids, name) from SU2 text; markers are boundary edges. Solids are refused."""
    lines = [x.split("%", 1)[0].strip() for x in raw.decode().splitlines()]
    rank, k, marker = 2, 0, None
    while k < len(lines):
        key, _, value = lines[k].partition("=")
        key, value, k = key.strip(), value.strip(), k + 1
        if key == "NDIME":
            rank = int(value)
        elif key in ("NELEM", "MARKER_ELEMS"):
            for n in range(int(value)):
                # type, vertices, and maybe a number at the end
                numbers = [int(x) for x in lines[k].split()]
                if numbers[0] in SU2_SOLIDS:
                    raise ValueError("meshes of solids are not supported: their faces are no edges")
                size = {3: 2, 5: 3, 9: 4, 10: 4, 12: 8, 13: 6, 14: 5}[numbers[0]]  # fixed VTK element types
                yield ("element" if key == "NELEM" else "boundary", n, None, None, None, numbers[1 : 1 + size], marker if key != "NELEM" else None)
                k += 1
        elif key == "NPOIN":
            for n in range(int(value.split()[0])):
                p = [float(x) for x in lines[k].split()[:rank]] + [0.0] * (3 - rank)
                yield ("vertex", n, *p, None, None)
                k += 1
        elif key == "MARKER_TAG":
            marker = value


def parse_gmsh(raw: bytes) -> Iterator[tuple]:
    """The same from Gmsh text of version 2 or 4; lines are boundary edges named by their physical group."""
    sections = {m[1]: m[2].strip().splitlines() for m in re.finditer(r"\$(\w+)\n(.*?)\$End\1", raw.decode(), re.S)}
    names = {}
    for line in sections.get("PhysicalNames", [])[1:]:
        _, tag, name = line.split(maxsplit=2)
        names[int(tag)] = name.strip('"')
    head = sections.get("MeshFormat", ["2"])[0].split()
    if len(head) > 1 and head[1] != "0":
        raise ValueError("binary Gmsh files are not supported")
    if float(head[0]) >= 4:
        yield from _parse_gmsh4(sections, names)
        return
    for line in sections.get("Nodes", [])[1:]:
        n, x, y, z = line.split()
        yield ("vertex", int(n) - 1, float(x), float(y), float(z), None, None)
    count = {"element": 0, "boundary": 0}
    for line in sections.get("Elements", [])[1:]:
        v = [int(x) for x in line.split()]
        if v[1] in GMSH_SOLIDS:
            raise ValueError("meshes of solids are not supported: their faces are no edges")
        size = GMSH_SIZES[v[1]]
        if size == 1:
            continue
        kind = "boundary" if size == 2 else "element"
        tag = v[3] if v[2] else 0
        yield (kind, count[kind], None, None, None, [x - 1 for x in v[-size:]], names.get(tag, str(tag)) if size == 2 else None)
        count[kind] += 1


def _parse_gmsh4(sections: dict[str, list[str]], names: dict[int, str]) -> Iterator[tuple]:
    """Version 4: nodes and elements in blocks by entity; an entity's first physical group names its lines."""
    groups: dict[tuple[int, int], int] = {}
    rows = iter(sections.get("Entities", []))
    for rank, n in enumerate(map(int, next(rows, "").split())):
        for _ in range(n):
            v = next(rows).split()
            at = 4 if rank == 0 else 7  # after the tag, a place or a box
            if int(v[at]):
                groups[rank, int(v[0])] = int(v[at + 1])
    rows = iter(sections.get("Nodes", []))
    for _ in range(int(next(rows, "0").split()[0])):
        n = int(next(rows).split()[3])
        tags = [int(next(rows)) for _ in range(n)]
        for tag in tags:
            x, y, z = map(float, next(rows).split()[:3])
            yield ("vertex", tag - 1, x, y, z, None, None)
    rows, count = iter(sections.get("Elements", [])), {"element": 0, "boundary": 0}
    for _ in range(int(next(rows, "0").split()[0])):
        rank, entity, kind, n = map(int, next(rows).split())
        if kind in GMSH_SOLIDS:
            raise ValueError("meshes of solids are not supported: their faces are no edges")
        size = GMSH_SIZES[kind]
        group = groups.get((rank, entity), 0)
        for _ in range(n):
            vids = [int(x) - 1 for x in next(rows).split()[1 : 1 + size]]
            if size > 1:
                what = "boundary" if size == 2 else "element"
                yield (what, count[what], None, None, None, vids, names.get(group, str(group)) if size == 2 else None)
                count[what] += 1


def parse_stl(raw: bytes) -> Iterator[tuple]:
    """Triangles of text or binary STL; equal corners are one vertex."""
    if raw[:5] == b"solid" and b"facet" in raw[:2000]:
        corners = [tuple(map(float, m)) for m in re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", raw.decode())]
    else:
        (n,) = struct.unpack_from("<I", raw, 80)
        corners = []
        for k in range(n):
            v = struct.unpack_from("<9f", raw, 84 + 50 * k + 12)
            corners += [v[0:3], v[3:6], v[6:9]]
    ids: dict[tuple, int] = {}
    vids = [ids.setdefault(c, len(ids)) for c in corners]
    for c, n in ids.items():
        yield ("vertex", n, *map(float, c), None, None)
    for n in range(len(vids) // 3):
        yield ("element", n, None, None, None, vids[3 * n : 3 * n + 3], None)


PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"su2": parse_su2, "msh": parse_gmsh, "stl": parse_stl}


def read_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """All rows of the mesh files of a path; the parser is that of the file's ending, or ``kind``."""
    names = ["file", "kind", "id", "x", "y", "z", "vids", "name"]
    types = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 3, pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(name, *r) for r in PARSERS[kind or name.rsplit(".", 1)[-1].lower()](raw)]
                for k in range(0, len(found), 1 << 14):
                    part = zip(*found[k : k + (1 << 14)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def load_mesh(spark: SparkSession, path: str, kind: str | None = None) -> Mesh:
    """The mesh of one file."""
    rows = read_rows(spark, path, kind)
    return Mesh(
        rows.where("kind = 'vertex'").select(F.col("id").alias("vid"), "x", "y", "z"),
        rows.where("kind = 'element'").select(F.col("id").alias("eid"), "vids"),
        rows.where("kind = 'boundary'").select("name", F.get("vids", F.lit(0)).alias("v1"), F.get("vids", F.lit(1)).alias("v2")),
    )
