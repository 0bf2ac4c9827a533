"""Near-duplicate detection with MinHash, banding and exact confirmation.

Plan, for N documents:

1. One map-only Arrow pass makes each document's set of word shingles, a
   128-bit digest of the set, its universal-hash minima, and one key a band.
2. Equal sets collapse into classes (aggregation with map-side combine), so a
   group of copies of any size is one row from here on.  A class has a number
   of its own, written with it, so rows of one doc_id may be in several.
3. Every band key with two classes or more links each of its classes to the
   smallest one, its hub: a star, never all pairs.  Each link is confirmed on
   the full sets; the members of a hub come in shares of bounded size, each with
   the hub's set, so a group of near copies costs its size.
4. Connected components of the confirmed links.  A band key all of whose classes
   are in one is settled, which is usual.
5. In the others the classes that are not with the hub (the strays) are compared
   with all classes of the key, by signatures alone, in cells of two blocks of
   bounded size.  Classes with an alike one in another component are confirmed
   on their full sets, cell by cell; a cell reports a spanning forest.
6. Components of all confirmed links, and the join back to all documents.

Nothing is capped: a band key of any size is covered by its cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import dealt_anew, map_arrow, saved, table
from .textops import list_array, mix, rolling, seeds, word_slices

#: A pair at the threshold itself shares no band with this probability at most.
MISS = 1e-6
#: Classes in a block (a cell has two blocks at most), and members of a hub in a share.
BLOCK, SHARE = 64, 64
#: A pair is dropped unconfirmed if its signature is this many standard deviations under the threshold.
SIGMAS = 6.0


def banding(threshold: float) -> tuple[int, int]:
    """Rows in a band and bands: as many rows as keep the bands at 50 or fewer."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if bands <= 50:
            return rows, bands
    raise ValueError(f"threshold {threshold} is too low for banding")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as the contract of ``near_duplicates`` defines them."""
    for i, j, w in word_slices(column, lower=True):
        h, first = w.windows(size)
        at = np.searchsorted(first, w.bounds)
        count = np.diff(w.bounds)
        for k in range(j - i):
            if 0 < count[k] < size:
                own = w.hash[w.bounds[k] : w.bounds[k + 1]]
                whole, _ = rolling(own, np.array([0, len(own)]), len(own))
                yield mix(whole + np.uint64(len(own)))
            else:
                yield np.unique(h[at[k] : at[k + 1]])


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(mix(~s).sum(dtype=np.uint64))


def minima(s: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``a * x + c`` over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (x[k : k + 1024, None] * a + c).min(axis=0), out=out)
    return out


def _signatures(size: int, rows: int, bands: int):
    n = rows * bands
    a = (seeds(n, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    c = (seeds(n, 2) >> np.uint64(32)).astype(np.uint32)

    def run(batches):
        for batch in batches:
            count, low, high, keys, used, marks = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                x, y = digest(s)
                count.append(len(s))
                low.append(x)
                high.append(y)
                used.append(bands if len(s) else 0)
                if len(s):
                    m = minima(s, a, c)
                    key = seeds(bands, 3)
                    for column in m.reshape(bands, rows).T:
                        key = mix(key * np.uint64(31) + column)
                    keys.append(key)
                    marks.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    marks.append(b"")
            if count:
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(count, pa.int64()),
                        pa.array(np.array(low, np.uint64).view(np.int64)),
                        pa.array(np.array(high, np.uint64).view(np.int64)),
                        list_array(flat, np.array(used), pa.int64()),
                        pa.array(marks, pa.binary()),
                        batch.column(2),
                    ],
                    ["doc_id", "n_shingles", "low", "high", "bands", "marks", "mark"],
                )

    return run


def _sets(size: int):
    """Rows (node, text, low, high, rest...) to (node, rest..., set), where the digest is the expected one."""

    def run(batches):
        for batch in batches:
            want = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            rows, values, lengths = [], [], []
            for k, (s, (x, y)) in enumerate(zip(shingle_sets(batch.column(1), size), want, strict=True)):
                u, v = digest(s)
                if (u - x) % (1 << 64) == 0 and (v - y) % (1 << 64) == 0:
                    rows.append(k)
                    values.append(s)
                    lengths.append(len(s))
            if rows:
                at = pa.array(rows)
                flat = np.concatenate(values).view(np.int64)
                rest = [batch.column(0).take(at)] + [batch.column(k).take(at) for k in range(4, batch.num_columns)]
                names = ["node", *batch.schema.names[4:], "shingles"]
                yield pa.RecordBatch.from_arrays([*rest, list_array(flat, np.array(lengths), pa.int64())], names)

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(x), len(y)) * threshold.denominator < threshold.numerator * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common)


def alike(marks: np.ndarray, sides: np.ndarray, comps: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows in different components, and on different sides if there are two, that agree in enough marks."""
    two = len(set(sides.tolist())) > 1
    out = []
    for i in range(len(marks) - 1):
        ok = (comps[i + 1 :] != comps[i]) & ((sides[i + 1 :] != sides[i]) if two else True)
        at = np.flatnonzero(ok) + i + 1
        at = at[(marks[at] == marks[i]).mean(axis=1) >= least] if len(at) else at
        out += [(i, int(j)) for j in at]
    return out


def cell_links(
    ids: list[int], sides: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, threshold: Fraction, least: float
) -> list[tuple[int, int]]:
    """A spanning forest of the links of one cell between its components, each link as (member, member)."""
    root = {c: c for c in comps.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in alike(marks, sides, comps, least):
        p, q = find(comps[i]), find(comps[j])
        if p != q and linked(sets[i], sets[j], threshold):
            root[max(p, q)] = min(p, q)
            out.append((ids[i], ids[j]))
    return out


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["a", "b"])


def _confirm(threshold: Fraction):
    """Rows sorted by (hub, share), the hub's own first: (hub, share, member, node, shingles) to confirmed links (a, b)."""

    def run(batches):
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, _, members, nodes = (batch.column(k).to_pylist() for k in range(4))
            lists = batch.column(4)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            out = []
            for k, of in enumerate(hubs):
                s = flat[at[k] : at[k + 1]]
                if not members[k]:
                    hub, own = of, s.copy()
                elif of == hub and linked(s, own, threshold):
                    out.append((nodes[k], of))
            if out:
                yield _links(out)

    return run


def _grouped(batches, width: int) -> Iterator[list[tuple]]:
    """The rows of one cell after another (the first ``width`` columns name it), without these columns; of a last list column, arrays."""
    cell, rows = None, []
    for batch in batches:
        lists = batch.columns[-1] if pa.types.is_list(batch.columns[-1].type) else None
        columns = [c.to_pylist() for c in (batch.columns[:-1] if lists is not None else batch.columns)]
        if lists is not None:
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            columns.append([flat[at[k] : at[k + 1]].copy() for k in range(batch.num_rows)])
        for row in zip(*columns, strict=True):
            if row[:width] != cell:
                if len(rows) > 1:
                    yield rows
                cell, rows = row[:width], []
            rows.append(row[width:])
    if len(rows) > 1:
        yield rows


def _unpacked(rows: list[tuple]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    return [r[2] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), marks


CELL = ["key", "lo", "hi"]


def _survivors(least: float):
    """Rows sorted by cell (key, lo, hi, side, comp, node, marks) to those with an alike one in another component.

    A cell is named by a hash of what is left of it, so that cells of the same classes have one name.
    """

    def run(batches):
        out = []

        def packed():
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["cell", "side", "comp", "node", "marks"])

        for rows in _grouped(batches, 3):
            ids, sides, comps, marks = _unpacked(rows)
            used = sorted({k for pair in alike(marks, sides, comps, least) for k in pair})
            if used:
                two = len(set(sides[used].tolist())) > 1
                halves = {s: k for k, s in enumerate(dict.fromkeys(sides[used].tolist()))}  # in the order of nodes
                side = [halves[s] if two else 0 for s in sides[used].tolist()]
                cell = int(mix(np.array([ids[k] * 2 + s for k, s in zip(used, side, strict=True)], np.int64).view(np.uint64)).sum(dtype=np.uint64))
                cell = (cell ^ 1 << 63) - (1 << 63)
                out += [(cell, s, *rows[k][1:]) for k, s in zip(used, side, strict=True)]
            if len(out) >= 1024:
                yield packed()
                out = []
        if out:
            yield packed()

    return run


def _cells(threshold: Fraction, least: float):
    """Rows sorted by cell (cell, side, comp, node, marks, shingles) to links (a, b)."""

    def run(batches):
        for rows in _grouped(batches, 1):
            ids, sides, comps, marks = _unpacked(rows)
            links = cell_links(ids, sides, comps, [r[4] for r in rows], marks, threshold, least)
            if links:
                yield _links(links)

    return run


def _with_roles(docs: DataFrame, classes: DataFrame, stars: DataFrame, size: int) -> DataFrame:
    """(node, roles, shingles) of the classes in ``stars`` (node, hub), from one text of each, written once for all that follows."""
    shares = stars.groupBy("hub").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    own = shares.select(
        F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("member")
    )
    share = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share")
    members = stars.join(dealt_anew(shares, "hub"), "hub").select("node", "hub", share, F.lit(True).alias("member"))
    roles = own.union(members).groupBy("node").agg(F.collect_list(F.struct("hub", "share", "member")).alias("roles"))
    wanted = roles.join(classes.select("node", "first", "low", "high"), "node")
    texts = docs.join(wanted, docs.doc_id == wanted["first"]).select("node", "text", "low", "high", "roles")
    kinds = "node long, roles array<struct<hub:long,share:int,member:boolean>>, shingles array<long>"
    return saved(map_arrow(texts, _sets(size), kinds), "sets")


def _confirmed_stars(held: DataFrame, exact: Fraction) -> DataFrame:
    """The links (a, b) of the stars in ``held`` that the full sets confirm."""
    placed = held.select("node", "shingles", F.explode("roles").alias("role"))
    placed = placed.select("role.hub", "role.share", "role.member", "node", "shingles")
    dealt = placed.repartition("hub", "share").sortWithinPartitions("hub", "share", "member")
    return map_arrow(dealt, _confirm(exact), "a long, b long")


def _stray_links(
    held: DataFrame, classes: DataFrame, members: DataFrame, near: DataFrame, exact: Fraction, least: float
) -> DataFrame | None:
    """Links (a, b) between components that share a band key; None if no two classes are alike enough."""
    comp = lambda node, name: near.select(F.col("node").alias(node), F.col("component").alias(name))
    known = members.join(comp("node", "comp"), "node", "left").join(comp("hub", "hub_comp"), "hub", "left")
    known = known.select(
        "key", "node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("comp", "node") != F.coalesce("hub_comp", "hub")).alias("stray")
    )
    known = saved(known, "members")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = known.groupBy("key").agg(F.sum(F.col("stray").cast("int")).alias("s"), F.count("*").alias("n")).where("s > 0")
    mixed = mixed.select("key", blocks(F.col("s")).alias("gs"), blocks(F.col("n") - F.col("s")).alias("gh"))
    placed = known.join(dealt_anew(mixed, "key"), "key").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("gs")).otherwise(F.col("gh"))).cast("int")
    )
    # cells of two strays' blocks have hi >= 0, cells of a strays' block and another one hi < 0
    block, cell = F.col("block"), lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_strays = F.transform(upto(F.col("gs")), lambda k: cell(F.least(block, k), F.greatest(block, k), block))
    with_others = F.transform(upto(F.col("gh")), lambda k: cell(block, -1 - k, F.lit(0)))
    as_other = F.transform(upto(F.col("gs")), lambda k: cell(k, -1 - block, F.lit(1)))
    cells = F.when(F.col("stray"), F.concat(with_strays, with_others)).otherwise(as_other)
    marked = placed.select("key", "node", "comp", cells.alias("cells")).join(classes.select("node", "marks"), "node")
    rows = marked.select("key", "node", "comp", "marks", F.explode("cells").alias("cell"))
    rows = rows.select("key", "cell.lo", "cell.hi", "cell.side", "comp", "node", "marks")
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL, "node")
    kinds = "cell long, side int, comp long, node long, marks binary"
    found = saved(map_arrow(rows, _survivors(least), kinds), "alike")
    if found.isEmpty():
        return None
    # classes that are alike share many band keys: cells of the same classes count once
    wanted = found.groupBy("node").agg(F.collect_set(F.struct("cell", "side", "comp", "marks")).alias("cells"))
    rows = held.select("node", "shingles").join(wanted, "node").select("node", "shingles", F.explode("cells").alias("c"))
    rows = rows.select("c.cell", "c.side", "c.comp", "node", "c.marks", "shingles")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "node")
    return map_arrow(rows, _cells(exact, least), "a long, b long")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    A document's set has the distinct shingles of ``size`` words (A-Z lower-cased;
    words are runs of bytes other than space and tab..carriage return); with
    fewer words, the whole sequence as one.  Two documents are linked if the
    Jaccard similarity of their sets is at least ``threshold``, confirmed on the
    full sets; ``component_id`` is the smallest doc_id that links lead to.

    Null, empty and blank texts have an empty set and are linked with nothing.
    A row without doc_id is in no class with another: its component_id is null
    and it is kept.  Rows are told apart by doc_id and set, so different texts of
    one doc_id are linked or kept each by its own set; rows that are equal in
    both are kept together.  Other columns are ignored; an empty table gives an
    empty result.
    """
    return _judged(docs, threshold, size, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, threshold: float, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``near_duplicates`` with the set's digest (``low``, ``high``) and the xxhash64 of the text (``mark``)."""
    exact = Fraction(threshold).limit_denominator(10_000)
    rows, bands = banding(float(exact))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    schema = "doc_id long, n_shingles long, low long, high long, bands array<long>, marks binary, mark long"
    signed = saved(map_arrow(docs, _signatures(size, rows, bands), schema), "signatures")
    sets = ["low", "high", "n_shingles"]
    classes = saved(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*sets)
        .agg(F.min("doc_id").alias("first"), F.min_by(F.struct("bands", "marks"), "doc_id").alias("of"))
        .select(*sets, "first", F.monotonically_increasing_id().alias("node"), "of.bands", "of.marks"),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "node")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    members = saved(banded.join(dealt_anew(hubs, "key"), "key").select("key", "node", "hub"), "banded")
    stars = members.where("node <> hub").select("node", "hub").distinct()
    held = _with_roles(docs, classes, stars, size)
    found = components(_confirmed_stars(held, exact))
    t = float(exact)
    least = t - SIGMAS * math.sqrt(t * (1 - t) / (rows * bands))
    more = _stray_links(held, classes, members, found, exact, least)
    if more is not None:
        # a component is one node in what links components
        found = components(found.toDF("a", "b").union(more))
    # each component's class with the smallest doc_id, of several the one with the smallest digest
    heads = found.join(classes.select("node", "first", "low", "high"), "node")
    heads = heads.groupBy("component").agg(F.min(F.struct("first", "low", "high", "node")).alias("head"))
    found = found.join(dealt_anew(heads, "component"), "component").select(F.col("node").alias("rep"), "head")
    found = found.select("rep", F.col("head.first").alias("component_id"), F.col("head.node").alias("head"))
    at_head = F.col("component_id").eqNullSafe(F.col("doc_id")) & F.coalesce(F.col("rep") == F.col("head"), F.lit(True))
    return (
        signed.select("doc_id", *sets, "mark")
        .join(classes.select(*sets, "first", F.col("node").alias("rep")), sets, "left")
        .join(found, "rep", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first", "doc_id")))
        .withColumn("kept", at_head)
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that near-duplicate detection keeps, one row for each doc_id and set.

    Of rows with one doc_id and set, those of the text with the least hash are
    taken, and of these the least row.  Rows without a doc_id all stay.
    """
    judged = _judged(docs, threshold, size).where("kept and doc_id is not null")
    own = F.when(F.col("n_shingles") == 0, F.col("mark"))  # empty sets are linked with nothing
    kept = judged.groupBy("doc_id", "low", "high", "n_shingles", own.alias("own")).agg(F.min("mark").alias("_mark"))
    kept = kept.select(F.col("doc_id").alias("_doc"), "_mark")
    marked = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_mark"), F.struct(*docs.columns).alias("_row"))
    one = marked.join(kept, ["_doc", "_mark"], "left_semi").groupBy("_doc", "_mark").agg(F.min("_row").alias("_row"))
    return one.select("_row.*").union(docs.where("doc_id is null"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


#: Exact links by an inverted index over shingle strings, then the smallest doc_id reachable.
OP9_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
flat as (select doc_id, len(s) as n, unnest(s) as h from shingles),
common as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c
  from flat a join flat b on a.h = b.h and a.doc_id < b.doc_id group by all),
links as (select x, y from common where 100 * c >= 85 * (nx + ny - c)),
both_ways as (select x, y from links union select y, x from links),
reach as (select doc_id as a, doc_id as b from documents union
  select r.a, l.y from reach r join both_ways l on r.b = l.x),
least_id as (select a, min(b) as component_id from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, l.component_id, s.doc_id = l.component_id as kept
from shingles s join least_id l on s.doc_id = l.a
"""

QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLE_SQL = {"op9_minhash_near_dedup": OP9_SQL}
