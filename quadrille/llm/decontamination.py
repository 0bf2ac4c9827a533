"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set.  It is read in blocks of a bounded number of
words, whatever its size; each block is broadcast and runs against all
documents in one map-only pass, so no task holds more than one block and one
slice of texts.  With several blocks each pass ends, and its block is given
back, before the next begins.  In a pass:

1. Karp-Rabin hashes of all windows of ``min_match`` words of the documents
   are joined with those of the block (a sorted lookup): the shared seeds.
2. Seeds on one diagonal run together into matches, compared word by word.
3. Greedy tiling: the longest match is marked first; what a mark covers is cut
   from the others, as long as matches of ``min_match`` words remain.
4. An item whose marked share reaches ``coverage`` is contained, in whatever
   order its passages stand.

An item of fewer words than ``min_match`` has no seed; it is contained where
its whole sequence of words stands.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, map_arrow, saved, table
from .textops import Words, hash_words, rolling, text_buffers, word_slices

#: Shortest match in words.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover. Moved passages lose up to four words at each cut.
COVERAGE = 0.6
#: Words of the benchmark in a block: 24 bytes each are broadcast.
BLOCK_WORDS = 1 << 20


@dataclass
class Block:
    """Some benchmark items: their words' hashes, and the seeds in order of their hash.

    ``short`` has, by number of words, the items without seeds: their hashes in order, and their places.
    """

    ids: list[int | None]
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str], min_match: int) -> Block:
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        w = hash_words(data, offsets, lower=True, signs=True)
        seeds, at = rolling(w.hash, w.bounds, min_match)
        order = np.argsort(seeds, kind="stable")
        count, short = np.diff(w.bounds), {}
        for n in range(1, min_match):
            items = np.flatnonzero(count == n)
            if len(items):
                whole, first = rolling(w.hash, w.bounds, n)
                whole = whole[np.searchsorted(first, w.bounds[items])]
                by_hash = np.argsort(whole, kind="stable")
                short[n] = whole[by_hash], items[by_hash]
        return cls(ids, w.hash, w.bounds, seeds[order], at[order], short)


def blocks(benchmark: DataFrame, min_match: int, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    ids, texts, n = [], [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        size = row.text.count(" ") + row.text.count("\n") + 1
        if ids and n + size > limit:
            yield Block.of(ids, texts, min_match)
            ids, texts, n = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        n += size
    if ids:
        yield Block.of(ids, texts, min_match)


def matches(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal runs of seeds ``(i, j)`` on one diagonal, as (item position, document position, words)."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    out = []
    for a, b in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(i)]]), strict=True):
        p, q, n = int(i[a]), int(j[a]), int(b - a) + size - 1
        if np.array_equal(item[p : p + n], doc[q : q + n]):
            out.append((p, q, n))
    return out


def tile(found: list[tuple[int, int, int]], n_item: int, n_doc: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping tiles, the longest first; ties go to the first in the item, then the document."""
    left, right = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    heap = [(-n, p, q) for p, q, n in found]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = left[p : p + n] | right[q : q + n]
        if not taken.any():
            left[p : p + n] = right[q : q + n] = True
            tiles.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= size:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return tiles


def contained(block: Block, doc: np.ndarray, seed: np.ndarray, at: np.ndarray, size: int, coverage: float):
    """(item, tiled words, item words) of each item of a block that a document contains; ``seed`` and ``at`` are its shared seeds.

    A place of the block counts once however often the document has its seed;
    only for an item that the document's seeds may cover are the places of both
    brought together, one item at a time.
    """
    by_seed = np.argsort(seed, kind="stable")
    seed, at = seed[by_seed], at[by_seed]
    own, first, times = np.unique(seed, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(block.seeds, own, "left"), np.searchsorted(block.seeds, own, "right")
    many = hi - lo
    which = np.repeat(np.arange(len(own)), many)
    i = block.at[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    item = np.searchsorted(block.bounds, i, "right") - 1
    order = np.argsort(item, kind="stable")
    i, which, item = i[order], which[order], item[order]
    cuts = np.flatnonzero(np.diff(item)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(item)]]), strict=True):
        k = item[a]
        base, n = block.bounds[k], int(block.bounds[k + 1] - block.bounds[k])
        reach = np.zeros(n + 1, np.int64)  # an upper bound of what tiles can cover
        starts = i[a:b] - base
        np.add.at(reach, starts, 1)
        np.add.at(reach, starts + size, -1)
        if (np.cumsum(reach)[:-1] > 0).sum() < coverage * n:
            continue
        words = block.words[base : base + n]
        here = times[which[a:b]]
        j = at[np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here) + np.repeat(first[which[a:b]], here)]
        tiled = sum(x[2] for x in tile(matches(words, doc, np.repeat(starts, here), j, size), n, len(doc), size))
        if tiled >= coverage * n:
            yield block.ids[k], tiled, n


def short_items(block: Block, w: Words) -> Iterator[tuple[int, int, int]]:
    """(text, item's place, words) of the items without seeds that stand in some texts as a whole, each pair once."""
    for n, (whole, items) in block.short.items():
        h, first = w.windows(n)
        lo, hi = np.searchsorted(whole, h, "left"), np.searchsorted(whole, h, "right")
        many = hi - lo
        j = np.repeat(first, many)
        k = items[np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        step = np.arange(n)
        same = (w.hash[j[:, None] + step] == block.words[block.bounds[k][:, None] + step]).all(axis=1)
        owner = np.searchsorted(w.bounds, j[same], "right") - 1
        for text, item in np.unique(np.stack([owner, k[same]], 1), axis=0).tolist():
            yield text, item, n


def _pass(shared, size: int, coverage: float):
    def run(batches):
        block = shared.value
        for batch in batches:
            rows, found = [], []
            for i, _, w in word_slices(batch.column(2), lower=True, signs=True):
                h, first = w.windows(size)
                spot = np.minimum(np.searchsorted(block.seeds, h), max(0, len(block.seeds) - 1))
                hit = block.seeds[spot] == h if len(block.seeds) else np.zeros(len(h), bool)
                h, first = h[hit], first[hit]
                edge = np.searchsorted(first, w.bounds)
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    own = slice(edge[k], edge[k + 1])
                    a, b = w.bounds[k], w.bounds[k + 1]
                    new = list(contained(block, w.hash[a:b], h[own], first[own] - a, size, coverage))
                    found += new
                    rows += [i + k] * len(new)
                for k, item, n in short_items(block, w):
                    found.append((block.ids[item], n, n))
                    rows.append(i + k)
            if found:
                at = pa.array(rows)
                columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *columns],
                    ["doc_id", "mark", "item_id", "tiled", "n_words"],
                )

    return run


def contaminations(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, mark, item_id, tiled, n_words): which documents contain which benchmark items.

    ``mark`` is the xxhash64 of the text: together with doc_id it tells rows of
    one doc_id apart.  Words are runs of ASCII letters (lower-cased), digits
    and bytes beyond ASCII, so punctuation and case don't matter.  Null and empty texts contain nothing,
    and items that are null or have no words are contained in nothing.  Items of fewer than ``min_match``
    words are contained where they stand as a whole.  An item without id is
    judged like any other, with a null item_id.  Repeated rows and items are
    judged each.  A null doc_id is kept as null.  Other columns are ignored, and empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    schema = "doc_id long, mark long, item_id long, tiled long, n_words long"
    def found(block: Block) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(block)
        return map_arrow(docs, _pass(shared, min_match, coverage), schema), shared

    todo = blocks(benchmark, min_match)
    now, out = next(todo, None), spark.createDataFrame([], schema)
    for after in todo:
        part, shared = found(now)
        out = out.union(saved(part, "contaminations"))  # so that one block at a time is held
        shared.destroy()
        now = after
    return out.union(found(now)[0]) if now is not None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns unchanged, whatever their names.

    Rows are told apart by doc_id and text, so a null doc_id or one that several
    rows have does not matter; repeated rows go or stay together.  Null and
    empty texts stay, and texts of any length are judged whole.  Without
    documents the result is empty, without benchmark it is ``docs``.
    """
    doc, mark = fresh(docs, "_doc", "_mark")
    found = contaminations(docs, benchmark, min_match, coverage).select("doc_id", "mark").distinct().toDF(doc, mark)
    same = docs.doc_id.cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs.text) == F.col(mark))
    return docs.join(found, same, "left_anti")


def judge(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, coverage (of the item covered best), item_ids (without nulls)."""
    found = contaminations(docs, benchmark, min_match, coverage)
    found = found.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(
        F.max(F.col("tiled") / F.col("n_words")).alias("coverage"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
    )
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    same = docs.doc_id.eqNullSafe(F.col("_doc")) & (docs.mark == F.col("_mark"))
    return docs.join(found, same, "left").select(
        "doc_id",
        F.col("_mark").isNotNull().alias("contaminated"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
