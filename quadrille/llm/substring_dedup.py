"""Removal of word sequences that repeat, by seed and extend.

Every window of ``length`` words has an anchor: the least of its ``seed``-word
hashes (winnowing).  It depends on the window's words alone, so equal windows
have equal anchors, wherever they are.  The windows of one anchor follow each
other; all their words are the anchor's reach, the farthest that a match around
it can be extended to both sides with that anchor.

1. One map-only pass lists the anchors of each text, each with a hash of its
   words (the seed) and of its reach.
2. Seeds that occur once end there (a count with map-side combine, joined back).
3. Where the reaches of a seed are all equal, the match extends over the whole
   reach.  The same holds for a reach that occurs more than once.
4. Around seeds with different reaches the match is extended window by window:
   of each different reach, one occurrence lists its windows, and a window that
   two of them have is repeated (again count, then join).
5. Overlapping repeated windows, and so neighbouring matches, join into maximal
   repeats, whose words go.

Windows are the same if their seed and a hash of all their words are: two
64-bit hashes, one of them compared only among rows of the other.  Counts
combine before they are shuffled, and a passage that very many documents share
is listed by one of them, so a hot passage costs each task a few rows.  Joins on
a frequent seed are inner joins that adaptive execution may split.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt_anew, map_arrow, saved, table
from .textops import Words, list_array, rolling, span_hashes, word_slices

#: Words in a seed. A window of 35 words has 24 of them, and about one word in twelve starts an anchor.
SEED_WORDS = 12
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Windows:
    """All windows of some texts, in order: first word, hash, and the number of their anchor.

    An anchor has the hash of its seed, that of its reach, and its first window.
    """

    first: np.ndarray
    hash: np.ndarray
    anchor: np.ndarray
    seed: np.ndarray
    reach: np.ndarray
    begins: np.ndarray

    def of_texts(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's windows and anchors."""
        windows = np.searchsorted(self.first, bounds)
        return windows, np.searchsorted(self.begins, windows)


def anchored_windows(words: Words, length: int, seed: int) -> Windows:
    windows, first = rolling(words.hash, words.bounds, length)
    if not len(first):
        return Windows(first, windows, first, windows, windows, first)
    grams, at = rolling(words.hash, words.bounds, seed)
    full = np.full(len(words.hash), np.uint64(0xFFFFFFFFFFFFFFFF))
    full[at] = grams
    view = sliding_window_view(full, length - seed + 1)
    anchor = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 14):
        part = first[k : k + (1 << 14)]
        anchor[k : k + len(part)] = part + np.argmin(view[part], axis=1)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(first)) - 1
    reach = span_hashes(words.hash, first[begins], first[ends] + length)
    return Windows(first, windows, np.cumsum(new) - 1, full[anchor[begins]], reach, begins)


def joined_sha256(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """sha256 of the given words joined by one space."""
    if not len(start):
        return _EMPTY
    raw = data.tobytes()
    return hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])).hexdigest()


def _survey(length: int, seed: int):
    """(doc_id, key, text) to (doc_id, key, n_words, kept_sha256 of all words, seeds and reaches of the anchors)."""

    def run(batches):
        for batch in batches:
            n_words, digests, anchors, reaches, lengths = [], [], [], [], []
            for i, j, w in word_slices(batch.column(2), lower=False):
                found = anchored_windows(w, length, seed)
                anchors.append(found.seed)
                reaches.append(found.reach)
                lengths.append(np.diff(found.of_texts(w.bounds)[1]))
                n_words.append(np.diff(w.bounds))
                for k in range(j - i):
                    a, b = w.bounds[k], w.bounds[k + 1]
                    lo, hi = (w.start[a], w.end[b - 1]) if b > a else (0, 0)
                    digests.append(joined_sha256(w.data[lo:hi], w.start[a:b] - lo, w.end[a:b] - lo))
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(np.concatenate(n_words), pa.int64()),
                        pa.array(digests),
                        list_array(np.concatenate(anchors).view(np.int64), np.concatenate(lengths), pa.int64()),
                        list_array(np.concatenate(reaches).view(np.int64), np.concatenate(lengths), pa.int64()),
                    ],
                    ["doc_id", "key", "n_words", "kept_sha256", "seeds", "reaches"],
                )

    return run


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    return np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)


def _windows(length: int, seed: int):
    """(row, text, reaches, times) to (seed, window, row, n) for each window of an anchor with one of those reaches."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            at, wanted = _longs(batch.column(2))
            times = np.asarray(batch.column(3).values)
            for i, j, w in word_slices(batch.column(1), lower=False):
                found = anchored_windows(w, length, seed)
                _, own = found.of_texts(w.bounds)
                ends = np.append(found.begins[1:], len(found.first))
                who, seeds, what, count = [], [], [], []
                for k in range(j - i):
                    mine, n = wanted[at[i + k] : at[i + k + 1]], times[at[i + k] : at[i + k + 1]]
                    order = np.argsort(mine)
                    # each reach once: where it occurs again, it is the same windows
                    reach, first = np.unique(found.reach[own[k] : own[k + 1]], return_index=True)
                    spot = np.minimum(np.searchsorted(mine[order], reach), max(0, len(mine) - 1))
                    hit = mine[order][spot] == reach if len(mine) else np.zeros(len(reach), bool)
                    anchors = own[k] + first[hit]
                    size = ends[anchors] - found.begins[anchors]
                    spots = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(found.begins[anchors], size)
                    what.append(found.hash[spots])
                    seeds.append(np.repeat(found.seed[anchors], size))
                    count.append(np.repeat(n[order][spot[hit]], size))
                    who.append(np.full(len(spots), i + k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(seeds).view(np.int64)),
                        pa.array(np.concatenate(what).view(np.int64)),
                        keys.take(pa.array(np.concatenate(who))),
                        pa.array(np.concatenate(count), pa.int64()),
                    ],
                    ["seed", "window", "row", "n"],
                )

    return run


def _removals(length: int, seed: int):
    """(key, text, repeated reaches, repeated windows) to (key, n_removed, kept_sha256, kept words' byte spans)."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            at_reach, reaches = _longs(batch.column(2))
            at, repeated = _longs(batch.column(3))
            removed, digests, spans = [], [], []
            for i, j, w in word_slices(batch.column(1), lower=False):
                found = anchored_windows(w, length, seed)
                windows, anchors = found.of_texts(w.bounds)
                for k in range(j - i):
                    a, b = w.bounds[k], w.bounds[k + 1]
                    lo, hi = windows[k], windows[k + 1]
                    whole = np.isin(found.reach[anchors[k] : anchors[k + 1]], reaches[at_reach[i + k] : at_reach[i + k + 1]])
                    hit = whole[found.anchor[lo:hi] - anchors[k]] | np.isin(found.hash[lo:hi], repeated[at[i + k] : at[i + k + 1]])
                    starts = found.first[lo:hi][hit] - a
                    cover = np.zeros(b - a + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + length, -1)
                    keep = np.cumsum(cover)[:-1] == 0
                    s, e = w.start[a:b], w.end[a:b]
                    base = s[0] if b > a else 0
                    top = e[-1] if b > a else 0
                    digests.append(joined_sha256(w.data[base:top], s[keep] - base, e[keep] - base))
                    removed.append(int((~keep).sum()))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], (~keep).astype(np.int8), [0]])))
                    spans.append([{"first": int(x), "last": int(y)} for x, y in edges.reshape(-1, 2)])
            if digests:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, kind)],
                    ["key", "n_removed", "kept_sha256", "repeats"],
                )

    return run


def repeated_spans(
    docs: DataFrame, length: int = 35, seed: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, repeats (maximal runs ``[first, last)`` of removed words).

    A word goes if a window of ``length`` consecutive words that covers it also
    starts anywhere else, in the same row or another; windows are judged on the
    input.  Words are runs of bytes other than space and tab..carriage return,
    unchanged; ``kept_sha256`` is of the kept words joined by one space.

    Null texts have no words.  Rows with equal texts, repeated rows included,
    repeat each other, so all their words go if there are ``length`` of them.
    doc_id is carried only: nulls and repeats of it don't matter.  Other columns
    are ignored; an empty table gives an empty result.
    """
    if not 0 < seed < length:
        raise ValueError("seed must be shorter than length")
    docs = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"),
        F.col(text).alias("text"),
    )
    base = docs.schema["doc_id"].dataType.simpleString()
    survey = map_arrow(
        docs, _survey(length, seed),
        f"doc_id {base}, key binary, n_words long, kept_sha256 string, seeds array<long>, reaches array<long>",
    )
    # the number is fixed once the table is written; it stands for the row in all that is shuffled
    survey = saved(survey.withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = survey.groupBy("key").agg(F.count("*").alias("copies"), F.min_by("doc_id", "row").alias("one"), F.min("row").alias("row"))

    every = survey.select("row", F.explode(F.arrays_zip("seeds", "reaches")).alias("a")).select("row", "a.seeds", "a.reaches").toDF("row", "seed", "reach")
    shared = every.groupBy("seed").agg(F.count("*").alias("n"), (F.min("reach") < F.max("reach")).alias("open")).where("n > 1")
    anchors = saved(every.join(dealt_anew(shared.drop("n"), "seed"), "seed").select("row", "seed", "reach", "open"), "seeds")
    kinds = anchors.where("open").groupBy("seed", "reach").agg(F.count("*").alias("n"), F.min("row").alias("lead"))
    differ = anchors.where("open").select("row", "seed", "reach").join(dealt_anew(kinds, "seed"), ["seed", "reach"])
    settled = anchors.where("not open").select("row", "reach").union(differ.where("n > 1").select("row", "reach"))
    settled = settled.groupBy("row").agg(F.collect_set("reach").alias("reaches"))
    listed = differ.where("n = 1 or lead = row").groupBy("row", "reach").agg(F.max("n").alias("n"))
    listed = listed.groupBy("row").agg(F.collect_list(F.struct("reach", "n")).alias("l"))
    # one row of each text is enough: a text with copies goes as a whole
    one_of = copies.select("row", "one", F.col("key").alias("of"), "copies")

    # from here on only the texts that have shared seeds, read and dealt once
    same = (docs.key == F.col("of")) & docs.doc_id.eqNullSafe(F.col("one"))
    wanted = settled.join(listed, "row", "full").join(one_of, "row").where("l is not null or copies = 1")
    texts = docs.join(wanted, same).select("row", "key", "text", "copies", "reaches", "l")
    texts = saved(texts, "texts")
    listing = texts.where("l is not null").select("row", "text", F.col("l.reach").alias("reaches"), F.col("l.n").alias("times"))
    windows = saved(map_arrow(listing, _windows(length, seed), "seed long, window long, row long, n long"), "windows")
    again = windows.groupBy("seed", "window").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = windows.select("seed", "window", "row").join(dealt_anew(again, "seed"), ["seed", "window"])
    repeated = repeated.groupBy("row").agg(F.collect_set("window").alias("windows"))
    hit = texts.where("copies = 1").join(repeated, "row", "left").where("reaches is not null or windows is not null")
    cut = map_arrow(
        hit.select("key", "text", *[F.coalesce(c, F.array().cast("array<long>")) for c in ("reaches", "windows")]), _removals(length, seed),
        "key binary, n_removed long, kept_sha256 string, repeats array<struct<first:long,last:long>>",
    ).toDF("key", "n_cut", "sha_cut", "repeats")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    return (
        survey.drop("seeds", "reaches", "row")
        .join(dealt_anew(copies.select("key", "copies").join(cut, "key", "left"), "key"), "key")
        .select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("sha_cut", "kept_sha256")).alias("kept_sha256"),
            F.when(whole, all_words).otherwise(F.coalesce("repeats", F.array())).alias("repeats"),
        )
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), length=35).drop("repeats")


OP10_SQL = r"""
with words as (select row_number() over () as r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, unnest(range(1, len(w) - 33)) as i, w from words where len(w) >= 35),
hashed as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from windows),
again as (select h from hashed group by h having count(*) > 1),
covered as (select distinct r, unnest(range(i, i + 35)) as p from hashed where h in (select h from again)),
gone as (select r, list(p) as p, count(*) as n from covered group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when n is null then w else
    list_select(w, list_filter(range(1, len(w) + 1), lambda q: not list_contains(p, q))) end, ' ')) as kept_sha256
from words left join gone using (r)
"""

QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL = {"op10_substring_dedup": OP10_SQL}
