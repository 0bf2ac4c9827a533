"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the
whole text is encoded: shares of byte classes and of pairs of them, word
lengths, and how often words repeat, then one learned dense layer.  Gated
attention, learned from document labels alone, weights the passages, and the
score is a logistic function of the weighted sum.  Features are of bytes and of
repetition; no word is looked up.

Training runs on the driver in numpy, on at most ``TRAIN_ROWS`` labelled
documents picked by a hash of doc_id.  Of a document with more than
``TRAIN_PASSAGES`` passages it takes so many, picked by a hash of their place;
the features are made by the executors.  Scoring is one map-only Arrow pass
over all passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, give_back, map_arrow, table
from .textops import seeds, word_slices

#: Words in a passage.
PASSAGE = 48
#: Bounds of the training sample: documents, and passages of one document.
TRAIN_ROWS, TRAIN_PASSAGES = 4000, 256
#: Scores from here on are label 1.
THRESHOLD = 0.3

_CLASSES = 8


def _classes() -> np.ndarray:
    """Lower, upper, digit, white space, sentence marks, exclamation mark, other signs, bytes beyond ASCII."""
    kind = np.full(256, 6, np.uint8)
    kind[128:] = 7
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:?'\"-()", "!")):
        kind[[ord(c) for c in chars]] = k
    return kind


_KIND = _classes()
#: Pairs of classes, class shares, and five figures of the words.
WIDTH = _CLASSES * _CLASSES + _CLASSES + 5


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a column's texts (one row each), and the passages of each text, at least one."""
    rows, counts = [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, np.int64)]
    for _, _, w in word_slices(column, lower=True):
        n = np.diff(w.bounds)
        own = np.maximum(1, -(-n // PASSAGE))
        total = int(own.sum())
        x = np.zeros((total, WIDTH), np.float32)
        base = np.concatenate([[0], np.cumsum(own)])
        counts.append(own)
        if len(w.hash):
            index = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], n)
            of_word = np.repeat(base[:-1], n) + index // PASSAGE
            first = np.flatnonzero(np.diff(of_word, prepend=-1))
            used = of_word[first]
            words = np.bincount(of_word, minlength=total).astype(np.float32)
            # bytes from a passage's first word up to the last byte of its last
            lo, hi = w.start[first], w.end[np.append(first[1:], len(w.hash)) - 1]
            size = hi - lo
            of_byte = np.repeat(used, size)
            spot = np.arange(len(of_byte)) - np.repeat(np.cumsum(size) - size - lo, size)
            kind = _KIND[w.data[spot]].astype(np.int64)
            pairs = kind[:-1] * _CLASSES + kind[1:]
            inside = of_byte[:-1] == of_byte[1:]
            grid = np.bincount(of_byte[:-1][inside] * _CLASSES**2 + pairs[inside], minlength=total * _CLASSES**2)
            share = np.bincount(of_byte * _CLASSES + kind, minlength=total * _CLASSES)
            bytes_ = np.maximum(1, np.bincount(of_byte, minlength=total))[:, None]
            x[:, : _CLASSES**2] = grid.reshape(total, -1) / bytes_
            x[:, _CLASSES**2 : _CLASSES**2 + _CLASSES] = share.reshape(total, -1) / bytes_
            length = (w.end - w.start).astype(np.float32)
            words1 = np.maximum(1, words)
            same = np.zeros(len(w.hash), bool)
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
            order = np.lexsort((w.hash, of_word))
            new = np.ones(len(order), bool)
            new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
            mean = np.bincount(of_word, length, total) / words1
            x[:, -5] = mean / 10
            x[:, -4] = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, total) / words1 - mean**2)) / 10
            x[:, -3] = np.bincount(of_word[same], minlength=total) / words1
            x[:, -2] = np.bincount(of_word[order][new], minlength=total) / words1
            x[:, -1] = words / PASSAGE
        rows.append(x)
    return np.concatenate(rows), np.concatenate(counts)


@dataclass
class Model:
    """Standardisation, encoder, attention (two gates) and output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward(self.weights, self.encode(x), counts)["y"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), counts))
    a = e / np.repeat(np.add.reduceat(e, start), counts)
    z = np.add.reduceat(a[:, None] * h, start)
    y = _sigmoid(z @ p["c"] + p["d"])
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "start": start}


def gradients(p, x, counts, labels) -> dict[str, np.ndarray]:
    f = forward(p, x, counts)
    dy = (f["y"] - labels) / len(labels)
    dz = dy[:, None] * p["c"]
    dz_all = np.repeat(dz, counts, axis=0)
    da = (dz_all * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["start"]), counts))
    gate = de[:, None] * p["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz_all + dt @ p["V"].T + dg @ p["U"].T
    dh *= 1 - f["h"] ** 2
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
    }


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 30, seed: int = 7) -> Model:
    """Adam over mini-batches of bags; without rows of both labels, a constant score of their mean (or of one half)."""
    rng = np.random.default_rng(seed)
    hidden, gates = 16, 8
    sizes = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "c": (hidden,), "d": (1,)}
    p = {k: rng.normal(0, 0.2, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in sizes.items()}
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(WIDTH)
    model = Model(mean, scale, p)
    if len(set(labels.tolist())) < 2:
        rate = labels.mean() if len(labels) else 0.5
        p |= {"c": np.zeros(hidden), "d": np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3))])}
        return model
    z = model.encode(x)
    start = np.concatenate([[0], np.cumsum(counts)])
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            bags = order[k : k + 64]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in bags])
            g = gradients(p, z[rows], counts[bags], labels[bags])
            step += 1
            rate = 0.01 * 0.9**epoch
            for name in p:
                d = g[name] + 1e-5 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return model


#: Documents whose passages are held at once.
BLOCK = 256


def _sample(x: np.ndarray) -> np.ndarray:
    """A document's passages for training, in their order."""
    return x if len(x) <= TRAIN_PASSAGES else x[np.sort(np.argsort(seeds(len(x), 4))[:TRAIN_PASSAGES])]


def _features(batches):
    """Features as raw bytes: as lists they would be an object for each number on the driver."""
    for batch in batches:
        x, counts = passages(batch.column(1))
        cut = np.split(x, np.cumsum(counts)[:-1]) if len(counts) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_sample(b).astype("<f4").tobytes() for b in cut], pa.binary())], ["label", "features"]
        )


def _in_blocks(model: Model, column: pa.Array) -> np.ndarray:
    """Scores of a column's texts."""
    return np.concatenate([model.score(*passages(column[k : k + BLOCK])) for k in range(0, len(column), BLOCK)])


def in_training_fold(doc_id) -> F.Column:
    """Four rows of five; a row without doc_id is not in it."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn ``labels.quality`` (0 or 1) from the texts of the training fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(in_training_fold("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    n = known.count()
    # a share by hash, then the bound itself
    share = 1.2 * rows / max(1, n)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")  # at most ``rows`` ids
    found = map_arrow(pairs, _features, "label int, features binary")
    found = found.orderBy(F.xxhash64("features"), "label").limit(rows).collect()  # where doc_ids repeat, the bound holds for rows, too
    found.sort(key=lambda r: (r.label, bytes(r.features)))  # whatever order rows came in
    xs = [np.frombuffer(r.features, "<f4").reshape(-1, WIDTH) for r in found]
    x = np.concatenate(xs) if xs else np.zeros((0, WIDTH), np.float32)
    return train(x, np.array([len(a) for a in xs], np.int64), np.array([r.label for r in found], np.float64))


def _scores(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                scores = _in_blocks(model, batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"]
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    Null, empty and blank texts are a bag of one empty passage.  Nulls and
    repeats of doc_id don't matter (a null is not held out); very long texts are
    scored whole, and other columns, whatever their names, are ignored.  An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(docs.select("doc_id", "text"), _scores(shared), f"doc_id {kind}, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts as label 1, all columns unchanged, whatever their names.

    Null, empty and blank texts are judged as one empty passage, very long ones
    whole.  Equal texts are judged alike, so repeated rows stay or go together;
    doc_id is only carried.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(_in_blocks(shared.value, column) >= THRESHOLD if len(column) else [], pa.bool_())
        give_back()

    bound_batches(docs.sparkSession)
    return docs.where(F.arrow_udf(good, "boolean")("text"))  # only texts and marks pass Python


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
