"""Language identification by averaged hashed subword embeddings.

A text's subwords are all runs of 2, 3 and 4 bytes of its lower-cased UTF-8
with word gaps as one space.  Each hashes to one of ``BUCKETS`` embeddings; the text is
the average of its subwords' embeddings, and a linear softmax gives the
languages.  Embeddings and softmax are trained together by stochastic gradient
descent in numpy on the driver, on at most ``TRAIN_ROWS`` rows
whose subword counts the executors made.  A held-back part of these sets the
temperature that makes scores probabilities, and the score under which a
prediction is rejected.

The average is linear, so scoring needs one table of bucket by language, of
fixed size, which is broadcast; documents pass through one map-only Arrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, table
from .textops import slices, text_buffers

#: Embeddings and their width.
BITS, DIM = 14, 16
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
#: Bound of the training sample, and passes over it.
TRAIN_ROWS, EPOCHS = 2500, 6
#: Accuracy that accepted predictions are to have on the held-back part.
TARGET = 0.99
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _runs(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket of every subword, and where each text's begin."""
    x = _LOWER[data]
    plain = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(plain[1:] & plain[:-1])
    x = x[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = []
    code = x
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] * np.uint32(257) + x[n - 1 :] if len(code) > 1 else code[:0]
        if n in SIZES:
            h = code * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            out.append(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), bounds, n))
    return out


def counts(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Used buckets and their shares of the subwords, for each text."""
    data, offsets = text_buffers(column)
    buckets, shares = [], []
    for i, j in slices(offsets):
        at = offsets[i : j + 1]
        runs = _runs(data[at[0] : at[-1]], at - at[0])
        for k in range(j - i):
            own = np.concatenate([c[b[k] : max(b[k], b[k + 1] - n + 1)] for c, b, n in runs])
            u, c = np.unique(own, return_counts=True)
            buckets.append(u.astype(np.int32))
            shares.append((c / max(1, len(own))).astype(np.float32))
    return buckets, shares


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.float64)
        for i, j in slices(offsets):
            at = offsets[i : j + 1]
            total, n_all = np.zeros((j - i, len(self.languages))), np.zeros(j - i)
            for codes, bounds, n in _runs(data[at[0] : at[-1]], at - at[0]):
                lo, hi = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - n + 1)
                n_all += hi - lo
                rows = np.zeros((len(codes) + 1, len(self.languages)))
                np.cumsum(self.table[codes], axis=0, dtype=np.float64, out=rows[1:])
                total += rows[np.minimum(hi, len(codes))] - rows[np.minimum(lo, len(codes))]
            out[i:j] = total / np.maximum(1, n_all)[:, None]
        return out + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(column) / self.temperature
        p = softmax(z)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    languages: list[str], labels: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], epochs: int = EPOCHS, seed: int = 11
) -> Model:
    """SGD on four fifths of the rows; temperature and rejection from the rest."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(held):
        held = used
    steps, k = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            rate = 2.0 * (1 - k / steps)
            k += 1
            v = shares[i] @ embed[buckets[i]]
            e = softmax(v @ weights + bias)
            e[labels[i]] -= 1
            back = weights @ e
            weights -= rate * np.outer(v, e)
            bias -= 0.05 * rate * e
            # an average's gradient is spread over its members; the sum of squares restores the step
            embed[buckets[i]] -= (rate / max(1e-6, float(shares[i] @ shares[i])) * 0.1) * np.outer(shares[i], back)
    model = Model(languages, (embed @ weights).astype(np.float32), bias.astype(np.float64))
    if len(held):
        z = np.array([shares[i] @ model.table[buckets[i]] for i in held]) + model.bias
        y = labels[held]
        choices = np.geomspace(0.5, 20, 60)
        loss = [(-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12)).mean() for t in choices]
        model.temperature = float(choices[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        top, right = p.max(1), p.argmax(1) == y
        down = np.argsort(-top, kind="stable")
        accuracy = np.cumsum(right[down]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(accuracy >= TARGET)
        # a score that is the target itself is never rejected
        model.reject_below = min(TARGET, float(top[down][good[-1]])) if len(good) else TARGET
    return model


def _features(batches):
    """Buckets and shares as raw bytes: as lists they would be an object for each number on the driver."""
    for batch in batches:
        buckets, shares = counts(batch.column(1))
        if buckets:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([b.astype("<u2").tobytes() for b in buckets], pa.binary()),
                    pa.array([c.astype("<f4").tobytes() for c in shares], pa.binary()),
                ],
                ["lang", "buckets", "shares"],
            )


def in_training_fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and non-null lang of the training fold; without any such row, from nothing (one language, und)."""
    known = docs.where("lang is not null and text is not null").where(in_training_fold())
    share = 1.2 * rows / max(1, known.count())
    pick = F.xxhash64("doc_id", F.lit(3))
    if share < 1:
        # a share by hash, then the bound itself: the same rows whatever the layout of the table
        known = known.where(F.pmod(pick, F.lit(1 << 20)) < int(share * (1 << 20)))
    ids = known.select("doc_id").distinct().orderBy(pick, "doc_id").limit(rows)
    known = known.join(F.broadcast(ids), "doc_id").select("lang", "text")  # at most ``rows`` ids
    found = map_arrow(known, _features, "lang string, buckets binary, shares binary")
    # where doc_ids repeat, the bound holds for rows, too
    found = found.orderBy(F.xxhash64("buckets", "shares"), "lang").limit(rows).collect()
    languages = sorted({r.lang for r in found}) or [UNKNOWN]
    labels = np.array([languages.index(r.lang) for r in found], np.int64)
    # whatever order rows came in
    order = sorted(range(len(found)), key=lambda i: (found[i].lang, bytes(found[i].buckets), bytes(found[i].shares)))
    buckets = [np.frombuffer(r.buckets, "<u2") for r in found]
    shares = [np.frombuffer(r.shares, "<f4") for r in found]
    return train(languages, labels[order], [buckets[i] for i in order], [shares[i] for i in order])


def _predict(shared):
    def run(batches):
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            best, score = model.predict(batch.column(1))
            texts = batch.column(1).to_pylist()
            letters = np.array([t is not None and has_letter(t) for t in texts])
            lang = np.where(letters, names[best], UNKNOWN)
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lang.tolist(), pa.string()),
                    pa.array(score),
                    pa.array(letters & (score >= model.reject_below)),
                ],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, accepted.

    ``lang_pred`` is the likeliest learned language and ``score`` its calibrated
    probability; ``accepted`` says whether the score reaches the threshold under
    which predictions are to be rejected.  A text that is null or has no letter
    has lang_pred ``und``, score 0 and is not accepted.  Nulls and repeats of
    doc_id don't matter (a null is not held out); repeated rows are judged each,
    and very long texts whole.  Other columns, whatever their names, are ignored.
    An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(
        docs.select("doc_id", "text"), _predict(shared), f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    )
    held_out = F.coalesce(~in_training_fold(), F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "accepted")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
