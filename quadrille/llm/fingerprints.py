"""Exact document fingerprints: a canonical form and its 128-bit xxhash.

The canonical form is NFKC, then case folding, then NFKC once more (folding can
denormalise), with each run of Unicode white space as one space and none at the
ends.  Documents with equal hashes form a bucket; inside a bucket the canonical
bytes themselves are compared.  A bucket keeps its least and its greatest bytes
only, combined on the map side, so a group of copies of any size costs one row
a task.  If those two differ in any bucket, texts collided, and all hashes are
made again with the next seed, so equal fingerprints always mean equal bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, saved, table


def canonical(text: str | None) -> bytes:
    """The canonical form as UTF-8; of null as of an empty text."""
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


#: Seeds that are tried before texts that collide under all of them are given up.
SEEDS = 8


def hashed(form: bytes, seed: int = 0, digits: int = 32) -> str:
    return xxhash.xxh3_128_hexdigest(form, seed)[:digits]


def fingerprint(text: str | None, seed: int = 0, digits: int = 32) -> str:
    return hashed(canonical(text), seed, digits)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _packed(batches):
    """(id, text) to (id, hash of the text, zstd of the text); what is shuffled next is a third as large."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        marks = pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), marks, pa.array(map(pack.compress, raw), pa.binary())], ["id", "mark", "z"])


def _buckets(seed: int, digits: int):
    """(id, text) to (id, hash, zstd of the canonical bytes): equal blobs stand for equal bytes."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            forms = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashed(x, seed, digits) for x in forms], pa.string()),
                    pa.array([pack.compress(x) for x in forms], pa.binary()),
                ],
                ["doc_id", "fingerprint", "form"],
            )

    return run


def collided(forms: DataFrame) -> DataFrame:
    """The fingerprints of ``forms`` (fingerprint, form) under which the bytes differ; none is usual."""
    ends = forms.groupBy("fingerprint").agg(F.min("form").alias("low"), F.max("form").alias("high"))
    return ends.where("low <> high").select("fingerprint")


def _forms(docs: DataFrame, doc_id: str, text: str, seed: int, digits: int) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, _buckets(seed, digits), f"doc_id {kind}, fingerprint string, form binary")


def clean_seed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int = 32) -> int:
    """The first seed with which no two texts of different canonical bytes have one fingerprint."""
    for seed in range(SEEDS):
        if collided(_forms(docs, doc_id, text, seed, digits)).isEmpty():
            return seed
    raise ValueError(f"texts collide under {SEEDS} seeds")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int = 32) -> DataFrame:
    """Per row: doc_id, fingerprint.  Two rows have equal fingerprints if and only if their canonical bytes are equal.

    Null and empty texts share a fingerprint, repeated rows too; doc_id is only
    carried, so nulls and repeats of it don't matter.  Very long texts are
    hashed whole.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    return _forms(docs, doc_id, text, clean_seed(docs, doc_id, text, digits), digits).select("doc_id", "fingerprint")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint, class_id (the smallest doc_id of the same canonical bytes).

    A class whose doc_ids are all null has a null class_id.
    """
    marked = fingerprints(docs, doc_id, text)
    return marked.join(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "fingerprint").select(
        "doc_id", "fingerprint", "class_id"
    )


def _compare(id_kind: pa.DataType, seed: int):
    """Sorted (id, mark, z) of a range of ids to one row a document, compared with the next document of the range.

    The range's last document waits for the next range: it comes as role
    'last' with its text, and each range's first document also as role 'first'.
    """

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for key, z in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                form = canonical(text)
                if before is None:
                    out.append(("first", part, key, z, *[None] * 6))
                else:
                    out.append(("done", part, before[0], None, *compared(before[2], before[3], text, form, seed)))
                before = key, z, text, form
            if out:
                yield _batch(out, NAMES, id_kind)
        if before is not None:
            yield _batch([("last", part, before[0], before[1], *[None] * 6)], NAMES, id_kind)

    return run


NAMES = ["role", "part", "id", "z", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(text: str, form: bytes, following: str, next_form: bytes, seed: int = 0) -> tuple:
    """n_chars, edited_sha256, both fingerprints, and the likeness to the edited text and to the following one."""
    changed = edited(text, following)
    changed_form = canonical(changed)
    own, other = hashed(form, seed), hashed(changed_form, seed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, own, other, float(changed_form == form), float(next_form == form)


def _batch(rows: list[tuple], names: list[str], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), id_kind, pa.binary(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _close(seed: int):
    """(id, z, next z) of the last document of each range to its row."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, y = (unpack.decompress(z).decode("utf-8", "surrogatepass") for z in (a, b))
                rows.append(("done", 0, key, None, *compared(x, canonical(x), y, canonical(y), seed)))
            if rows:
                yield _batch(rows, NAMES, batch.column(0).type)

    return run


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside its edited text's and that of the next document by doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; the likenesses are 1.0 for equal canonical bytes,
    else 0.0.  The edited text has its last quarter of code points replaced by
    as many of the start of the next document's (or all of them).  After the
    last document comes the first, so a single row follows itself.

    Null texts count as empty.  Rows without doc_id come first; rows of one
    doc_id stand in the order of a hash of their text, so neither need share a
    range unless their texts are equal, too.  Other columns, whatever
    their names, are ignored; an empty table gives an empty result.

    Documents are dealt by ranges of doc_id and hash, compressed; that is the
    shuffle of texts.  Only the first and last document of each range are
    matched across ranges.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    seed = clean_seed(docs, "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = map_arrow(docs, _packed, "id long, mark long, z binary")
    schema = (
        "role string, part int, id long, z binary, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    ordered = packed.repartitionByRange(parts, "id", "mark").sortWithinPartitions("id", "mark", "z")
    rows = saved(map_arrow(ordered, _compare(pa.int64(), seed), schema), "compared")
    # as many numbers as there are ranges
    used = sorted(r.part for r in rows.where("role = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, after int")
    first = rows.where("role = 'first'").select(F.col("part").alias("after"), F.col("z").alias("next_z"))
    last = rows.where("role = 'last'").select("part", "id", "z").join(after, "part").join(first, "after")
    closed = map_arrow(last.select("id", "z", "next_z"), _close(seed), schema)
    return rows.where("role = 'done'").union(closed).drop("role", "part", "z").withColumnRenamed("id", "doc_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op2_document_fingerprints": op2_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
