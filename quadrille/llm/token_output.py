"""Token ids as Arrow stream files of fixed-size-list batches.

One file holds the ids of a range of documents, end to end, cut into sequences
of equal length: column ``ids`` is a fixed-size list of the narrowest unsigned
type for the vocabulary, ``mask`` says which of them are real (only the last
sequence of a file is padded).  All batches but the last have as many
sequences, so with a memory map any sequence is a view, not a copy.  A second
file has doc_id, start and n_tokens of the documents, in order.

A task writes under a name of its own and renames when complete; the manifest
names the files of the attempts that succeeded, so a lost executor costs the
repeat of its ranges and leaves no half file in use.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, new_path, table
from .textops import hash_spans

#: Ids in a sequence, and sequences in a batch.
LENGTH, BATCH = 2048, 64
#: Appended to each document.
END_ID = 0
#: Words whose ids a worker remembers at most (about 50 bytes each); when there are more, it starts anew.
MEMO_WORDS = 2_000_000
#: Characters encoded at once, and new words given to the library as one text.
BLOCK_CHARS, TOGETHER = 1 << 19, 512

_OTHER_SPACE = re.compile(r"[^\S \n]")
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True
_ALNUM, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'_"]] = True


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A byte-level BPE tokenizer with a memory of words.

    Its pre-tokenizer always cuts before white space that follows another
    character, and between an ASCII letter or digit and a sign other than the
    apostrophe, so a text's ids are those of its pieces in turn.  Pieces are
    found and hashed (64 bits) for a block of texts at once; the library encodes
    those that are not remembered.  A text with white space other than space
    and line feed, or with a token that was added to the vocabulary, is encoded
    by the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        #: Bytes of each token: in this kind of vocabulary a character stands for a byte.
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes[k] = len(token)
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([_OTHER_SPACE.pattern, *map(re.escape, added)]))
        self._forget()

    def _forget(self) -> None:
        """Words are kept as sorted hashes with a place and a size in a pool of ids; new ones wait in a dict."""
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.recent: dict[int, tuple[int, int]] = {}

    def _settle(self) -> None:
        """Move the waiting words to the sorted ones."""
        hashes = np.fromiter(self.recent, np.uint64, len(self.recent))
        places = np.array(list(self.recent.values()), np.int64).reshape(-1, 2)
        order = np.argsort(hashes)
        spot = np.searchsorted(self.hash, hashes[order])
        self.hash = np.insert(self.hash, spot, hashes[order])
        self.at, self.size = np.insert(self.at, spot, places[order, 0]), np.insert(self.size, spot, places[order, 1])
        self.recent = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words; those that begin with a gap and end without are encoded many together, and cut by their bytes."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(words)
        joint = [k for k, w in enumerate(words) if _GAP[w[0]] and not _GAP[w[-1]]]
        alone = [k for k, w in enumerate(words) if not (_GAP[w[0]] and not _GAP[w[-1]])]
        groups = [joint[i : i + TOGETHER] for i in range(0, len(joint), TOGETHER)]
        for group, ids in zip(groups, self._library([b"".join(words[k] for k in g).decode() for g in groups]), strict=True):
            ends, cuts = np.cumsum(self.bytes[ids]), np.cumsum([len(words[k]) for k in group])
            spot = np.searchsorted(ends, cuts)
            if not np.array_equal(ends[spot], cuts):
                raise ValueError("the tokenizer does not cut before white space")
            for k, own in zip(group, np.split(ids, spot[:-1] + 1), strict=True):
                out[k] = own
        for k, ids in zip(alone, self._library([words[k].decode() for k in alone]), strict=True):
            out[k] = ids
        return out

    def _places(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of distinct words, the new ones encoded."""
        order = np.argsort(hashes)
        spot = np.minimum(np.searchsorted(self.hash, hashes[order]), max(0, len(self.hash) - 1))
        known = self.hash[spot] == hashes[order] if len(self.hash) else np.zeros(len(hashes), bool)
        at, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        if len(self.hash):
            at[order], size[order] = self.at[spot], self.size[spot]
        rest = order[~known]
        keys = hashes[rest].tolist()
        new = [(k, h) for k, h in zip(rest.tolist(), keys, strict=True) if h not in self.recent]
        found = self._new([raw[start[k] : end[k]] for k, _ in new])
        if found:
            flat = np.concatenate(found)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(flat)), self.dtype)])
            self.pool[self.used : self.used + len(flat)] = flat
            for (_, h), ids in zip(new, found, strict=True):
                self.recent[h] = self.used, len(ids)
                self.used += len(ids)
        if keys:
            at[rest], size[rest] = np.array([self.recent[h] for h in keys], np.int64).T
        if len(self.recent) > 1 << 16:
            self._settle()
        return at, size

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = [t.encode() for t in texts]
        raw = b"".join(raws)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        if not raw:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        gap = _GAP[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (gap[1:] & ~gap[:-1]) | (_SIGN[data[1:]] & _ALNUM[data[:-1]])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        code, distinct = pd.factorize(hash_spans(data, start, end).view(np.int64))
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        at, size = self._places(distinct.view(np.uint64), raw, start[first], end[first])
        size = size[code]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(at[code] - total[:-1], size)]
        if len(self.hash) + len(self.recent) > MEMO_WORDS:
            self._forget()
        return ids, np.diff(total[np.searchsorted(start, offsets)])

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``end_id`` behind it if one is given, and their numbers; null is empty."""
        plain = [t or "" for t in texts]
        whole = [k for k, t in enumerate(plain) if self.special.search(t)]
        ids, counts = self._pieces([("" if self.special.search(t) else t) for t in plain] if whole else plain)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, own in zip(whole, self._library([plain[k] for k in whole]), strict=True):
                parts[k], counts[k] = own, len(own)
            ids = np.concatenate(parts)
        if end_id is None:
            return ids, counts
        counts = counts + 1
        out = np.full(len(ids) + len(counts), end_id, self.dtype)
        text = np.ones(len(out), bool)
        text[np.cumsum(counts) - 1] = False
        out[text] = ids
        return out, counts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass(frozen=True)
class Format:
    """The layout of the files of one output."""

    dtype: str
    length: int = LENGTH
    batch: int = BATCH

    @property
    def schema(self) -> pa.Schema:
        ids = pa.from_numpy_dtype(np.dtype(self.dtype))
        return pa.schema([("ids", pa.list_(ids, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

    def sequences(self, ids: np.ndarray) -> pa.RecordBatch:
        """Whole sequences of ``ids``, the last one padded."""
        n = -(-len(ids) // self.length)
        flat = np.zeros(n * self.length, self.dtype)
        flat[: len(ids)] = ids
        mask = pa.array(np.arange(n * self.length) < len(ids))
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
            pa.FixedSizeListArray.from_arrays(mask, self.length),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Documents in order, some ``BLOCK_CHARS`` characters of text together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write(folder: str, vocabulary: str, length: int, batch: int, end_id: int):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        enc = encoder(vocabulary)
        layout = Format(enc.dtype.str, length, batch)
        whole = layout.length * layout.batch
        held, start = np.zeros(0, enc.dtype), 0
        index_sink = data_sink = None
        for keys, texts in blocks(batches):
            if data_sink is None:
                data_sink, index_sink = (store.open_output_stream(f"{name}.{x}.tmp") for x in ("ids", "docs"))
                data, index = pa.ipc.new_stream(data_sink, layout.schema), pa.ipc.new_stream(index_sink, INDEX)
            ids, counts = enc.encode(texts, end_id)
            starts = start + np.concatenate([[0], np.cumsum(counts)])
            columns = [pa.array(keys, pa.int64()), pa.array(starts[:-1]), pa.array(counts)]
            index.write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))
            start = int(starts[-1])
            held = np.concatenate([held, ids])
            while len(held) >= whole:
                data.write_batch(layout.sequences(held[:whole]))
                held = held[whole:]
        if data_sink is None:
            return
        if len(held):
            data.write_batch(layout.sequences(held))
        for x in (data, index, data_sink, index_sink):
            x.close()
        for x in ("ids", "docs"):
            store.move(f"{name}.{x}.tmp", f"{name}.{x}.arrows")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([os.path.basename(name)]), pa.array([start], pa.int64())],
            ["part", "name", "n_tokens"],
        )

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    length: int = LENGTH,
    batch: int = BATCH,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode all texts in ascending doc_id order into ``folder``; returns the manifest (name, start, n_tokens).

    ``start`` counts the ids in the files before.  Null texts are empty, and
    every document, empty or not, ends with ``end_id``.  Rows without doc_id
    come first; rows of one doc_id stand in the order of a hash of their texts.
    Very long texts are encoded whole.  Other columns, whatever their names, are
    ignored; an empty table writes no file.

    The manifest has one row for each range of documents, by which texts are
    dealt in one shuffle; only these rows pass the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    task = _write(folder, vocabulary, length, batch, end_id)
    done = sorted(map_arrow(ordered, task, "part int, name string, n_tokens long").collect())
    starts = np.concatenate([[0], np.cumsum([x.n_tokens for x in done], dtype=np.int64)]).tolist()
    rows = [(x.name, s, x.n_tokens) for x, s in zip(done, starts, strict=False)]
    return spark.createDataFrame(rows, "name string, start long, n_tokens long").repartition(max(1, len(rows)))


class Sequences:
    """Random access to the sequences of one file on a local or mounted disk, by a memory map.

    Opening it reads the batches' headers alone.  ``sequences[i]`` gives the ids
    and the mask of a sequence as views of the map: no byte of them is copied.
    """

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.batches = pa.ipc.open_stream(self.map).read_all().to_batches()
        self.each = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return self.each * (len(self.batches) - 1) + self.batches[-1].num_rows if self.batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, k = self.batches[i // self.each], i % self.each
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        return ids.values.slice(k * n, n).to_numpy(zero_copy_only=True), mask.values.slice(k * n, n)


def read_file(store: fs.FileSystem, path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document of a file, with one batch and one document in memory."""

    def values() -> Iterator[np.ndarray]:
        with store.open_input_file(f"{path}.ids.arrows") as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                ids = np.asarray(batch.column(0).flatten())
                yield ids[np.asarray(batch.column(1).flatten())]

    source = values()
    held = next(source, np.zeros(0, np.uint16))
    with store.open_input_file(f"{path}.docs.arrows") as f, pa.ipc.open_stream(f) as index:
        for batch in index:
            for key, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [held]
                size = len(held)
                while size < n:
                    own.append(next(source))
                    size += len(own[-1])
                held = np.concatenate(own) if len(own) > 1 else held
                yield key, start, held[:n]
                held = held[n:]


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``ids_crc32`` is the unsigned crc32 of the document's ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for key, start, ids in read_file(store, f"{root}/{name}"):
                    rows.append((key, offset + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield _columns(rows)
                        rows = []
                if rows:
                    yield _columns(rows)

    return map_arrow(manifest, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary or vocabulary_path()), folder)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_output": op7_token_output}
ORACLE_SQL: dict[str, str] = {}
