"""Operator 12: token ids in files of fixed-width bits.

Every id takes the minimum number of bits that the vocabulary needs.  A file holds
the ids of many documents one after the other, in blocks of a fixed number of ids
that start at whole bytes, and ends with the block offsets, their checksums and the
index of documents, so any range of ids is read from the blocks that hold it:

    header    magic, bits, ids in a block (16 bytes)
    blocks    ids packed from the lowest bit up; the last block may be shorter
    footer    block offsets (blocks + 1), block CRCs, document ids, null marks, document ends
    trailer   ids, documents, blocks, footer offset, magic (40 bytes)

All numbers are little-endian.  Eight ids of w bits are w bytes, so packing and
unpacking are 8 + w numpy operations over whole blocks, for any width to 32 bits.

Ranges of the document id, one a file, come from a pass over the ids alone; a range also
splits an id that many rows share.  Documents are then encoded in place, sent once, as
ids, to the task of their range, and sorted there, so files in order hold the documents
in order.
Tasks name their file anew in each attempt and return a row about it: those rows are
the manifest, so files of lost attempts are never read.  Files stand in a folder that
all executors share (any store that Arrow's file systems reach).

Defined results: a null text is the empty text (the end id alone); null ids come
first; repeated ids stand in the order of a hash of their text, then as read; an empty table gives no files and an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .textops import text_slices
from .vocab import vocabulary

MAGIC = b"NDBITS01"
BLOCK_IDS = 1 << 16
#: Bytes of text in a file (about 32 MB of ids at 16 bits); small tables have smaller files, one for each core.
FILE_BYTES = 1 << 26
#: Ids that a reading task unpacks at a time.
READ_IDS = 1 << 20


def width(size: int) -> int:
    """Least number of bits for the ids 0 .. size - 1."""
    return max(1, int(size - 1).bit_length())


def _overlaps(bits: int) -> Iterator[tuple[int, int, int]]:
    """(id, byte, shift) of eight ids in ``bits`` bytes: the id's bits move up by ``shift`` (down if negative) into the byte."""
    for i in range(8):
        for byte in range(i * bits // 8, (i * bits + bits - 1) // 8 + 1):
            yield i, byte, i * bits - 8 * byte


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of ``bits`` bits each, from the lowest bit up, filled to a whole byte."""
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), np.uint32)
    rows.reshape(-1)[:n] = ids
    if n and int(rows.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    out = np.zeros((len(rows), bits), np.uint8)
    for i, byte, shift in _overlaps(bits):
        part = rows[:, i] << np.uint32(shift) if shift >= 0 else rows[:, i] >> np.uint32(-shift)
        out[:, byte] |= part.astype(np.uint8)
    return out.tobytes()[:-(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of `pack`."""
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, np.uint8)
    raw[:len(data)] = np.frombuffer(data, np.uint8)
    raw = raw.reshape(rows, bits).astype(np.uint32)
    out = np.zeros((rows, 8), np.uint32)
    for i, byte, shift in _overlaps(bits):
        # bits above the width fall off below
        out[:, i] |= raw[:, byte] >> np.uint32(shift) if shift >= 0 else raw[:, byte] << np.uint32(-shift)
    return out.reshape(-1)[:n] & np.uint32((1 << bits) - 1)


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder or file named by a path or URI."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


class Writer:
    """Appends documents to one file; holds one block and the index."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids <= 0 or block_ids % 8:
            raise ValueError("a block holds a multiple of eight ids")
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.offsets, self.crcs = [16], []
        self.keys, self.ends = [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        out.write(MAGIC + np.array([bits, block_ids], "<u4").tobytes())

    def append(self, keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents one after the other: their ids' keys, numbers of ids, and all ids."""
        self.keys += keys
        self.ends.append(self.n_ids + np.cumsum(sizes))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % self.block_ids
            for lo in range(0, whole, self.block_ids):
                self._block(every[lo:lo + self.block_ids])
            self.held, self.n_held = [every[whole:].copy()], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))
        self.crcs.append(zlib.crc32(data))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        ends = np.concatenate([np.empty(0, "<u8"), *self.ends]).astype("<u8")
        self.out.write(b"".join([np.array(self.offsets, "<u8").tobytes(), np.array(self.crcs, "<u4").tobytes(), keys.tobytes(), null.tobytes(), ends.tobytes()]))
        self.out.write(np.array([self.n_ids, len(keys), len(self.crcs), self.offsets[-1]], "<u8").tobytes() + MAGIC)
        self.out.close()


class TokenFile:
    """One file: its documents and any range of its ids."""

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        head, tail = self.file.read_at(16, 0), self.file.read_at(40, size - 40)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.bits, self.block_ids = np.frombuffer(head[8:], "<u4").tolist()
        self.n_ids, self.n_docs, blocks, footer = np.frombuffer(tail[:32], "<u8").tolist()
        raw = self.file.read_at(size - 40 - footer, footer)
        parts, at = [], 0
        for kind, n in (("<u8", blocks + 1), ("<u4", blocks), ("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        self.offsets, self.crcs, self.keys, self.null, ends = parts
        self.bounds = np.concatenate(([0], ends.astype(np.int64)))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids [lo, hi) of the file, from the blocks that hold them."""
        if not 0 <= lo <= hi <= self.n_ids:
            raise IndexError(f"[{lo}, {hi}) of {self.n_ids} ids")
        if lo == hi:
            return np.empty(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        start = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - start, start)
        for b in range(first, last + 1):
            if zlib.crc32(data[int(self.offsets[b]) - start:int(self.offsets[b + 1]) - start]) != self.crcs[b]:
                raise ValueError(f"block {b} is damaged")
        # whole blocks are multiples of eight ids, so blocks side by side are one packed string
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        return unpack(data, n, self.bits)[lo - first * self.block_ids:hi - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document number k."""
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))

    def runs(self, limit: int = READ_IDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents that hold at most ``limit`` ids (one document at least)."""
        lo = 0
        while lo < self.n_docs:
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + limit, "right")) - 1)
            yield lo, hi
            lo = hi


def _place(key: int | None, tie: int, row: int) -> tuple:
    return (key is not None, key or 0, tie, row)


def _encoder(path: str, pattern: str, end_id: int | None, kind: str, bounds_of_files: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                ids, bounds = vocab.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                small = ids.astype(kind)
                stored = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((bounds * small.itemsize).astype(np.int64)), pa.py_buffer(small)])
                order = [batch.column(c).slice(lo, hi - lo) for c in ("key", "tie", "row")]
                file = [bisect_right(bounds_of_files, _place(*x)) for x in zip(*(c.to_pylist() for c in order))]
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), *order, pa.array(np.diff(bounds)), stored.cast(pa.binary())],
                                                 names=["file", "key", "tie", "row", "n", "ids"])
    return run


def _file_writer(folder: str, bits: int, kind: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, writer, number = f"{uuid.uuid4().hex}.ids", None, 0
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                store.create_dir(base, recursive=True)
                writer = Writer(store.open_output_stream(f"{base}/{name}"), bits, block_ids)
                number = batch.column("file")[0].as_py()
            column = batch.column("ids").cast(pa.large_binary())
            _, offsets, values = column.buffers()
            bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
            ids = np.frombuffer(values, kind, (bounds[-1] - bounds[0]) // np.dtype(kind).itemsize, bounds[0]) if values is not None else np.empty(0, kind)
            writer.append(batch.column("key").to_pylist(), batch.column("n").to_numpy(), ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.n_ids], pa.int64()), pa.array([number], pa.int32())], names=["name", "n_ids", "file"])
    return run


def write(docs: DataFrame, vocab_path: str, pattern: str, folder: str | None = None, end_id: int | None = 2, file_bytes: int = FILE_BYTES,
          block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents by ascending id; the manifest: (path, n_ids, start), one row a file, in order.

    ``folder``: shared by all executors; unset, a new one under the session's checkpoint folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    bits = width(len(vocabulary(vocab_path, pattern).token_bytes))
    if end_id is not None and end_id >> bits:
        raise ValueError(f"the end id {end_id} needs more than {bits} bits")
    kind = "<u2" if bits <= 16 else "<u4"
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("key"), text.alias("text")).select("key", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, spark.sparkContext.defaultParallelism, -(-total // file_bytes))
    ranges = own.drop("text").repartitionByRange(files, F.col("key").asc_nulls_first(), F.col("tie"), F.col("row"))
    # the first row of each range: one row a file
    lows = ranges.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("key").isNotNull().alias("there"), "key", "tie", "row")).alias("low")).collect()
    bounds = sorted(_place(r["low"]["key"], r["low"]["tie"], r["low"]["row"]) for r in lows)[1:]
    shape = "file int, key long, tie long, row long, n long, ids binary"
    coded = own.mapInArrow(_encoder(vocab_path, pattern, end_id, kind, bounds), shape)
    dealt = coded.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "row")
    written = materialize(dealt.mapInArrow(_file_writer(folder, bits, kind, block_ids), "name string, n_ids long, file int"), "op12-manifest")
    # one row a file: the start of each is the sum of those before
    found = written.orderBy("file").collect()
    starts = np.concatenate(([0], np.cumsum([r["n_ids"] for r in found], dtype=np.int64))).tolist()
    return spark.createDataFrame([(f"{folder}/{r['name']}", r["n_ids"], s) for r, s in zip(found, starts)], "path string, n_ids long, start long")


def _file_reader(with_ids: bool):
    names = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(path)
                for lo, hi in file.runs():
                    bounds = file.bounds[lo:hi + 1]
                    ids = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    at = bounds - bounds[0]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
                    columns = [pa.array(file.keys[lo:hi], mask=file.null[lo:hi].astype(bool)), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def read(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document in the files of a manifest, a task a file."""
    files = manifest.count()
    shape = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    dealt = manifest.select("path", "start").repartition(max(1, files))
    return dealt.mapInArrow(_file_reader(with_ids), shape).withColumnRenamed("key", id_col)
