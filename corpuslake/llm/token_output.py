"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the documents of one range of ids, in ascending order. Its ids are cut into blocks of
``BLOCK``; of each block the minimum is subtracted, the rest is packed at a width that holds
``PERCENTILE`` of the values, and what needs more bits goes to an exception list (position, high
bits). A table at the file's end holds where each block starts, so a reader can fetch any range.

Layout, little-endian: blocks; then int64 block starts, int64 document ids (nulls are flagged), uint8
null flags, int64 document lengths; then the footer (uint64 documents, ids, blocks, magic).
Block: uint32 minimum, uint8 width, uint16 values, uint16 exceptions, packed bits in lanes, uint16 positions,
uint32 high parts.

Files are written by the tasks into a shared folder under names that hold the task attempt; a
manifest lists the files of the attempts that succeeded, so tasks may run twice.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, shared_dir, written
from .library_tokens import library_tokens

BLOCK = 1024
PERCENTILE = 0.98
MAGIC = 0x31524F4650
HEAD, FOOT = struct.Struct("<IBHH"), struct.Struct("<QQQQ")


LANES = 32  # a block is packed as BLOCK / LANES rows of LANES values, each lane into its own 32-bit words


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``BLOCK`` ids each; the last may hold fewer (its packed part is filled up with its last id)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    group = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], ids.dtype)]).reshape(n, BLOCK)
    low = group.min(axis=1)
    rest = group - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    mark = np.partition(rest, at, axis=1)[:, at]
    widths = np.ceil(np.log2(mark.astype(np.float64) + 1)).astype(np.int64)
    blocks: list = [b""] * n
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        values = rest[own]
        plain = (values & np.uint32((1 << width) - 1)).reshape(len(own), -1, LANES)
        packed = np.zeros((len(own), width, LANES), np.uint32)
        for row in range(plain.shape[1] if width else 0):
            word, shift = divmod(row * width, 32)
            packed[:, word] |= plain[:, row] << np.uint32(shift)
            if shift + width > 32:
                packed[:, word + 1] |= plain[:, row] >> np.uint32(32 - shift)
        high = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        for k, block in enumerate(own):
            odd = np.flatnonzero(high[k])
            count = min(BLOCK, len(ids) - int(block) * BLOCK)
            blocks[block] = HEAD.pack(int(low[block]), width, count, len(odd)) + packed[k].tobytes() + odd.astype("<u2").tobytes() + high[k][odd].astype("<u4").tobytes()
    return blocks


def unpack_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """Values of the blocks at ``starts``, one after the other."""
    heads = [HEAD.unpack_from(data, at) for at in starts]
    out = np.zeros((len(starts), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = width * LANES
        packed = np.stack([np.frombuffer(data, "<u4", size, starts[k] + HEAD.size) for k in own]).reshape(len(own), width, LANES)
        values = np.zeros((len(own), BLOCK // LANES, LANES), np.uint32)
        for row in range(values.shape[1] if width else 0):
            word, shift = divmod(row * width, 32)
            values[:, row] = packed[:, word] >> np.uint32(shift)
            if shift + width > 32:
                values[:, row] |= packed[:, word + 1] << np.uint32(32 - shift)
        out[own] = values.reshape(len(own), BLOCK) & np.uint32((1 << width) - 1)
    for k, (low, width, _, odd) in enumerate(heads):
        if odd:
            at = starts[k] + HEAD.size + 4 * width * LANES
            out[k, np.frombuffer(data, "<u2", odd, at)] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(width)
        out[k] += np.uint32(low)
    counts = [h[2] for h in heads]
    if min(counts) == BLOCK:
        return out.reshape(-1)
    return np.concatenate([row[:n] for row, n in zip(out, counts)])


class FileWriter:
    def __init__(self, stream):
        self.stream, self.at, self.n_ids = stream, 0, 0
        self.starts: list[int] = []
        self.docs: list = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 4 * BLOCK * 256:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.waiting)
        whole = len(data) if last else len(data) // (4 * BLOCK) * (4 * BLOCK)
        for block in pack_blocks(np.frombuffer(data, "<u4", whole // 4)):
            self.starts.append(self.at)
            self.stream.write(block)
            self.at += len(block)
        self.waiting, self.size = [data[whole:]], len(data) - whole

    def close(self) -> None:
        self._flush(last=True)
        empty = np.array([d is None for d in self.docs], np.uint8)
        for part in (np.array([*self.starts, self.at], "<i8"), np.array([d or 0 for d in self.docs], "<i8"), empty, np.array(self.lengths, "<i8")):
            self.stream.write(part.tobytes())
        self.stream.write(FOOT.pack(len(self.docs), self.n_ids, len(self.starts), MAGIC))


class FileReader:
    """Random access to one file through its block starts."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        n_docs, self.n_ids, n_blocks, magic = FOOT.unpack(stream.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        tail = 8 * (n_blocks + 1) + 17 * n_docs
        data = stream.read_at(tail, size - FOOT.size - tail)
        self.starts = np.frombuffer(data, "<i8", n_blocks + 1)
        docs = np.frombuffer(data, "<i8", n_docs, 8 * (n_blocks + 1))
        empty = np.frombuffer(data, np.uint8, n_docs, 8 * (n_blocks + 1) + 8 * n_docs)
        self.docs = [None if e else int(d) for d, e in zip(docs, empty)]
        self.lengths = np.frombuffer(data, "<i8", n_docs, 8 * (n_blocks + 1) + 9 * n_docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        data = self.stream.read_at(int(self.starts[last] - self.starts[first]), int(self.starts[first]))
        found = unpack_blocks(data, (self.starts[first:last] - self.starts[first]).tolist())
        return found[start - first * BLOCK : stop - first * BLOCK]


def write_tokens(docs: DataFrame, vocab: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents under ``folder``; returns the manifest (one row per file).

    Files follow each other in ascending ``id_col`` (nulls first; rows of equal id lie together, by the
    hash of their text, then by the text). Null and empty texts have only the end id; very long texts are
    written whole, over as many blocks as they need. An empty table gives an empty manifest; other columns
    of ``docs`` are not read.
    """
    from pyarrow import fs

    def rows(batches) -> Iterator[list]:
        tokens, context, writer, stream = library_tokens(vocab), TaskContext.get(), None, None
        end = end_id.to_bytes(4, "little")
        path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.pfor"
        for doc_ids, texts in batches:
            if writer is None and texts:
                store, inner = fs.FileSystem.from_uri(path)
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                stream = store.open_output_stream(inner)
                writer = FileWriter(stream)
            for doc, coded in zip(doc_ids.to_pylist(), tokens.encode_all(texts, 2_000_000)):
                writer.add(doc, coded + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield [[context.partitionId()], [path], [len(writer.docs)], [writer.n_ids]]

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = chosen.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"), "text")
    files = written(by_text(dealt, rows, "file_no long, path string, n_docs long, n_ids long", "id", "text"), "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of a manifest: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``), one task per file."""
    from pyarrow import fs

    def rows(batches) -> Iterator[list]:
        for bases, paths in batches:
            for path, base in zip(paths, bases.to_pylist()):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as stream:
                    reader = FileReader(stream)
                    ends = np.cumsum(reader.lengths)
                    first = 0
                    while first < len(ends):  # some documents at a time, of about a million ids
                        begin = int(ends[first] - reader.lengths[first])
                        stop = max(first + 1, int(np.searchsorted(ends, begin + 1_000_000, "right")))
                        ids, out = reader.ids(begin, int(ends[stop - 1])), []
                        for k in range(first, stop):
                            a = int(ends[k] - reader.lengths[k])
                            own = ids[a - begin : int(ends[k]) - begin]
                            row = (reader.docs[k], base + a, len(own), zlib.crc32(own.astype("<u4", copy=False).tobytes()))
                            out.append((*row, own.astype(np.int32)) if with_ids else row)
                        first = stop
                        yield [list(c) for c in zip(*out)]

    kind = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # A stated number, so that adaptive execution doesn't merge the few rows of the manifest into one task.
    files = max(1, manifest.count())
    return by_text(manifest.select("path", "start").repartition(files, "path"), rows, kind, "start", "path").withColumnRenamed("id", id_col)


def store_and_read(docs: DataFrame, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files into the shared folder and reads every document back from them."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocab, folder, end_id, id_col, text_col), id_col)
