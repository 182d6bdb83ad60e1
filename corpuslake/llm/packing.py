"""Packing documents into training sequences by the sum-of-squares rule.

Documents come one by one. What fills whole windows of ``size`` ids is cut off at once; the rest of
the document is placed into the fill level that makes the sum of squared counts of partly filled
windows smallest. A level array holds how many windows stand at each level. Where more than ``most``
windows are open, two of the level that holds the most of them are joined (which lowers the sum of
squares, too), so memory is bounded; what the rule places next is not touched by that. At a
partition's end the windows that are still open are topped up: ids are cut from the emptiest and
moved into the fullest, so at most one window stays partly filled; that one is cut at powers of two,
where sequences need no padding.

Each partition packs on its own, so nothing is shuffled, and a task that runs again after a lost
executor packs only its own rows. Sequence ids hold the partition's number in their upper bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_text
from .library_tokens import library_tokens


class Packer:
    """Places pieces ``(doc, start, ids, doc_tokens)`` into windows; ``done`` gets finished windows."""

    def __init__(self, size: int, most: int = 4096):
        self.size, self.most, self.n_open = size, max(most, size), 0
        self.levels = np.zeros(size + 1, np.int64)  # windows at each fill; empty and full ones are not counted
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.done: list[list[tuple]] = []

    def add(self, doc, ids: np.ndarray, total: int) -> None:
        start, size = 0, self.size
        while len(ids) - start >= size:
            self.done.append([(doc, start, ids[start : start + size], total)])
            start += size
        if start < len(ids):
            self._place((doc, start, ids[start:], total))

    def _place(self, piece: tuple) -> None:
        n, size, levels = len(piece[2]), self.size, self.levels
        # Change of the sum of squares, halved: leaving level h gives 1/2 - N(h), reaching h+n gives N(h+n) + 1/2.
        change = levels[n : size + 1] - levels[: size + 1 - n] + 1.0
        change[0] = levels[n] + 0.5
        change[size - n] = 0.5 - levels[size - n]
        change[1:][levels[1 : size + 1 - n] == 0] = np.inf
        best = int(change.argmin())
        if best:
            window = self._opened(best)
        else:
            window = []
        window.append(piece)
        self._put(window, best + n)
        if self.n_open > self.most:
            self._join(int(levels.argmax()))

    def _opened(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: list, level: int) -> None:
        if level == self.size:
            self.done.append(window)
        elif level:
            self.open[level].append(window)
            self.levels[level] += 1
            self.n_open += 1

    def _join(self, level: int) -> None:
        """Moves ids from one window of a level into another (more windows are open than levels, so there are two)."""
        giver, taker = self._opened(level), self._opened(level)
        moved = min(level, self.size - level)
        self._put(taker + self._cut(giver, moved), level + moved)
        self._put(giver, level - moved)

    def close(self) -> None:
        """Tops up the open windows from each other; what is left is cut at powers of two."""
        size = self.size
        windows = [(fill, w) for fill in range(size - 1, 0, -1) for w in self.open[fill]]
        self.open = [[] for _ in range(size + 1)]
        self.levels[:] = self.n_open = 0
        low, high = 0, len(windows) - 1
        while low < high:
            fill, window = windows[low]
            left, giver = windows[high]
            need = size - fill
            moved = self._cut(giver, min(need, left))
            window += moved
            taken = sum(len(p[2]) for p in moved)
            windows[high] = (left - taken, giver)
            windows[low] = (fill + taken, window)
            if left == taken:
                high -= 1
            if fill + taken == size:
                self.done.append(window)
                low += 1
        if low == high:
            fill, window = windows[low]
            while fill:
                part = 1 << (fill.bit_length() - 1)
                self.done.append(self._cut(window, part))
                fill -= part

    @staticmethod
    def _cut(window: list, n: int) -> list:
        """Takes ``n`` ids from the window's end, whole pieces first."""
        taken = []
        while n:
            doc, start, ids, total = window.pop()
            if len(ids) > n:
                keep = len(ids) - n
                window.append((doc, start, ids[:keep], total))
                doc, start, ids = doc, start + keep, ids[keep:]
            taken.append((doc, start, ids, total))
            n -= len(ids)
        return taken


PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str, size: int = 1024, end_id: int = 0, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int = 500_000) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    Ids are the tokenizers library's for ``vocab`` and ``end_id`` after them. Null and empty texts have
    only the end id; very long texts fill windows of their own and place the rest. Repeated rows and ids
    are packed each; null ids stay null; an empty table gives no rows; other columns of ``docs`` are not
    read. ``with_ids`` adds the ids (array<int>) of each piece. ``most`` bounds the open windows of a task,
    ``cache`` the parts of texts that a worker keeps with their ids; results do not depend on the latter.
    """

    def rows(batches) -> Iterator[list]:
        tokens, packer, number = library_tokens(vocab, cache), Packer(size, most), TaskContext.get().partitionId() << 36
        end = end_id.to_bytes(4, "little")

        def flushed() -> list:
            nonlocal number
            out, data = [], []
            for window in packer.done:
                at = 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids), zlib.crc32(ids), total, number, at))
                    data.append(ids)
                    at += len(ids)
                number += 1
            packer.done = []
            return [*map(list, zip(*out)), *([pa.array([d.astype(np.int32) for d in data], pa.list_(pa.int32()))] if with_ids else [])]

        for doc_ids, texts in batches:
            for doc, coded in zip(doc_ids.to_pylist(), tokens.encode_all(texts)):
                ids = np.frombuffer(coded + end, "<u4")
                packer.add(doc, ids, len(ids))
                if len(packer.done) >= 2000:
                    yield flushed()
        packer.close()
        if packer.done:
            yield flushed()

    kind = PIECE + (", ids array<int>" if with_ids else "")
    return by_text(docs, rows, kind, id_col, text_col).withColumnRenamed("id", id_col)
