"""Packing token ids into fixed windows: bounded-space online best fit.

Each task keeps a fixed number of open windows.  A document goes into the open
window that it fits best; when none has room, the fullest window is closed and
a new one opened.  Documents longer than a window first give whole windows.
What is open at a task's end is merged, a bounded number of tasks at a time:
there the emptiest windows are cut to fill the fullest ones exactly, and the
one window that stays unfilled is cut at powers of two, which need no padding.

Defined cases: a null or empty text is a document of the end id alone; null
and repeated document ids are packed row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched_by_bytes, written
from .tokens import encoder, slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


class OpenWindows:
    """A fixed number of open windows; ``place`` says what had to be closed.

    A piece is ``[doc_id, start, ids, doc_tokens]``.
    """

    def __init__(self, size: int, count: int):
        self.size, self.count = size, count
        self.by_room: list[tuple[int, int]] = []  # (free, window number), ascending
        self.held: dict[int, list[list]] = {}
        self.made = 0

    def place(self, piece: list) -> list[tuple[int, list[list]]]:
        """Put a piece of at most ``size`` ids; returns the windows closed by that."""
        closed, n = [], len(piece[2])
        at = bisect_left(self.by_room, (n, -1))
        if at < len(self.by_room):
            free, w = self.by_room.pop(at)
        else:
            if len(self.by_room) >= self.count:
                _, fullest = self.by_room.pop(0)
                closed.append((fullest, self.held.pop(fullest)))
            free, w = self.size, self.made
            self.made += 1
            self.held[w] = []
        self.held[w].append(piece)
        if free > n:
            insort(self.by_room, (free - n, w))
        else:
            closed.append((w, self.held.pop(w)))
        return closed

    def rest(self) -> list[tuple[int, list[list]]]:
        return sorted(self.held.items())


def fill_by_cutting(windows: list[list[list]], size: int) -> list[list[list]]:
    """Merge windows so that all are full but the last parts, cut at powers of two."""
    fill = lambda w: sum(len(p[2]) for p in w)
    todo = sorted(windows, key=lambda w: (-fill(w), [p[:2] for p in w if p[0] is not None]))
    lo, hi, out = 0, len(todo) - 1, []
    while lo < hi:
        gap = size - fill(todo[lo])
        while gap and lo < hi:
            giver = todo[hi]
            fits = [k for k, p in enumerate(giver) if len(p[2]) <= gap]
            if fits:
                piece = giver.pop(max(fits, key=lambda k: len(giver[k][2])))
            else:
                doc, start, ids, total = giver.pop()
                piece = [doc, start, ids[:gap], total]
                giver.append([doc, start + gap, ids[gap:], total])
            todo[lo].append(piece)
            gap -= len(piece[2])
            if not giver:
                hi -= 1
        if not gap:
            out.append(todo[lo])
            lo += 1
    if lo <= hi and todo[lo]:
        out += _at_powers(todo[lo], size)
    return out


def _at_powers(window: list[list], size: int) -> list[list[list]]:
    """Cut one window into sequences whose lengths are ``size`` or powers of two."""
    left, pieces, out = sum(len(p[2]) for p in window), list(window), []
    while left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        left -= room
        now: list[list] = []
        while room:
            doc, start, ids, total = pieces.pop(0)
            now.append([doc, start, ids[:room], total])
            if len(ids) > room:
                pieces.insert(0, [doc, start + room, ids[room:], total])
            room -= len(now[-1][2])
        out.append(now)
    return out


def _rows(window: list[list], number: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window:
        out.append((doc, start, len(ids), _crc(ids), total, number, offset))
        offset += len(ids)
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = 64,
    merged_tasks: int = 4,
    spaces_matter: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    ``sequence_id`` holds the task (or group of tasks) in its upper bits.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, open_ = encoder(tokenizer_path, spaces_matter), TaskContext.get().partitionId(), OpenWindows(size, open_windows)
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")] + [("ids", pa.binary())])

        def batch(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([task] * len(rows), pa.int64()), pa.array(ids, pa.binary())], schema=schema)

        for b in batches:
            for some in slices(b, 1):
                rows: list[tuple] = []
                flat, ends = enc.encode_ended(some.column(1), end_id)
                for doc, lo, hi in zip(some.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    n = hi - lo
                    whole = n - n % size
                    for start in range(0, whole, size):
                        rows += _rows([[doc, start, flat[lo + start : lo + start + size], n]], task << 32 | open_.made)
                        open_.made += 1
                    if whole < n:
                        for w, pieces in open_.place([doc, whole, flat[lo + whole : hi].copy(), n]):
                            rows += _rows(pieces, task << 32 | w)
                if rows:
                    yield batch(rows, [None] * len(rows))
        enc.settle()
        rows, kept = [], []
        for w, pieces in open_.rest():
            rows += _rows(pieces, task << 32 | w)
            kept += [p[2].astype("<u4").tobytes() for p in pieces]
        yield batch(rows, kept)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        windows: dict[int, list[list]] = {}
        for r in pdf.sort_values(["sequence_id", "offset"]).itertuples():
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            windows.setdefault(r.sequence_id, []).append([doc, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens])
        group, out = 1 << 62 | int(pdf["task"].iloc[0]) // merged_tasks << 32, []
        for k, w in enumerate(fill_by_cutting(list(windows.values()), size)):
            out += _rows(w, group | k)
        names = [x.split()[0] for x in PIECE.split(", ")]
        made = pd.DataFrame(out, columns=names)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = written(batched_by_bytes(narrow).mapInArrow(online, PIECE + ", task long, ids binary"), "packed")
    names = [x.split()[0] for x in PIECE.split(", ")]
    done = placed.filter("ids is null").select(*names)
    group = F.floor(F.col("task") / merged_tasks)
    return done.unionByName(placed.filter("ids is not null").groupBy(group.alias("tasks")).applyInPandas(merge, PIECE))
