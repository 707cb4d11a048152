"""Bounded-space online packing: documents go into a fixed number of open windows.

1. Each partition is read once, in its order. A document's ids go, whole, to the open
   window with the least room that holds them. Where none does and another may be
   opened, it is. Else the fullest window leaves: the beginning of the document fills its room to
   the end, and the rest of the document looks for a place again. What is longer than a window fills windows of its own
   first. So a task holds `windows` windows of `capacity` ids, whatever it reads, and a window
   that leaves has no padding unless its room is below `least_piece`.
2. At a partition's end the emptiest open window is dealt to the others by the same rule,
   until one is left.
3. These leftovers, one a partition, are merged FAN partitions to a task and round by round in the same way.
   The last one is cut at powers of two, which need no padding.

Documents are never shuffled; the merging moves at most `capacity` ids a partition.

Defined results: null text is empty and still carries its end id; rows that share an id
are packed as separate documents, and a null id stays null; an empty table gives an empty
packing; other columns are not looked at. Which documents share a sequence depends on how
the table is dealt to partitions; what is promised does not.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import default_path, encode
from .common import stored

CAPACITY, END_ID, WINDOWS, FAN = 2048, 1, 32, 64
COLUMNS = "part BIGINT, no BIGINT, doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, ids BINARY"


class Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int, capacity: int, windows: int, least_piece: int, keep_ids: bool):
        self.part, self.capacity, self.windows, self.least_piece, self.keep_ids = part, capacity, windows, least_piece, keep_ids
        self.rooms: list[tuple[int, int]] = []  # (room, window), least room first
        self.open: dict[int, list[tuple]] = {}
        self.n_opened = self.n_left = self.n_rows = 0
        self.rows: list[tuple] = []

    def put(self, key: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.capacity:
                self._leave([(key, start, ids[: self.capacity], total)])
                start, ids = start + self.capacity, ids[self.capacity :]
                continue
            at = bisect_left(self.rooms, (len(ids), -1))
            if at == len(self.rooms) and len(self.rooms) >= self.windows:
                room, window = self.rooms.pop(0)
                pieces = self.open.pop(window)
                if room >= self.least_piece:
                    pieces.append((key, start, ids[:room], total))
                    start, ids = start + room, ids[room:]
                self._leave(pieces)
                continue
            if at == len(self.rooms):
                room, window = self.capacity, self.n_opened
                self.n_opened += 1
                self.open[window] = []
            else:
                room, window = self.rooms.pop(at)
            self.open[window].append((key, start, ids, total))
            if room == len(ids):
                self._leave(self.open.pop(window))
            else:
                insort(self.rooms, (room - len(ids), window))
            return

    def _leave(self, pieces: list[tuple], whole: bool = True) -> None:
        """A window leaves as a sequence of its own; with `whole` unset it goes on to be merged."""
        offset = 0
        for key, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((
                self.part, self.n_rows, key, start, len(ids), zlib.crc32(raw), total, (self.part << 32) + self.n_left if whole else None,
                offset if whole else None, raw if self.keep_ids or not whole else None,
            ))
            self.n_rows += 1
            offset += len(ids)
        self.n_left += whole

    def close(self, last: bool) -> None:
        """Merge the open windows into one, which is left open, or cut at powers of two if it is the `last`."""
        while len(self.rooms) > 1:
            _room, emptiest = self.rooms.pop()
            self.windows = len(self.rooms)
            for piece in self.open.pop(emptiest):
                self.put(*piece)
        for _room, window in self.rooms:
            pieces = self.open[window]
            if not last:
                self._leave(pieces, False)
                continue
            fill = sum(len(ids) for _k, _s, ids, _t in pieces)
            for power in (1 << b for b in reversed(range(fill.bit_length())) if fill >> b & 1):
                taken = []
                while power:
                    key, start, ids, total = pieces.pop(0)
                    if len(ids) > power:
                        pieces.insert(0, (key, start + power, ids[power:], total))
                        ids = ids[:power]
                    taken.append((key, start, ids, total))
                    power -= len(ids)
                self._leave(taken)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            kinds = [pa.int64()] * 9 + [pa.binary()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            self.rows = []


def window_pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, end_id: int = END_ID, least_piece: int = 1,
    fan: int = FAN, key: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece.

    ids: little-endian unsigned 32-bit integers with `keep_ids`, else null.
    """
    path = tokenizer or default_path()

    def fill(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), capacity, windows, least_piece, keep_ids)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), path)):
                    ids = np.frombuffer(raw + end, "<u2")
                    packer.put(k, 0, ids, len(ids))
                yield from packer.flush()
        packer.close(False)
        yield from packer.flush()

    def merge(first: int, last: bool):
        def merged(group):
            group = group.sort_by([("part", "ascending"), ("no", "ascending")])
            packer = Packer(first + group.column("part")[0].as_py() // fan, capacity, windows, least_piece, keep_ids)
            for piece in group.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                packer.put(piece["doc_id"], piece["start"], np.frombuffer(piece["ids"], "<u4"), piece["doc_tokens"])
            packer.close(last)
            return pa.Table.from_batches(list(packer.flush()))

        return merged

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = stored(source.mapInArrow(fill, COLUMNS), "packed-windows")
    out, left, first, used = packed.filter("sequence_id IS NOT NULL"), packed.filter("sequence_id IS NULL"), 0, 0
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1  # parts of a round are numbered from `first`
    while True:
        first, groups = first + parts, -(-parts // fan)
        numbered = left.withColumn("part", F.col("part") - used)
        merged = stored(numbered.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge(first, groups == 1), COLUMNS), "packed-leftovers")
        out = out.unionByName(merged.filter("sequence_id IS NOT NULL"))
        if groups == 1:
            return out.drop("part", "no")
        left, parts, used = merged.filter("sequence_id IS NULL"), groups, first
