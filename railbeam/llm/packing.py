"""Best-fit packing (operator 11): pieces of documents into sequences of a fixed length, online, in bounded space.

A document's ids, with an end id, are cut only if they are longer than a sequence: into full pieces, of which the
first may be shorter. Pieces are laid down (without their ids) and dealt over tasks by their number alone, a task for
every ``PIECES_PER_TASK``. A task packs its pieces in one pass with a fixed number of open bins:

* a bin is known by its free space; one stack of bins for each free space, and one bit in a bitset for each stack that
  is not empty. The lowest set bit from the length of a piece upwards is the bin it fits best, found at once;
* if no open bin has room, a new one is opened; when the number is reached, the fullest one, which is the lowest set
  bit of all, closes first and stays as it is. A bin without free space closes at once;
* pieces arrive by falling length within windows of ``WINDOW`` pieces, so long pieces of a window open the bins that
  its short ones fill. Bins stay open from window to window.

Memory is a window and the open bins, however many pieces there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import renamed, stored
from railbeam.llm.rans import encoder

OPEN_BINS, WINDOW = 8192, 8192
PIECES_PER_TASK = 20_000


class Packer:
    """Open bins of one stream of pieces. ``place`` gives (bin, offset); bins are numbered as they open."""

    def __init__(self, capacity: int, open_bins: int):
        if open_bins < 1:
            raise ValueError("at least one bin must be open")
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.with_room = 0
        self.held = 0
        self.opened = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.with_room ^= 1 << free
        self.held -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.with_room >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            into = self._take(free)
        else:
            if length < self.capacity and self.held == self.open_bins:
                self._take((self.with_room & -self.with_room).bit_length() - 1)
            free, into = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.stacks[left].append(into)
            self.with_room |= 1 << left
            self.held += 1
        return into, self.capacity - free


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row's ids."""
    slim = renamed(docs, doc_id=doc_id, text=text)
    names = ["piece", "start", "length", "ids_crc32"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, found = [], []
            for row, ids in enumerate(own.ids_of(x.as_py() for x in batch.column(1))):
                ids = np.concatenate((ids.astype("<u4"), end))
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append(row)
                    found.append((piece, a, b - a, crc32(ids[a:b].tobytes())))
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            ids_of = batch.column(0).take(pa.array(rows, pa.int64()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids_of, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (any columns, and ``length``) with ``sequence_id`` and ``offset``; no length may be over ``capacity``.

    A sequence's pieces lie in it from offset 0 without gaps. ``pieces`` should be a stored table, since it is read
    once to count it and once to deal it over tasks.
    """
    tasks = 1 + pieces.count() // PIECES_PER_TASK
    place = pieces.columns.index("length")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(capacity, open_bins), TaskContext.get().partitionId() << 33
        window: list[pa.RecordBatch] = []

        def filled() -> pa.RecordBatch:
            table = pa.Table.from_batches(window).combine_chunks()
            lengths = table.column(place).to_numpy()
            order = np.argsort(-lengths, kind="stable")
            places = np.array([packer.place(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2)
            window.clear()
            ordered = table.take(pa.array(order)).combine_chunks()
            columns = [*[c.combine_chunks() for c in ordered.columns], pa.array(places[:, 0] + first), pa.array(places[:, 1])]
            return pa.RecordBatch.from_arrays(columns, [*table.column_names, "sequence_id", "offset"])

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                if held and held + part.num_rows > WINDOW:
                    yield filled()
                    held = 0
                window.append(part)
                held += part.num_rows
        if held:
            yield filled()

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    return pieces.repartition(tasks).mapInArrow(of, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    A null or empty text is one piece that holds the end id alone. Null ids and repeated rows are packed each for
    itself, and an empty table gives an empty result. The result is written before it is returned: sequence numbers
    follow from the order in which a task met its pieces, so they must not be computed twice.
    """
    pieces = stored(pieces_of(docs, tokenizer_path, capacity, end_id, doc_id, text), "packing-pieces", "zstd")
    return stored(packed(pieces, capacity, open_bins), "packing", "zstd")
