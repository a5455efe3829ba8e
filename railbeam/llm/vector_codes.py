"""Vector code compression (operator 12): product codes learnt exactly, with boxes that spare most distances.

A vector of integers ``floor(scale * x)`` is cut into equal consecutive parts. The points of one part position are
put in the order of a Hilbert curve and cut into flat blocks of ``BLOCK`` points. A block stores its points, the
smallest and largest value of each component (its box), and its sums. In each round, and for each block:

* the distances between the box and the codebook entries give for every entry the least and the largest distance
  that a point of the block can have; an entry whose least is above the smallest of the largest is nearest to none
  of the points. The others, ties included, are the shortlist of the block;
* a block with one entry on its list adds its stored sums and count to that entry, with no look at its points;
* the points of other blocks are compared, in integers, with the entries of the list alone, in rising order, so
  that the lowest index wins a tie.

Blocks are made within a run of at most ``RUN_VALUES`` components of one input partition and written once, so no vector is
shuffled; the order within a run changes how much is spared, never a result. A round reads the blocks and sends one
row for each (part, entry) that a task has used to an aggregate; the codebook, entries times the vector's length,
is the only thing that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import forget, renamed, stored

#: Points of a block, and components of a run: 32,768 vectors of length 64.
BLOCK, RUN_VALUES = 16, 1 << 21
#: A scaled component may be as large as this, so that squares of differences add up in 64 bits.
LARGEST = 1 << 24
#: A label with over one in so many rows is joined by broadcast; there are fewer of these than this number.
HOT_LABELS = 1000
KEY_BITS, AXIS_BITS = 62, 10


@dataclass(frozen=True)
class VectorCodes:
    """``rows`` has (vec_id, label, code, error) of every kept vector, ``codebooks`` is (part, entry, component)."""

    rows: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point (n, axes) of non-negative integers on a Hilbert curve over as many bits as a key holds."""
    axes = min(points.shape[1], KEY_BITS)
    bits = max(1, min(AXIS_BITS, KEY_BITS // max(1, axes)))
    top = max(1, int(points.max(initial=0)).bit_length())
    x = [(points[:, a] >> max(0, top - bits)).astype(np.int64) for a in range(axes)]
    for level in range(bits - 1, 0, -1):  # undo the turns of the curve from the coarsest cell inward
        low = (1 << level) - 1
        for a in range(axes):
            turned = (x[a] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[a]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[a] = x[a] ^ swap if a else x[a]
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    flip = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0) if axes else 0
    keys = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in range(axes):
            keys = (keys << 1) | (((x[a] ^ flip) >> level) & 1)
    return keys


class Blocks:
    """The points of one part position in flat blocks: (components, points) in order, boxes and sums."""

    def __init__(self, points: np.ndarray):
        order = np.argsort(hilbert_keys(points - points.min(axis=0)), kind="stable")
        ordered, starts = points[order].T, np.arange(0, len(points), BLOCK)
        self.order, self.points = order, ordered
        self.low, self.high, self.sums = (np.stack([f.reduceat(c, starts) for c in ordered], axis=1) for f in (np.minimum, np.maximum, np.add))

    @classmethod
    def of(cls, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> Blocks:
        own = cls.__new__(cls)
        own.order, own.points, own.low, own.high, own.sums = order, points, low, high, sums
        return own

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(blocks, entries): whether the entry may be the nearest one of some point of the block."""
        least, most = np.zeros((2, len(self.low), len(entries)), np.int64)
        for low, high, entry in zip(self.low.T[..., None], self.high.T[..., None], entries.T, strict=True):
            outside = np.maximum(np.maximum(low - entry, entry - high), 0)
            across = np.maximum(entry - low, high - entry)
            least += outside * outside
            most += across * across
        return least <= most.min(axis=1, keepdims=True)

    def _compared(self, entries: np.ndarray, lists: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, nearest entry, squared distance) of all points of the chosen blocks."""
        places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        inside = places < self.points.shape[1]
        places, listed = places[inside], np.repeat(lists[blocks].T, BLOCK, axis=1)[:, inside]
        span = max(self.high.max(), entries.max()) - min(self.low.min(), entries.min())
        kind = np.int32 if len(self.points) * int(span) ** 2 < 1 << 31 else np.int64
        points, entries = self.points[:, places].astype(kind), entries.astype(kind)
        best, nearest = np.full(len(places), np.iinfo(kind).max, kind), np.zeros(len(places), np.uint8)
        for e, own in enumerate(listed):
            rows = np.flatnonzero(own)
            if len(rows):
                off = points[:, rows] - entries[e][:, None]
                apart = (off * off).sum(axis=0, dtype=kind)
                closer = apart < best[rows]
                rows = rows[closer]
                best[rows], nearest[rows] = apart[closer], e
        return places, nearest, best

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (entries) and sums (entries, components) of the points that are nearest to each entry."""
        lists = self.shortlists(entries)
        one = lists.sum(axis=1) == 1
        sizes = np.full(len(lists), BLOCK)
        sizes[-1] = self.points.shape[1] - BLOCK * (len(lists) - 1)
        only = lists[one].argmax(axis=1)
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        np.add.at(counts, only, sizes[one])
        np.add.at(sums, only, self.sums[one])
        places, nearest, _ = self._compared(entries, lists, np.flatnonzero(~one))
        counts += np.bincount(nearest, minlength=len(entries))
        for c, values in enumerate(self.points):  # doubles are exact here: a run has 2^21 values below 2^25
            sums[:, c] += np.bincount(nearest, values[places], len(entries)).astype(np.int64)
        return counts, sums

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each point, in the order the points were given."""
        lists = self.shortlists(entries)
        places, nearest, apart = self._compared(entries, lists, np.arange(len(lists)))
        codes, errors = np.empty(len(places), np.uint8), np.empty(len(places), np.int64)
        codes[self.order[places]], errors[self.order[places]] = nearest, apart
        return codes, errors


_KINDS = {"order": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def packed(points: np.ndarray) -> dict[str, bytes]:
    """The blocks of all part positions of ``points`` (vectors, parts, width)."""
    made = [Blocks(points[:, part]) for part in range(points.shape[1])]
    return {name: np.stack([getattr(one, name) for one in made]).astype(kind).tobytes() for name, kind in _KINDS.items()}


def unpacked(row: dict[str, bytes], parts: int, width: int) -> list[Blocks]:
    held = {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()}
    shapes = {"order": (parts, -1), "points": (parts, width, -1)}
    held = {name: values.reshape(shapes.get(name, (parts, -1, width))).astype(np.int64) for name, values in held.items()}
    return [Blocks.of(*[held[name][part] for name in _KINDS]) for part in range(parts)]


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """Scaled components, rounded down. Too large ones fail the job, as integer overflow does in Spark SQL."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component times {scale} is beyond {LARGEST}")
    return scaled.astype(np.int64)


def _runs(kept: DataFrame, parts: int, dim: int, scale: int) -> DataFrame:
    """One row for each run of vectors: their ids and labels, and the blocks of all part positions."""
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    longest = max(1, RUN_VALUES // dim)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run() -> pa.RecordBatch:
            ids, vectors, labels = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
            points = whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(ids), parts, -1)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own) for own in (ids, labels)]
            blocks = [pa.array([value], pa.binary()) for value in packed(points).values()]
            held.clear()
            return pa.RecordBatch.from_arrays([*lists, *blocks], ["vec_ids", "labels", *_KINDS])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, longest):
                piece = batch.slice(at, longest)
                if size + piece.num_rows > longest:
                    yield run()
                    size = 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield run()

    binaries = ", ".join(f"{name} binary" for name in _KINDS)
    return kept.select("vec_id", "embedding", "label").mapInArrow(of, f"vec_ids array<{id_type}>, labels array<{label_type}>, {binaries}")


def _round(runs: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries that are nearest to no point stay."""
    parts, _, width = codebooks.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                for part, blocks in enumerate(unpacked(batch.slice(at, 1).to_pylist()[0], parts, width)):
                    n, total = blocks.totals(codebooks[part])
                    counts[part] += n
                    sums[part] += total
        part, entry = np.nonzero(counts)
        totals = pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), totals], ["part", "entry", "n", "sums"])

    used = runs.select(*_KINDS).mapInArrow(of, "part long, entry long, n long, sums array<long>")
    whole = used.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[c]) for c in range(width)]).alias("sums"))
    moved = codebooks.copy()
    for row in whole.collect():  # at most one row for each part and entry
        moved[row["part"], row["entry"]] = [total // row["n"] for total in row["sums"]]
    return moved


def _assigned(runs: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the runs."""
    parts, _, width = codebooks.shape
    id_type, label_type = (runs.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = (batch.column(name)[at].values for name in ("vec_ids", "labels"))
                codes, errors = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for part, blocks in enumerate(unpacked(batch.select(list(_KINDS)).slice(at, 1).to_pylist()[0], parts, width)):
                    codes[:, part], apart = blocks.assigned(codebooks[part])
                    errors += apart
                digits = codes.tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return runs.mapInArrow(of, f"vec_id {id_type}, label {label_type}, code string, error long")


def encode(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> VectorCodes:
    """Codes of all vectors by codebooks that ``rounds`` of exact assignment and averaging have made.

    Rows whose vector is null, has a null or non-finite component, or has no components are dropped. Vectors must
    be as long as the kept one with the smallest id, a multiple of ``parts``; others are dropped as well. The first
    ``entries`` kept ids, in ascending order with nulls last and equal ids by their vectors, start the codebooks;
    fewer rows give fewer entries. Null ids, null labels and repeated rows are kept, each row for itself. An empty
    table gives no rows and empty codebooks. Only the three named columns are read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    slim = renamed(vectors, vec_id=vec_id, embedding=embedding, label=label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = slim.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = usable.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding", F.size("embedding").alias("dim"))
    start = first.limit(entries).collect()
    if not start:
        none = usable.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return VectorCodes(none, np.zeros((parts, 0, 0), np.int64))
    dim = start[0]["dim"]
    kept = usable.where(F.size("embedding") == dim)
    if any(row["dim"] != dim for row in start):  # other lengths among the first ids
        start = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    values = np.array([row["embedding"] for row in start], np.float64)
    codebooks = whole_numbers(values, scale).reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    runs = stored(_runs(kept, parts, dim, scale), "vector-runs", "zstd")
    for _ in range(rounds):
        codebooks = _round(runs, codebooks)
    rows = stored(_assigned(runs, codebooks), "vector-codes", "zstd")
    forget(runs)
    return VectorCodes(rows, codebooks)


def decode(codes: VectorCodes, scale: int = 256) -> DataFrame:
    """(vec_id, vector): what the codes stand for, each component the lower end of its step."""
    parts, entries, width = codes.codebooks.shape
    books = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in entry]) for entry in book]) for book in codes.codebooks])
    digits = [F.conv(F.substring("code", 1 + 2 * p, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.rows.select("vec_id", F.concat(*[books[p][digit] for p, digit in enumerate(digits)]).alias("vector"))


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over rows of equal label; null labels count as equal.

    Sums are made before they meet the rows. Labels with over a thousandth of all rows, which are under a thousand,
    are joined by broadcast; no other label can fill a task.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = stored(sums.withColumnRenamed("label", "own"), "vector-labels")
    limit = (sums.agg(F.sum("n")).first()[0] or 0) // HOT_LABELS
    same = F.col("label").eqNullSafe(F.col("own"))
    hot, rest = sums.where(F.col("n") > limit).drop("n"), sums.where(F.col("n") <= limit).drop("n")
    out = [*rows.columns, "label_error"]
    by_broadcast = rows.join(F.broadcast(hot), same).select(*out)
    few = rows.join(F.broadcast(hot.select("own")), same, "left_anti").join(rest, same).select(*out)
    return by_broadcast.unionByName(few)
