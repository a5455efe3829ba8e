"""Importance resampling towards a target text (operator 13): array-scored weights, then a distributed radix sort.

Words and runs of words are features, hashed into buckets. One pass over the texts counts the buckets, a second one
adds up, for every text, the gains of its features: how much likelier a bucket is in the target than in the corpus.
Gumbel noise from a hash of the id makes the highest sums a draw without replacement by those weights.

The hash of a run is its CRC-32, and a CRC is linear: that of "a b" is that of "a", moved on by the length of " b",
xor that of " b". So each word is hashed once, runs follow by table look-ups over whole arrays of words.

Ranks come from a radix sort, least significant digit first, over the composite key (score falling, id rising). A pass
is a stable counting sort: rows are counted by block of positions and digit, prefix sums over (digit, block) give
where each digit of each block goes, and a row's next position is that plus its place among the rows of its own block
and digit. No pass needs more in one task than one block, whatever the keys, and ties keep their earlier order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbeam.llm.common import forget, renamed, stored

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bytes of text whose words are hashed at a time; a longer text is read in pieces of this size.
PIECE = 1 << 20
#: Rows of a block of positions, and bits of a digit.
BLOCK_ROWS, DIGIT_BITS = 1 << 13, 11

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# --- features -----------------------------------------------------------------------------------------------


def _crc_moves() -> tuple[np.ndarray, np.ndarray]:
    """Tables for moving a CRC register on: by 0..TABLED bytes, and by 2^k bytes; (moves, byte place, byte value)."""

    def tables(columns: np.ndarray) -> np.ndarray:
        """From the image of each of the 32 bits to the image of each byte at each of the four places."""
        found = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                found[place, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * place + bit]
        return found

    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    byte = np.array([crc32(b"\0", int(u) ^ 0xFFFFFFFF) ^ crc32(b"\0", 0xFFFFFFFF) for u in units], np.uint32)
    by_one = tables(byte)
    few, columns = [tables(units)], units
    for _ in range(TABLED):
        columns = _look_up(by_one, columns)
        few.append(tables(columns))
    powers, columns = [], byte
    for _ in range(48):
        powers.append(tables(columns))
        columns = _look_up(powers[-1], columns)
    return np.stack(few), np.stack(powers)


def _look_up(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """``tables`` is (4, 256) for one move, or (n, 4, 256)-shaped choices already taken for each crc."""
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


TABLED = 48
_FEW, _POWERS = _crc_moves()
_FLAT = np.ascontiguousarray(_FEW.transpose(1, 0, 2)).reshape(4, -1)
_BLANK = np.uint32(crc32(b" "))


def moved(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What each CRC becomes in the CRC of a text with so many more bytes, without what these bytes add."""
    near = np.minimum(lengths, TABLED) << 8
    found = _FLAT[0][near | (crcs & 255)] ^ _FLAT[1][near | ((crcs >> 8) & 255)]
    found ^= _FLAT[2][near | ((crcs >> 16) & 255)] ^ _FLAT[3][near | (crcs >> 24)]
    far = np.flatnonzero(lengths > TABLED)
    if len(far):
        rest, part = lengths[far] - TABLED, found[far]
        for k in range(int(rest.max()).bit_length()):
            on = (rest >> k) & 1 == 1
            part[on] = _look_up(_POWERS[k], part[on])
        found[far] = part
    return found


def run_crcs(words: list[bytes]) -> list[np.ndarray]:
    """CRC-32 of every run of 1 to ``LONGEST_RUN`` words, joined by blanks; the k-th array by the place of the last word
    (its first k places mean nothing)."""
    own = np.fromiter(map(crc32, words), np.uint32, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    after_blank = moved(np.full(len(words), _BLANK, np.uint32), lengths) ^ own
    runs = [own]
    for _ in range(1, LONGEST_RUN):
        before = np.concatenate((np.zeros(1, np.uint32), runs[-1][:-1])) if len(words) else runs[-1]
        runs.append(moved(before, lengths + 1) ^ after_blank)
    return runs


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text of plain words, cut at blanks."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(b" ", at, at + PIECE)
        cut = text.find(b" ", at + PIECE) if cut <= at else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def bucket_runs(texts: Iterator[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (place of the text, words of it here, buckets of its features, place of the text of each).

    A text of more than ``PIECE`` bytes is dealt over groups; the last words of one are carried into the next, so that
    every run is counted once, where it ends.
    """
    words: list[bytes] = []
    places: list[int] = []
    sizes: list[int] = []
    carried: list[int] = []
    held = 0

    def group() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, skip = np.array(sizes, np.int64), np.array(carried, np.int64)
        starts = np.cumsum(size) - size
        within = np.arange(len(words)) - np.repeat(starts, size)
        fresh = within >= np.repeat(skip, size)
        text = np.repeat(np.array(places, np.int64), size)
        found, owners = [], []
        for run, crcs in enumerate(run_crcs(words)):
            whole = np.flatnonzero(fresh & (within >= run))
            found.append(crcs[whole] % np.uint32(buckets))
            owners.append(text[whole])
        made = np.array(places, np.int64), size - skip, np.concatenate(found), np.concatenate(owners)
        for one in (words, places, sizes, carried):
            one.clear()
        return made

    for place, text in enumerate(texts):
        last: list[bytes] = []
        plain = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
        for piece in _pieces(plain):
            own = piece.split()
            if held and held + len(piece) > PIECE:
                yield group()
                held = 0
            words += last
            words += own
            places.append(place)
            sizes.append(len(last) + len(own))
            carried.append(len(last))
            held += len(piece)
            last = (last + own)[-(LONGEST_RUN - 1) :]
    if places:
        yield group()


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _ in bucket_runs((x.as_py() for x in batch.column(0)), buckets):
                counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    rows = renamed(texts, text=text).mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in rows.collect():  # at most one row for each bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's smoothed shares in the target and in the corpus."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([floor(1000 * log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    slim = renamed(docs, doc_id=doc_id, text=text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = np.zeros((3, batch.num_rows), np.int64)
            for places, sizes, found, owners in bucket_runs((x.as_py() for x in batch.column(1)), len(gain)):
                first = int(places[0])
                np.add.at(words, places, sizes)
                each = np.bincount(owners - first)
                features[first : first + len(each)] += each
                # Doubles add whole numbers below 2^53 exactly; a group's sums are far below.
                weights[first : first + len(each)] += np.bincount(owners - first, gain[found]).astype(np.int64)
            columns = [batch.column(0), *map(pa.array, (words, features, weights))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of standard Gumbel noise from the hash of seed and id; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


# --- the sort -----------------------------------------------------------------------------------------------


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort: ``at`` becomes the position of the row by ``digit`` and then by ``at`` before."""
    dealt = rows.withColumns({"block": F.expr(f"at div {BLOCK_ROWS}"), "digit": digit})
    counts = dealt.groupBy("block", "digit").agg(F.count("*").alias("n"))
    # At most 2^DIGIT_BITS rows are put in order here, and as many rows as there are blocks for each digit below.
    totals = counts.groupBy("digit").agg(F.sum("n").alias("all"))
    lower = totals.select("digit", (F.sum("all").over(W.orderBy("digit")) - F.col("all")).alias("lower"))
    earlier = F.sum("n").over(W.partitionBy("digit").orderBy("block")) - F.col("n")
    offsets = counts.withColumn("earlier", earlier).join(lower, "digit")
    offsets = offsets.select("block", "digit", (F.col("lower") + F.col("earlier")).alias("offset"))
    within = F.row_number().over(W.partitionBy("block", "digit").orderBy("at")) - 1
    placed = dealt.withColumn("within", within).join(offsets, ["block", "digit"])
    return placed.withColumn("at", F.col("offset") + F.col("within")).select(*rows.columns)


def radix_sorted(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with ``at``, their positions from 0 by the integer ``keys`` (name, falling), the first one leading.

    Null keys come last. Rows with equal keys have positions of their own, in the order of a first numbering of the
    rows. A key takes as many passes as its range needs digits. ``rows`` must not have a column ``at``.
    """
    whole = rows.select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    now = stored(whole, "radix-rows")
    ends = now.agg(*[f(F.col(f"row.{k}")).alias(f"{f.__name__}{i}") for i, (k, _) in enumerate(keys) for f in (F.min, F.max)]).first()
    for i, (key, falling) in reversed(list(enumerate(keys))):
        low, high = ends[f"min{i}"], ends[f"max{i}"]
        if low is None:
            continue
        if high - low >= (1 << 63) - 1:
            raise ValueError(f"{key} spans more than 63 bits")
        value = F.col(f"row.{key}")
        steps = F.coalesce((F.lit(high) - value if falling else value - F.lit(low)).cast("long"), F.lit(high - low + 1).cast("long"))
        for shift in range(0, (high - low + 1).bit_length(), DIGIT_BITS):
            digit = F.shiftright(steps, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
            before, now = now, stored(_pass(now, digit), "radix-rows")
            forget(before)
    if all(ends[f"min{i}"] is None for i in range(len(keys))):  # the first numbering has gaps
        now = stored(_pass(now, F.lit(0)), "radix-rows")
    return now.select("row.*", "at")


# --- the draw -----------------------------------------------------------------------------------------------


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null if not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down: the highest scores, ties
    to the smaller id. Null and empty texts have no features and the weight 0. Null ids are kept, hash like an empty
    id, and lose ties; the rows of a repeated id and score take ranks of their own, in any order. An empty table gives
    an empty result, and an empty target leaves the smoothing alone to weigh. Ids must be integers.
    """
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be an integer, since its digits are sorted")
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weighed(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "resampling-scores")
    in_draw = F.col("n_words") >= least_words
    drawn = percent * scored.where(in_draw).count() // 100
    ordered = radix_sorted(scored.where(in_draw), [("score", True), ("doc_id", False)])
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~in_draw).select(*out, F.lit(None).cast("long").alias("rank"))
    return ordered.select(*out, rank.alias("rank")).unionByName(rest)
