"""Language-model scores (operator 8): context-tree weighting over bytes, beside a unigram base.

A byte is eight binary decisions. Each decision has a binary context tree over the bytes before it, up to
``DEPTH`` of them; every node keeps how often each bit followed, its Krichevsky-Trofimov probability of those
bits, and the weighted probability: half its own, half the product of its children's. The chance of a next bit
mixes the estimates of all depths along the context with the weights that this gives to each.

Where the work is done:

* Texts are dealt to chunks by a hash. A chunk gives its distinct byte strings of ``DEPTH`` + 1 with their counts
  in training texts (0 for strings of other texts alone), and its distinct words likewise; these are summed.
* Strings whose context has the same last three bytes lie in one partition, which holds the tree from the leaves
  up to depth 3 (at most 2^24 strings share such an end). Depth 2 has at most 2^24 nodes whatever the corpus,
  and usually some thousands; it and what is above are finished on the driver.
* Going down again gives every string one number: the logarithm of its last byte's probability. The numbers go
  back to the chunks that have the string, next to the chunk's texts, where they are added up for each text.

No table of the corpus is broadcast or held by one task: what a chunk gets is what its texts contain.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import forget, packed_words, renamed, stored

DEPTH, UPPER = 5, 2
#: The end of a text, as a token and as a byte; texts begin after as many ends as the tree is deep.
END = b"\n"
CHUNK_CHARS, STRINGS_PER_PART, BLOCK = 28_000_000, 500_000, 1 << 19
#: Texts whose words are cut at a time, and rows of a batch that leaves a task.
TEXTS_AT_ONCE, OUT_ROWS = 1024, 1 << 16
_COUNTED = ["chunk", "string", "word", "n"]
LN2 = np.log(2.0)


def give_back() -> None:
    """Return freed memory to the system. A worker lives on from stage to stage, and what its allocators keep counts
    against the executor beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


# --- the tree -----------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, where it has twelve digits; smaller values are shifted there."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: key (context bytes, then the bits decided so far), counts, weighted probability."""

    def __init__(self, keys, zeros, ones, children):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.own = log_kt(zeros, ones)
        self.weighted = self.own if children is None else np.logaddexp(self.own, children) - LN2
        #: Weight of the node's own estimate against those below it.
        self.share = np.ones(len(keys)) if children is None else np.exp(self.own - LN2 - self.weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)

    def above(self, depth: int) -> tuple[Level, np.ndarray]:
        """The level with ``depth`` context bytes, and the place there of each node here."""
        cut = (self.keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
        keys, place = np.unique((cut << np.uint64(8)) | (self.keys & np.uint64(255)), return_inverse=True)
        sums = [np.bincount(place, x, len(keys)) for x in (self.zeros, self.ones, self.weighted)]
        return Level(keys, *sums), place


def leaves(strings: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level, and for each string and bit the place of its node and the bit: (strings, 8) each."""
    byte = strings & np.uint64(255)
    bits = np.stack([(byte >> np.uint64(7 - k)) & np.uint64(1) for k in range(8)], axis=1)
    nodes = np.stack([np.uint64(1 << k) | (byte >> np.uint64(8 - k)) for k in range(8)], axis=1)
    keys, place = np.unique(((strings >> np.uint64(8) << np.uint64(8))[:, None] | nodes).ravel(), return_inverse=True)
    place, n = place.reshape(-1, 8), np.repeat(counts.astype(np.float64), 8)
    flat = bits.ravel() == 1
    ones, total = np.bincount(place.ravel(), n * flat, len(keys)), np.bincount(place.ravel(), n, len(keys))
    return Level(keys, total - ones, ones, None), place, bits


def lower_part(strings: np.ndarray, counts: np.ndarray) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels from ``DEPTH`` up to the one below ``UPPER``, and the places of nodes in the level above theirs."""
    level, place, bits = leaves(strings, counts)
    levels, ups = [level], []
    for depth in range(DEPTH - 1, UPPER, -1):
        level, up = level.above(depth)
        levels.append(level)
        ups.append(up)
    return levels, ups, place, bits


class Top:
    """The levels from ``UPPER`` to the root as two numbers a node: P(1) = ``fixed`` + ``free`` times what is below."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        order = np.argsort(keys)
        level = Level(keys[order], zeros[order], ones[order], children[order])
        self.keys = level.keys
        self.fixed, self.free = level.share * level.one, 1 - level.share
        at = np.arange(len(self.keys))
        for depth in range(UPPER - 1, -1, -1):
            level, up = level.above(depth)
            at = up[at]
            self.fixed = level.share[at] * level.one[at] + (1 - level.share[at]) * self.fixed
            self.free = (1 - level.share[at]) * self.free

    def place(self, keys: np.ndarray) -> np.ndarray:
        cut = (keys >> np.uint64(8)) & np.uint64((1 << 8 * UPPER) - 1)
        return np.searchsorted(self.keys, (cut << np.uint64(8)) | (keys & np.uint64(255)))


def log10_of(strings: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each string's last byte after the others."""
    levels, ups, place, bits = lower_part(strings, counts)
    chain = [np.arange(len(levels[0].keys))]
    for up in ups:
        chain.append(up[chain[-1]])
    p = levels[0].one
    for level, at in zip(levels[1:], chain[1:], strict=True):
        p = level.share[at] * level.one[at] + (1 - level.share[at]) * p
    at = top.place(levels[0].keys)
    p = top.fixed[at] + top.free[at] * p
    chosen = p[place]
    return np.log10(np.where(bits == 1, chosen, 1 - chosen)).sum(axis=1)


# --- texts --------------------------------------------------------------------------------------------------


def normal(text: str | None) -> bytes:
    """The bytes of a text that the model sees: lower-cased words between blanks, then the end."""
    return b" ".join(packed_words(text)) + END


def byte_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The string that ends at each byte of the texts, and how many each text has."""
    pad = END * DEPTH
    data = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    found = np.zeros(len(data) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        found = (found << np.uint64(8)) | data[k : len(data) - DEPTH + k]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    own = np.ones(len(found), bool)
    for k in range(DEPTH):  # strings that end in the padding of a later text
        own[starts[1:] - DEPTH + k] = False
    return found[own], sizes


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes, or one longer text."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > BLOCK:
            yield first, at
            first, held = at, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def _summed(strings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(strings, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A-Z in lower case, and how many each text has; nulls have none."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    there = pc.not_equal(words, "")
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), np.diff(upto[ends - ends[0]])


def chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings and words of each chunk with their counts in its training texts, from (chunk, text, learn) by chunk.

    Texts pass through in blocks; what is held is a chunk's distinct strings and words, as arrays.
    """
    texts: list[bytes] = []
    learns: list[bool] = []
    words: list[pa.Table] = []
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # sums of blocks that are not yet part of the above
    held = 0

    def absorb(last: bool = False) -> None:
        nonlocal keys, counts, held
        for learn in (True, False):
            part = [t for t, x in zip(texts, learns, strict=True) if x is learn]
            if part:
                own, n = np.unique(byte_strings(part)[0], return_counts=True)
                waiting.append((own, n if learn else np.zeros(len(own), np.int64)))
        texts.clear()
        learns.clear()
        held = 0
        if waiting and (last or sum(len(own) for own, _ in waiting) > max(len(keys) // 2, BLOCK)):
            keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True)))
            waiting.clear()

    def add_words(rows: pa.RecordBatch) -> None:
        for learn in (True, False):
            part = rows.filter(pc.equal(rows.column("learn"), learn)).column("text")
            if len(part):
                found = tokens_of(part)[0].value_counts()
                spelt = pa.concat_arrays([found.field(0), pa.array([END.decode()])])
                n = pa.concat_arrays([found.field(1), pa.array([len(part)], pa.int64())])
                words.append(pa.table({"word": spelt, "n": n if learn else pa.array(np.zeros(len(spelt), np.int64))}))
        if len(words) > 16:
            words[:] = [merged()]
            pa.default_memory_pool().release_unused()

    def merged() -> pa.Table:
        whole = pa.concat_tables(words).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": whole.column("word"), "n": whole.column("n_sum")}).combine_chunks()

    def chunk_of(chunk: int) -> Iterator[pa.RecordBatch]:
        nonlocal keys, counts
        absorb(last=True)
        give_back()
        for at in range(0, len(keys), OUT_ROWS):
            own = keys[at : at + OUT_ROWS]
            columns = [np.full(len(own), chunk, np.int32), own.view(np.int64), pa.nulls(len(own), pa.string()), counts[at : at + OUT_ROWS]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _COUNTED)
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in merged().to_batches(OUT_ROWS):
            rows = batch.num_rows
            columns = [pa.array(np.full(rows, chunk, np.int32)), pa.nulls(rows, pa.int64()), batch.column("word"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, _COUNTED)
        words.clear()
        give_back()

    now = None
    for batch in batches:
        ends = np.flatnonzero(np.diff(batch.column("chunk").to_numpy())) + 1 if batch.num_rows else []
        bounds = [0, *ends, batch.num_rows]
        for first, stop in zip(bounds, bounds[1:], strict=False):
            rows = batch.slice(first, stop - first)
            if not rows.num_rows:
                continue
            chunk = rows.column("chunk")[0].as_py()
            if now is not None and chunk != now:
                yield from chunk_of(now)
            now = chunk
            for at in range(0, rows.num_rows, TEXTS_AT_ONCE):
                add_words(rows.slice(at, TEXTS_AT_ONCE))
            for text, learn in zip(rows.column("text"), rows.column("learn").to_pylist(), strict=True):
                texts.append(normal(text.as_py()))
                learns.append(learn)
                held += len(texts[-1])
                if held > BLOCK:
                    absorb()
    if now is not None:
        yield from chunk_of(now)


def scores(texts: pa.Table, values: pa.Table, train_tokens: int, train_words: int) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score, n_bytes) of a chunk's texts, given the numbers of its strings and words."""
    give_back()
    is_word = values.column("word").is_valid()
    words = values.select(["word", "value"]).filter(is_word)
    spelt, seen = words.column("word").combine_chunks(), words.column("value").to_numpy()
    # The strings are most of a chunk: each copy of them goes as soon as the next one is there.
    rest = values.select(["string", "value"]).filter(pc.invert(is_word))
    strings, logs = rest.column("string").to_numpy().view(np.uint64), rest.column("value").to_numpy()
    del rest
    order = np.argsort(strings)
    strings = strings[order]
    logs = logs[order]
    del order
    give_back()
    whole = np.log10(train_tokens + train_words + 1)
    end = seen[pc.index_in(pa.scalar(END.decode()), spelt).as_py()]
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in texts.select(["text"]).to_batches(TEXTS_AT_ONCE):
        tokens, n = tokens_of(batch.column(0))
        count = seen[pc.index_in(tokens, spelt).to_numpy()] if len(tokens) else np.empty(0)
        owner = np.repeat(np.arange(len(n)), n)
        known = np.bincount(owner, count > 0, len(n)).astype(np.int64) + int(end > 0)
        base = np.bincount(owner, np.log10(count + 1), len(n)) + np.log10(end + 1) - (n + 1) * whole
        data = [normal(text.as_py()) for text in batch.column(0)]
        own = []
        for first, stop in blocks(data):
            found, sizes = byte_strings(data[first:stop])
            own.append(np.add.reduceat(logs[np.searchsorted(strings, found)], np.cumsum(sizes) - sizes))
        parts.append((n + 1, known, base, np.concatenate(own), np.fromiter(map(len, data), np.int64, len(data))))
    del strings, logs, spelt, seen, words
    give_back()
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


# --- the job ------------------------------------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    held = [(b.column("string").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches if b.num_rows]
    return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else None


def model(strings: DataFrame) -> DataFrame:
    """(string, value): log10 of the probability of each string's last byte, from (string, n), strings distinct."""
    parts = 1 + strings.count() // STRINGS_PER_PART
    end = F.shiftrightunsigned("string", 8).bitwiseAND(F.lit((1 << 8 * (UPPER + 1)) - 1))
    dealt = strings.repartition(parts, end).select("string", "n")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _whole(batches)
        if held is None:
            return
        level = lower_part(*held)[0][-1]
        cut = (level.keys >> np.uint64(8)) & np.uint64((1 << 8 * UPPER) - 1)
        keys, place = np.unique((cut << np.uint64(8)) | (level.keys & np.uint64(255)), return_inverse=True)
        sums = [np.bincount(place, x, len(keys)) for x in (level.zeros, level.ones, level.weighted)]
        del held, level, cut, place
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["key", "zeros", "ones", "weighted"])

    nodes = dealt.mapInArrow(up, "key long, zeros double, ones double, weighted double")
    upper = nodes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()
    top = Top(upper["key"].to_numpy().view(np.uint64), *[upper[c].to_numpy() for c in ("zeros", "ones", "weighted")])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _whole(batches)
        if held is not None:
            values = pa.array(log10_of(*held, top))
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), values], ["string", "value"])

    return dealt.mapInArrow(down, "string long, value double")


def score(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    ``learn_from`` is a condition on ``doc_id`` that marks the rows to learn from; null counts as false. A null
    text counts as empty: one token, the end. ``score`` is the model's log10 probability of the text's tokens,
    the end included, and ``bits_per_byte`` its code length for each byte of them; ``base_score`` is that of the
    unigrams with one added to each count. Null ids and repeated
    rows count as rows of their own. Without rows to learn from every bit has the chance one half. An empty
    table gives an empty result.
    """
    slim = renamed(docs, doc_id=doc_id, text=text)
    characters = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = 1 + characters // CHUNK_CHARS
    learn = F.coalesce(learn_from, F.lit(False))
    dealt = slim.select("doc_id", "text", learn.alias("learn"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    by_chunk = dealt.select("chunk", "text", "learn").repartition(int(chunks), "chunk").sortWithinPartitions("chunk")
    counted = stored(by_chunk.mapInArrow(chunk_counts, "chunk int, string long, word string, n long"), "ctw-counts", "zstd")
    strings = stored(counted.where("word is null").groupBy("string").agg(F.sum("n").alias("n")), "ctw-strings", "zstd")
    words = stored(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("value")), "ctw-words", "zstd")
    totals = words.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("tokens"), F.count_if(F.col("value") > 0).alias("words")).first()
    valued = stored(model(strings), "ctw-values", "zstd")
    forget(strings)
    of_strings = counted.where("word is null").join(valued, "string").select("chunk", "string", F.lit(None).cast("string").alias("word"), "value")
    of_words = counted.where("word is not null").drop("n", "string").join(words, "word")
    of_words = of_words.select("chunk", F.lit(None).cast("long").alias("string"), "word", F.col("value").cast("double").alias("value"))
    train_tokens, train_words = totals["tokens"], totals["words"]

    def of(texts: pa.Table, values: pa.Table) -> pa.Table:
        n_tokens, n_known, base, own, n_bytes = scores(texts, values, train_tokens, train_words)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "learn": texts.column("learn"),
                "n_tokens": n_tokens,
                "n_known": n_known,
                "train_tokens": np.full(len(n_tokens), train_tokens, np.int64),
                "base_score": base,
                "score": own,
                "bits_per_byte": -own * np.log2(10) / n_bytes,
            }
        )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(of_strings.union(of_words).groupBy("chunk")).applyInArrow(of, schema)
