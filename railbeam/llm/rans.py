"""Token files (operator 3): ids in blocks of a static range asymmetric numeral system.

A folder of token files holds two tables. ``table`` has the frequency of each id, scaled to a sum of 2^20 and
shared by all blocks. ``chunks`` has one row for each run of whole documents: ``shard`` and ``chunk`` order the
runs, ``doc_ids`` and ``lengths`` are the directory, and ``payload`` holds the ids:

    "RANS", version, lanes (u8 each, then two zeros), symbols of a block (u32), ids (u64), blocks (u32)
    for every block: where its words begin (u32), the crc32 of its ids as u32 (u32), a state for each lane (u64)
    words (u32); everything is little-endian

Blocks are independent: the checkpoint of a block (its states and the place of its words) is all that a decoder
needs, so blocks are decoded in any order, and here all blocks of a chunk at once, one vector step for each
place in a block. Lanes are interleaved: lane k has the ids k, k + lanes, ... of its block, and all share one run
of words. The files are Parquet, so a lost writer leaves nothing behind and any store that Spark reaches will do.
"""

from __future__ import annotations

import array
import json
import posixpath
import re
import struct
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbeam.llm.common import forget, renamed, stored

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LOWEST = np.uint64(1 << 31)
LANES, BLOCK = 32, 4096
STEPS = BLOCK // LANES
HEAD = struct.Struct("<4sBBHIQI")
#: Ids of a chunk: it ends with the document that brings it to so many.
CHUNK_IDS = 1 << 20
#: Characters of a shard, which is one task and one file.
SHARD_CHARS = 16_000_000
#: Bytes of a generation of remembered words in a Python worker; what an entry takes besides its text and ids.
MEMORY, ENTRY_BYTES = 32 << 20, 200
#: Characters of texts whose ids are found together; a longer text is a group of its own.
GROUP_CHARS = 12 << 20


# --- tokens -------------------------------------------------------------------------------------------------

#: White space other than the blank and the line feed; a text with any of it is searched for odd blanks.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A blank beside other white space or at an end; elsewhere a blank always begins a piece of the byte-level BPE.
_ODD = re.compile(r"(?:^|\s) | (?:\s|$)")
#: Fixed by the byte-level BPE: how it cuts a text into words, and the characters that stand for bytes: visible
#: ones for themselves, the others in turn for those from U+0100.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _VISIBLE)}
_SHOWN_BLANK = chr(_SHOWN[32])
_loaded: dict = {}


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, a group of texts at a time.

    The texts of a group are cut at single blanks. Each distinct piece of the group is cut into words once, each
    word goes through the library's BPE model once, and the ids of the texts are gathered from those of the pieces.
    Words met before are remembered in two generations of ``MEMORY`` bytes each: a full young one becomes the old
    one, and what is asked for again becomes young. Long words are not remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        cut = kind["pre_tokenizer"] or {}
        self.by_pieces = not kind["normalizer"] and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        short = self.tokenizer.get_vocab_size() <= 1 << 16
        self.code, self.kind = ("H", "<u2") if short else ("I", "<u4")
        self.tokenize = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not young."""
        ids = self.old.get(word)
        if ids is None:
            plain = word[1:] if word[0] == " " else word
            if plain.isascii() and plain.isprintable() and " " not in plain:
                seen = _SHOWN_BLANK + plain if word[0] == " " else plain
            else:
                seen = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)
            ids = array.array(self.code, [t.id for t in self.tokenize(seen)]).tobytes()
        cost = ENTRY_BYTES + len(word) + len(ids)
        if cost <= 2 * ENTRY_BYTES:
            if self.held + cost > MEMORY:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[word] = ids
            self.held += cost
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the byte-level pre-tokenizer has cut."""
        found = list(map(self.young.get, words))
        new: dict[str, bytes] = {}
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = new.get(word)
            if ids is None:
                ids = new[word] = self._word(word)
            found[i] = ids
        return found

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuttable(self, text: str) -> bool:
        if not self.by_pieces or any(s in text for s in self.special):
            return False
        if _RARE.search(text):
            return not _ODD.search(text)
        return not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that can be cut at their blanks."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = cut.offsets.to_numpy()
        values = cut.values
        # The first piece of a text has no blank before it; a last one may end in other white space.
        odd = np.zeros(len(values), bool)
        odd[starts[:-1]] = True
        odd[[end - 1 for end, text in zip(starts[1:].tolist(), texts, strict=True) if text[-1].isspace()]] = True
        spelt = values.filter(pa.array(~odd)).dictionary_encode()
        pieces = spelt.dictionary.to_pylist()
        words = _WORDS.findall(" " + " ".join(pieces)) if pieces else []
        firsts = np.flatnonzero(np.fromiter((word[0] == " " for word in words), bool, len(words)))
        coded = self._words(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        sizes = np.add.reduceat(sizes, firsts) if pieces else sizes
        at_start = set(starts[:-1].tolist())
        for place in np.flatnonzero(odd).tolist():
            piece = values[place].as_py()
            coded.append(self._encode([piece])[0] if place in at_start else b"".join(self._words(_WORDS.findall(" " + piece))))
        width = np.dtype(self.kind).itemsize
        sizes = np.concatenate((sizes, np.fromiter(map(len, coded[len(words) :]), np.int64, int(odd.sum())))) // width
        flat = np.frombuffer(b"".join(coded), self.kind)
        which = np.empty(len(values), np.int64)
        which[~odd], which[odd] = spelt.indices.to_numpy(), len(pieces) + np.arange(int(odd.sum()))
        each = sizes[which]
        upto = np.cumsum(each)
        bounds = np.concatenate((np.zeros(1, np.int64), upto))[starts]
        from_ = np.repeat((np.cumsum(sizes)[which] - upto).astype(np.int32), each)
        from_ += np.arange(len(from_), dtype=np.int32)
        ids = flat[from_]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def ids_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null and empty texts have none. Groups hold ``GROUP_CHARS`` or one text."""
        waiting: list[str | None] = []
        held = 0
        for text in texts:
            if held and held + len(text or "") > GROUP_CHARS:
                yield from self._in_order(waiting)
                waiting, held = [], 0
            waiting.append(text)
            held += len(text or "")
        yield from self._in_order(waiting)

    def _in_order(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        fit = [i for i, text in enumerate(texts) if text and self._cuttable(text)]
        found = dict(zip(fit, self._group([texts[i] for i in fit]), strict=True)) if fit else {}
        for i, text in enumerate(texts):
            if i in found:
                yield found[i]
            else:
                yield np.frombuffer(self._encode([text])[0] if text else b"", self.kind)

    def ids(self, text: str) -> np.ndarray:
        return next(iter(self.ids_of([text])))


def encoder(path: str) -> Encoder:
    """One for each Python worker, however many tasks it runs."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


# --- the numeral system -------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies with the sum ``SCALE``, at least 1 for every id that occurs; all zero if none does."""
    used = np.nonzero(counts)[0]
    if not len(used):
        return np.zeros(len(counts), np.uint64)
    if len(used) > SCALE:
        raise ValueError("more ids than the frequency table can hold")
    share = counts[used] * (SCALE / counts.sum())
    whole = np.maximum(1, np.floor(share)).astype(np.int64)
    rest = SCALE - int(whole.sum())
    if rest > 0:
        order = np.argsort(-(share - whole), kind="stable")
        whole += rest // len(used)
        whole[order[: rest % len(used)]] += 1
    while rest < 0:
        big = np.nonzero(whole > 1)[0]
        cut = np.minimum(whole[big] - 1, np.maximum(1, whole[big] * -rest // max(1, whole[big].sum())))
        order = np.argsort(-whole[big], kind="stable")
        upto = np.cumsum(cut[order])
        take = np.where(upto <= -rest, cut[order], np.maximum(0, -rest - (upto - cut[order])))
        whole[big[order]] -= take
        rest += int(take.sum())
    found = np.zeros(len(counts), np.uint64)
    found[used] = whole
    return found


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        ends = np.cumsum(self.frequency)
        self.below = ends - self.frequency
        self.usual = int(self.frequency.argmax()) if len(self.frequency) else 0
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The id of each of the ``SCALE`` slots."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self._symbols

    def encode(self, ids: np.ndarray) -> bytes:
        blocks = -(-len(ids) // BLOCK)
        padded = np.full(blocks * BLOCK, self.usual, np.uint32)
        padded[: len(ids)] = ids
        grid = padded.reshape(blocks, STEPS, LANES)
        state = np.full((blocks, LANES), LOWEST, np.uint64)
        words, spilled = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
        for step in range(STEPS - 1, -1, -1):
            now = grid[:, step]
            f = self.frequency[now]
            full = state >= f << np.uint64(63 - SCALE_BITS)
            words[:, step], spilled[:, step] = state & np.uint64(0xFFFFFFFF), full
            state = np.where(full, state >> np.uint64(32), state)
            whole = state // f
            state = (whole << np.uint64(SCALE_BITS)) + (state - whole * f) + self.below[now]
        each = spilled.sum(axis=(1, 2))
        table = np.zeros(blocks, [("at", "<u4"), ("crc", "<u4"), ("state", "<u8", LANES)])
        table["at"], table["state"] = np.cumsum(each) - each, state
        table["crc"] = [crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
        head = HEAD.pack(b"RANS", 1, LANES, 0, BLOCK, len(ids), blocks)
        return head + table.tobytes() + words[spilled].astype("<u4").tobytes()

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from ``first`` to before ``last``; the checksum of each is tested."""
        magic, version, lanes, _, size, count, blocks = HEAD.unpack_from(payload)
        if magic != b"RANS" or version != 1 or size % lanes:
            raise ValueError("not a chunk of token ids")
        kind = np.dtype([("at", "<u4"), ("crc", "<u4"), ("state", "<u8", lanes)])
        table = np.frombuffer(payload, kind, blocks, HEAD.size)[first:last]
        words = np.frombuffer(payload, "<u4", offset=HEAD.size + blocks * kind.itemsize).astype(np.uint64)
        words = np.append(words, np.uint64(0))
        state, at = table["state"].astype(np.uint64), table["at"].astype(np.int64)
        grid = np.empty((len(table), size // lanes, lanes), np.uint32)
        for step in range(size // lanes):
            slot = state & np.uint64(SCALE - 1)
            now = self.symbols[slot]
            grid[:, step] = now
            state = self.frequency[now] * (state >> np.uint64(SCALE_BITS)) + slot - self.below[now]
            low = state < LOWEST
            upto = np.cumsum(low, axis=1)
            word = words[np.minimum(at[:, None] + upto - 1, len(words) - 1)]
            state = np.where(low, (state << np.uint64(32)) | word, state)
            at = at + upto[:, -1]
        ids = grid.reshape(-1)[: max(0, count - first * size)]
        for b, crc in enumerate(table["crc"].tolist()):
            if crc32(ids[b * size : (b + 1) * size].tobytes()) != crc:
                raise ValueError(f"block {first + b} is damaged")
        return ids


# --- writing ------------------------------------------------------------------------------------------------


_NAMES = ["shard", "chunk", "before", "n_ids", "doc_ids", "lengths"]


def _tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Chunks in order with their ids as plain numbers: every text is read, moved and encoded once.

    The last row of a shard has no ids but how often each id occurs in it (``seen`` and ``times``).
    """
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + characters // SHARD_CHARS
    own_type = docs.schema["doc_id"].dataType.simpleString()
    numbers = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, numbers, pa.binary(), numbers, numbers]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        chunk, before, held, shard, ids, lengths, parts = 0, 0, 0, 0, [], [], []
        end = np.array([end_id], own.kind)
        counts = np.zeros(max(own.tokenizer.get_vocab_size(), end_id + 1), np.int64)

        def batch_of(*row) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], k or id_list) for c, k in zip(row, kinds, strict=True)], [*_NAMES, "ids", "seen", "times"])

        def packed() -> pa.RecordBatch:
            joined = np.concatenate(parts).astype("<u2" if own.kind == "<u2" and end_id < 1 << 16 else "<u4")
            counts[:] += np.bincount(joined, minlength=len(counts))
            return batch_of(shard, chunk, before, held, pa.array(ids, id_list.value_type), lengths, joined.tobytes(), None, None)

        for batch in batches:
            id_list = pa.list_(batch.schema.field(0).type)
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for doc, found in zip(batch.column(0), own.ids_of(x.as_py() for x in batch.column(1)), strict=True):
                parts += [found, end]
                ids.append(doc)
                lengths.append(len(found) + 1)
                held += lengths[-1]
                if held >= CHUNK_IDS:
                    yield packed()
                    chunk, before, held, ids, lengths, parts = chunk + 1, before + held, 0, [], [], []
        if parts:
            yield packed()
        seen = np.flatnonzero(counts)
        if len(seen):
            yield batch_of(shard, None, None, None, None, None, None, seen.tolist(), counts[seen].tolist())

    key = [F.asc_nulls_last("doc_id"), F.asc("mark")]
    spread = docs.withColumn("mark", F.xxhash64("text")).repartitionByRange(shards, *key).sortWithinPartitions(*key)
    schema = f"shard int, chunk int, before long, n_ids long, doc_ids array<{own_type}>, lengths array<long>, ids binary, seen array<long>, times array<long>"
    return spread.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(of, schema)


def _plain(ids: bytes, count: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * count else "<u4").astype(np.uint32)


def _counted(chunks: DataFrame) -> np.ndarray:
    """How often each id occurs in all chunks, from the sums of the shards."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            seen, times = (batch.column(c).flatten().to_numpy() for c in range(2))
            found = np.bincount(seen, times, max(len(counts), 1)).astype(np.int64)  # far below 2^53
            found[: len(counts)] += counts
            counts = found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    sums = chunks.where("chunk is null").select("seen", "times").mapInArrow(of, "id long, n long")
    rows = sums.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((row["id"] for row in rows), default=0), np.int64)  # as long as the vocabulary at most
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text of ``docs``, each followed by ``end_id``, in ascending order of the ids of rows.

    A null text counts as empty and is the end id alone. Null ids come last. Rows with equal ids are written in
    the order of a hash of their texts, repeated rows each for itself. An empty table gives empty files.
    """
    spark = docs.sparkSession
    plain = stored(_tokenized(renamed(docs, doc_id=doc_id, text=text), tokenizer_path, end_id), "token-ids", compression="zstd")
    frequencies = scaled(_counted(plain))
    table = [(i, int(f)) for i, f in enumerate(frequencies.tolist()) if f]
    spark.createDataFrame(table, "id long, frequency long").coalesce(1).write.parquet(posixpath.join(path, "table"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                payload = coder.encode(_plain(one.column("ids")[0].as_py(), one.column("n_ids")[0].as_py()))
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in _NAMES], pa.array([payload], pa.binary())], [*_NAMES, "payload"])

    chunks = plain.where("chunk is not null").select(*_NAMES, "ids")
    chunks.mapInArrow(of, chunks.select(*_NAMES).schema.add("payload", "binary")).write.option("compression", "uncompressed").parquet(posixpath.join(path, "chunks"))
    forget(plain)


# --- reading ------------------------------------------------------------------------------------------------


def _starts(chunks: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before; sums of a thousand shards first, so that no task sees all of them."""
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("shard") / 1024))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("all"))
    earlier = groups.select("group", (F.sum("all").over(W.orderBy("group")) - F.col("all")).alias("earlier"))
    within = F.sum("n").over(W.partitionBy("group").orderBy("shard")) - F.col("n")
    return sizes.withColumn("within", within).join(earlier, "group").select("shard", (F.col("earlier") + F.col("within")).alias("base"))


def _read(spark: SparkSession, path: str, kind: pa.DataType, sql_kind: str, value) -> DataFrame:
    table = spark.read.parquet(posixpath.join(path, "table")).collect()  # as long as the vocabulary at most
    frequencies = np.zeros(1 + max((row["id"] for row in table), default=0), np.uint64)
    for row in table:
        frequencies[row["id"]] = row["frequency"]
    chunks = spark.read.parquet(posixpath.join(path, "chunks"))
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths = batch.column("doc_ids")[row].values, batch.column("lengths")[row].values.to_numpy()
                ids = coder.decode(batch.column("payload")[row].as_py())
                ends = np.cumsum(lengths)
                values = [value(ids[end - n : end]) for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)]
                starts = batch.column("before")[row].as_py() + ends - lengths
                shard = np.full(len(lengths), batch.column("shard")[row].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), docs, pa.array(starts), pa.array(lengths), pa.array(values, kind)],
                    ["shard", "doc_id", "before", "n_tokens", "value"],
                )

    decoded = chunks.select("shard", "before", "doc_ids", "lengths", "payload").mapInArrow(
        of, f"shard int, doc_id {id_type}, before long, n_tokens long, value {sql_kind}"
    )
    return decoded.join(_starts(chunks), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``start`` counts the ids before it."""
    return _read(spark, path, pa.list_(pa.int64()), "array<long>", lambda ids: ids.tolist()).withColumnRenamed("value", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): like ``read_tokens`` with a checksum in place of the ids."""
    return _read(spark, path, pa.int64(), "long", lambda ids: crc32(ids.astype("<u4").tobytes())).withColumnRenamed("value", "ids_crc32")
