"""Benchmark decontamination (operator 10): rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is the stated query set. It is taken in blocks of about ``BLOCK_WORDS`` words, so what a task gets
of it has a bound; every block meets all documents. A first pass counts in how many documents each seed (three
words of an item, the last of them perhaps one place further on) occurs. A seed is rare for an item if it occurs in at most ``RARE_FLOOR`` documents more than
``RARE_FACTOR`` times the item's median seed: a bound that moves with the item, so that an item copied into very
many documents keeps most of its seeds. In the second pass rare seeds mark windows of a document, and the item
is aligned with each of them; no pair of a document and an item is formed without a seed, and no text is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import renamed

SEED_WORDS, RARE_FLOOR, RARE_FACTOR = 3, 100, 10
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item is found in a document if the alignment has at least this share of an exact copy's score.
MIN_SCORE = 0.5
BLOCK_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Keys are first looked up by their highest bits.
FILTER_SHIFT = np.uint64(44)
#: Words of the texts that are searched at a time; words that no item has keep two texts apart.
GROUP_WORDS, _BETWEEN = 1 << 16, ["", "", "", ""]


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, each in lower case."""
    text = text or ""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        return _WORD.findall(low)
    return [word.lower() for word in _WORD.findall(text)]  # lower case would depend on what stands beside a word


@dataclass
class Block:
    """Some of the items, with their words as numbers and their seeds as sorted keys."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray = field(default=None)  # distinct seed keys, sorted
    owners: list[list[tuple[int, int]]] = field(default=None)  # for each key: (item, place in it)
    rare: list[list[tuple[int, int]]] = field(default=None)
    sizes: list[int] = field(default_factory=list)  # of the seeds, in words
    filter: np.ndarray = field(default=None)  # whether some key begins with these bits


def seed_keys(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of each seed of ``n`` known words: a run, or a run whose last word stands one place further on.

    An inserted, replaced or missing word turns the one kind into the other or leaves a seed of the second kind whole,
    so copies edited at every third word keep seeds. Unknown words are negative.
    """
    places, keys = [], []
    is_known = words >= 0
    count = max(0, len(words) - n + 1)
    start = is_known[:count].copy()
    for k in range(1, n - 1):
        start &= is_known[k : count + k]
    start = np.flatnonzero(start)
    for gap in (0, 1) if n > 2 else (0,):
        own = start[start < len(words) - n + 1 - gap]
        own = own[is_known[own + n - 1 + gap]]
        key = np.zeros(len(own), np.uint64)
        for k in (*range(n - 1), n - 1 + gap):
            key = key * _BASE + (words[own + k] + 1).astype(np.uint64)
        places.append(own)
        keys.append(key)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(keys)


def block_of(items: list[tuple], seed_words: int) -> Block:
    """Items with fewer words than a seed are seeds themselves."""
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(text)], np.int64) for _, text in items]
    owners: dict[int, list[tuple[int, int]]] = {}
    sizes = set()
    for item, own in enumerate(words):
        size = min(seed_words, len(own))
        if size:
            sizes.add(size)
            for place, key in zip(*map(np.ndarray.tolist, seed_keys(own, size)), strict=True):
                owners.setdefault(key, []).append((item, place))
    keys = np.array(sorted(owners), np.uint64)
    seen = np.zeros(1 << 64 - int(FILTER_SHIFT), bool)
    seen[keys >> FILTER_SHIFT] = True
    return Block([i for i, _ in items], words, vocabulary, keys, [owners[k] for k in keys.tolist()], sizes=sorted(sizes), filter=seen)


def numbered(block: Block, words: list[str]) -> np.ndarray:
    return np.fromiter(map(block.vocabulary.get, words, repeat(-1)), np.int64, len(words))


def seeds_in(block: Block, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index of the seed) of every seed that occurs."""
    found = [seed_keys(numbers, size) for size in block.sizes]
    places, keys = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))
    if not len(keys):
        return places[:0], np.empty(0, np.int64)
    maybe = block.filter[keys >> FILTER_SHIFT]
    places, keys = places[maybe], keys[maybe]
    at = np.minimum(np.searchsorted(block.keys, keys), len(block.keys) - 1)
    hit = block.keys[at] == keys
    return places[hit], at[hit]


@dataclass
class Group:
    """Some texts as one row of numbers, unknown words between them; the seeds found, by text."""

    numbers: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    texts: np.ndarray  # for each hit: which text, the place in it, the seed
    places: np.ndarray
    seeds: np.ndarray


def groups(block: Block, texts: Iterator[str | None]) -> Iterator[Group]:
    """Texts by and by, about ``GROUP_WORDS`` words or one longer text at a time."""
    words: list[str] = []
    lengths: list[int] = []

    def group() -> Group:
        numbers = numbered(block, words)
        sizes = np.array(lengths, np.int64)
        starts = np.cumsum(sizes + len(_BETWEEN)) - sizes - len(_BETWEEN)
        places, seeds = seeds_in(block, numbers)
        own = np.searchsorted(starts, places, side="right") - 1
        words.clear()
        lengths.clear()
        return Group(numbers, starts, sizes, own, places - starts[own], seeds)

    for text in texts:
        found = tokens(text)
        if lengths and len(words) + len(found) > GROUP_WORDS:
            yield group()
        words += found
        words += _BETWEEN
        lengths.append(len(found))
    if lengths:
        yield group()


def choose_rare(block: Block, documents: np.ndarray, floor: int, factor: float) -> None:
    """Keep for each seed the items it is rare for, given in how many documents each seed occurs."""
    of_item: dict[int, list[int]] = {}
    for seed, own in enumerate(block.owners):
        for item, _ in own:
            of_item.setdefault(item, []).append(int(documents[seed]))
    limit = {item: floor + factor * float(np.median(n)) for item, n in of_item.items()}
    block.rare = [[(i, p) for i, p in own if documents[seed] <= limit[i]] for seed, own in enumerate(block.owners)]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, start, stop) of the best local alignment; start and stop are places in ``words``, stop exclusive."""
    n = len(words)
    above, begun = np.zeros(n + 1, np.int64), np.arange(n + 1)
    place, best = np.arange(n + 1), (0, 0, 0)
    for word in item.tolist():
        step = np.where(words == word, MATCH, MISMATCH)
        row, start = np.zeros(n + 1, np.int64), place.copy()
        slant, down = above[:-1] + step, above[1:] + GAP
        use = down > slant
        top = np.where(use, down, slant)
        fits = top > 0
        row[1:][fits] = top[fits]
        start[1:][fits] = np.where(use, begun[1:], begun[:-1])[fits]
        # A gap along the row: the best earlier cell, less the distance to it.
        raised = row - GAP * place
        lead = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == lead, place, 0))
        along = lead + GAP * place
        better = along > row
        row = np.where(better, along, row)
        start = np.where(better, start[source], start)
        top_at = int(row.argmax())
        if row[top_at] > best[0]:
            best = (int(row[top_at]), int(start[top_at]), top_at)
        above, begun = row, start
    return best


def matches(block: Block, group: Group, text: int, hits: slice, value: str, min_score: float) -> list[tuple]:
    """(item id, score, start, end) of the items found in one text; offsets in code points, end exclusive."""
    first, count = int(group.starts[text]), int(group.lengths[text])
    numbers = group.numbers[first : first + count]
    windows: dict[int, list[tuple[int, int]]] = {}
    for place, seed in zip(group.places[hits].tolist(), group.seeds[hits].tolist(), strict=True):
        for item, at in block.rare[seed]:
            length = len(block.words[item])
            margin = max(8, length // 2)
            windows.setdefault(item, []).append((max(0, place - at - margin), min(count, place - at + length + margin)))
    found, bounds = [], None
    for item, spans in windows.items():
        best = (0, 0, 0)
        full = MATCH * len(block.words[item])
        spans.sort()
        low, high = spans[0]
        for start, stop in [*spans[1:], (count + 1, 0)]:
            if start < high and stop - low <= 8 * len(block.words[item]) + 64:
                high = max(high, stop)
                continue
            # A score is at most that of the item's words which occur here, so most windows need no alignment.
            if best[0] < full and MATCH * int(np.isin(block.words[item], numbers[low:high]).sum()) >= min_score * full:
                score, a, b = align(block.words[item], numbers[low:high])
                best = max(best, (score, low + a, low + b), key=lambda x: x[0])
            low, high = start, stop
        if best[0] and best[0] >= min_score * full:
            bounds = bounds or [m.span() for m in _WORD.finditer(value)]
            found.append((block.ids[item], best[0] / full, bounds[best[1]][0], bounds[best[2] - 1][1]))
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items block by block; each block has about ``BLOCK_WORDS`` words."""
    items = renamed(benchmark, item_id=item_id, text=text).where("text is not null").distinct()
    characters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + characters // (5 * BLOCK_WORDS)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield sorted(map(tuple, part.collect()), key=lambda row: (row[0] is None, row[0], row[1]))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    seed_words: int = SEED_WORDS,
    min_score: float = MIN_SCORE,
    rare_floor: int = RARE_FLOOR,
    rare_factor: float = RARE_FACTOR,
) -> DataFrame:
    """(doc_id, item_id, score, start, end) for each row of ``docs`` and each item that it contains a copy of.

    ``score`` is the best alignment's share of an exact copy's score, and the span is that alignment's. Null,
    empty and blank texts match nothing. Repeated items count once. Rows with null ids and
    repeated rows are matched like any other, each for itself. Empty tables give an empty result.
    """
    slim = renamed(docs, doc_id=doc_id, text=text)
    id_type = slim.schema["doc_id"].dataType.simpleString()
    item_type = "string" if benchmark.schema[item_id].dataType.simpleString() == "string" else "long"
    schema = f"doc_id {id_type}, item_id {item_type}, score double, start int, end int"
    found = None
    for items in _blocks(benchmark, item_id, item_text):
        part = _one_block(slim, block_of(items, seed_words), schema, min_score, rare_floor, rare_factor)
        found = part if found is None else found.union(part)
    return found


def _one_block(slim: DataFrame, block: Block, schema: str, min_score: float, floor: int, factor: float) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        documents = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for group in groups(block, (x.as_py() for x in batch.column(0))):
                pairs = np.unique(group.texts * len(documents) + group.seeds)
                documents += np.bincount(pairs % max(1, len(documents)), minlength=len(documents))
        seen = np.nonzero(documents)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(documents[seen])], ["seed", "n"])

    counts = slim.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    documents = np.zeros(len(block.keys), np.int64)
    for row in counts.collect():  # at most one row per seed of the block
        documents[row["seed"]] = row["n"]
    choose_rare(block, documents, floor, factor)
    kinds = (pa.string() if "item_id string" in schema else pa.int64(), pa.float64(), pa.int32(), pa.int32())

    is_rare = np.array([bool(own) for own in block.rare], bool)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, before = [], 0
            for group in groups(block, (x.as_py() for x in batch.column(1))):
                order = np.flatnonzero(is_rare[group.seeds])
                order = order[np.lexsort((group.places[order], group.texts[order]))]
                group.texts, group.places, group.seeds = group.texts[order], group.places[order], group.seeds[order]
                ends = np.flatnonzero(np.diff(group.texts, append=-1)) + 1
                for first, stop in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                    text = int(group.texts[first])
                    value = batch.column(1)[before + text].as_py()
                    found += [(before + text, *m) for m in matches(block, group, text, slice(first, stop), value, min_score)]
                before += len(group.lengths)
            rows = pa.array([f[0] for f in found], pa.int64())
            columns = [pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], ["doc_id", "item_id", "score", "start", "end"])

    return slim.mapInArrow(find, schema)
