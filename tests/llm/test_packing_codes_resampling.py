"""Packing, vector codes and resampling against brute force on small rows and on the smallest given tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railbeam.llm import packing, queries, resampling, vector_codes

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SYLLABLES = ["the", "er", "on", "an", "re", "nd", "ou", "ing", "ti", "es", "st", "ha"]


def prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(words))


TEXTS = [None, "", " \t\n", "A", "One two", "été É été x y", prose(1, 60), prose(1, 60), prose(2, 900), prose(3, 4000), "ab " * 50, "Z" * 5000]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6]), (None, TEXTS[8]), (None, None), (40, prose(9, 25))]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves; ids repeat and are null."""
    rows = [(i, t, 1, 2, "x", 3.0) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, length long, at long, piece string, score double")


# Packing --------------------------------------------------------------------------------------


def slow_packer(lengths, capacity, open_bins):
    """Every open bin is looked at for every piece."""
    free, closed, placed = {}, 0, []
    for n in lengths:
        fits = [b for b in free if free[b] >= n]
        if fits:
            least = min(free[b] for b in fits)
            into = max((b for b in fits if free[b] == least), key=lambda b: order[b])
        else:
            if n < capacity and len(free) == open_bins:
                least = min(free.values())
                del free[max((b for b in free if free[b] == least), key=lambda b: order[b])]
            into, closed = closed, closed + 1
            free[into] = capacity
            order = {} if into == 0 else order
        placed.append((into, capacity - free[into]))
        free[into] -= n
        order[into] = len(placed)
        if not free[into]:
            del free[into]
    return placed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 6))
def test_bitset_packer_is_bounded_best_fit(lengths, open_bins):
    packer = packing.Packer(16, open_bins)
    assert [packer.place(n) for n in lengths] == slow_packer(lengths, 16, open_bins)
    assert packer.held <= open_bins


def check_packed(rows, docs, capacity, end_id):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted = Counter()
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            wanted[doc, piece, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        upto = 0
        for offset, length in sorted(held):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(bins), sum(n for held in bins.values() for _, n in held)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_every_piece_is_packed_once(docs, capacity):
    rows = packing.pack(docs, TOKENIZER, capacity, 2).collect()
    bins, ids = check_packed(rows, DOCS, capacity, 2)
    assert bins <= 1.1 * math.ceil(ids / capacity) + 1


def test_packing_query_fills_sequences(spark):
    rows = queries.op11_packing(spark, SF).collect()
    given_docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bins, ids = check_packed(rows, given_docs, 1024, 2)
    assert bins <= 1.03 * math.ceil(ids / 1024)


def test_few_open_bins_pack_everything_too(spark, docs):
    pieces = packing.pieces_of(docs, TOKENIZER, 64, 2).cache()
    rows = packing.packed(pieces, 64, open_bins=1).collect()
    check_packed(rows, DOCS, 64, 2)
    pieces.unpersist()


def test_packing_of_no_rows(docs):
    assert packing.pack(docs.limit(0), TOKENIZER).collect() == []


# Vector codes ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("axes", "side"), [(1, 16), (2, 8), (3, 4)])
def test_curve_steps_to_a_neighbour(axes, side):
    cells = np.stack(np.meshgrid(*[np.arange(side)] * axes), axis=-1).reshape(-1, axes)
    full = np.concatenate((cells, [[side - 1] * axes]))  # sets the number of bits
    keys = vector_codes.hilbert_keys(full)[:-1]
    assert len(set(keys.tolist())) == len(cells)
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def slow_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in by_id[:entries]] for p in range(parts)]

    def nearest(x, p):
        apart = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        found = [[nearest(cut(v, p), p)[0] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), codes in zip(kept, found, strict=True) if codes[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, totals = [], Counter()
    for i, v, label in kept:
        each = [nearest(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in each), sum(d for _, d in each), label))
        totals[label] += out[-1][2]
    said = ",".join(str(x) for book in books for entry in book for x in entry)
    return Counter((i, code, error, totals[label]) for i, code, error, label in out), hashlib.sha256(said.encode()).hexdigest()


def vectors(spark, rows):
    wide = [(i, v, label, 1, "x", 2) for i, v, label in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, error long, code string, own int")


def codes_of(spark, rows, **settings_):
    codes = vector_codes.encode(vectors(spark, rows), **settings_)
    found = vector_codes.label_errors(codes.rows).collect()
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), codes.sha256()


def some_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, dim))], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(i, v, None) for i, v, _ in rows[:9]]  # repeated ids and ties, null labels
    rows += [(None, rows[3][1], 1), (n, None, 1), (n + 1, [*rows[0][1][:-1], None], 1), (n + 2, [*rows[0][1][:-1], float("nan")], 1)]
    return [*rows, (n + 3, [*rows[0][1][:-1], float("-inf")], 2)]


@pytest.mark.parametrize(("n", "dim", "entries"), [(700, 16, 12), (5, 8, 64), (300, 32, 1)])
def test_codes_equal_brute_force(spark, n, dim, entries):
    rows = some_vectors(n, dim, n)
    settings_ = {"parts": 4, "entries": entries, "rounds": 2, "scale": 256}
    assert codes_of(spark, rows, **settings_) == slow_codes(rows, **settings_)


def test_equal_vectors_take_the_lowest_entry(spark):
    rows = [(i, [0.5] * 8, 1) for i in range(200)] + [(900 + i, [0.25 * (i % 2)] * 8, None) for i in range(50)]
    settings_ = {"parts": 4, "entries": 16, "rounds": 2, "scale": 256}
    assert codes_of(spark, rows, **settings_) == slow_codes(rows, **settings_)


def test_vector_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    wanted = con.execute(queries.ORACLES["op12_vector_codes"]).df()
    found = queries.op12_vector_codes(spark, SF).toPandas()
    both = [t.sort_values("vec_id").reset_index(drop=True)[sorted(wanted.columns)] for t in (wanted, found)]
    assert len(wanted) and both[0].equals(both[1])


def test_boxes_spare_distances_and_lose_none():
    points = np.random.default_rng(3).integers(-150, 150, (20_000, 4))
    entries = np.random.default_rng(4).integers(-150, 150, (64, 4))
    blocks = vector_codes.Blocks(points)
    apart = ((points[:, None] - entries) ** 2).sum(axis=2)
    codes, errors = blocks.assigned(entries)
    assert (codes == apart.argmin(axis=1)).all() and (errors == apart.min(axis=1)).all()
    assert blocks.shortlists(entries).mean() < 0.4


def test_codes_of_no_usable_rows_and_other_lengths(spark):
    assert codes_of(spark, [(1, None, 1), (2, [], 1), (3, [1.0, 2.0, 3.0], 1)], parts=4) == (Counter(), hashlib.sha256(b"").hexdigest())
    assert codes_of(spark, [], parts=4)[0] == Counter()
    found, _ = codes_of(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [2.0] * 4, 1)], parts=4)
    assert {i for i, *_ in found} == {1, 3}


def test_codes_stand_for_their_vectors(spark):
    rows = [(i, [float(i % 3)] * 8, 0) for i in range(30)]
    codes = vector_codes.encode(vectors(spark, rows), parts=4, entries=3, rounds=1, scale=256)
    decoded = {r["vec_id"]: r["vector"] for r in vector_codes.decode(codes).collect()}
    assert decoded == {i: v for i, v, _ in rows}


# Resampling -----------------------------------------------------------------------------------

NOT_A_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = NOT_A_WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(run.encode()) % 10000 for run in runs]


def slow_resample(docs, target, percent, least_words):
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(slow_features(text)[1])
    for text in target:
        wanted.update(slow_features(text)[1])
    all_s, all_t = sum(corpus.values()), sum(wanted.values())
    rows, able = [], []
    for doc, text in docs:
        words, found = slow_features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (all_s + 10000) / ((corpus[b] + 1) * (all_t + 10000)))) for b in found]
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = sum(gain) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), sum(gain), score))
        if words >= least_words:
            able.append((-score, doc is None, doc))
    ranked = sorted(able)[: percent * len(able) // 100]
    return Counter(rows), [(doc, -score) for score, _, doc in ranked], len(able)


def found_resample(df):
    rows = df.collect()
    drawn = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(drawn) + 1))
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in rows), [(r["doc_id"], r["score"]) for r in drawn]


@pytest.mark.parametrize("percent", [0, 40, 100])
def test_resampling_equals_brute_force(spark, docs, percent):
    target = spark.createDataFrame([(prose(2, 300), 1), (None, 2), ("the the thing", 3)], "text string, doc_id int")
    found = resampling.resample(docs, target, percent=percent, least_words=20)
    wanted = slow_resample(DOCS, [r["text"] for r in target.collect()], percent, 20)
    assert found_resample(found) == wanted[:2]


def test_resampling_query_equals_brute_force(spark):
    given_docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = slow_resample(given_docs, target, 5, 20)
    assert found_resample(queries.op13_resampling(spark, SF)) == wanted[:2]
    assert len(wanted[1]) == 5 * wanted[2] // 100 > 0


def test_resampling_without_rows_or_target(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert found_resample(resampling.resample(docs, target, percent=50)) == slow_resample(DOCS, [], 50, 20)[:2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé ", min_size=1, max_size=120).map(lambda s: s.replace(" ", "b")), max_size=12))
def test_hashes_of_runs(words):
    spelt = [w.encode() for w in words]
    for n, crcs in enumerate(resampling.run_crcs(spelt), start=1):
        assert crcs.tolist()[n - 1 :] == [crc32(b" ".join(spelt[i : i + n])) for i in range(len(spelt) - n + 1)]


def test_texts_in_pieces_have_the_same_features(monkeypatch):
    texts = [*TEXTS, prose(8, 500)]
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(resampling, "PIECE", size)
        words, found = Counter(), defaultdict(Counter)
        for places, sizes, buckets, owners in resampling.bucket_runs(iter(texts)):
            words.update(dict(zip(places.tolist(), [0] * len(places), strict=True)))
            for place, n in zip(places.tolist(), sizes.tolist(), strict=True):
                words[place] += n
            for owner, bucket in zip(owners.tolist(), buckets.tolist(), strict=True):
                found[owner][bucket] += 1
        for place, text in enumerate(texts):
            n, wanted = slow_features(text)
            assert words[place] == n and found[place] == Counter(wanted)


@pytest.mark.parametrize("blocks", [4, 1 << 16])
def test_radix_sort(spark, monkeypatch, blocks):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(5)
    rows = [(int(a) if a % 11 else None, int(b), i) for i, (a, b) in enumerate(rng.integers(-(1 << 20), 1 << 13, (500, 2)) // [997, 1])]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(3)
    found = sorted(resampling.radix_sorted(df, [("a", True), ("b", False)]).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in found] == list(range(500))
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    assert [key((r["a"], r["b"])) for r in found] == sorted(map(key, rows))


def test_radix_sort_of_equal_and_single_rows(spark):
    same = spark.range(50).select(F.lit(7).alias("a"))
    assert sorted(r["at"] for r in resampling.radix_sorted(same, [("a", False)]).collect()) == list(range(50))
