"""SimHash near-duplicates (operator 1): fingerprints, Golay keys, verified links and their components.

A 64-bit fingerprint has the majority of each bit over the hashes of a text's shingles. Equal fingerprints are
one vertex, whatever the number of their documents. A fingerprint is cut into segments of 22, 21 and 21 bits.

* Up to 2 differing bits: some segment is equal (pigeonhole), and the next one differs in at most two bits, so
  both fingerprints decode it to a common Golay index. The key is the equal segment with that index, about
  sixteen keys for each fingerprint.
* Up to 8 differing bits: some segment differs in at most two bits, and its Golay indices alone are the keys.

Members of a key are joined and their differing bits counted. A key with more than ``pair_limit`` members is not
joined with itself: for up to 2 bits its members are linked through all words one bit away from them, which is
exact (two fingerprints share such a word just when at most two bits differ) and grows with the members alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import forget, packed_words, renamed, stored
from railbeam.llm.components import components
from railbeam.llm.golay import indices

HASH_SEED = 42
#: Shift and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at a time, so that a very long text takes no more memory than its words.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The unsigned fingerprint of a text; 0 for null and for texts without a word."""
    words = packed_words(text)
    if not words:
        return 0
    size = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = len(words) - size + 1
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, shingles, BLOCK):
        stop = min(at + BLOCK, shingles)
        bounds = zip(starts[at:stop].tolist(), ends[at + size - 1 : stop + size - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in bounds], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""
    slim = renamed(docs, doc_id=doc_id, text=text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle_words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, fp long")


def _keys(max_bits: int):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy().astype(np.int64)
            for at in range(0, len(fps), BLOCK):
                part = fps[at : at + BLOCK]
                cut = [(part.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in SEGMENTS]
                for i in range(len(SEGMENTS)):
                    near = (i + 1) % len(SEGMENTS) if max_bits <= 2 else i
                    rows, index = indices(cut[near], SEGMENTS[near][1])
                    equal = cut[i][rows].astype(np.int64) if max_bits <= 2 else np.zeros(len(rows), np.int64)
                    yield pd.DataFrame({"key": (i << 40) | (equal << 12) | index.astype(np.int64), "fp": part[rows]})

    return of


def links(distinct_fps: DataFrame, max_bits: int = 2, pair_limit: int = 64) -> DataFrame:
    """Links (a, b), a < b, that connect just the fingerprints at most ``max_bits`` bits apart.

    Fingerprints that are linked directly or by a chain of such links are connected in the result, and every
    link of the result differs in at most ``max_bits`` bits.
    """
    if not 0 <= max_bits <= 8:
        raise ValueError("the Golay keys cover up to 8 differing bits")
    keys = stored(distinct_fps.select("fp").mapInPandas(_keys(max_bits), "key long, fp long"), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(keys.join(sizes, "key"), "simhash-shared")
    forget(keys)
    few = shared if max_bits > 2 else shared.where(F.col("members") <= pair_limit)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    paired = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (bits <= max_bits)).select("a", "b")
    if max_bits > 2:
        return paired.distinct()
    flips = F.array(*[F.lit(v) for v in (0, *(1 << bit if bit < 63 else -(1 << 63) for bit in range(64)))] if max_bits > 1 else [F.lit(0).cast("long")])
    crowded = shared.where(F.col("members") > pair_limit).select("fp").distinct()
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    hubs = near.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    through = near.join(hubs, "word").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    if max_bits == 1:
        # One differing bit: the star would also join words two bits apart, so the flipped word itself must exist.
        one = crowded.select("fp", F.explode(F.array(*[F.lit(1 << bit if bit < 63 else -(1 << 63)) for bit in range(64)])).alias("flip"))
        other = crowded.select(F.col("fp").alias("b"))
        through = one.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b")).where("a < b").join(other, "b").select("a", "b")
    return paired.union(through).distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    pair_limit: int = 64,
) -> DataFrame:
    """(doc_id, fp, component_id, copies) for every row of ``docs``.

    ``component_id`` is the smallest doc_id among rows reachable by links of at most ``max_bits`` bits, the row
    itself included; ``copies`` counts the rows with the same fingerprint. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Rows with a null doc_id are kept; they belong to a component
    like others but never name it (a component of null ids alone has a null id). Repeated rows are all returned.
    An empty table gives an empty result. Only the two named columns are read.
    """
    fps = stored(fingerprints(docs, doc_id, text, shingle_words), "simhash-fps")
    vertices = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-vertices")
    group = components(links(vertices, max_bits, pair_limit))
    linked = vertices.join(group, vertices["fp"] == group["node"])
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    far = linked.join(named, "component").select("fp", "component_id")
    classes = vertices.join(far, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "copies")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id", "copies")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
