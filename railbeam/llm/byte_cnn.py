"""Quality classifier (operator 6): a convolutional network over bytes, written in numpy.

A byte is a fixed vector: its character class and a random code. Learned filters of eight bytes move by four,
and their maximum over a half chunk of 128 bytes is kept. A chunk is two neighbouring halves, so chunks overlap
by half and cover the whole text; the larger of its halves' maxima goes through a hidden layer to one logit per
chunk. A logistic layer combines the mean, the largest and the smallest logit of a text and its length into one
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import renamed, spread

HALF, STRIDE, FILTERS, HIDDEN, CODE = 128, 4, 48, 16, 12
POSITIONS = HALF // STRIDE
#: The sample for training: texts per label at most, pieces of a long text and characters of a piece (``spread``).
PER_LABEL, PIECES, PIECE_CHARS = 1500, 8, 500
#: Chunks of a text that one epoch learns from; each epoch draws others.
EPOCH_CHUNKS = 6
#: Halves that are scored at a time.
BLOCK = 2048


def _codes() -> np.ndarray:
    rng = np.random.default_rng(11)
    byte = np.arange(256)
    kinds = [(byte >= 97) & (byte <= 122), (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57), byte == 32, byte == 10, byte >= 128]
    codes = rng.normal(0, 0.7, (256, CODE)).astype(np.float32)
    codes[:, : len(kinds)] = np.array(kinds, np.float32).T * 1.5
    codes[0] = 0
    return codes


CODES = _codes()


@dataclass
class Network:
    first: np.ndarray  # filters over a window's first four bytes
    second: np.ndarray  # and over its last four
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        inner = np.maximum(np.maximum(pooled, 0) @ self.hidden + self.hidden_bias, 0)
        return inner @ self.out + self.out_bias[0]


def _maxima(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter maxima of each half chunk of the bytes, padded with zeros: (halves, filters)."""
    halves = max(1, -(-len(data) // HALF))
    found = np.empty((halves, FILTERS), np.float32)
    for at in range(0, halves, BLOCK):
        stop = min(at + BLOCK, halves)
        part = data[at * HALF : stop * HALF + STRIDE]
        padded = np.zeros((stop - at) * HALF + STRIDE, np.uint8)
        padded[: len(part)] = part
        quads = CODES[padded].reshape(-1, STRIDE * CODE)
        moved = quads[:-1] @ net.first + quads[1:] @ net.second
        found[at:stop] = moved.reshape(stop - at, POSITIONS, FILTERS).max(axis=1) + net.filter_bias
    return found


def features(net: Network, text: str | None) -> np.ndarray:
    """What the last layer combines: mean, largest and smallest chunk logit, length."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    halves = _maxima(net, data)
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    logits = np.clip(net.logits(chunks), -12, 12)
    return np.array([logits.mean(), logits.max(), logits.min(), np.log1p(len(data)) / 10, 1.0])


def score(net: Network, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(features(net, text) @ net.combine, -30, 30))))


def _chunks(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts = range(0, max(1, len(data) - HALF), HALF)
    found = np.zeros((len(starts), 2 * HALF + STRIDE), np.uint8)
    for row, start in zip(found, starts, strict=True):
        piece = data[start : start + 2 * HALF + STRIDE]
        row[: len(piece)] = piece
    return found


def _drawn(owner: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """At most ``EPOCH_CHUNKS`` chunks of each text, at random, in random order; ``owner`` is sorted."""
    order = np.lexsort((rng.random(len(owner)), owner))
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return rng.permutation(order[rank < EPOCH_CHUNKS])


def _piece(text: str, rng: np.random.Generator) -> str:
    """Some whole words of a text, 4 to 200 characters."""
    start = int(rng.integers(0, max(1, len(text) - 200)))
    cut = text[start : start + int(np.exp(rng.uniform(np.log(8), np.log(200))))]
    return " ".join(cut.split()[1 if start else 0 :]) or cut


def train(texts: list[str], labels: list[int], epochs: int = 14, rate: float = 3e-3, seed: int = 5) -> Network:
    """Adam on the chunks of the texts, each text with the same weight and both labels with the same; then the last layer.

    Every text is also learnt as a short piece of it, because a text's length says nothing about its quality.
    """
    rng = np.random.default_rng(seed)
    texts, labels = texts + [_piece(text, rng) for text in texts], labels + labels
    parts = [_chunks(text) for text in texts]
    x = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    y = np.array(labels, np.float32)[owner]
    drawn = np.array([min(len(p), EPOCH_CHUNKS) for p in parts])
    share = (1 / drawn).astype(np.float32)[owner]
    marks = np.array(labels)
    for label in (0, 1):
        share[y == label] *= drawn.sum() / 2 / max((marks == label).sum(), 1)
    width = STRIDE * CODE
    p = {
        "first": rng.normal(0, 0.15, (width, FILTERS)),
        "second": rng.normal(0, 0.15, (width, FILTERS)),
        "filter_bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, 0.2, (FILTERS, HIDDEN)),
        "hidden_bias": np.full(HIDDEN, 0.1),
        "out": rng.normal(0, 0.2, HIDDEN),
        "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    t = 0
    for _ in range(epochs):
        order = _drawn(owner, rng)
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            n = len(rows)
            quads = CODES[x[rows]].reshape(n, -1, width)
            moved = quads[:, :-1] @ p["first"] + quads[:, 1:] @ p["second"]
            best = moved.argmax(axis=1)
            pooled = np.take_along_axis(moved, best[:, None, :], axis=1)[:, 0] + p["filter_bias"]
            active = np.maximum(pooled, 0)
            inner = active @ p["hidden"] + p["hidden_bias"]
            lit = np.maximum(inner, 0)
            logit = lit @ p["out"] + p["out_bias"]
            error = share[rows] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / n
            g = {"out": lit.T @ error, "out_bias": error.sum(keepdims=True)}
            back = np.outer(error, p["out"]) * (inner > 0)
            g |= {"hidden": active.T @ back, "hidden_bias": back.sum(axis=0)}
            back = (back @ p["hidden"].T) * (pooled > 0)
            each = np.arange(n)[:, None]
            g["first"] = np.einsum("nf,nfk->kf", back, quads[each, best])
            g["second"] = np.einsum("nf,nfk->kf", back, quads[each, best + 1])
            g["filter_bias"] = back.sum(axis=0)
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net = Network(**p, combine=np.zeros(5))
    found = np.array([features(net, text) for text in texts])
    wanted = np.array(labels, np.float64)
    weight = np.array([0.5 / max(1, (wanted == label).sum()) for label in labels]) * len(labels)
    w = np.array([1.0, 0, 0, 0, 0])
    for _ in range(30):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(found @ w, -30, 30)))
        slope = found.T @ (weight * (q - wanted)) + 0.5 * w
        curve = (found * (weight * q * (1 - q))[:, None]).T @ found + 0.5 * np.eye(5)
        w -= np.linalg.solve(curve, slope)
    net.combine = w
    return net


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Network | None:
    """Train on at most ``per_label`` labelled texts of each label, chosen by a hash; None if there are none.

    ``learn_from`` is a condition on the labels' id. Of a sampled text over ``PIECES`` times ``PIECE_CHARS``
    characters that many pieces are learnt, one from each equal part; of rows that share an id, one. The
    chosen ids are at most twice ``per_label``, so they are broadcast and the texts are not shuffled.
    """
    marks = renamed(labels, own=doc_id, label=label).where("label is not null and own is not null").where(learn_from)
    marks = marks.groupBy("own").agg(F.max("label").cast("int").alias("label"))
    zero, one = (marks.where(F.col("label") == k).orderBy(F.xxhash64("own"), "own").limit(per_label) for k in (0, 1))
    rows = renamed(docs, doc_id=doc_id, text=text).where("text is not null")
    rows = rows.join(F.broadcast(zero.unionByName(one)), F.col("doc_id") == F.col("own"))
    rows = rows.select("own", "label", spread(F.col("text"), PIECES, PIECE_CHARS).alias("part"))
    sample = rows.groupBy("own", "label").agg(F.max("part").alias("part")).collect()
    sample.sort(key=lambda row: (row["own"], row["part"]))
    return train([row["part"] for row in sample], [row["label"] for row in sample]) if sample else None


def scored(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, from its whole text alone.

    A null text counts as empty; an empty text is one chunk of zeros. Without a network every score is 0.5. Null
    ids and repeated rows are scored like any other. An empty table gives an empty result.
    """
    slim = renamed(docs, doc_id=doc_id, text=text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([0.5 if net is None else score(net, x.as_py()) for x in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, score double, predicted int")
