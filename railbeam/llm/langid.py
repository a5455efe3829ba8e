"""Language identification (operator 9): averaged hashed subword embeddings under a linear softmax.

A text's features are the hashes of its byte n-grams in lower case. Their embeddings are averaged and mapped to
one score per language; both tables are trained by stochastic gradient descent in numpy on a bounded sample of
labelled texts. As everything before the softmax is linear, scoring adds up one row of class scores per n-gram.
A temperature fitted on texts that training left out calibrates the probabilities. Texts whose best probability is
below a threshold are rejected; it is fitted on the texts left out and on garbled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import renamed, spread

UNKNOWN = "und"
ORDERS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 15, 16
#: The sample for training: texts per language, pieces of a long text and characters of a piece (``spread``).
PER_LANGUAGE, PIECES, PIECE_CHARS = 1500, 6, 500
BLOCK = 1 << 19
#: Shares of left-out texts: of rightly predicted ones that the threshold may reject, of garbled ones that it should.
RIGHT_LOST, NOISE_REJECTED = 0.0005, 0.95
#: Languages that a model can learn: the most frequent ones.
MOST_LANGUAGES = 500
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(2654435761)


@dataclass
class Model:
    """``table`` has a row of class scores for each bucket of each order."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the table row of each n-gram of the bytes."""
    found, grams = [], np.zeros(len(data), np.uint32)
    for place, order in enumerate(ORDERS):
        if len(data) < order:
            break
        grams = (grams[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        found.append(((grams * _MIX) >> np.uint32(17)).astype(np.int64) + place * BUCKETS)
    return found


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)


def train(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 0.6, seed: int = 7) -> Model:
    """Gradient descent on four fifths of the texts, each also as a short piece; the rest calibrates."""
    languages = sorted(set(labels))
    classes = len(languages)
    rng = np.random.default_rng(seed)
    rows = len(ORDERS) * BUCKETS
    embed = rng.normal(0, 0.1, (rows, WIDTH)).astype(np.float32)
    soft, bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    soft += rng.normal(0, 0.1, soft.shape).astype(np.float32)
    parts = []
    for i, text in enumerate(texts):
        data = encoded(text)
        start = int(rng.integers(0, max(1, len(data) - 40)))
        for piece in (data, data[start : start + int(rng.integers(20, 200))]):
            ids = buckets(piece)
            if ids:
                unique, n = np.unique(np.concatenate(ids), return_counts=True)
                parts.append((i % 5 == 4, languages.index(labels[i]), unique, (n / n.sum()).astype(np.float32)))
    fit, kept = [p for p in parts if not p[0]] or parts, [p for p in parts if p[0]] or parts
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for at in rng.permutation(len(fit)):
            _, label, ids, share = fit[at]
            vectors = embed[ids]
            mean = share @ vectors
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            step = np.float32(rate * (1 - steps / total))
            back = soft @ p
            soft -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            embed[ids] -= step * 20 * share[:, None] * back[None, :]
            steps += 1
    table = (embed @ soft).astype(np.float32)
    raw = np.array([share @ table[ids] + bias for _, _, ids, share in kept], np.float64)
    truth = np.array([label for _, label, _, _ in kept])
    temperature = min(np.geomspace(0.05, 20, 200), key=lambda t: _loss(raw / t, truth))
    best = _softmax(raw / temperature)
    right = best.max(axis=1)[best.argmax(axis=1) == truth]
    model = Model(languages, table, bias, float(temperature), 0.0)
    # As low as noise allows, and never so high that more than a few of the right predictions go.
    noise = [predict(model, _garbled(text, rng))[1] for i, text in enumerate(texts) if i % 5 == 4]
    limits = [float(np.quantile(right, RIGHT_LOST)) if len(right) else 0.0, float(np.quantile(noise, NOISE_REJECTED)) if noise else 0.0]
    return replace(model, reject_below=min(limits))


def _garbled(text: str, rng: np.random.Generator) -> str:
    """A text of another kind: letters at random in words of the same lengths."""
    return "".join(chr(97 + int(k)) if c.isalpha() else c for c, k in zip(text, rng.integers(0, 26, len(text)), strict=True))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(logits)[np.arange(len(truth)), truth] + 1e-12).mean())


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(language, calibrated probability, rejected) of a whole text."""
    if not has_letter(text) or not model.languages:
        return UNKNOWN, 0.0, True
    data = encoded(text)
    sums, n = np.zeros(len(model.languages)), 0
    for at in range(0, len(data), BLOCK):
        # Blocks overlap so that n-grams across their border count once.
        for order, ids in zip(ORDERS, buckets(data[max(0, at - ORDERS[-1] + 1) : at + BLOCK]), strict=False):
            own = ids[ORDERS[-1] - order :] if at else ids
            sums += np.take(model.table, own, axis=0).sum(axis=0, dtype=np.float64)
            n += len(own)
    p = _softmax((sums / n + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.reject_below)


def fit(docs: DataFrame, learn_from: Column, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> Model:
    """Train on at most about ``per_language`` texts of each language, chosen by the hash of their ids.

    Of a text over ``PIECES`` times ``PIECE_CHARS`` characters that many pieces are learnt, one from each equal part.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    known = renamed(docs.where(learn_from), doc_id=doc_id, text=text, lang=lang).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {row["lang"]: row["n"] for row in counts.collect()}
    if not sizes:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n) * 1_000_003)])
    part = spread(F.col("text"), PIECES, PIECE_CHARS)
    sample = known.where(place < F.try_element_at(share, F.col("lang"))).select("lang", part.alias("part"), place.alias("place")).collect()
    sample = sorted((row for row in sample if has_letter(row["part"])), key=lambda row: (row["place"], row["part"]))
    return train([row["part"] for row in sample], [row["lang"] for row in sample]) if sample else fit(docs.limit(0), learn_from, doc_id, text, lang)


def languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every text if nothing
    could be learned. Null ids and repeated rows are predicted like any other. An empty table gives an empty result.
    """
    slim = renamed(docs, doc_id=doc_id, text=text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns; each row is judged for itself."""
    place, schema = docs.columns.index(text), docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not predict(model, x.as_py())[2] for x in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(of, schema)
