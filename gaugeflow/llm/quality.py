"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors. The sum over all pairs is half of the square of
the summed vectors minus the summed squares, so a document is scored in time linear in its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from gaugeflow.llm.common import blocks_of
from gaugeflow.llm.labelled import held_out, training_rows

BUCKETS, FACTORS = 1 << 18, 8
#: Labelled documents that the model is fitted on at most.
TRAINING_ROWS = 6_000
EPOCHS, BATCHES, RATE, SHRINK = 12, 40, 0.08, 1e-5
SUPPORT = 4
REMEMBERED = 200_000
THRESHOLD = 0.3
#: Equal steps of a share between 0 and 1; larger values fall into the last.
STEPS = 20
#: Classes of the code points below 0x250: upper case, digit, mark, "!", "|", sentence end; others are 0.
UPPER, DIGIT, MARK, SHOUT, BAR, STOP = range(1, 7)


def _classes() -> np.ndarray:
    found = np.zeros(0x251, np.uint8)
    for c in map(chr, range(0x250)):
        mark = not c.isalnum() and not c.isspace() and c != "_"
        found[ord(c)] = UPPER if c.isupper() else DIGIT if c.isdecimal() else SHOUT if c == "!" else BAR if c == "|" else STOP if c in ".?" else MARK if mark else 0
    return found


CLASSES = _classes()


_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("features", pa.binary()), ("amounts", pa.binary())])


@dataclass(frozen=True)
class QualityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _bucket(name: str) -> int:
    return xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % BUCKETS


def structure(text: str, words: list[str], n_chars: int | None) -> list[str]:
    """A name for the step of each structure statistic, and for the length that the metadata state."""
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    n, size, rows = max(1, len(words)), max(1, len(text)), max(1, len(lines))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(CLASSES[np.minimum(points, 0x250)], minlength=7)
    counts = Counter(words)
    shares = {
        "upper": kinds[UPPER] / size,
        "digit": kinds[DIGIT] / size * 4,
        "mark": (kinds[MARK] + kinds[SHOUT] + kinds[BAR] + kinds[STOP]) / n / 2,
        "shout": kinds[SHOUT] / n,
        "bar": kinds[BAR] / n,
        "again": sum(map(eq, words, words[1:])) / n,
        "distinct": len(counts) / n,
        "common": max(counts.values(), default=0) / n,
        "lines": 1 - len(set(lines)) / rows,
        "short": sum(len(line) < 20 for line in lines) / rows,
        "length": sum(map(len, words)) / n / 20,
        "ends": (kinds[SHOUT] + kinds[STOP]) / n,
    }
    found = [f"#{name}:{min(STEPS, int(value * STEPS))}" for name, value in shares.items()]
    return [*found, f"#words:{len(words).bit_length()}", f"#n_chars:{'none' if n_chars is None else max(0, int(n_chars)).bit_length()}"]


class Featurizer:
    """Buckets and values of a text; word buckets are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens, known = text.lower().split(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = set(tokens)
        for word in words:
            if word not in known:
                known[word] = _bucket(word)
        buckets = np.sort(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        stats = np.array([_bucket(name) for name in structure(text, tokens, n_chars)], np.int32)
        values = np.ones(len(buckets) + len(stats), np.float32)
        values[: len(buckets)] = 1 / np.sqrt(max(1, len(buckets)))
        return np.concatenate([buckets, stats]), values


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features_of = Featurizer()
    for batch in blocks_of(batches):
        found = [features_of(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
        packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *packed], ["doc_id", "y", "features", "amounts"])


def fit_factorisation(features: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Logistic loss over mini-batches with per-weight rates."""
    support = np.zeros(BUCKETS, np.int32)
    for own in features:
        support[np.unique(own)] += 1
    names = np.flatnonzero(support >= SUPPORT)
    place = np.full(BUCKETS, -1, np.int64)
    place[names] = np.arange(len(names))
    draw = np.random.Generator(np.random.PCG64(11))
    w, v = np.zeros(len(names)), draw.standard_normal((len(names), FACTORS)) * 0.05
    w_squares, v_squares = np.full(len(names), 1e-6), np.full((len(names), FACTORS), 1e-6)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    parts = []
    for own in np.array_split(draw.permutation(len(labels)), min(BATCHES, max(1, len(labels)))):
        if len(own):
            flat, x = place[np.concatenate([features[k] for k in own])], np.concatenate([values[k] for k in own])
            row = np.repeat(np.arange(len(own)), [len(features[k]) for k in own])
            parts.append((flat[flat >= 0], x[flat >= 0].astype(float), row[flat >= 0], labels[own]))
    for _ in range(EPOCHS):
        for flat, x, row, y in parts:
            n = len(y)
            scaled = v[flat] * x[:, None]
            summed = np.stack([np.bincount(row, scaled[:, f], n) for f in range(FACTORS)], 1)
            pairs = 0.5 * ((summed**2).sum(1) - np.bincount(row, (scaled**2).sum(1), n))
            z = bias + np.bincount(row, w[flat] * x, n) + pairs
            pull = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            w_step = np.bincount(flat, pull[row] * x, len(w)) + SHRINK * w
            inner = (pull[row] * x)[:, None] * (summed[row] - scaled)
            v_step = np.stack([np.bincount(flat, inner[:, f], len(w)) for f in range(FACTORS)], 1) + SHRINK * v
            w_squares += w_step**2
            v_squares += v_step**2
            w -= RATE * w_step / np.sqrt(w_squares)
            v -= RATE * v_step / np.sqrt(v_squares) * (v_squares > 2e-6)
            bias -= RATE * pull.sum()
    linear, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    linear[names], factors[names] = w, v
    return QualityModel(bias, linear, factors)


def _with_length(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", length.alias("n_chars"))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = pa.Table.from_batches(batches, _FEATURES).sort_by("doc_id")
    unpack = lambda name, kind: [np.frombuffer(x, kind) for x in found.column(name).to_pylist()]
    labels = np.array(found.column("y").to_pylist(), np.int32)
    model = fit_factorisation(unpack("features", np.int32), unpack("amounts", np.float32), labels)
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (model.linear, model.factors)]
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *packed], ["bias", "linear", "factors"])


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents, in one task. Without labels every document scores one half."""
    sample = training_rows(_with_length(docs), labels, "quality", rows, "n_chars")
    features = sample.mapInArrow(_features, "doc_id long, y int, features binary, amounts binary")
    found = features.repartition(1).mapInArrow(_fit, "bias double, linear binary, factors binary").first()
    if found is None:
        return QualityModel(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    linear, factors = (np.frombuffer(bytes(found[name]), np.float32) for name in ("linear", "factors"))
    return QualityModel(found["bias"], linear, factors.reshape(BUCKETS, FACTORS))


def log_odds(model: QualityModel, buckets: np.ndarray, values: np.ndarray) -> float:
    scaled = model.factors[buckets] * values[:, None]
    summed = scaled.sum(0)
    return model.bias + float((model.linear[buckets] * values).sum() + 0.5 * ((summed**2).sum() - (scaled**2).sum()))


def _scores_with(model: QualityModel):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features_of = Featurizer()
        for batch in blocks_of(batches):
            rows = zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            z = np.array([log_odds(model, *features_of(text, n)) for text, n in rows])
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], ["doc_id", "score"])

    return scores


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text, n_chars?, ...)``; null texts score like empty ones."""
    return _with_length(docs).mapInArrow(_scores_with(model), "doc_id long, score double")


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score_quality(docs, train_quality(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
