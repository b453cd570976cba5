"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the document's is the
noisy-or of its sentences: one minus the product of their complements. Training sees document labels only, and the
sentence scores then show where the offending sentences are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from gaugeflow.llm.common import blocks_of, fields_of
from gaugeflow.llm.labelled import TRAINING_ROWS, held_out, training_rows

BUCKETS = 1 << 20
#: Longer stretches without a sentence end are cut after this many words.
SENTENCE_WORDS = 40
#: Beginnings of a word that are features besides the word, in letters.
PREFIXES = (3, 4, 5)
#: A feature must occur in this many training documents.
SUPPORT = 4
EPOCHS, BATCHES, RATE, SHRINK, START = 24, 24, 0.4, 1e-4, -4.0
#: Log-odds of every sentence where no document is labelled toxic.
UNTRAINED = -30.0
REMEMBERED = 200_000
THRESHOLD = 0.5
_END = re.compile(r"[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("features", pa.binary()), ("sizes", pa.binary())])


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings."""
    raw = word.encode("utf-8", "surrogatepass")
    starts = [xxh32_intdigest(word[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS for n in PREFIXES if len(word) > n]
    return [xxh32_intdigest(raw) % BUCKETS, *starts]


def sentence_words(text: str) -> tuple[list[str], list[int]]:
    """The different lower-case words of each sentence in turn, and how many each has.

    A word that a sentence repeats says no more than once.
    """
    flat, sizes = [], []
    for part in _END.split(text.lower()):
        words = _WORD.findall(part)
        for begin in range(0, len(words), SENTENCE_WORDS):
            own = dict.fromkeys(words[begin : begin + SENTENCE_WORDS])
            flat += own
            sizes.append(len(own))
    return flat, sizes


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each sentence of ``sentence_words``."""
    spans = []
    for match in _SENTENCE.finditer(text):
        # One word of the text may be several words in lower case, or a word may begin with a mark that lower case adds.
        count = len(_WORD.findall(match[0].lower()))
        if 0 < count <= SENTENCE_WORDS:
            spans.append(match.span())
        elif count:
            found = list(_WORD.finditer(match[0]))
            for i in range(0, count, SENTENCE_WORDS):
                first, last = found[min(i, len(found) - 1)], found[min(i + SENTENCE_WORDS, len(found)) - 1]
                spans.append((match.start() + first.start(), match.start() + max(first.end(), last.end())))
    return spans


class _Remembered(dict):
    """Values of words, made when first asked for; forgotten all at once when there are too many."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features_of = _Remembered(word_features)
    for batch in blocks_of(batches):
        flat, sizes = [], []
        for text in batch.column("text").to_pylist():
            words, lengths = sentence_words(text or "")
            found = list(map(features_of.__getitem__, words))
            ends = np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int64)])
            flat.append(np.array(list(chain.from_iterable(found)), np.int32).tobytes())
            sizes.append(np.diff(ends[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]).astype(np.int32).tobytes())
        columns = [batch.column("doc_id"), batch.column("y"), pa.array(flat, pa.binary()), pa.array(sizes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "features", "sizes"])


def fit_noisy_or(features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> ToxicityModel:
    """Sentence weights that make the noisy-or of each document likely; gradient steps with per-weight rates."""
    if not labels.any():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), UNTRAINED)
    weights = np.zeros(BUCKETS, np.float64)
    support = np.zeros(BUCKETS, np.int32)
    for own in features:
        support[np.unique(own)] += 1
    names = np.flatnonzero(support >= SUPPORT)
    place = np.full(BUCKETS, -1, np.int32)
    place[names] = np.arange(len(names))
    w, squares, bias, bias_squares = np.zeros(len(names)), np.full(len(names), 1e-6), START, 1e-6
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(labels))
    parts = []
    for own in np.array_split(order, min(BATCHES, max(1, len(order)))):
        if not len(own):
            continue
        flat = place[np.concatenate([features[k] for k in own])]
        lengths = np.concatenate([sizes[k] for k in own])
        sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[flat >= 0]
        document = np.repeat(np.arange(len(own)), [len(sizes[k]) for k in own])
        parts.append((flat[flat >= 0], sentence, document, len(lengths), labels[own]))
    for _ in range(EPOCHS):
        for flat, sentence, document, count, y in parts:
            z = bias + np.bincount(sentence, w[flat], count)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            unlikely = np.bincount(document, np.logaddexp(0, z), len(y))  # -log(1 - score)
            slope = np.where(y == 1, -1 / np.expm1(np.clip(unlikely, 1e-9, 50)), 1.0)
            pull = slope[document] * p / len(y)
            step = np.bincount(flat, pull[sentence], len(w)) + SHRINK * w
            squares += step * step
            w -= RATE * step / np.sqrt(squares)
            bias_step = pull.sum()
            bias_squares += bias_step * bias_step
            bias -= RATE * bias_step / np.sqrt(bias_squares)
    weights[names] = w
    return ToxicityModel(weights.astype(np.float32), float(bias))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = pa.Table.from_batches(batches, _FEATURES).sort_by("doc_id")
    unpack = lambda name: [np.frombuffer(x, np.int32) for x in found.column(name).to_pylist()]
    model = fit_noisy_or(unpack("features"), unpack("sizes"), np.array(found.column("y").to_pylist(), np.int32))
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "weights"])


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents, in one task. Where no label is toxic no sentence is."""
    sample = training_rows(docs, labels, "toxic", rows).mapInArrow(_features, "doc_id long, y int, features binary, sizes binary")
    found = sample.repartition(1).mapInArrow(_fit, "bias double, weights binary").first()
    if found is None:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), UNTRAINED)
    return ToxicityModel(np.frombuffer(bytes(found["weights"]), np.float32), found["bias"])


class SentenceScorer:
    """Log-odds of the sentences of a text under a model; word weights are remembered."""

    def __init__(self, model: ToxicityModel) -> None:
        weights = array("f", model.weights.tobytes())
        self.bias = model.bias
        self.weight = _Remembered(lambda word: sum([weights[f] for f in word_features(word)]))

    def __call__(self, text: str | None) -> np.ndarray:
        words, sizes = sentence_words(text or "")
        if not words:
            return np.zeros(0)
        weights = np.fromiter(map(self.weight.__getitem__, words), np.float64, len(words))
        return self.bias + np.add.reduceat(weights, np.cumsum([0, *sizes[:-1]]))


def noisy_or(log_odds: np.ndarray) -> float:
    """One minus the product of the complements; 0 without sentences."""
    return float(-np.expm1(-np.logaddexp(0, log_odds).sum()))


def offending(log_odds: np.ndarray) -> np.ndarray:
    """Numbers of the sentences that make a document toxic, ascending; none where the noisy-or is below the threshold.

    They are the sentences that are toxic by themselves, or else the fewest whose own noisy-or reaches the threshold.
    """
    alone = np.flatnonzero(log_odds >= 0)
    if len(alone) or not len(log_odds) or noisy_or(log_odds) < THRESHOLD:
        return alone
    order = np.argsort(-log_odds, kind="stable")
    reached = -np.expm1(-np.cumsum(np.logaddexp(0, log_odds[order]))) >= THRESHOLD
    return np.sort(order[: int(reached.argmax()) + 1] if reached.any() else order)


def _scores_with(model: ToxicityModel, score_name: str, offending_name: str):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences_of = SentenceScorer(model)
        for batch in blocks_of(batches):
            score, spans = [], []
            for text in batch.column("text").to_pylist():
                z = sentences_of(text)
                score.append(noisy_or(z))
                named = offending(z)
                found = sentence_spans(text) if len(named) else []
                spans.append([{"start": found[k][0], "end": found[k][1]} for k in named])
            kept = [batch.column(i) for i in range(batch.num_columns)]
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), spans], [*batch.schema.names, score_name, offending_name])

    return scores


def score_toxicity(docs: DataFrame, model: ToxicityModel, score: str = "score", spans: str = "offending") -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``score`` and the ``offending`` sentences (start, end in code points).

    Null and empty texts have no sentence and score 0. Every document that scores ``THRESHOLD`` has offending sentences. All
    rows and columns are returned; a column of ``docs`` that is named like a new one gives way to it, so name them otherwise
    to keep it.
    """
    rows = docs.drop(score, spans)
    schema = f"{fields_of(rows)}, `{score}` double, `{spans}` array<struct<start:int,end:int>>"
    return rows.mapInArrow(_scores_with(model, score, spans), schema)


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the number of offending sentences."""
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long"), "text"), train_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
