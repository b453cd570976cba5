"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items of more than ``PIECE_WORDS`` words are cut into pieces of that size that overlap by half. The score of a piece is the best
local alignment's share of a full match; edited and paraphrased copies lose as much as they differ. An alignment worth
``EXCERPT_WORDS`` matching words is a copy whatever its share of the piece, so parts of long items are found too: the
overlap is longer than that, and such a part lies whole in one piece wherever it begins.

Seeds are word pairs. An alignment of m matching words and e errors that scores a share s of a piece of L words has 2m - e >= 2sL,
so it holds at least m - e - 1 >= (2s - 1)L - 1 pairs of neighbouring words unchanged, over at most (3 - 2s)L words of the
document. A piece therefore asks for so many hits within that stretch. Its commonest pairs over the corpus are no seeds, up to half
of that number, and it asks for as many hits fewer: the rarest remain, and no copy that scores enough is missed. Pieces of fewer than
ten words, where the number would be below one, also take pairs with one word between them, in the item and in the document. Items
under ``LEAST_WORDS`` words match texts that consist of the same words.

Items are taken in blocks of ``BLOCK_WORDS`` words: what a task holds of them is bounded, and each block is one
pass over all documents to count its pairs and one to find copies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import blocks_of, fields_of

#: Shorter items match whole texts only.
LEAST_WORDS = 5
PIECE_WORDS = 128
BLOCK_WORDS = 200_000
#: Matching words that make a copy of an item of any length.
EXCERPT_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6
#: Pieces of fewer words have gapped seeds too.
SMALL_WORDS = 10
_WORD = re.compile(r"\w+")


def least_share(words: int, threshold: float) -> float:
    """The score that a piece of so many words needs."""
    return min(threshold, EXCERPT_WORDS / words)


@dataclass
class Pieces:
    """Items of one block: pieces as word numbers (from 1), short items, and the word pairs that are looked for."""

    words: dict[str, int] = field(default_factory=dict)
    pieces: list[tuple[int, np.ndarray]] = field(default_factory=list)
    #: Items of fewer than ``LEAST_WORDS`` words.
    short: dict[tuple[str, ...], list[int]] = field(default_factory=dict)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Where each code's pieces begin in ``holders``, and the end.
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    holders: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: For each piece the hits it asks for and the words of a document that they may lie apart.
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spans: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    small: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, item: int, words: list[str]) -> None:
        if len(words) < LEAST_WORDS:
            if words:
                self.short.setdefault(tuple(words), []).append(item)
            return
        numbers = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64)
        last = max(0, len(numbers) - PIECE_WORDS)
        starts = [*range(0, last, PIECE_WORDS // 2), last]
        self.pieces += [(item, numbers[i : i + PIECE_WORDS]) for i in starts]

    def pairs(self, numbers: np.ndarray, apart: int = 1) -> np.ndarray:
        """Code of the pair that begins at each place, 0 where a word is unknown."""
        if len(numbers) <= apart:
            return np.zeros(0, np.int64)
        first, second = numbers[:-apart], numbers[apart:]
        return np.where((first > 0) & (second > 0), first * (len(self.words) + 1) + second, 0)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))

    def _index(self, chosen: list[tuple[int, np.ndarray]]) -> None:
        """Look for the codes chosen for each piece."""
        pieces = np.concatenate([np.full(len(codes), p) for p, codes in chosen] or [np.zeros(0, np.int64)]).astype(np.int64)
        codes = np.concatenate([codes for _, codes in chosen] or [np.zeros(0, np.int64)])
        order = np.lexsort((pieces, codes))
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.starts, self.holders = np.append(starts, len(codes)), pieces[order]

    def _all_codes(self, own: np.ndarray) -> np.ndarray:
        gapped = self.pairs(own, 2) if len(own) < SMALL_WORDS else own[:0]
        return np.unique(np.concatenate([self.pairs(own), gapped]))

    def look_for_all(self) -> None:
        self._index([(p, self._all_codes(own)) for p, (_, own) in enumerate(self.pieces)])

    def look_for_rare(self, frequency: dict[int, int], threshold: float) -> None:
        """Leave out the commonest pairs of each piece, as many as its score allows."""
        chosen, needed, spans = [], [], []
        for p, (_, own) in enumerate(self.pieces):
            share, codes = least_share(len(own), threshold), self._all_codes(own)
            hits = max(1, math.ceil((2 * share - 1) * len(own) - 1 - 1e-9))
            spare, left = hits // 2, []
            times = Counter(self.pairs(own).tolist())
            for code in sorted(codes.tolist(), key=lambda c: (-frequency.get(c, 0), c)):
                if len(own) >= SMALL_WORDS and times[code] <= spare:
                    spare -= times[code]
                    hits -= times[code]
                else:
                    left.append(code)
            chosen.append((p, np.array(left, np.int64)))
            needed.append(max(1, hits))
            spans.append(math.floor((3 - 2 * share) * len(own)) + 1)
        self._index(chosen)
        self.needed, self.spans = np.array(needed, np.int64), np.array(spans, np.int64)
        self.small = np.array([len(own) < SMALL_WORDS for _, own in self.pieces], bool)

    def hits(self, numbers: np.ndarray, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, number of the code) of the pairs that are looked for."""
        pairs = self.pairs(numbers, apart)
        at = np.flatnonzero(pairs)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.codes, pairs[at]), len(self.codes) - 1)
        real = self.codes[slot] == pairs[at]
        return at[real], slot[real]

    def _met(self, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place) of every piece that a hit belongs to."""
        count = self.starts[slots + 1] - self.starts[slots]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.holders[np.repeat(self.starts[slots], count) + inside], np.repeat(at, count)

    def windows(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(piece, from, to): stretches of the document with as many hits as the piece asks for."""
        piece, place = self._met(*self.hits(numbers))
        if self.small.any():
            more, there = self._met(*self.hits(numbers, 2))
            kept = self.small[more]
            piece, place = np.concatenate([piece, more[kept]]), np.concatenate([place, there[kept]])
        if not len(piece):
            return
        order = np.lexsort((place, piece))
        piece, place = piece[order], place[order]
        ahead = np.arange(len(piece)) + self.needed[piece] - 1
        inside = np.minimum(ahead, len(piece) - 1)
        enough = np.flatnonzero((ahead < len(piece)) & (piece[inside] == piece) & (place[inside] - place <= self.spans[piece]))
        held = None
        for p, lo, hi in zip(piece[enough].tolist(), place[enough].tolist(), place[inside[enough]].tolist()):
            span = int(self.spans[p])
            lo, hi = max(0, lo - span), min(len(numbers), hi + span + 2)
            if held and held[0] == p and lo <= held[2] and hi - held[1] <= 4 * span:
                held = (p, held[1], hi)
                continue
            if held:
                yield held
                # A long stretch is cut where the next one, which reaches a span back, holds all that may cross.
            held = (p, lo, hi)
        if held:
            yield held


def item_blocks(benchmark: DataFrame) -> Iterator[Pieces]:
    """Blocks of the items; rows reach the driver one block at a time."""
    block, held = Pieces(), 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        words = _WORD.findall(row["text"].lower())
        block.add(row["item_id"], words)
        held += len(words)
        if held >= BLOCK_WORDS:
            yield block
            block, held = Pieces(), 0
    if held:
        yield block


def _counter(block: Pieces):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in blocks_of(batches):
            for text in batch.column("text").to_pylist():
                _, slots = block.hits(block.numbers(_WORD.findall((text or "").lower())))
                counts.update(np.unique(slots).tolist())
        slots = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.codes[slots], pa.int64()), pa.array([counts[s] for s in slots], pa.int64())], ["code", "docs"]
        )

    return count


def with_seeds(docs: DataFrame, block: Pieces, threshold: float = THRESHOLD) -> Pieces:
    """The block with the rarest pairs of each piece as seeds; one pass over all documents counts them."""
    block.look_for_all()
    counts = docs.select("text").mapInArrow(_counter(block), "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    block.look_for_rare({r["code"]: r["docs"] for r in counts.collect()}, threshold)  # at most one row per word of the block
    return block


def alignment(piece: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment as a share of a full match, and where it ends in the window (exclusive)."""
    slope = GAP * np.arange(len(window) + 1)
    before, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in piece:
        row = np.zeros_like(before)
        row[1:] = before[:-1] + np.where(window == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(row, before + GAP), 0)
        row = np.maximum.accumulate(row - slope) + slope  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        before = row
    return best / (MATCH * len(piece)), end


def matches(block: Pieces, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of each item that the text copies; offsets in code points."""
    words = _WORD.findall(text.lower())
    numbers = block.numbers(words)
    best: dict[int, tuple[float, int, int]] = {}
    if len(words) < LEAST_WORDS:
        best = {item: (1.0, 0, len(words)) for item in block.short.get(tuple(words), ())}
    for piece, lo, hi in block.windows(numbers):
        item, own = block.pieces[piece]
        needed = least_share(len(own), threshold)
        window = numbers[lo:hi]
        shared = sum((Counter(own.tolist()) & Counter(window.tolist())).values())
        if shared < needed * len(own):  # no alignment can score more
            continue
        score, end = alignment(own, window)
        if score >= needed and score > best.get(item, (0.0,))[0]:
            start = end - alignment(own[::-1], window[:end][::-1])[1]
            best[item] = (score, lo + start, lo + end)
    if not best:
        return []
    # The lower-case form of a few letters is longer: places count words, which it leaves as they are.
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words):
        spans = [m.span() for m in _WORD.finditer(text.lower())]
    return [(item, score, spans[a][0], spans[b - 1][1]) for item, (score, a, b) in sorted(best.items())]


def _finder(block: Pieces, threshold: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches):
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [(d, *m) for d, t in zip(docs, texts) if t for m in matches(block, t, threshold)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "start", "end"])

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, end) for every document and item of ``benchmark(item_id, text)`` that it copies.

    Of an item with several matching places the best is given; a score below ``threshold`` is that of an excerpt. Null and
    empty texts and items match nothing. An item of fewer than ``LEAST_WORDS`` words matches the texts that consist of its words.
    Repeated documents and items match each. Empty tables give an empty result; other columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, start int, end int"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = [rows.mapInArrow(_finder(with_seeds(docs, block, threshold), threshold), schema) for block in item_blocks(benchmark)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _clean_only(block: Pieces, threshold: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches):
            yield batch.filter(pa.array([not (t and matches(block, t, threshold)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that copy an item; rows and columns that stay are unchanged."""
    out = docs
    for block in item_blocks(benchmark):
        out = out.mapInArrow(_clean_only(with_seeds(docs, block, threshold), threshold), fields_of(docs))
    return out
