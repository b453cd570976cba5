"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length.

Pieces have between 1 and ``LENGTH`` tokens, so the serial best-fit-decreasing order only needs how many pieces there
are of each length. The plan is made on these counts, with runs of equal pieces and of equal bins: a segment tree over
remaining capacities gives the tightest open bin, and every piece then finds its place from its number among the
pieces of its length. The result is that of placing the pieces one by one.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import blocks_of, numbered, with_row_number
from gaugeflow.materialize import written_table

LENGTH, END = 2048, 0
#: Distinct words and cuts whose ids a worker remembers, about.
REMEMBERED = 1_000_000
#: What a vocabulary file does to a text before it cuts it, for its cuts to be remembered.
_NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Separators that the two pattern engines take differently, and letters with a special lower case.
_UNUSUAL = regex.compile("[\x1c-\x1f\x85\u180eΣİ]")


class OpenCapacities:
    """Segment tree over capacities 0..most: which of them have open bins."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        node = self.size + capacity
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest open capacity of at least ``need``."""
        node = self.size + need
        if not self.open[node]:
            while node > 1 and (node % 2 or not self.open[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def pack_counts(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing on counts by piece length.

    Returns runs (piece length, first number, first sequence, pieces per sequence, offset): from the first number
    on, that many consecutive pieces go to each sequence, starting at the offset.
    """
    tree, bins = OpenCapacities(length), {}
    runs, sequences = [], 0

    def shelve(capacity: int, lo: int, hi: int) -> None:
        if capacity and lo < hi:
            bins.setdefault(capacity, []).append((lo, hi))
            tree.put(capacity, True)

    for size in sorted((s for s in counts if counts[s]), reverse=True):
        number, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                per, capacity = length // size, length
                lo, hi = sequences, sequences + -(-left // per)
                sequences = hi
            else:
                per = capacity // size
                lo, hi = bins[capacity].pop()
                if not bins[capacity]:
                    tree.put(capacity, False)
            full = min(hi - lo, left // per)
            partly = left - full * per if full < hi - lo else 0
            runs.append((size, number, lo, per, length - capacity))
            shelve(capacity - per * size, lo, lo + full)
            if partly:
                shelve(capacity - partly * size, lo + full, lo + full + 1)
            shelve(capacity, lo + full + bool(partly), hi)
            number += full * per + partly
            left -= full * per + partly
    return runs


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def _cuts(path: str) -> tuple[regex.Pattern | None, str]:
    """The pattern of a vocabulary file's cuts and the ending of a cut's last token; no pattern where its rules are others."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normaliser, (first, *rest) = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    suffix = spec["model"].get("end_of_word_suffix") or ""
    split = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
    plain = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
    if split and plain and suffix and normaliser.get("normalizers") == _NORMALISED:
        return regex.compile(first["pattern"]["Regex"]), suffix
    return None, suffix


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The tokenizer puts a text in lower case, cuts it by a pattern and encodes each cut on its own. No cut holds white space, so the ids
    of a word between white space are those of its cuts; they are remembered, and a word that occurs again costs one look-up,
    without being cut. Texts that change when
    normalised, or have letters whose lower case depends on their neighbours, go to the tokenizer whole, and so do all texts under a
    vocabulary file with other rules.
    """

    def __init__(self, path: str) -> None:
        self.model, self.known, self.words = _tokenizer(path), {}, {}
        vocabulary = self.model.get_vocab()
        self.cuts, suffix = _cuts(path)
        #: Whether a token ends a cut.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True

    def _learn(self, cuts: list[str]) -> None:
        """Remember the ids of cuts, encoded as one text with white space between them: each ends with one end token."""
        ids = np.array(self.model.encode_batch_fast([" ".join(cuts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) == len(cuts):
            raw = ids.tobytes()
            for cut, begin, end in zip(cuts, [0, *ends], ends):
                self.known[cut] = raw[4 * begin : 4 * end]
        else:
            for cut in cuts:
                self.known[cut] = self._plain(cut)

    def _learn_words(self, words: list[str]) -> None:
        if len(self.words) + len(self.known) > REMEMBERED:
            self.known.clear()
        cuts = [self.cuts.findall(word) for word in words]
        new = [cut for cut in dict.fromkeys(chain.from_iterable(cuts)) if cut not in self.known]
        if new:
            self._learn(new)
        for word, own in zip(words, cuts):
            self.words[word] = b"".join(map(self.known.__getitem__, own))

    def _plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cuts is None or _UNUSUAL.search(text) or not unicodedata.is_normalized("NFC", text):
            return self._plain(text)
        words, known = text.lower().split(), self.words
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            self._learn_words([word for word in dict.fromkeys(words) if word not in known])
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that they share what it remembers."""
    return Encoder(path)


def _pieces_with(path: str, length: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = np.array([END], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in blocks_of(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for piece, begin in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[begin : begin + 4 * length]
                    rows.append((doc, piece, begin // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return pieces


def tokenized_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``length`` tokens of every document, the end token included."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces_with(path, length, with_ids), schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs(doc_id, text, ...)`` with their sequence_id and offset.

    A null text is empty: one end token. Only documents longer than ``length`` are cut. Repeated rows are packed as
    often as they occur; a null doc_id stays null. An empty table gives an empty result. ``with_ids`` adds the ids as
    little-endian 32-bit integers.
    """
    pieces = written_table(with_row_number(tokenized_pieces(docs, path, length, with_ids)), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    runs: dict[int, list] = {}
    for size, *run in pack_counts(counts, length):
        runs.setdefault(size, []).append(tuple(run))
    plan = docs.sparkSession.createDataFrame(
        list(runs.items()), "length long, runs array<struct<first:long,sequence:long,per:long,offset:long>>"
    )
    order = ["doc_id", "piece", "ids_crc32"]
    numbers = numbered(pieces, ["length"], order, "number")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)
    inside = F.col("number") - F.col("run.first")
    return (
        numbers.join(plan, "length")
        .withColumn("run", run)
        .withColumn("sequence_id", F.col("run.sequence") + F.expr("cast((number - run.first) div run.per as long)"))
        .withColumn("offset", F.col("run.offset") + F.pmod(inside, F.col("run.per")) * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
    )
