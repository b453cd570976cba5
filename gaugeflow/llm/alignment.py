"""Token alignment between two tokenizers by lockstep merging.

Both tokenizers cut the same bytes. Byte offsets at which tokens of both end cut a document into groups, and tokens of a group
are linked. All documents of a batch are merged at once: a state vector holds one pointer into A's and one into B's tokens
for every lane; each step advances in all lanes the pointer whose token ends first, or both where they end together, which
is a cut that completes a group and its links. Lanes that reach their end leave the vector. A long document takes part as
several lanes that begin at common ends, so that none keeps the others waiting.

How many documents hold a pair of ids is counted over the whole corpus. Documents stay in chunks as they were read; only
a chunk's distinct pairs are shuffled, and the counts come back to the chunk.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import blocks_of
from gaugeflow.materialize import written_table

#: A tokens of a lane, about. A lane ends at the first common end among the next ``LOOK`` tokens, or goes on.
LANE, LOOK = 512, 64
#: Bytes of text that a worker aligns at once, besides one text that is longer: each has some fifty bytes of arrays.
ALIGNED_AT_ONCE = 2_000_000
#: Groups with more links than this are expanded by their distinct ids.
LARGE = 64


class Groups(NamedTuple):
    """Groups in order: their first A and B tokens, and how many of each."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


def _lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lanes: those of the documents, and common ends inside documents of more than ``LANE`` tokens."""
    bounds = np.append(a_starts, len(a_ends))
    parts = np.diff(bounds) // LANE
    which = np.repeat(np.arange(len(parts)), parts)
    wanted = a_starts[which] + LANE * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts) + 1)
    look = np.minimum(wanted[:, None] + np.arange(LOOK), bounds[which + 1][:, None] - 1)
    places = np.searchsorted(b_ends, a_ends[look])
    common = b_ends[np.minimum(places, len(b_ends) - 1)] == a_ends[look]
    found, at = common.any(1), common.argmax(1)
    rows = np.arange(len(which))
    a = np.append(a_starts, look[rows, at][found] + 1)
    b = np.append(b_starts, places[rows, at][found] + 1)
    a, kept = np.unique(a[a < len(a_ends)], return_index=True)
    return a, b[kept]


def merge_in_lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> Groups:
    """Groups of all documents of a batch.

    The ends are byte offsets into the batch's texts put after one another, so a document's last tokens end together.
    ``a_starts`` and ``b_starts`` are the first tokens of each document; every document has some.
    """
    if not len(a_ends):
        return Groups(*[np.zeros(0, np.int64)] * 4)
    lane_a, lane_b = _lanes(a_ends, b_ends, a_starts, b_starts)
    stop = np.append(lane_a[1:], len(a_ends))
    at_a, at_b, from_a, from_b = lane_a.copy(), lane_b.copy(), lane_a, lane_b
    cuts = []
    while len(at_a):
        ends, others = a_ends[at_a], b_ends[at_b]
        first, second = ends <= others, others <= ends
        cut = np.flatnonzero(first & second)
        at_a, at_b = at_a + first, at_b + second
        if len(cut):
            cuts.append((from_a[cut], at_a[cut], from_b[cut], at_b[cut]))
            from_a[cut], from_b[cut] = at_a[cut], at_b[cut]
            going = at_a < stop
            if not going.all():
                at_a, at_b, from_a, from_b, stop = (x[going] for x in (at_a, at_b, from_a, from_b, stop))
    a, a_to, b, b_to = (np.concatenate(x) for x in zip(*cuts))
    order = np.argsort(a)
    return Groups(a[order], (a_to - a)[order], b[order], (b_to - b)[order])


def links(groups: Groups, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, times): all pairs of an A and a B token of a group; a large group gives each pair of ids once."""
    count = groups.n_a * groups.n_b
    small = np.flatnonzero(count <= LARGE)
    many = count[small]
    group = np.repeat(small, many)
    place = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    row, column = np.divmod(place, groups.n_b[group])
    found = [(group, a_ids[groups.a[group] + row], b_ids[groups.b[group] + column], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(count > LARGE):
        a, a_times = np.unique(a_ids[groups.a[g] : groups.a[g] + groups.n_a[g]], return_counts=True)
        b, b_times = np.unique(b_ids[groups.b[g] : groups.b[g] + groups.n_b[g]], return_counts=True)
        found.append((np.full(len(a) * len(b), g), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(a_times, b_times).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Ids and byte lengths of whole texts in both vocabularies. Only a plain byte-level BPE file will do for A."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        model, cuts, special = spec["model"], spec["pre_tokenizer"] or {}, {t["content"] for t in spec["added_tokens"]}
        plain = model["type"] == "BPE" and not spec["normalizer"] and cuts.get("type") == "ByteLevel"
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if not plain or cuts["add_prefix_space"] or not cuts["use_regex"] or any(model["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merged)):
            raise ValueError(f"{path_a} is no plain byte-level BPE vocabulary in the order of its merges")
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): number for token, number in model["vocab"].items() if token not in special}
        # The same merges as the file's own library, several times as fast; special tokens are plain text.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = max(model["vocab"].values()) + 1, self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(map(self.b.id_to_piece, range(self.size_b)))
        ]
        self.length_a = np.zeros(self.size_a, np.int64)
        self.length_a[list(ranks.values())] = [len(token) for token in ranks]
        self.length_b = np.array([len(token) for token in self.bytes_b], np.int64)
        names = [f"{k}{end}" for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for k in range(size)]
        #: Decimal ids with the sign that follows: A inside and at the end of its part, then B.
        self.names = np.array(names, "S")

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where there are no tokens or their bytes are not those of a space and the text."""
        if not text:
            return None
        raw = (" " + text).encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if self.a.decode_bytes(a) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Aligned(NamedTuple):
    """A batch: token ids of its documents with tokens, where each document starts, and the groups of all."""

    documents: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    groups: Groups
    #: Number, among ``documents``, of each group's document.
    owner: np.ndarray


def align(texts: list[str | None], both: Tokenizers) -> Aligned:
    encoded = [both(text) for text in texts]
    documents = np.array([k for k, found in enumerate(encoded) if found], np.int64)
    none = [np.zeros(0, np.int64)]
    a_ids, b_ids = (np.concatenate([encoded[k][side] for k in documents] or none) for side in (0, 1))
    a_starts, b_starts = (np.cumsum([0, *[len(encoded[k][side]) for k in documents]])[:-1].astype(np.int64) for side in (0, 1))
    groups = merge_in_lockstep(np.cumsum(both.length_a[a_ids]), np.cumsum(both.length_b[b_ids]), a_starts, b_starts)
    owner = np.searchsorted(a_starts, groups.a, side="right") - 1
    return Aligned(documents, a_ids, b_ids, a_starts, b_starts, groups, owner)


def group_texts(found: Aligned, both: Tokenizers) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document with tokens: the decimal ids of its groups."""
    groups, n_a, n_b = found.groups, len(found.a_ids), len(found.b_ids)
    last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    last_a[groups.a + groups.n_a - 1] = last_b[groups.b + groups.n_b - 1] = 1
    names = np.empty(n_a + n_b, both.names.dtype)
    # B's tokens before a group stand before its A tokens, its A tokens before its B tokens.
    names[np.arange(n_a) + np.repeat(groups.b, groups.n_a)] = both.names[found.a_ids + last_a * both.size_a]
    names[np.arange(n_b) + np.repeat(groups.a + groups.n_a, groups.n_b)] = both.names[2 * both.size_a + found.b_ids + last_b * both.size_b]
    starts = [*(found.a_starts + found.b_starts).tolist(), n_a + n_b]
    return [names[lo:hi].tobytes().translate(None, b"\0")[:-1] for lo, hi in zip(starts, starts[1:])]


def _counts_by_owner(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of ``values`` by ascending ``owner``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return np.diff(sums[np.searchsorted(owner, np.arange(size + 1))])


_CHUNK = pa.schema(
    [
        ("chunk", pa.string()),
        ("doc_id", pa.list_(pa.int64())),
        *[(name, pa.list_(pa.int64())) for name in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.list_(pa.string())),
        ("n_pairs", pa.list_(pa.int64())),
        ("at", pa.binary()),
        ("times", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("holders", pa.list_(pa.int64())),
    ]
)
_CHUNK_SQL = (
    "chunk string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, n_pairs array<long>, at binary, times binary, pairs array<long>, holders array<long>"
)
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk(ids: list, found: Aligned, both: Tokenizers) -> dict:
    """A batch of documents as one row: figures of each, its distinct pairs of ids as places in the chunk's, and how often each."""
    docs = len(found.documents)
    group, a, b, times = links(found.groups, found.a_ids, found.b_ids)
    key = (found.owner[group] << 40) + a * both.size_b + b
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(times, starts) if len(starts) else times
    owner, pair = key[starts] >> 40, key[starts] & ((1 << 40) - 1)
    pairs, at, holders = np.unique(pair, return_inverse=True, return_counts=True)

    def whole(values: np.ndarray) -> list[int]:
        out = np.zeros(len(ids), np.int64)
        out[found.documents] = values
        return out.tolist()

    digests = [""] * len(ids)
    for k, text in zip(found.documents.tolist(), group_texts(found, both)):
        digests[k] = sha256(text).hexdigest()
    sizes = found.groups.n_a * found.groups.n_b
    return {
        "chunk": uuid.uuid4().hex,
        "doc_id": ids,
        "n_a": whole(np.diff(np.append(found.a_starts, len(found.a_ids)))),
        "n_b": whole(np.diff(np.append(found.b_starts, len(found.b_ids)))),
        "n_groups": whole(_counts_by_owner(np.ones(len(sizes), np.int64), found.owner, docs)),
        "n_links": whole(_counts_by_owner(sizes, found.owner, docs)),
        "groups_sha256": digests,
        "n_pairs": whole(_counts_by_owner(np.ones(len(owner), np.int64), owner, docs)),
        "at": at.astype("<i4").tobytes(),
        "times": times.astype("<i8").tobytes(),
        "pairs": pairs,
        "holders": holders.astype(np.int64),
    }


def _chunks_with(path_a: str, path_b: str):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in blocks_of(batches, at_once=ALIGNED_AT_ONCE):
            row = _chunk(batch.column("doc_id").to_pylist(), align(batch.column("text").to_pylist(), both), both)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _CHUNK], schema=_CHUNK)

    return chunks


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk's documents, from the counts of its pairs in their order."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            ids = row["doc_id"].values
            counts, best = (
                np.zeros(0, np.int64) if row[name].values is None else row[name].values.to_numpy(zero_copy_only=False).astype(np.int64)
                for name in ("counts", "bests")
            )
            at, times = np.frombuffer(row["at"].as_py(), "<i4"), np.frombuffer(row["times"].as_py(), "<i8")
            n_pairs = row["n_pairs"].values.to_numpy()
            owner = np.repeat(np.arange(len(ids)), n_pairs)
            n_best = _counts_by_owner(times * best[at], owner, len(ids))
            total = _counts_by_owner(times * counts[at], owner, len(ids))
            figures = [row[name].values for name in ("n_a", "n_b", "n_groups", "n_links")]
            columns = [ids, *figures, pa.array(n_best), pa.array(total), row["groups_sha256"].values]
            yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in ROWS.split(", ")])


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def pair_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents of the corpus a pair is linked, and whether that is its A id's highest count."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.pairs", "x.holders")
    counts = written_table(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")), "pair-counts")
    of_a = F.expr(f"pair div {size_b}").alias("a")
    highest = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", of_a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def op12_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Figures of the links of every text of ``docs(doc_id, text, ...)``.

    A text that is null or empty, or whose tokens do not spell a space and the text, has no tokens: zeros and an empty
    digest. Repeated rows count as documents of their own, null ids stay null, and other columns are ignored. An empty table
    gives an empty result. A row of the intermediate table is of up to 2 MB of texts, or one longer text.
    """
    path_a, path_b = _paths(path_a, path_b)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = written_table(rows.mapInArrow(_chunks_with(path_a, path_b), _CHUNK_SQL), "alignment")
    counts = pair_counts(chunks, tokenizers(path_a, path_b).size_b)
    asked = chunks.select("chunk", F.explode("pairs").alias("pair"))
    # As many values as the chunk has distinct pairs.
    answers = (
        asked.join(counts, "pair")
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))
        .select("chunk", F.col("known.n").alias("counts"), F.col("known.best").alias("bests"))
    )
    none = [F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in (("counts", "array<long>"), ("bests", "array<boolean>"))]
    joined = chunks.drop("pairs", "holders").join(answers, "chunk", "left")
    kept = [name for name in chunks.columns if name not in ("chunk", "pairs", "holders")]
    return joined.select(*kept, *none).mapInArrow(_document_rows, ROWS)


def _groups_with(path_a: str, path_b: str):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in blocks_of(batches, at_once=ALIGNED_AT_ONCE):
            found = align(batch.column("text").to_pylist(), both)
            groups = found.groups
            ids = batch.column("doc_id").take(pa.array(found.documents[found.owner]))
            first = np.searchsorted(found.owner, np.arange(len(found.documents)))
            number = pa.array(np.arange(len(found.owner)) - first[found.owner])
            sides = [
                pa.ListArray.from_arrays(pa.array(np.append(start, len(tokens)), pa.int32()), pa.array(tokens))
                for start, tokens in ((groups.a, found.a_ids), (groups.b, found.b_ids))
            ]
            yield pa.RecordBatch.from_arrays([ids, number, *sides], ["doc_id", "number", "a_ids", "b_ids"])

    return grouped


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, number, a_ids, b_ids): the groups themselves, numbered from 0 in a document; texts without tokens have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_groups_with(*_paths(path_a, path_b)), "doc_id long, number long, a_ids array<long>, b_ids array<long>")
