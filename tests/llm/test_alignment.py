"""Token alignment against plain loops."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from gaugeflow.llm.alignment import LANE, ROWS, merge_in_lockstep, op12_alignment, token_groups

FIELDS = [part.split()[0] for part in ROWS.split(", ")]
STRANGE = [
    None, "", " ", "a", "<|endoftext|> and <s> </s> <unk>", "don't  stop\n\n\n now", "café 你好 \U0001f600\U0001f600", "x" * 300,
    "a\x00b", "▁ low line", "ﬁ ① ½", "=" * 500 + "!" * 90, "  two  spaces  ", "\t\r\n", "<0x41> A",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _groups(text, libraries):
    """[(A ids, B ids)] of a text, with the vocabularies' own libraries and sets of ends."""
    if not text:
        return []
    a, b = libraries
    found = a.encode(" " + text, add_special_tokens=False)
    byte_of = _byte_of()
    sides = [(found.ids, [bytes(byte_of[c] for c in token) for token in found.tokens])]
    ids = b.encode(text)
    sides.append((ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids))]))
    if any(b"".join(raw) != (" " + text).encode() for _, raw in sides):
        return []
    ends = [np.cumsum([len(x) for x in raw]).tolist() for _, raw in sides]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, begin = [], 0
    for end in common:
        groups.append(tuple([i for i, e in zip(side[0], own) if begin < e <= end] for side, own in zip(sides, ends)))
        begin = end
    return groups


def _expected(rows, libraries):
    grouped = [_groups(text, libraries) for _, text in rows]
    links = [Counter((a, b) for xs, ys in groups for a in xs for b in ys) for groups in grouped]
    count = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, _), groups, own in zip(rows, grouped, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append(
            (
                doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
                sum(n for pair, n in own.items() if count[pair] == highest[pair[0]]),
                sum(n * count[pair] for pair, n in own.items()),
                sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return Counter(out)


def _texts(seed):
    draw = random.Random(seed)
    words = ["the", "enen", "ß", "étion", "http://x.yz/", "1234567", "!!!", "日本", "\n", "  ", "foo_bar", "\U0001f468‍\U0001f469"]
    return [" ".join(draw.choices(words, k=draw.choice([1, 5, 40, 900]))) for _ in range(60)]


def test_against_loops(spark, libraries):
    rows = [(k, text) for k, text in enumerate(STRANGE + _texts(1))]
    rows += rows[:20] + [(None, "null id"), (None, "null id"), (10**12, "the " * 6_000)]
    df = spark.createDataFrame([(d, t, "mine", 1) for d, t in rows], "doc_id long, text string, chunk string, pair int").repartition(5)
    found = Counter(tuple(r[f] for f in FIELDS) for r in op12_alignment(df).collect())
    assert found == _expected(rows, libraries)


def test_given_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = Counter(tuple(r[f] for f in FIELDS) for r in op12_alignment(docs).collect())
    assert found == _expected(rows, libraries)


def test_groups(spark, libraries):
    texts = STRANGE + _texts(2)[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["number"], r["a_ids"], r["b_ids"]) for r in token_groups(df).collect())
    assert found == [(d, k, a, b) for d, text in enumerate(texts) for k, (a, b) in enumerate(_groups(text, libraries))]


def test_lanes_of_long_documents():
    """Documents of many lanes, and one whose tokens meet only at its end."""
    draw = np.random.default_rng(3)
    sizes = [3, 40 * LANE, 1, 2 * LANE + 1]
    a, b, a_starts, b_starts, at = [], [], [], [], 0
    for n in sizes:
        a_starts.append(len(a)), b_starts.append(len(b))
        own = np.cumsum(draw.integers(1, 4, n))
        a += (at + own).tolist()
        other = sorted({*draw.integers(1, own[-1] + 1, n).tolist(), int(own[-1])})
        b += [at + x for x in other]
        at += int(own[-1])
    a_starts.append(len(a)), b_starts.append(len(b))
    a += [at + 2 * k for k in range(1, 2000)] + [at + 4001]
    b += [at + 2 * k + 1 for k in range(2000)] + [at + 4001]
    found = merge_in_lockstep(np.array(a), np.array(b), np.array(a_starts), np.array(b_starts))
    common = sorted(set(a) & set(b))
    assert [a[k] for k in (found.a + found.n_a - 1)] == common == [b[k] for k in (found.b + found.n_b - 1)]
    assert found.n_a.sum() == len(a) and found.n_b.sum() == len(b)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12_alignment(empty).count() == 0 and token_groups(empty).count() == 0
