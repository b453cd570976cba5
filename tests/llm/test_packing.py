"""Sharding and sequence packing against placing the items one by one."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeflow.llm.packing import Encoder, OpenCapacities, pack, pack_counts
from gaugeflow.llm.sharding import Treap, plan_shards, shard_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(sizes, length):
    """Fill of every bin after best-fit-decreasing."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, used in enumerate(bins) if used + size <= length]
        if fitting:
            bins[max(fitting, key=lambda i: bins[i])] += size
        else:
            bins.append(size)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pack_counts_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 20, 64, 2048])
    sizes = [min(length, 1 + int(rng.expovariate(4 / length))) for _ in range(rng.choice([1, 30, 700]))]
    placed = defaultdict(list)
    counts = Counter(sizes)
    runs = pack_counts(counts, length)
    for size, first, sequence, per, offset in runs:
        last = min((r[1] for r in runs if r[0] == size and r[1] > first), default=counts[size])
        for n in range(last - first):
            placed[sequence + n // per].append((offset + n % per * size, size))
    for spans in placed.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= length
    assert sorted(placed) == list(range(len(placed)))
    assert sorted(sum(s for _, s in spans) for spans in placed.values()) == one_by_one(sizes, length)


def test_tightest_capacity():
    rng = random.Random(2)
    tree, held = OpenCapacities(100), set()
    for _ in range(500):
        c = rng.randrange(101)
        (held.discard if c in held else held.add)(c)
        tree.put(c, c in held)
        need = rng.randrange(101)
        assert tree.tightest(need) == min((h for h in held if h >= need), default=None)


@pytest.mark.parametrize(
    "text", ["", "Plain words, it's fine", "a\x1cb c\x1dd", "é ̈x İstanbul ΣΑΣ　wide", "<|endoftext|> x<|startoftext|>y", "🙂 emoji 12345 ''s 's", "\x85next line\xa0gap​zero", "tab\tnew\nline " * 300]
)
def test_encoder_is_the_tokenizer(text):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    encode = Encoder(PATH)
    expected = model.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == expected == np.frombuffer(encode(text), "<u4").tolist()


def check_packed(docs, rows, length=2048):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    pieces = Counter()
    for d in docs:
        ids = model.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, begin in enumerate(range(0, len(ids), length)):
            part = ids[begin : begin + length]
            pieces[d["doc_id"], k, begin, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for spans in sequences.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= length
        fills.append(end)
    assert sorted(fills) == one_by_one([r["length"] for r in rows], length)


def test_pack_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packed(docs.collect(), pack(docs).collect())


def test_pack_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word"), (3, "long text " * 9000), (3, "long text " * 9000), (4, "a b c")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).withColumnRenamed("lang", "length").withColumnRenamed("source", "number")
    packed = pack(docs, with_ids=True)
    check_packed(docs.collect(), packed.collect())
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in packed.collect())
    assert pack(docs.limit(0)).count() == 0


def test_treap():
    rng, tree, held = random.Random(4), Treap(), set()
    for n in range(400):
        key = (rng.randrange(50), n)
        tree.add(key)
        held.add(key)
        if n % 3 == 0:
            gone = rng.choice(sorted(held))
            tree.remove(gone)
            held.remove(gone)
        asked = (rng.randrange(55), -1)
        assert tree.at_least(asked) == min((k for k in held if k >= asked), default=None) and (not held or tree.largest() == max(held))


def slow_shards(sizes, shards):
    """Loads after best-fit-decreasing, one group at a time."""
    free, total, left = shards, sum(sizes), sorted(sizes, reverse=True)
    loads = []
    while left and free > 1 and left[0] * free > total:
        loads.append(left[0])
        total -= left.pop(0)
        free -= 1
    share = -(-total // free)
    bins = [0] * free
    for size in left:
        fitting = [i for i in range(free) if bins[i] + size <= share]
        bins[max(fitting, key=lambda i: bins[i]) if fitting else min(range(free), key=lambda i: bins[i])] += size
    return sorted(loads + bins)


@pytest.mark.parametrize("seed", range(5))
def test_plan_shards(seed):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(1.1) * 20) for _ in range(rng.choice([3, 80, 2000]))]
    counts = Counter(sizes)
    runs, loads = plan_shards(counts.items(), 24), Counter()
    for size, first, shard in runs:
        last = min((r[1] for r in runs if r[0] == size and r[1] > first), default=counts[size])
        loads[shard] += size * (last - first)
    assert sorted([*loads.values(), *[0] * (24 - len(loads))]) == slow_shards(sizes, 24)


def check_shards(docs, rows):
    expected = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_shard_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_documents(docs).collect()
    check_shards(docs.collect(), rows)
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    where = defaultdict(set)
    loads = Counter()
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert max(loads.values()) - min(loads.values()) <= 0.03 * sum(loads.values()) / 24


def test_shard_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word"), (3, "x" * 300_000), (4, "word"), (5, None)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).withColumnRenamed("lang", "size").withColumnRenamed("source", "shard")
    out = shard_documents(docs).collect()
    check_shards(docs.collect(), out)
    assert len({r["shard"] for r in out if r["doc_id"] in (1, 5)}) == 1 and len({r["shard"] for r in out if r["size"] == 12}) == 1
    assert shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_any_vocabulary(name):
    """Cuts are taken from the file; a file with other rules is used as it is."""
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    encode = Encoder(public_tokenizers.path(name))
    assert (encode.cuts is None) == (name == "byte_bpe_50k.json")
    for text in ["", "It's  two\nlines, café 12 <|endoftext|> don't", "A  B\tC" * 50, "日本語 text!!", "İstanbul Σ"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
