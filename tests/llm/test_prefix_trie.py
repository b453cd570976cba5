"""The prefix trie against nested dictionaries."""

import random
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm.prefix_trie import op11_prefix_trie, ordered_turns, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place string, digest int, block int, id1 string, up string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _in_order(rows):
    """Turns of each conversation; ties by the digest that the docstring names."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {conv: [turn for _, turn in sorted(turns)] for conv, turns in found.items()}


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def _trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in ids if len(convs[c]) == len(path))
        rows.append(
            (
                min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids),
                sum(len(p) == len(path) + 1 for p in below),
                sum(p not in inner for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def _rows(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def _table(spark, rows):
    return spark.createDataFrame([(*r, "mine", 7, 8, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_against_dictionaries(spark, block):
    draw = random.Random(block)
    rows = []
    for c in [*range(-3, 40), *range(98, 130), 100_000, 100_007, 10**15 + 3]:
        for turn in range(draw.choice([1, 1, 2, 5, 8, 14])):
            # Few texts, so that many conversations share turns.
            rows.append((c, turn if turn % 7 else None, draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "é", "", None, "long text"])))
    rows += rows[:25] + [(None, 0, "user", "lost"), (None, None, None, None)]
    assert _rows(op11_prefix_trie(_table(spark, rows), block)) == _trie(_rebuilt(_in_order(rows)))


def test_copies_and_chains(spark):
    """Thousands of copies, a caterpillar whose chains hang from each other, and one conversation of many turns."""
    rows = [(1000 + c, t, "u", f"t{t}") for c in range(60) for t in range(7)]
    rows += [(5000 + 100 * k, t, "u", f"step {min(t, k)}{'' if t < k else k}") for k in range(20) for t in range(k + 2)]
    rows += [(9000, t, "u", str(t)) for t in range(60)]
    assert _rows(op11_prefix_trie(_table(spark, rows))) == _trie(_rebuilt(_in_order(rows)))


def test_plain_tables_and_turnless_conversations(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")]
    turns = ordered_turns(_table(spark, rows))
    lengths = spark.createDataFrame([(1, 1), (2, 2), (7, 0)], "conv_id long, length long")
    found = _rows(prefix_trie(turns.join(lengths, "conv_id"), lengths))
    convs = {**_in_order(rows), 7: []}
    assert found == _trie(convs)


def test_empty(spark):
    empty = _table(spark, []).where("false")
    assert op11_prefix_trie(empty).count() == 0
    assert op11_prefix_trie(_table(spark, [(None, 1, "u", "x")])).count() == 0
    one = op11_prefix_trie(_table(spark, [(100, 0, "u", "x" * 50_000)]))
    assert one.agg(F.max("depth")).first()[0] == 1
