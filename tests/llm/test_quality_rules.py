"""Quality rules: statistics against plain loops, verdicts on held-out labels."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm.labelled import held_out
from gaugeflow.llm.quality_rules import Condition, Rule, apply_rules, learn_rules, op13_quality_rules, statistics

SF = "/root/testdata/sf0.1"
FIELDS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _plain(doc, text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (doc, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def _texts():
    draw = random.Random(5)
    words = ["a", "b", "é", "日本", "x#y", "$", "A!", "\U0001f600"]
    out = [None, "", " ", "\n\n", "\x0b a\x0cb\r\n", "one", "one two", "a b c", "a b c a b c", "a a a a a", "a b a b a b", "x\n x\nx\n\nx", "c\x00 d e f \x85g"]
    for n in (5, 30, 200, 3000):
        for _ in range(8):
            out.append("".join(draw.choice(words) + draw.choice([" ", "  ", "\n", "\t"]) for _ in range(n)))
    return out + ["word " * 40_000, " ".join(map(str, range(30_000)))]


@pytest.mark.parametrize("bits", [24, 61, 9])
def test_statistics(spark, bits):
    """Few hash bits make different windows meet, few place bits long texts; both then sort the windows themselves."""
    rows = [(k, text) for k, text in enumerate(_texts())] + [(None, "a b c a b c"), (None, "a b c a b c"), (3, "a b")]
    if bits != 24:
        rows = [(d, t) for d, t in rows if not t or len(t) < 9_000]
    df = spark.createDataFrame([(d, t, "mine", 5, 6) for d, t in rows], "doc_id long, text string, words string, keys int, n_words int")
    found = Counter(tuple(r[f] for f in FIELDS) for r in statistics(df, bits).select(*FIELDS).collect())
    assert found == Counter(_plain(d, t) for d, t in rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = Counter(tuple(r[f] for f in FIELDS) for r in statistics(docs).select(*FIELDS).collect())
    assert found == Counter(_plain(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    rules = learn_rules(docs, labels)
    assert rules and all(1 <= len(rule.conditions) <= 4 for rule in rules)
    judged = apply_rules(docs, rules).join(labels, "doc_id").where(held_out(F.col("doc_id")) & ~F.col("base_failed"))
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    low, high = (sum(found.get((q, k), 0) for k in (True, False)) for q in (0, 1))
    assert found.get((0, False), 0) >= 0.9 * low, (found, list(map(str, rules)))
    assert found.get((1, True), 0) >= 0.99 * high, (found, list(map(str, rules)))


def test_planted_rule(spark):
    """A conjunction is found: many symbols are bad only in long lines."""
    draw = random.Random(2)
    docs, labels = [], []
    for k in range(1200):
        symbols, per_line = draw.random() < 0.5, draw.choice([4, 40])
        words = [f"w{draw.randrange(10**6)}" + ("#" if symbols else "") for _ in range(80)]
        text = "\n".join(" ".join(words[i : i + per_line]) for i in range(0, 80, per_line))
        docs.append((k, text))
        labels.append((k, int(not (symbols and per_line == 40))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = learn_rules(docs, labels)
    assert len(rules) == 1 and {c.feature for c in rules[0].conditions} == {"symbol_share", "line_words"}, list(map(str, rules))
    wrong = apply_rules(docs, rules).join(labels, "doc_id").where(F.col("kept") != (F.col("quality") == 1))
    assert wrong.isEmpty()


def test_order_and_base(spark):
    rules = [Rule((Condition("symbol_share", True, 0.5), Condition("n_words", False, 60.0))), Rule((Condition("upper_share", True, 0.9),))]
    assert str(rules[0]) == "symbol_share >= 0.5 and n_words < 60"
    words = [f"w{k}" for k in range(100)]
    texts = ["# ".join(words[:55]), "# ".join(words), "".join(f"{w.upper()} " for w in words).translate({ord(c): None for c in "0123456789"}), " ".join(words[:49]), " ".join(words[:20] * 4)]
    texts[2] = " ".join(f"W{'ABCDEFGHIJ'[k // 10]}{'ABCDEFGHIJ'[k % 10]}" for k in range(100))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["base_failed"], r["kept"]) for r in apply_rules(df, rules).orderBy("doc_id").collect()]
    assert found == [(False, False), (False, True), (False, False), (True, False), (True, False)]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "one two " + " ".join(map(str, range(60)))), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["doc_id"], r["kept"]) for r in op13_quality_rules(docs, none).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    assert op13_quality_rules(docs.where("false"), none).count() == 0
    one_kind = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert learn_rules(docs, one_kind) == []
