"""Quality rules as a learned decision list.

Sequential covering: a rule is grown condition by condition on two thirds of the labelled rows that no earlier rule covers,
each time with the threshold of the highest information gain; its last conditions are pruned by the remaining third; the rows it
covers are taken away and the next rule is grown. The rules become one ordered conditional expression. Everything
is DataFrame expressions: rows are counted by statistic and bin, and the driver sees these counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.jsontypes import computed_once
from gaugeflow.llm.labelled import TRAINING_ROWS, training_rows
from gaugeflow.materialize import written_table

WHITE, SPACE = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Low bits of a window's sort key that hold its place; the others are of its hash.
PLACE_BITS = 24
#: Statistics that conditions may use, in the order of ties.
FEATURES = {
    "symbol_share": "n_symbols / n_words",
    "upper_share": "n_upper / word_chars",
    "shout_share": "n_shouts / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "mean_word": "word_chars / n_words",
    "line_words": "n_words / n_lines",
    "n_words": "n_words",
}
#: Candidate thresholds of a statistic: quantiles of all rows and of the low ones.
CUTS = 24
MOST_RULES, MOST_CONDITIONS = 8, 4
#: A rule must cover this many low rows, and be right on this share of what it covers, of either part.
LEAST_COVERED, LEAST_PRECISION = 3, 0.9


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _window(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + k) for k in range(WINDOW)]


def _keys(words: Column, bits: int) -> Column:
    """A sorted number for each window: the high bits of its hash, then its place."""
    low = (1 << bits) - 1
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    key = F.transform(places, lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(F.lit(-1 - low)).bitwiseOR(i.cast("long")))
    return F.sort_array(F.when(F.size(words).between(WINDOW, low), key).otherwise(F.array().cast("array<long>")))


def _covered(places: Column) -> Column:
    """Words in the windows at ``places``, ascending."""
    last = F.lit(WINDOW)
    own = F.transform(places, lambda p, k: F.least(last, F.coalesce(F.get(places, k + 1) - p, last)).cast("long"))
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _exact_repeats(words: Column) -> Column:
    """As ``_repeated_words``, by the windows themselves."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    window = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("w"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
        found = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return _let(F.sort_array(F.transform(found, lambda x: x["i"])), _covered)

    return _let(F.sort_array(window), repeated)


def _repeated_words(words: Column, keys: Column, bits: int) -> Column:
    """Words in windows found twice or more, the first included.

    Windows of one hash stand together in ``keys``. Should two different windows share a hash, or a text have more windows
    than places, the windows themselves are sorted instead.
    """
    low = (1 << bits) - 1
    near = lambda x, k: F.coalesce(F.shiftright(F.get(keys, k), bits) == F.shiftright(x, bits), F.lit(False))
    found = F.filter(keys, lambda x, k: near(x, k - 1) | near(x, k + 1))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def differs(repeats: Column) -> Column:
        def pair(x: Column, k: Column) -> Column:
            following = F.get(repeats, k + 1)
            together = F.shiftright(following, bits) == F.shiftright(x, bits)
            return F.coalesce(together & (F.concat_ws(" ", *_window(words, place(x))) != F.concat_ws(" ", *_window(words, place(following)))), F.lit(False))

        return F.exists(F.transform(repeats, pair), lambda x: x)

    def counted(repeats: Column) -> Column:
        quick = _let(F.sort_array(F.transform(repeats, place)), _covered)
        return F.when(F.size(repeats) == 0, F.lit(0).cast("long")).when(differs(repeats), _exact_repeats(words)).otherwise(quick)

    n = F.size(words)
    return F.when(n < WINDOW, F.lit(0).cast("long")).when(n > low, _exact_repeats(words)).otherwise(_let(found, counted))


def statistics(docs: DataFrame, bits: int = PLACE_BITS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_shouts, ...) of every text.

    Other columns but ``text`` stay as they are if they begin with ``label_``. A null text has no words.
    """
    kept = [c for c in docs.columns if c.startswith("label_")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *kept)
    bare = F.btrim("text", F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    worded = computed_once(rows, "words", words)
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lined = computed_once(
        worded.withColumns(
            {
                "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
                "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long"),
                "n_shouts": F.regexp_count("text", F.lit("!")).cast("long"),
            }
        ),
        "lines",
        lines,
    )
    counted = lined.select(
        "doc_id", *kept, "words", "n_symbols", "n_upper", "n_shouts",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    keyed = computed_once(counted, "keys", _keys(F.col("words"), bits))
    return keyed.withColumn("n_repeat_words", _repeated_words(F.col("words"), F.col("keys"), bits)).drop("words", "keys")


def with_features(stats: DataFrame) -> DataFrame:
    """The shares that conditions use; a share of nothing is 0."""
    return stats.withColumns({f"f_{name}": F.coalesce(F.expr(f"try_divide({top}, {below})"), F.lit(0.0)) if below else F.col(top).cast("double")
                              for name, (top, _, below) in ((name, how.partition(" / ")) for name, how in FEATURES.items())})


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value >= F.lit(self.cut) if self.at_least else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are of low quality."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(Column.__and__, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: false at the first rule that applies, else true."""
    if not rules:
        return F.lit(True)
    return reduce(lambda chain, rule: chain.when(rule.column(), False), rules[1:], F.when(rules[0].column(), False)).otherwise(True)


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic, at most twice ``CUTS``, rounded to three digits."""
    shares = [(k + 0.5) / CUTS for k in range(CUTS)]
    low = F.when(F.col("label_y") == 0, 1)
    wanted = [
        F.percentile_approx(F.col(f"f_{name}") * chosen, shares, 2_000).alias(f"{name}_{part}")
        for name in FEATURES
        for part, chosen in (("all", F.lit(1)), ("low", low))
    ]
    found = rows.agg(*wanted).first()
    cuts = {}
    for name in FEATURES:
        values = {float(f"{v:.3g}") for part in ("all", "low") for v in found[f"{name}_{part}"] or []}
        cuts[name] = sorted(values)
    return cuts


def _bins(cuts: dict[str, list[float]]) -> Column:
    """For each statistic the number of thresholds that it reaches."""
    reached = lambda name: F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda c: c <= F.col(f"f_{name}")))
    return F.array(*[reached(name) if cuts[name] else F.lit(0) for name in FEATURES])


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    """Conditions in the order of their choice; each narrows the rows to more of the low ones."""
    conditions: list[Condition] = []
    names = list(FEATURES)
    while len(conditions) < MOST_CONDITIONS:
        counts = {
            (r["pos"], r["col"]): (r["low"], r["n"])
            for r in rows.select("label_y", F.posexplode("bins"))
            .groupBy("pos", "col")
            .agg(F.count_if(F.col("label_y") == 0).alias("low"), F.count(F.lit(1)).alias("n"))
            .collect()  # at most one row per statistic and threshold
        }
        all_low, everything = (sum(v[k] for (pos, _), v in counts.items() if pos == 0) for k in (0, 1))
        if not all_low or all_low == everything:
            break
        best, chosen = 0.0, None
        for pos, name in enumerate(names):
            low = n = 0
            # Down from the highest threshold: the rows that reach it.
            for k in range(len(cuts[name]), 0, -1):
                more = counts.get((pos, k), (0, 0))
                low, n = low + more[0], n + more[1]
                for at_least, p, size in ((True, low, n), (False, all_low - low, everything - n)):
                    if p >= LEAST_COVERED and size < everything:
                        gain = p * (math.log2(p / size) - math.log2(all_low / everything))
                        if gain > best + 1e-9:
                            best, chosen = gain, Condition(name, at_least, cuts[name][k - 1])
        if chosen is None:
            break
        conditions.append(chosen)
        rows = rows.where(chosen.column())
    return conditions


def _prune(rows: DataFrame, conditions: list[Condition]) -> tuple[Rule, bool]:
    """The conditions without last ones that do not help on the pruning part, and whether the rule is good enough there and in all."""
    prefixes = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
    low = F.col("label_y") == 0
    wanted = []
    for k, rule in enumerate(prefixes):
        for name, part in (("prune", F.col("label_part") == 0), ("all", F.lit(True))):
            wanted += [F.count_if(rule.column() & part & low).alias(f"{name}_low_{k}"), F.count_if(rule.column() & part).alias(f"{name}_n_{k}")]
    found = rows.agg(*wanted).first()
    worth = [(found[f"prune_low_{k}"] + 1) / (found[f"prune_n_{k}"] + 2) for k in range(len(prefixes))]
    k = worth.index(max(worth))
    right = lambda name: found[f"{name}_low_{k}"] >= LEAST_PRECISION * found[f"{name}_n_{k}"]
    return prefixes[k], found[f"all_low_{k}"] >= LEAST_COVERED and right("prune") and right("all")


def learn_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> list[Rule]:
    """An ordered list of rules for low quality, from at most ``rows`` labelled documents outside the held-out fold.

    A third of them, by a digest of the id, prunes. Without labels, or with labels of one kind, the list is empty.
    """
    sample = training_rows(docs, labels, "quality", rows).withColumnRenamed("y", "label_y")
    part = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)).alias("label_part")
    stats = written_table(with_features(statistics(sample.select("doc_id", "text", "label_y", part))), "rule-statistics")
    kinds = stats.agg(F.countDistinct("label_y")).first()[0]
    if kinds < 2:
        return []
    cuts = _cuts(stats)
    left = written_table(stats.select("label_y", "label_part", *[f"f_{name}" for name in FEATURES], _bins(cuts).alias("bins")), "rule-bins")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        conditions = _grow(left.where("label_part <> 0"), cuts)
        if not conditions:
            break
        rule, good = _prune(left, conditions)
        if not good:
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every text with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return with_features(statistics(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(verdict(rules)).alias("kept"),
    )


def op13_quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Base statistics and the verdict for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no words and fail. Repeated rows and null ids stay; other columns are ignored. An empty
    table gives an empty result.
    """
    return apply_rules(docs, learn_rules(docs, labels, rows))
