"""Secret scans with a trigram index.

Each rule is a regular expression. From its syntax follows which trigrams a match must contain: a Boolean query, kept
as alternatives of trigrams that must all occur. The index lists, for every trigram that some rule asks for, the
documents that hold it; the postings of an alternative are intersected, and only the candidates are matched against the
rule. A rule without a mandatory trigram scans all texts. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import row_key
from gaugeflow.materialize import written_table


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Syntax that Java and Python read alike.
    pattern: str
    #: Group whose length decides, and the least length that counts.
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are matched whole, so asking for the length in the pattern finds the same ones without all the short runs.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
#: Literal strings and alternatives that a derivation keeps track of; beyond it, it asks for less.
STRINGS = 64

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"

Query = frozenset[frozenset[str]]


def _minimal(alternatives) -> Query:
    found = set(alternatives)
    return frozenset(a for a in found if not any(b < a for b in found))


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3].lower() for i in range(len(text) - 2))


def _both(a: Query | None, b: Query | None) -> Query | None:
    """None asks for nothing."""
    if a is None or b is None:
        return a or b
    joined = _minimal(x | y for x, y in product(a, b))
    return joined if len(joined) <= STRINGS else min(a, b, key=len)


def _asked(strings: set[str]) -> Query | None:
    grams = [_trigrams(s) for s in strings]
    return _minimal(grams) if all(grams) else None


def _sequence(items) -> tuple[set[str] | None, Query | None]:
    """(all strings it can match, if few; what any match must contain)."""
    query, run, exact = None, {""}, True
    for op, value in items:
        strings, inner = _element(op, value)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        query = _both(_both(query, _asked(run)), inner if strings is None else _asked(strings))
        run = {""}
    return (run if exact else None), _both(query, _asked(run))


def _element(op, value) -> tuple[set[str] | None, Query | None]:
    if op is sre.LITERAL:
        return {chr(value)}, None
    if op is sre.AT:
        return {""}, None
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in value):
        return {chr(c) for _, c in value}, None
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        parts = [_sequence(part) for part in value[1]]
        known = [strings for strings, _ in parts]
        if all(s is not None for s in known) and len(whole := set().union(*known)) <= STRINGS:
            return whole, _asked(whole)
        asked = [_asked(s) if s is not None else q for s, q in parts]
        return None, _minimal(a for q in asked for a in q) if all(q is not None for q in asked) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, part = value
        strings, query = _sequence(part)
        if strings is not None and high == 1:
            return ({""} if low == 0 else set()) | strings, None
        return None, (_both(query, _asked(strings) if strings is not None else None) if low > 0 else None)
    return None, None


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of lower-case trigrams, one of which is contained in any match; None if nothing is mandatory."""
    return _sequence(sre_parse.parse(pattern))[1]


def _postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, row) of every trigram of ``grams`` that a text holds: the inverted index."""
    low = F.lower("text")
    held = F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    return rows.select("row", F.explode(F.array_compact(held)).alias("gram"))


def _candidates(rows: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row, kind) of the rows that meet the trigram query of a rule."""
    grams = sorted({g for q in queries.values() for a in q for g in a})
    asked = [
        (grams.index(g), kind, number, len(alternative))
        for kind, query in queries.items()
        for number, alternative in enumerate(sorted(query, key=sorted))
        for g in alternative
    ]
    wanted = rows.sparkSession.createDataFrame(asked, "gram int, kind string, alternative int, need long")
    # As many rows as the rules' queries have trigrams.
    return (
        _postings(rows, grams)
        .distinct()
        .join(F.broadcast(wanted), "gram")
        .groupBy("row", "kind", "alternative", "need")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held = need")
        .select("row", "kind")
        .distinct()
    )


def _matched(rule: Rule) -> Column:
    """(gap before, match, length that decides) of every match of the rule, in order."""
    found, group = (F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    gaps = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found))
    lengths = lambda strings: F.transform(strings, lambda s: F.char_length(s))
    return F.arrays_zip(lengths(gaps).alias("gap"), lengths(found).alias("size"), lengths(group).alias("deciding"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, doc_id, spans) of every row of ``docs(doc_id, text, ...)``; spans is an array of (start, rank, kind, end).

    Spans are sorted by start and by the rule's place in ``rules``. ``row`` is a digest of doc_id and text. Null texts are
    empty. Repeated rows stay and have equal spans. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = {kind: query for kind, query in queries.items() if query is not None}
    parts = [
        rows.where(F.col("text").rlike(rule.pattern)).select("row", F.lit(rule.kind).alias("kind"), _matched(rule).alias("found"))
        for rule in rules
        if queries[rule.kind] is None
    ]
    if asked:
        candidates = written_table(_candidates(rows, asked), "candidates")
        texts = rows.join(candidates.groupBy("row").agg(F.collect_set("kind").alias("kinds")), "row")
        each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.when(F.array_contains("kinds", r.kind), _matched(r)).alias("found")) for r in rules if r.kind in asked])
        parts.append(texts.select("row", F.inline(each)).where(F.size("found") > 0))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    order = Window.partitionBy("row", "kind").orderBy("number")
    ends = F.sum(F.col("gap") + F.col("size")).over(order)
    spans = (
        reduce(DataFrame.union, parts)
        .dropDuplicates(["row", "kind"])
        .select("row", "kind", F.posexplode("found").alias("number", "one"))
        .select("row", "kind", "number", "one.gap", "one.size", "one.deciding")
        .withColumn("end", ends.cast("int"))
        .where(F.col("deciding") >= least[F.col("kind")])
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), rank.alias("rank"), "kind", "end"))).alias("spans"))
    )
    return rows.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def op10_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of their spans and all spans of every document."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
