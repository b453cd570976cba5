"""Personal data: patterns, and terms that give the found identifiers away.

An identifier found by a pattern is a protected entity. A term discloses an entity as far as their pointwise mutual
information over the corpus reaches the entity's own information content: at ``REMOVE`` of it, reading the term is
as good as reading the entity. Such terms are removed wherever they stand in a document of the entity; terms between ``GENERALISE``
and ``REMOVE`` are replaced by their kind. Probabilities are document frequencies over all documents; of an entity's share
among a term's documents the lower confidence bound counts, so an identifier of one document is judged like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gaugeflow.llm.common import blocks_of, fields_of, free_name, row_key
from gaugeflow.materialize import written_table

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "term")
GENERALISE, REMOVE = 0.6, 0.9
#: Confidence of the lower bound of the entity's share among a term's documents.
CONFIDENCE = 0.85
#: Distinct words that a worker counts before it passes the counts on.
COUNTED = 200_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From the "@": looking for a local part at every place would be quadratic in a long run of its characters.
    ended = 0
    for match in _AT.finditer(text):
        start = match.start()
        while start > ended and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            yield start, match.end()
            ended = match.end()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all identifiers, by start and then kind."""
    found = [(lo, hi, "email") for lo, hi in _emails(text)]
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((match.start(), match.end(), "ip"))
    for match in _CARD.finditer(text):
        digits = _DIGITS.sub("", match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), match.end(), "card"))
    for match in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", match[0])) <= 15:
            found.append((match.start(), match.end(), "phone"))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple:
    return span[0], (*KINDS, *TERM_KINDS).index(span[2]), span[1]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


def entity(kind: str, found: str) -> int:
    """Signed 64-bit name of an identifier; cards and phones by their digits, emails in lower case."""
    plain = found.lower() if kind == "email" else found if kind == "ip" else _DIGITS.sub("", found)
    value = xxh64_intdigest(f"{kind}:{plain}".encode())
    return value - (1 << 64) if value >> 63 else value


def contexts(text: str, spans: list[Span]) -> dict[str, list[str]]:
    """Places (start:end) of each term of a text with identifiers, outside all of them."""
    found: dict[str, list[str]] = {}
    if spans:
        for m in _TERM.finditer(_blanked(text, spans)):
            found.setdefault(m[0].lower(), []).append(f"{m.start()}:{m.end()}")
    return found


def _blanked(text: str, spans: list[Span]) -> str:
    parts, done = [], 0
    for lo, hi, _ in spans:
        if hi > done:
            parts += [text[done : max(lo, done)], " " * (hi - max(lo, done))]
            done = hi
    return "".join([*parts, text[done:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers of each row, and (term, places) of the rows that have any."""
    held = pa.list_(pa.struct([("term", pa.string()), ("places", pa.string())]))
    for batch in blocks_of(batches):
        out: list[tuple] = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            kinds = Counter(kind for _, _, kind in spans)
            words = [{"term": t, "places": " ".join(p)} for t, p in contexts(text, spans).items()]
            names = sorted({entity(kind, text[lo:hi]) for lo, hi, kind in spans})
            out.append((*(kinds[k] for k in KINDS), joined(spans), names, words))
        kinds_of = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), held]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds_of)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", *(f"n_{k}" for k in KINDS), "base", "entities", "words"]
        )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this part of the input that hold each term."""
    counts: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "docs"])
        counts.clear()
        return out

    for batch in blocks_of(batches):
        for text in batch.column("text").to_pylist():
            counts.update({term.lower() for term in _TERM.findall(text or "")})
            if len(counts) > COUNTED:
                yield passed_on()
    yield passed_on()


def at_least(hits: Column, trials: Column, share: Column, confidence: float = CONFIDENCE) -> Column:
    """Whether the lower confidence bound of ``hits`` of ``trials`` reaches ``share``: Chernoff's bound on the relative entropy.

    For hits in every trial it is (1 - confidence) ** (1 / trials). There is no least number of hits.
    """
    rate = hits / trials
    rest = F.when(hits < trials, (trials - hits) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    return (rate > share) & (hits * F.log(rate / share) + rest >= -math.log(1 - confidence))


def candidate_terms(docs: DataFrame, scanned: DataFrame, total: int, rarity: float, generalise: float = GENERALISE) -> DataFrame:
    """(row, term, term_docs, places): terms rare enough to disclose an entity, in the rows that hold identifiers.

    ``rarity`` is the largest share of documents that one entity has. A term in more than rarity ** generalise of them
    can't reach ``generalise`` for any entity, as an entity has at most all of its own documents in common with it.
    """
    most = F.lit(total * rarity**generalise * (1 + 1e-9))
    terms = docs.select("text").mapInArrow(_count_terms, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("term_docs"))
    words = scanned.select("row", F.explode("words").alias("word")).select("row", "word.term", "word.places")
    return written_table(words.join(terms.where(F.col("term_docs") <= most), "term"), "personal-terms")


def _same_documents(found: DataFrame, name: str, docs: str) -> DataFrame:
    """(name, docs, like): the least of those that stand in the same documents, for each ``name`` of ``found(row, name, docs)``.

    Two names with equal documents have equal counts with everything. Sets are compared by their size and two sums of digests.
    """
    one, two = (F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)")).alias(f"set{seed}") for seed in (1, 2))
    sets = found.groupBy(name).agg(F.max(docs).alias(docs), F.count(F.lit(1)).alias("held"), one, two)
    alike = ["held", docs, "set1", "set2"]
    least = sets.groupBy(*alike).agg(F.min(name).alias("like"))
    return sets.join(least, alike).select(name, docs, "like")


def disclosed(
    candidates: DataFrame, scanned: DataFrame, total: int, confidence: float = CONFIDENCE, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """(row, term, removed, places): terms that disclose ``generalise`` of an entity of their row, or ``remove`` of it.

    With P = P(entity | term) the share is 1 + log P / information, so a share s is reached where P reaches
    P(entity) ** (1 - s). Both stand anywhere in the same document. Entities with the same documents are counted as one, and so
    are terms: a list of addresses that occurs once is one entity with one term, however long.
    """
    entities = scanned.select("row", F.explode("entities").alias("entity")).withColumn("one", F.lit(1))
    like_entity = _same_documents(entities.select("row", "entity", "one"), "entity", "one")
    docs_of = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    # (row, entity) for the least of the entities that are alike.
    held = written_table(
        entities.select("row", "entity").join(like_entity.where("entity = like").select("entity"), "entity").join(docs_of, "entity"), "personal-entities"
    )
    like_term = written_table(_same_documents(candidates.select("row", "term", "term_docs"), "term", "term_docs"), "personal-alike")
    named = candidates.select("row", "term").join(like_term.where("term = like").select("term", "term_docs"), "term")
    met = written_table(held.join(named, "row"), "personal-pairs")
    rarity = F.col("entity_docs") / F.lit(total)

    def reached(share: float) -> Column:
        return at_least(F.col("both"), F.col("term_docs"), F.pow(rarity, F.lit(1 - share)), confidence)

    pairs = met.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("both"), F.max("term_docs").alias("term_docs"), F.max("entity_docs").alias("entity_docs")
    )
    found = pairs.where((rarity < 1) & reached(generalise)).select("entity", "term", reached(remove).alias("removed"))
    in_rows = met.join(found, ["entity", "term"]).groupBy("row", F.col("term").alias("like")).agg(F.max("removed").alias("removed"))
    words = candidates.select("row", "term", "places").join(like_term.select("term", "like"), "term")
    return words.join(in_rows, ["row", "like"]).select("row", "term", "removed", "places")


def find_personal_data(
    docs: DataFrame, confidence: float = CONFIDENCE, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """(row, doc_id, n_email, n_ip, n_card, n_phone, base, terms) of every row of ``docs(doc_id, text, ...)``.

    ``base`` lists the identifiers as kind:start:end, ``terms`` the disclosing terms as an array of (start, end, kind).
    ``row`` is a digest of doc_id and text. Null texts are empty. Repeated rows stay, and each counts as a document. An empty
    table gives an empty result; other columns are ignored. Terms of one entity are never gathered: words meet the counts of rare
    terms by a join on the term, entities and terms of a row meet on the row, one for all that stand in the same documents.
    """
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), "text")
    schema = (
        "row string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
        "entities array<long>, words array<struct<term:string,places:string>>"
    )
    scanned = written_table(rows.mapInArrow(_scan, schema), "personal")
    entities = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    total, largest = scanned.count(), entities.agg(F.max("entity_docs")).first()[0] or 0
    candidates = candidate_terms(docs, scanned, total, largest / max(1, total), generalise)
    place = F.split(F.col("place"), ":")
    terms = (
        disclosed(candidates, scanned, total, confidence, generalise, remove)
        .select("row", "removed", F.explode(F.split("places", " ")).alias("place"))
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct(
                    place[0].cast("int").alias("start"),
                    place[1].cast("int").alias("end"),
                    F.when(F.col("removed"), "term").otherwise("general").alias("kind"),
                )
            ).alias("terms")
        )
    )
    counts = [f"n_{kind}" for kind in KINDS]
    return scanned.select("row", "doc_id", *counts, "base").join(terms, "row", "left").select("row", "doc_id", *counts, "base", "terms")


def _all_spans(base: str, terms: list | None) -> list[Span]:
    spans = [(int(lo), int(hi), kind) for kind, lo, hi in (x.split(":") for x in base.split(",") if x)]
    return sorted([*spans, *((t["start"], t["end"], t["kind"]) for t in terms or [])], key=_order)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist())
        spans = pa.array([joined(_all_spans(base, terms)) for base, terms in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["terms"]).columns, spans], [*(n for n in batch.schema.names if n != "terms"), "spans"])


def op1_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, SHA-256 of the identifiers and all spans of every document."""
    found = find_personal_data(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base", "terms")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return found.mapInArrow(_join_spans, schema).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), "spans"
    )


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with every span replaced: identifiers and generalised terms by their kind, disclosing terms by nothing."""
    parts, done = [], 0
    for lo, hi, kind in spans:
        if hi <= done:
            continue
        if lo >= done:
            parts += [text[done:lo], "" if kind == "term" else "[WORD]" if kind == "general" else f"[{kind.upper()}]"]
        done = hi
    return "".join([*parts, text[done:]])


def _sanitise_by(base_name: str, terms_name: str):
    def sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches):
            rows = zip(*(batch.column(n).to_pylist() for n in ("text", base_name, terms_name)))
            texts = pa.array([text if text is None else sanitised(text, _all_spans(base or "", terms)) for text, base, terms in rows], pa.string())
            names = [n for n in batch.schema.names if n not in (base_name, terms_name)]
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names)

    return sanitise


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; rows without any stay as they are, n_chars follows the text.

    All rows and columns are returned, whatever the names of the other columns; a null text stays null. Repeated rows are
    sanitised alike. An empty table gives an empty result.
    """
    found = find_personal_data(docs).where("base <> '' or terms is not null").dropDuplicates(["row"])
    row, base, terms = (free_name(docs.columns, name) for name in ("row", "base", "terms"))
    spans = found.select(F.col("row").alias(row), F.col("base").alias(base), F.col("terms").alias(terms))
    keyed = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(spans, row, "left").drop(row)
    out = keyed.mapInArrow(_sanitise_by(base, terms), fields_of(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
