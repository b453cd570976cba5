"""Personal data, secrets, benchmark leaks and chat formatting against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeflow.llm import decontaminate as leaks
from gaugeflow.llm import pii, secrets
from gaugeflow.llm.chat import rotate_perspectives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).withColumnRenamed("lang", "row").withColumnRenamed("source", "base")


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) for d in digits[-1::-1]]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(doubled))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
    return [(lo, hi, kind) for lo, _, kind, hi in sorted(found)]


def test_base_spans_on_random_texts():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", ".", "x@y.zz", "1", "255", "256", "4111 1111 1111 1111", "+", "+1 (415) 555-0132", "-", " ", "é", "@@", "0.0.0.0", "1.2.3.4.5", "5500005555555559", "_", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == slow_spans(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "+1" + "(" * 400_000, "a@" * 200_000, "1." * 200_000, "x@y" + ".z" * 100_000])
def test_base_spans_on_long_texts(text):
    assert len(pii.base_spans(text)) <= 100_000


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def person(n):
    return f"Wrote Zanziba{'rst'[n % 3]}okin about it , mail {'abc'[n % 3]}.known@host{n % 3}.example.com now please thing{n % 7} of the"


def slow_reached(hits, trials, share):
    """Chernoff: the chance of so large a rate, were the share the true one, is at most 15 %."""
    rate = hits / trials
    divergence = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if hits < trials else 0)
    return rate > share and math.exp(-trials * divergence) <= 0.15 * (1 + 1e-9)


def slow_terms(texts, generalise, remove):
    """Every term of a document against every identifier of it, counted over whole documents."""
    places, both, terms, entities = [], Counter(), Counter(), Counter()
    for text in texts:
        spans = slow_spans(text)
        terms.update(set(re.findall(r"[^\W\d_]{3,}", text.lower())))
        digits = lambda k, t: t.lower() if k == "email" else t if k == "ip" else re.sub("[^0-9]", "", t)
        names = {(k, digits(k, text[lo:hi])) for lo, hi, k in spans}
        entities.update(names)
        own = defaultdict(list)
        if spans:
            for m in re.finditer(r"[^\W\d_]{3,}", "".join(" " if any(lo <= k < hi for lo, hi, _ in spans) else c for k, c in enumerate(text))):
                own[m[0].lower()].append(m.span())
        both.update((name, term) for name in names for term in own)
        places.append((names, own))
    out = []
    for names, own in places:
        found = []
        for term, spans in own.items():
            kinds = set()
            for name in names:
                rarity = entities[name] / len(texts)
                hits = both[name, term], terms[term]
                if rarity < 1 and slow_reached(*hits, rarity ** (1 - generalise)):
                    kinds.add("term" if slow_reached(*hits, rarity ** (1 - remove)) else "general")
            found += [(lo, hi, "term" if "term" in kinds else "general") for lo, hi in spans if kinds]
        out.append(found)
    return out


def all_spans(text, terms):
    kinds = ["email", "ip", "card", "phone", "general", "term"]
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted([*slow_spans(text), *terms], key=lambda s: (s[0], kinds.index(s[2]))))


def test_terms_of_random_texts(spark):
    """Identifiers and names of all frequencies, alone and together, near and far, in lists and copies."""
    rng = random.Random(12)
    people = [(f"{w}@{v}.example.org", f"10.0.{n}.7", f"+1 415 555 01{n:02d}") for n, (w, v) in enumerate(zip(words(rng, 30), words(rng, 30)))]
    names = [w.capitalize() + "on" for w in words(rng, 60)]
    common = words(rng, 25)
    texts = []
    for n in range(500):
        text = rng.choices(common, k=rng.randrange(3, 40))
        if rng.random() < 0.3:
            who = int(rng.random() ** 2 * 30)
            for thing in (rng.choice(people[who]), names[who], *(rng.choices(names, k=1) if rng.random() < 0.2 else [])):
                for _ in range(rng.choice([1, 1, 2])):
                    text.insert(rng.randrange(len(text) + 1), thing)
        texts.append(" ".join(text))
    texts += [" ".join(f"{a}{k}@list.example.net {b}{k}x" for k, (a, b) in enumerate(zip(words(rng, 200), words(rng, 200))))] * 2
    texts += texts[:20]
    found = pii.op1_pii(table(spark, list(enumerate(texts)))).collect()
    expected = {n: all_spans(t, terms) for n, (t, terms) in enumerate(zip(texts, slow_terms(texts, 0.6, 0.9)))}
    assert {r["doc_id"]: r["spans"] for r in found} == expected
    assert sum("general" in s for s in expected.values()) > 20 and any("term:" in s for s in expected.values())


def test_a_list_of_addresses_is_one_entity(spark):
    """Two thousand addresses with a word each, in one text: pairs are counted for one of either."""
    text = " ".join(f"u{k}@list{k % 7}.example.com wordof{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2_000))
    rows = [(0, text)] + [(n, f"plain text {n}") for n in range(1, 300)]
    found = {r["doc_id"]: r for r in pii.op1_pii(table(spark, rows)).collect()}
    assert found[0]["n_email"] == 2_000 and found[0]["spans"].count("general:") == 2_000 and found[1]["spans"] == ""


def test_op1(spark):
    texts = [person(n) for n in range(24)] + [f"the plain of it now text number thing{n % 7}" for n in range(60)] + ["zanzibarokin elsewhere"] * 3
    rows = [(n, t) for n, t in enumerate(texts)] + [(900, None), (901, ""), (None, "call +1 (415) 555-0132"), (902, "ab " * 90_000 + "1.2.3.4"), (902, "ab " * 90_000 + "1.2.3.4")]
    docs = table(spark, rows)
    texts = [t or "" for _, t in rows]
    expected = []
    kinds = ["email", "ip", "card", "phone", "general", "term"]
    found_terms = slow_terms(texts, 0.6, 0.9)
    for (doc, _), text, terms in zip(rows, texts, found_terms):
        spans = slow_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        every = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted([*spans, *terms], key=lambda s: (s[0], kinds.index(s[2]))))
        counts = Counter(k for _, _, k in spans)
        expected.append((doc, *(counts[k] for k in kinds[:4]), hashlib.sha256(base.encode()).hexdigest(), every))
    out = pii.op1_pii(docs)
    got = [tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) for r in out.collect()]
    assert Counter(got) == Counter(expected)
    assert any("term:" in g[6] for g in got) and any("general:" in g[6] for g in got)
    assert pii.op1_pii(docs.limit(0)).count() == 0


def test_terms_of_an_identifier_in_one_document(spark):
    rows = [(0, "Wrote Quorvexil about it , mail only.once@rare.example.com now please")] + [(n, f"plain text wrote about mail now please {n}") for n in range(1, 400)]
    text = rows[0][1]
    spans = {r["doc_id"]: r["spans"] for r in pii.op1_pii(table(spark, rows)).collect()}
    at = text.index("Quorvexil")
    assert f"general:{at}:{at + 9}" in spans[0].split(",") and spans[0].count("general") == 1 and "term" not in spans[0]
    assert set(spans[n] for n in range(1, 400)) == {""}


def test_terms_far_from_the_identifier(spark):
    far = " ".join(["the plain of it"] * 30)
    letter = f"Quorvexil writes . {far} mail only.once@rare.example.com {far} signed Quorvexil"
    rows = [(n, letter) for n in range(12)] + [(n, far + " mail writes signed") for n in range(12, 400)]
    found = pii.op1_pii(table(spark, rows)).where("doc_id < 12").collect()
    places = [m.span() for m in re.finditer("Quorvexil", letter)]
    assert len(places) == 2 and len(found) == 12
    for r in found:
        assert [s for s in r["spans"].split(",") if not s.startswith("email")] == [f"term:{lo}:{hi}" for lo, hi in places]
    texts = {r["text"] for r in pii.sanitise(table(spark, rows)).where("doc_id < 12").collect()}
    assert len(texts) == 1 and "Quorvexil" not in texts.pop()


def test_sanitise(spark):
    rows = [(n, person(n)) for n in range(9)] + [(50 + n, "plain text") for n in range(20)] + [(60, None), (61, ""), (None, "1.2.3.4 x"), (7, "+1 (415) 555-0132"), (7, "+1 (415) 555-0132")]
    docs = table(spark, rows)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert texts[50, "plain text"] == 1 and texts[60, None] == 1 and texts[61, ""] == 1 and texts[None, "[IP] x"] == 1 and texts[7, "[PHONE]"] == 2
    assert all("known@" not in (t or "") for _, t in texts) and all("Zanziba" not in (t or "") for _, t in texts)
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())


SECRET = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "(?i:(password|passwd|secret|token|api_?key))")),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "pem": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "forge": re.compile("gh[pousr]_[A-Za-z0-9]{36,}"),
}


def slow_secrets(text):
    counts = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(SECRET.items()) for m in p.finditer(text) if counts.get(k, lambda m: True)(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_op10(spark):
    rng = random.Random(12)
    pieces = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ": ", "'", '"', "abc", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "0123", "é😀", " ", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "x" * 36, "tok", "en", "K", "İ"]
    rows = [(n, "".join(rng.choice(pieces) for _ in range(rng.randrange(18)))) for n in range(600)]
    rows += [(900, None), (901, ""), (None, "secret=abcdefg"), (902, "password=hunter22" * 3000), (902, "password=hunter22" * 3000), (903, "token=token:abcdefgh"), (904, "a" * 300_000)]
    docs = table(spark, rows)
    expected = Counter()
    for doc, text in rows:
        spans = slow_secrets(text or "")
        write = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        n = Counter(k for k, _, _ in spans)
        expected[doc, n["assign"], n["access"], n["hex"], hashlib.sha256(write(base).encode()).hexdigest(), write(spans)] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in secrets.op10_secrets(docs).collect())
    assert got == expected
    assert secrets.op10_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pattern", [r.pattern for r in secrets.RULES] + ["abc(def)?ghi", "(foo|bar)[0-9]+baz", "x*", "[ab]cde{2}f", "(?:abc)+d", "a.b", "hell[oa]w"])
def test_trigram_query_is_necessary(pattern):
    rng, query = random.Random(3), secrets.trigram_query(pattern)
    alphabet = ["password", "secret", "api", "_key", "token", "=", "abcdef", "AKIA", "QWERTYUIOP012345", "abc", "def", "ghi", "foo", "bar", "baz", "1", "cde", "ef", "hello", "w", "ghp_", "Z" * 36, "-----BEGIN ", "PRIVATE KEY-----", "deadbeef" * 3]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6)))
        if re.search(pattern, text) and query is not None:
            assert any(all(g in text.lower() for g in a) for a in query), (text, query)


def test_rules_and_their_trigrams():
    asked = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert asked["hex"] is None and asked["access"] == {frozenset({"aki", "kia"})}
    assert frozenset({"tok", "oke", "ken"}) in asked["assign"] and len(asked["assign"]) == 6


def slow_alignment(piece, window):
    best, before = 0, [0] * (len(window) + 1)
    for a in piece:
        row = [0]
        for j, b in enumerate(window, 1):
            row.append(max(0, before[j - 1] + (2 if a == b else -1), before[j] - 1, row[j - 1] - 1))
        best, before = max(best, *row), row
    return best / (2 * len(piece))


def test_alignment():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert leaks.alignment(np.array(a), np.array(b))[0] == slow_alignment(a, b)


def test_find_leaks(spark):
    rng = random.Random(21)
    items = [(i, words(rng, rng.randrange(15, 60))) for i in range(30)] + [(77, words(rng, 400))]
    rows, planted = [], set()
    for n in range(400):
        text = words(rng, rng.randrange(0, 200))
        if n % 4 == 0:
            item, own = rng.choice(items)
            own = [w if rng.random() > 0.12 else rng.choice(words(rng, 1)) for w in own]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
            if slow_alignment(dict(items)[item], own) >= 0.6:
                planted.add((n, item))
        rows.append((n, " ".join(text)))
    shared = " ".join(items[3][1]).upper().replace(" ", ", ")
    rows += [(1000 + n, f"intro {shared} outro") for n in range(200)]
    planted |= {(1000 + n, 3) for n in range(200)}
    rows += [(2000, None), (2001, ""), (None, shared), (2002, "pad " * 80_000 + shared), (2002, "pad " * 80_000 + shared), (2003, " ".join(items[5][1][:4]))]
    docs = table(spark, rows)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "the pad")], "item_id long, text string")
    found = leaks.find_leaks(docs, benchmark).collect()
    expected = planted | {(None, 3), (2002, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected) + 1
    text = dict(rows[:600])
    for r in found:
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000:
            assert text[r["doc_id"]][r["start"] : r["end"]] == shared and r["score"] == 1.0
    clean = leaks.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, t in rows if d not in {e[0] for e in expected})
    assert leaks.find_leaks(docs.limit(0), benchmark).count() == 0 and leaks.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert leaks.decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_excerpts_of_long_items(spark):
    rng = random.Random(8)
    items = {1: words(rng, 300), 2: words(rng, 191), 3: words(rng, 1000)}
    copies = [(1, 75, 225), (2, 40, 154), (1, 130, 182), (2, 0, 50), (2, 141, 191), *((3, at, at + 50) for at in range(0, 951, 19))]
    rows = [(n, " ".join([*words(rng, 40), *items[i][lo:hi], *words(rng, 40)])) for n, (i, lo, hi) in enumerate(copies)]
    rows += [(900 + n, " ".join([*words(rng, 60), *items[1][lo : lo + 25], *words(rng, 60)])) for n, lo in enumerate(range(0, 270, 30))]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = table(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, benchmark).collect()}
    assert found == {(n, i) for n, (i, _, _) in enumerate(copies)}
    assert {r["doc_id"] for r in leaks.decontaminate(docs, benchmark).collect()} == {d for d, _ in rows if d >= 900}


def test_short_items_and_torn_copies(spark):
    rng = random.Random(14)
    item, tiny = words(rng, 30), words(rng, 6)
    torn = [w for k, own in enumerate(item) for w in ([own, words(rng, 1)[0]] if k % 2 else [own])]
    rows = [(1, "Alpha, beta gamma delta!"), (2, "alpha beta gamma delta epsilon"), (3, "x alpha beta gamma delta"), (4, " ".join(torn)), (5, " ".join(words(rng, 20) + torn + words(rng, 20)))]
    rows += [(6, " ".join(tiny[:3] + ["new"] + tiny[3:])), (7, " ".join([tiny[0], "odd", *tiny[2:]])), (8, " ".join(tiny[:2] + tiny[3:])), (9, " ".join(tiny[:2])), (10, "yes"), (11, "no yes")]
    docs = table(spark, rows)
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, " ".join(item)), (3, " ".join(tiny)), (4, "Yes."), (5, "...")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (4, 2), (5, 2), (6, 3), (7, 3), (8, 3), (10, 4)}


def test_recall_of_plain_alignment(spark):
    """Every copy that plain Smith-Waterman finds on the given tables: documents that share no word pair with an item can't be one."""
    import numpy as np

    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, benchmark).collect()}
    numbers = {}
    number = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"\w+", text.lower())], np.int64)
    texts = {r["doc_id"]: number(r["text"]) for r in docs.collect()}
    expected = set()
    for r in benchmark.collect():
        own = number(r["text"])
        for doc, words_of in texts.items():
            # No alignment scores more than the words that both have.
            shared = sum((Counter(own.tolist()) & Counter(words_of.tolist())).values())
            if shared >= 0.6 * len(own) and leaks.alignment(own, words_of)[0] >= min(0.6, 50 / len(own)):
                expected.add((doc, r["item_id"]))
    assert expected and len(found & expected) >= 0.9 * len(expected) and found <= expected
    assert found == expected


def test_torn_copies_at_random(spark):
    rng = random.Random(4)
    items = {i: words(rng, rng.choice([5, 7, 9, 12, 30, 60, 84])) for i in range(60)}
    rows, expected = [], set()
    for n in range(500):
        i = rng.randrange(60)
        copy, edits = [], rng.choice([0.1, 0.25, 0.4])
        for w in items[i]:
            kind = rng.random()
            copy += [w] if kind > edits else [w, *words(rng, 1)] if kind > edits / 3 else [] if kind > edits / 6 else words(rng, 1)
        own = words(rng, rng.randrange(30)) + copy + words(rng, rng.randrange(30))
        rows.append((n, " ".join(own)))
        expected |= {(n, j) for j, item in items.items() if len(set(item) & set(own)) > 2 and slow_alignment(item, own) >= min(0.6, 50 / len(item))}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(table(spark, rows), benchmark).collect()}
    assert found == expected and len(expected) > 200


def test_leaks_in_blocks(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(leaks.find_leaks(docs, benchmark))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 300)
    assert whole and key(leaks.find_leaks(docs, benchmark)) == whole


def slow_chat(rows, turns=64, context=8):
    plain = lambda t: (t or "").replace("<|", "< |")
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append(((turn is not None, turn or 0), plain(role).strip(" ") or "unnamed", plain(text)))
    out = Counter()
    for conv, found in convs.items():
        said = [(name, text) for _, name, text in sorted(found)]
        opening = [(name, text) for name, text in said[:turns] if name == "system"]
        for who in {name for name, _ in said} - {"system"}:
            for begin in range(0, len(said), turns):
                own = said[begin : begin + turns]
                before = [] if not begin else [s for k, s in enumerate(said[begin - context : begin], begin - context) if k >= turns or s[0] != "system"]
                text, mask, masked = "", [], 0
                for k, (name, words) in enumerate((opening if begin else []) + before + own):
                    head = "<|system|>\n" if name == "system" else "<|assistant|>\n" if name == who else f"<|user:{name}|>\n"
                    if name == who and k >= len((opening if begin else []) + before):
                        lo, hi = len(text) + len(head), len(text) + len(head) + len(words) + 7
                        mask.append(f"{lo}:{hi}")
                        masked += hi - lo
                    text += head + words + "<|end|>\n"
                out[(conv, who, begin // turns, len(own), text, ",".join(mask), masked)] += 1
    return out


def test_chat(spark):
    rng = random.Random(31)
    rows = [(n % 9, rng.randrange(200), rng.choice(["user", "assistant", "system", "Bob", None, " "]), rng.choice(["hi", "é😀", "", None, "<|assistant|> no"])) for n in range(500)]
    # A dialogue of 200 turns, and null conversations and turns in great number.
    rows += [(30, n, "system" if n in (0, 5, 60, 70) else rng.choice(["user", "Ann"]), f"turn {n}") for n in range(200)]
    rows += [(None, None if n % 2 else n % 5, rng.choice(["user", "Bob", "system"]), str(n % 7)) for n in range(700)]
    rows += [(None, None, "user", "x"), (None, 1, "Bob", "y"), (3, None, "user", "late"), (20, 0, "system", "alone"), (21, 0, "user", "w" * 200_000)] + [(22, 5, "user", "same")] * 3
    chats = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    columns = ("conv_id", "perspective", "part", "n_turns", "text", "mask", "n_masked")
    assert Counter(tuple(r[c] for c in columns) for r in rotate_perspectives(chats).collect()) == slow_chat(rows)
    assert rotate_perspectives(chats.limit(0)).count() == 0
