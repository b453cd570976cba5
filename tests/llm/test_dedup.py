"""SimHash and vector near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from gaugeflow.llm import simhash
from gaugeflow.llm.buckets import star_links
from gaugeflow.llm.components import connected_components
from gaugeflow.llm import embeddings
from gaugeflow.llm.embeddings import near_vectors
from gaugeflow.llm.simhash import block_pairs, fingerprint, fingerprint_components, keep_one, op2_simhash, shifted_pairs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprints_near(rng, count):
    values = [rng.getrandbits(64) for _ in range(max(1, count // 4))]
    while len(values) < count:
        value = rng.choice(values)
        for _ in range(rng.randrange(1, 7)):
            value ^= 1 << rng.randrange(64)
        values.append(value)
    return sorted(set(values))


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "One two", "x y z w", "Ä Ö ü ẞ a\x0bb\x1cc\xa0d", "the cat sat on the mat the cat sat on the mat", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_over_many_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["tok", "TOK", "éa", "b,"]) for _ in range(900))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 64)
    assert fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("count", [1, 2, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_pairs(count, radius):
    values = fingerprints_near(random.Random(count), count)
    packed = np.array(values, np.uint64)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= radius}
    assert {(int(a), int(b)) for i, j in block_pairs(packed, radius) for a, b in zip(i, j)} == expected
    bucket = np.arange(len(values)) // 7
    i, j = shifted_pairs(packed, bucket, radius)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in expected if bucket[a] == bucket[b]}


def test_star_links_keep_components():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    row, root = star_links(a, b, 400)
    assert groups(range(400), zip(row.tolist(), root.tolist())) == groups(range(400), zip(a.tolist(), b.tolist()))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, n) for n in range(501, 600)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    links += [(7, 7), (160, 100)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert found == groups(nodes, [(a, b) for a, b in links if a != b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [4096, 16])
def test_fingerprint_components(spark, monkeypatch, most):
    values = fingerprints_near(random.Random(9), 600)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(simhash, "compare_in_buckets", lambda *args, real=simhash.compare_in_buckets: real(*args, most=most))
    found = {r["node"]: r["root"] for r in fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    linked = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    expected = groups(signed, linked)
    assert {v: found.get(v, v) for v in signed} == expected and len(set(expected.values())) < len(values)


def test_op2_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash(docs).collect()}
    own = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(own)
    root = groups(ids, [(a, b) for a in ids for b in ids if a < b and (own[a] ^ own[b]).bit_count() <= 4])
    assert found == {d: (f"{own[d]:016x}", root[d]) for d in ids}


def edge_documents(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, None), (3, ""), (9, " \n"), (4, same), (4, same), (None, same), (None, "alone in the world of words"), (8, "x " * 60_000), (2, "Other words that nobody else has written")]
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).withColumnRenamed("source", "row").withColumnRenamed("lang", "fp")


def test_op2_edge_cases(spark):
    docs = edge_documents(spark)
    rows = sorted(((r["doc_id"], r["component_id"]) for r in op2_simhash(docs).collect()), key=str)
    assert rows == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (4, 4), (None, 4), (None, None), (8, 8), (2, 2)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect()) == sorted([("3", ""), ("4", "one t"), ("None", "alone"), ("8", "x x x"), ("2", "Other")])
    assert op2_simhash(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def slow_vectors(rows, similarity=0.93):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and any(v) and lab is not None for _, v, lab in rows]
    links, pairs = [0] * len(rows), []
    for i, (_, u, lab) in enumerate(rows):
        for j in range(i):
            _, v, other = rows[j]
            if ok[i] and ok[j] and lab == other and len(u) == len(v):
                a, b = np.array(u, float), np.array(v, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similarity:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    root = groups(range(len(rows)), pairs)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("most", [1024, 8])
def test_near_vectors(spark, most):
    rng = np.random.default_rng(11)
    rows, centres = [], rng.standard_normal((40, 64))
    for n in range(500):
        spread = rng.choice([0.0, 0.1, 0.3, 3.0])
        vector = centres[n % 40 if n % 3 else 0] + spread * rng.standard_normal(64)
        rows.append((n, [float(x) for x in vector.astype(np.float32)], n % 2))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [None] * 64, 1), (905, rows[0][1], None), (906, rows[0][1][:10], 0), (907, rows[0][1][:10], 0), (908, [3e38] * 64, 0), (909, [1.0] * 64, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(table.withColumnRenamed("nothing", "x"), most=most).collect())
    expected = slow_vectors(rows)
    wanted, got = sum(n for _, n, _ in expected), sum(n for _, n, _ in found)
    assert got / wanted > 0.97 and all(a[1] <= b[1] for a, b in zip(found, expected))
    assert sum(a[2] == b[2] for a, b in zip(found, expected)) > 0.99 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in near_vectors(table, most=most).collect())


def test_near_vectors_recall_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected = slow_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(table).collect())
    assert sum(n for _, n, _ in found) >= 0.97 * sum(n for _, n, _ in expected)
    assert near_vectors(table.limit(0)).count() == 0


def test_codewords_follow_the_vectors():
    assert [embeddings.codewords(n) for n in (0, 32_768, 32_769, 131_073, 10**12, 10**18)] == [128, 128, 256, 512, 8_192, 8_192]
    sizes = [n * embeddings.FILTERS / (embeddings.CODES * embeddings.codewords(n) ** 2) for n in (32_768, 131_072, 10**6, 10**7)]
    assert max(sizes) <= 4 * min(sizes)


@pytest.mark.parametrize("words", [256, 512])
def test_filters_of_larger_labels_find_the_same_links(words):
    """Pairs near the threshold share a filter at the settings for four and sixteen times the vectors."""
    rng = np.random.default_rng(words)
    first = embeddings._unit(rng.standard_normal((1_000, 64)))
    aside = rng.standard_normal((1_000, 64))
    aside = embeddings._unit(aside - (aside * first).sum(1, keepdims=True) * first)
    cosine = rng.uniform(0.93, 0.96, (1_000, 1))
    second = cosine * first + np.sqrt(1 - cosine**2) * aside
    lists = []
    for side in (first, second):
        row, code = embeddings.decode(side, words)
        lists.append([set(code[row == k].tolist()) for k in range(1_000)])
    met = sum(bool(a & b) for a, b in zip(*lists)) / 1_000
    assert met >= 0.97, met
    assert np.mean([len(x) for x in lists[0]]) < 80
