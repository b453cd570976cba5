"""The stages of the corpus pipeline on a small corpus with planted rows."""

import corpus_pipeline
from gaugeflow.llm.packing import pack

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    filler = [" ".join(f"w{(n * 7 + k * k) % 997}x{k % 13}" for k in range(60)) + "." for n in range(80)]
    leak = " ".join(f"leak{k}" for k in range(30))
    rows = [(n, t) for n, t in enumerate(filler)] + [(200 + n, f"{t} you vile thing{n}.") for n, t in enumerate(filler[:40])]
    rows += [(300, filler[3]), (301, filler[3]), (302, filler[4] + " " + leak), (303, None), (304, ""), (305, "mail a.b@c.example.com " + filler[5])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int("vile" in (t or ""))) for d, t in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    plain = set(range(80))
    assert plain <= set(kept["toxicity"]) and not any(200 <= d < 240 for d in kept["toxicity"])
    assert not {300, 301} & set(kept["simhash_near_dedup"]) and plain - {5} <= set(kept["simhash_near_dedup"])
    assert 302 not in kept["benchmark_decontamination"] and 303 in kept["benchmark_decontamination"]
    assert all("@" not in (r["text"] or "") for r in kept["pii"].values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert set(whole.columns) == set(pack(spark.createDataFrame([], DOCS)).columns)
    assert {r["doc_id"] for r in whole.collect()} == set(kept["pii"])


def test_unusual_tables(spark, tmp_path):
    """Columns named like the stages' own, null ids, a long text, repeated rows, and no rows at all."""
    names = ("_row", "row", "score", "offending", "_base", "base", "terms", "_terms", "root", "component_id", "start")
    schema = DOCS + "".join(f", {n} string" for n in names)
    texts = [" ".join(f"q{(n * 11 + k * k) % 983}y{k % 17}" for k in range(50)) for n in range(12)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "no id " + texts[0][:80]), (None, "no id " + texts[0][:80]), (3, texts[3])]
    rows += [(40, " ".join(f"long{k % 4999}z{k}" for k in range(20_000))), (41, "write to x.y@z.example.org"), (42, None), (43, None)]
    docs = spark.createDataFrame([(d, t, None, "s", None, *(f"mine {n} {d}" for n in names)) for d, t in rows], schema)
    labels = spark.createDataFrame([(d, 0) for d, _ in rows], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[7]), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        none = stage(spark, whole.where("false"), str(tmp_path))
        assert none.count() == 0, name
        if name == "best_fit_packing":
            break
        assert out.schema.simpleString() == whole.schema.simpleString(), name
        found = out.collect()
        assert all(r[n] == f"mine {n} {r['doc_id']}" for r in found for n in names), name
        docs = spark.createDataFrame(found, whole.schema)
    ids = [r["doc_id"] for r in docs.collect()]
    assert sorted(d for d in ids if d is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 40, 41, 42] and ids.count(None) == 1
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[41] == "write to [EMAIL]"
    packed = out.collect()
    assert {r["doc_id"] for r in packed} == set(ids) and sum(r["length"] for r in packed if r["doc_id"] == 40) > 20_000
