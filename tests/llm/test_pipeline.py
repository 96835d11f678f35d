import corpus_pipeline
from railweave.llm.pieces import decode_ids


def test_stages(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    body = lambda k: " ".join(f"d{k}w{i}" for i in range(80))
    rows = [(k, body(k) + (" " + passage if k % 5 == 0 else ""), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, body(k) + f" extra{k}", "en", "s1", 0) for k in range(10)]
    rows += [(200 + k, body(300 + k) + " vile insult" * 3, "en", "s2", 0) for k in range(60)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 0, int(200 <= k < 400)) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = f"{d}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
    clean = {r.doc_id for r in seen["toxicity"].collect()}
    assert not any(200 <= i < 300 for i in clean) and set(range(60)) <= clean and {400, 401} <= clean
    kept = {r.doc_id for r in seen["near duplicates"].collect()}
    assert set(range(60)) <= kept and not kept & set(range(101, 105))
    holders = [r.doc_id for r in seen["repeated passages"].collect() if "p30" in (r.text or "")]
    assert holders == [0]
    mixed = decode_ids(seen["pieces"])
    texts = {r.doc_id: r.text or "" for r in seen["repeated passages"].collect()}
    assert mixed.count() == seen["mixing"].count() > 0
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())
    assert corpus_pipeline.run(spark, d).count() == seen["pieces"].count()


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "a b  c", "x"), (2, None, "x"), (3, "a▁b", "x")], "doc_id long, text string, source string")
    out = corpus_pipeline.encode(spark, docs, "")
    assert {r.doc_id: r.round_trip for r in out.collect()} == {1: True, 2: True, 3: False}
