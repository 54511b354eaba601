"""The classifier on held-out labels, and the pipeline's stages, one after the other."""

import re

import corpus_pipeline
from tests_llm_helpers import brute_near, brute_rules

from tidemark.llm import personal, quality, queries


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op1_quality(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for s, q in held if q == k] for k in (0, 1))
    assert sum(b < g for b in bad for g in good) > 0.97 * len(bad) * len(good)
    assert sum(s >= 0.3 for s in good) >= 0.95 * len(good)
    assert sum(s < 0.3 for s in bad) >= 0.7 * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 1), (None, "some words", 1), (3, "word " * 50000, 2)], "doc_id long, text string, score long")
    for marks in ([], [(1, 1, 0)], [(1, 0, 0), (3, 1, 0), (3, None, 0), (None, 1, 0), (2, 7, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        assert quality.judged(docs, labels).count() == 5
        assert quality.judged(docs.limit(0), labels).count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"]: r.asDict() for r in out.collect()}
        if name == "quality-rules":
            for r in rows:
                n, _, symbols, _, repeat = brute_rules(r["text"])
                if n < 10 or 100 * repeat > 20 * n or 100 * symbols > 10 * n:
                    assert r["doc_id"] not in kept
        if name == "near-duplicates":
            assert set(kept) == {c for _, _, c in brute_near([(r["doc_id"], r["text"]) for r in rows], 80)}
        if name == "personal-data":
            assert len(kept) == len(rows)
            for r in rows:
                clean = kept[r["doc_id"]]["text"]
                assert not any(personal.base_spans(clean).values())
                if not re.search("[0-9@]", r["text"]):
                    assert clean == r["text"]
        if name == "packing":
            assert set(kept) == {r["doc_id"] for r in rows}
        seen.append((name, len(rows)))
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "packing" else docs
    assert seen[0][1] > seen[1][1] >= seen[2][1] >= seen[3][1] == seen[4][1]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_pass_other_columns_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clashing = docs.selectExpr("*", "doc_id as _measures", "source as text_key", "lang as cid", "1 as digest", "'k' as key", "2 as score", "true as kept", "7 as component_id").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        assert out.columns == clashing.columns, name
        given = {r["doc_id"]: r for r in clashing.collect()}
        for r in out.collect():
            assert [r[c] for c in clashing.columns if c not in ("text", "n_chars")] == [given[r["doc_id"]][c] for c in clashing.columns if c not in ("text", "n_chars")]
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, sf).count() >= 60


def test_stages_on_empty_and_null(spark, sf):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "a few words, and ten of them or so, at least ten", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()
