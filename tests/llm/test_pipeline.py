"""The pipeline's stages on a small fixture, each against its own input."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import sentencepiece as library
from pyspark.sql import functions as F

from meterlake.llm import mixing, quality, secret_scan, sentencepiece_fst
from tests.llm.test_operators import _jaccard_groups, _many_secrets, _plain_models

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, "a text without an id that stands alone here", "en", None, 40), (90_001, None, None, None, None), (90_002, "", "en", "src1", 0)],
        docs.schema)
    # Columns named like results, or like what stages call their own.
    own = ["score", "predicted", "own_score", "own_predicted", "gone_id", "masked_before", "gone_id_"]
    docs = docs.unionByName(extra).withColumns({c: F.lit(1) for c in own})
    seen = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    first, second, third, fourth, last = seen[1:]

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = quality.score(docs, model, ["doc_id"]).filter("predicted = 1")
    assert sorted(r["doc_id"] or -1 for r in first.collect()) == sorted(r["doc_id"] or -1 for r in good.collect())

    rows = [(r["doc_id"], r["text"]) for r in first.filter("doc_id IS NOT NULL").collect()]
    keep = sorted(i for i, (_, g) in _jaccard_groups(rows, 5, 80).items() if i == g)
    assert sorted(r["doc_id"] for r in second.filter("doc_id IS NOT NULL").collect()) == keep

    models = secret_scan.train(second)
    before = {r["doc_id"]: r["text"] for r in second.collect()}
    for r in third.collect():
        text, parts, done = before[r["doc_id"]], [], 0
        for a, b, _ in secret_scan.spans(text or "", models):
            if a >= done:
                parts += [text[done:a], "[secret]"]
            done = max(done, b)
        assert r["text"] == (None if text is None else "".join(parts) + text[done:])
    assert third.count() == second.count()

    plan = mixing.mix(third, ["doc_id"]).agg(F.sum("taken")).first()[0]
    assert fourth.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan

    pieces = library.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    want = sorted((r["doc_id"] or -1, pieces.encode(r["text"]) if r["text"] is not None else []) for r in fourth.collect())
    assert sorted((r["doc_id"] or -1, r["ids"] or []) for r in last.collect()) == want


def test_secrets_stage_learns_from_every_row(spark, monkeypatch):
    docs = _many_secrets(spark)
    used = []
    redact = secret_scan.redact
    monkeypatch.setattr(secret_scan, "redact", lambda df, models: used.append(models) or redact(df, models))
    out = corpus_pipeline.secret_scans(spark, docs, SF)
    first, step, total = _plain_models([r["text"] for r in docs.distinct().collect() if r["text"]])
    assert np.allclose(used[0].first, first, atol=1e-9) and np.allclose(used[0].step, step, atol=1e-9) and used[0].total_bits == total
    assert out.count() == docs.count() and out.filter("text LIKE '%AKIA%' OR text LIKE '%password%'").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("NOT round_trip").count() == 0
