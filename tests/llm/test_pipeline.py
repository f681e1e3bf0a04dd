"""The corpus pipeline: each stage against brute force on its own input."""

import corpus_pipeline
from promptscreen.llm import quality, secret_scan, stages
from promptscreen.llm.common import word_count
from pyspark.sql import functions as F
from tests.llm.test_tables import brute_jaccard

ODD = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, "same words here again and again", "en", "a", 1), (4, "same words here again and again", "en", "b", 1), (4, "same words here again and again", "en", "b", 1), (None, "x y z", None, "c", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame([(*r, "e") for r in ODD], SCHEMA + ", spans string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns
            out.collect()
        stages.packing_stage(spark, frame, sf).collect()
    kept = stages.jaccard_stage(spark, docs, sf).collect()
    assert len(kept) == 4 and sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = {r.doc_id for r in stages.quality_stage(spark, docs, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id"), 3, 1))
    assert good == {i for i, t, _ in rows if model.score(t) >= 0.5}
    wanted = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & wanted) >= 0.98 * len(wanted & {i for i, _, _ in rows})
    single = {r.doc_id for r in stages.jaccard_stage(spark, docs, sf).collect()}
    assert single == {int(x[1 : x.index(",")]) for x in brute_jaccard(rows) if x.endswith("True)")}
    field = secret_scan.trained()
    for r in stages.secret_stage(spark, docs, sf).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert r.text == secret_scan.redacted(text, secret_scan.spans_of(text, field)) and r.n_chars == len(r.text)
    mixed = stages.mixing_stage(spark, docs, sf).agg(F.sum(word_count(F.col("text")))).head()[0]
    total = docs.agg(F.sum(word_count(F.col("text")))).head()[0]
    assert abs(mixed - 1.5 * total) <= docs.select("source").distinct().count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id"} <= set(out.columns) and out.count() > 0
