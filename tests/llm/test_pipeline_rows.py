"""Stages of the corpus pipeline with repeated and null ids."""

import corpus_pipeline as pipeline

from skylark.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).coalesce(2)


def test_quality_judges_rows(spark, tmp_path):
    good, bad = "Plain words of prose here. " * 5, "LOUD!! %%% ### " * 9
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(None, good), (None, bad), (1, bad), (3, good)]
    got = [(r.doc_id, r.text) for r in pipeline.quality_stage(spark, _frame(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] == good], key=str)


def test_mixture_takes_rows_once_and_holds_its_budget(spark):
    docs = _frame(spark, [(7, "w x y z")] * 5 + [(None, "a b c d")] * 5)
    got = pipeline.mix_stage(spark, docs, "")
    assert got.count() == 9 and got.agg({"n_chars": "max"}).first()[0] == 7
    assert got.select(mixing.token_count(got.text).alias("n")).agg({"n": "sum"}).first()[0] == 36
    assert got.columns == docs.columns and got.where("doc_id IS NULL").count() >= 4


def test_dedup_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text)] * 3 + [(None, text), (None, "alone " + "q r s t u v"), (9, ""), (2, text + " more")]
    got = pipeline.dedup_stage(spark, _frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text[:5]) for r in got), key=str) == sorted([(None, "alone"), (9, ""), (2, "w0 w1")], key=str)
