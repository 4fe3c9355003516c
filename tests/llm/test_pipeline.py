"""The pipeline, stage by stage, against plain versions on the stage's own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cubelark.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(1).select(F.lit(10_001).cast("long").alias("doc_id"), F.lit("123 456 !!").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    docs = docs.unionByName(extra)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = written(stages["language_id"](spark, docs, DATA), "a")
    assert known.columns == columns and known.count() == docs.count() - 1
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    distinct = written(stages["ngram_jaccard_join"](spark, known, DATA), "b")
    groups = brute.jaccard(rows, 5, 80, 100)
    assert {r["doc_id"] for r in distinct.collect()} == {d for d, (_, c) in groups.items() if d == c}
    rows = [(r["doc_id"], r["text"]) for r in distinct.collect()]
    cut = written(stages["suffix_array_dedup"](spark, distinct, DATA), "c")
    assert cut.columns == columns
    plain = brute.suffix_dedup(rows)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for d, t in rows:
        n, removed = plain[d][:2]
        assert len(texts[d].encode()) - (n - removed) in range(0, 4 * plain[d][2] + 1) if d in texts else n == removed
    packed = stages["best_fit_packing"](spark, cut, DATA)
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_stages_of_odd_tables(spark, table, odd_rows):
    for rows in (odd_rows, [], [(None, None), (1, "one two"), (None, "three")]):
        docs = table(rows)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, docs, DATA), name)
            assert i == 3 or out.columns == docs.columns
            docs = out


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    assert corpus_pipeline.run(spark, DATA).count() > 100


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered_once(n):
    assert sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) == 1
