"""What Python steps hold beside an executor: one worker a task, small batches, and memory given back."""

import pyarrow as pa

import corpus_pipeline
from dwellpath.llm import spark as helpers
from tests.llm.test_operators import EDGES, SCHEMA


def test_a_task_of_the_duplicate_stage_has_one_python_worker(spark):
    out = corpus_pipeline.duplicate_stage(spark, spark.createDataFrame(EDGES, SCHEMA), "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_batches_are_small_and_each_task_ends_with_a_rest(spark, monkeypatch):
    before = spark.conf.get(helpers.BATCH_KEY)
    try:
        spark.conf.set(helpers.BATCH_KEY, "10000")
        corpus_pipeline.packing_stage(spark, spark.createDataFrame(EDGES, SCHEMA), "")
        assert spark.conf.get(helpers.BATCH_KEY) == str(helpers.BATCH_ROWS)
    finally:
        spark.conf.set(helpers.BATCH_KEY, before)
    rests = []
    monkeypatch.setattr(helpers, "rest", lambda: rests.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert list(helpers.rested(lambda batches: batches)(iter([batch, batch]))) == [batch, batch] and rests == [1]
