"""The model of personal data is fitted to all rows, and is the same wherever its sums are added up."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dwellpath.llm import boosting, pii
from tests.llm.test_operators import SCHEMA
from tests.llm.test_pii import personal


def test_all_rows_are_learned_from(spark):
    rows = [(k, f"a{k} call +1 (743) 555-{k:04} or 1914-1918, {k}", "en", "s", 0, "x", 1) for k in range(3000)]
    # a span with the same surroundings counts once
    found = {(kind, label, h, tuple(x)) for r in rows for kind, label, h, x in pii.examples(r[1].encode())}
    want = Counter(x[:2] for x in found)
    assert max(want.values()) > 2500  # what the sample of a kind and label was cut at
    got = pii.training_rows(spark.createDataFrame(rows, SCHEMA)).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r["kind"], r["label"]): r["n"] for r in got} == want


def test_sums_by_spark_give_the_model_of_sums_at_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame(personal(200), SCHEMA)
    monkeypatch.setattr(pii, "grow", lambda *a: boosting.grow(*a, rounds=2))
    one = pii.fit(docs)
    monkeypatch.setattr(pii, "AT_DRIVER", 0)
    two = pii.fit(docs.repartition(5))
    assert all(np.array_equal(getattr(one.trees, k), getattr(two.trees, k)) for k in ("feature", "limit", "leaf")) and one.trees.base == two.trees.base
    assert one.lines == two.lines and one.limits == two.limits
