"""Measures worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lafzspark.operators import evaluate


@pytest.mark.parametrize(("a", "b"), [(0, 0), (1, 0), (3, 3), (2, 9), (40, 61)])
def test_sign_test_is_exact(a, b):
    tail = 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)
    assert evaluate.log10_sign_test(a, b) == pytest.approx(math.log10(min(1, tail)), abs=1e-9)


def test_a_leaking_class_ruins_a_rare_ones_precision_but_not_recall(spark):
    cells = spark.createDataFrame([("big", "big", 99), ("big", "rare", 1), ("rare", "rare", 100)], "truth string, pred string, n long")
    prior = spark.createDataFrame([("big", 99.0), ("rare", 1.0)], "label string, weight double")
    found = {r["label"]: r for r in evaluate.prior_shift(cells, prior).collect()}
    assert (found["rare"]["precision"], found["rare"]["recall"], found["big"]["recall"]) == (0.5025, 1.0, 0.99)


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, False), (0.0, False), (None, True), (float("nan"), True)], "c double, hit boolean")
    bins = evaluate.calibration_bins(rows, F.col("c"), F.col("hit"))
    assert sorted(map(tuple, bins.collect())) == [(1, 1, 0, 0.0, 0.0), (15, 2, 1, 1.0, 0.5)]
    assert evaluate.calibration_errors(bins).first()["mce"] == 0.5


def test_splits_have_their_sizes_in_each_group_nulls_too(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").alias("lang"))
    found = evaluate.split_by_source(rows, ["lang"], "id", "s").groupBy("lang", "part").count().collect()
    assert {(r["lang"], r["part"]): r["count"] for r in found} == {("a", "train"): 560, ("a", "val"): 70, ("a", "test"): 70, (None, "train"): 240, (None, "val"): 30, (None, "test"): 30}
