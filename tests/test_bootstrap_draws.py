"""The bootstrap's draws, against the plain definition, and its speed."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.functions import stats


def plain(rows, iterations):
    below = np.cumsum([0.36787944117144233 / np.prod(np.arange(1, k + 1)) if k else 0.36787944117144233 for k in range(7)])
    means = []
    for it in range(1, iterations + 1):
        times = [0 if k is None else int((zlib.crc32(f"{k}:{it}".encode()) % 1_000_003 / 1_000_003.0 >= below).sum()) for k, _ in rows]
        means.append(sum(v * t for (_, v), t in zip(rows, times) if v is not None) / sum(times))
    return np.percentile(means, 2.5), np.percentile(means, 97.5)


def test_draws_are_those_of_the_plain_definition(spark):
    rows = [(str(i * 7919), float(i % 13) * 1.5) for i in range(60)] + [("none", None), (None, 100.0)]
    got = stats.bootstrap(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", F.col("k"), 1200).first()
    assert (got["low"], got["high"]) == pytest.approx(plain(rows, 1200), rel=1e-12)
    empty = stats.bootstrap(spark.createDataFrame([], "k string, v double"), "v", F.col("k"), 10).first()
    assert empty["low"] is None and empty["mean"] is None


def test_no_row_for_each_iteration(spark):
    rows = spark.range(300_000).select("id", (F.col("id") % 1000).cast("double").alias("v"))
    began = time.time()
    got = stats.bootstrap(rows, "v", F.col("id"), 1000).first()
    assert got["low"] < 499.5 < got["high"] and time.time() - began < 60
