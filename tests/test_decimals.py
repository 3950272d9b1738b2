"""Figures in reports are those of the stored doubles."""

from pyspark.sql import functions as F

from promptloom.functions.text import decimals
from promptloom.operators import edits
from promptloom.sources import sinks


def test_decimals_round_the_stored_double(spark):
    values = [0.0000005, 136542.6692855, 162057.9515005, 2.0000005, 0.5, -1.25, 1234567.891, -0.0, 1e-9, 1e15]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", decimals(F.col("x")).alias("d"), decimals(F.col("x"), 1, True).alias("p")).collect()
    assert [(r["d"], r["p"]) for r in got] == [(f"{r['x']:.6f}", f"{r['x']:.1f}%") for r in got]


def test_report_lines_round_the_stored_double(spark):
    ranked = spark.createDataFrame([(1, "a", 0.0000005, 1)], "prompt_id long, phrase string, kl_score double, rank int")
    report = sinks.prompt_report(ranked, spark.createDataFrame([(1, "said")], "prompt_id long, text string")).first()["value"]
    assert '  1. 0.000000  "a"' in report and "mean: 0.000000" in report


def test_equal_candidates_are_told_apart(spark):
    rows = spark.createDataFrame([(1, n, 0.5, "one two", "one two") for n in (3, 9, 1, 7, 5, 2, 8)], "id long, other long, cosine double, source string, candidate string").repartition(5)
    got = edits.rerank(rows, "id", "source", "candidate", 0.3, 0.9, "other").orderBy("place").collect()
    assert [r["other"] for r in got] == [1, 2, 3, 5, 7, 8, 9]
