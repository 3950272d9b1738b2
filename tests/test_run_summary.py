import pytest
from pyspark.sql import functions as F

from promptloom.operators import corpus


def summary(spark, values, ordered=None, parts=1):
    v = spark.createDataFrame([("p", x) for x in values], "phrase string, similarity double").coalesce(1)
    v = v.sort(ordered).coalesce(1) if ordered is not None else v.repartition(parts)
    return corpus.run_summary(spark.range(3), v).first()


def test_mean_does_not_hang_on_the_order(spark):
    # the mean is 0.0499185, half-way between two values of 6 digits; sums of doubles end on either side of it
    hundredths = [5, 6, 4, 10, 0, 7, 3, 9, 1, 8, 2] * 5450
    hundredths += [4] * 40 + [0] * 9 + [1]
    hundredths = hundredths[:60_000]
    excess = sum(hundredths) - 299_511
    values = [x / 100 for x in hundredths]
    for i, x in enumerate(hundredths):
        if not excess:
            break
        step = min(excess, x) if excess > 0 else max(excess, x - 10)
        values[i], excess = (x - step) / 100, excess - step
    for options in ({"parts": 1}, {"parts": 2}, {"parts": 7}, {"ordered": F.asc("similarity")}, {"ordered": F.desc("similarity")}):
        assert summary(spark, values, **options)["mean_similarity"] == 0.0499185


@pytest.mark.parametrize("values, mean", [([], None), ([None, 0.5], 0.5), ([1e300, 1e300], 1e300), ([float("inf")], float("inf"))])
def test_mean_of_odd_values(spark, values, mean):
    assert summary(spark, values)["mean_similarity"] == mean


def test_mean_of_nan(spark):
    assert str(summary(spark, [float("nan"), 0.5])["mean_similarity"]) == "nan"
