"""Edit ratios of many pairs at once, against Spark's own distance."""

import random
import time

from pyspark.sql import functions as F

from promptloom.functions import text


def test_ratios_are_those_of_single_pairs(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abc#0\u00e4\U0001f600") for _ in range(n))
    left = [(i % 3, i, say(rng.choice([0, 1, 5, 18, 31, 32, 33, 63, 64, 65, 90]))) for i in range(60)] + [(1, 98, None), (7, 99, "x"), (None, 97, "x")]
    right = [(i % 3, say(rng.choice([0, 1, 4, 18, 40, 70]))) for i in range(60)] + [(1, None), (None, "x"), (2, "same"), (2, "same")]
    a, b = spark.createDataFrame(left, "key int, k long, x string"), spark.createDataFrame(right, "key int, y string")
    want = a.join(b, "key").select("k", "y", F.round(text.edit_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))
    assert sorted(map(str, text.edit_ratios(a, b, 6).collect())) == sorted(map(str, want.collect()))


def test_many_pairs_are_quick():
    distances, began = text.EditDistances([f"Supplier#{i:09d}" for i in range(20_000)]), time.time()
    assert all(int(distances(f"Customer#{i:09d}").min()) >= 5 for i in range(50)) and time.time() - began < 5
