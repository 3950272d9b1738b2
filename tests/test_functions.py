import pytest
from pyspark.sql import functions as F

from promptloom.functions import stats, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize("value, key", [(" A \tB. ", "a b"), ("É!?", "é"), ("", ""), (" \t", ""), ("x;\"'", "x")])
def test_phrase_key(spark, value, key):
    assert one(spark, text.phrase_key(F.col("s")), s=value) == key


def test_phrase_key_nfkc(spark):
    assert one(spark, text.phrase_key(F.col("s"), compatibility=True), s="ﬁt") == "fit"


@pytest.mark.parametrize("value, n", [("", 0), ("  ", 0), ("a b", 2), ("a b\tc\n", 3)])
def test_word_count(spark, value, n):
    assert one(spark, text.word_count(F.col("s")), s=value) == n


@pytest.mark.parametrize("count, want", [(1, "\\1$ b a"), (2, "\\1$ b \\1$"), (0, "\\1$ b \\1$")])
def test_replacement_is_literal(spark, count, want):
    assert one(spark, text.replace_occurrences(F.col("s"), F.lit("a"), F.lit("\\1$"), count), s="a b a") == want


def test_replace_first_without_match_or_phrase(spark):
    assert one(spark, text.replace_first(F.col("s"), F.lit("z"), F.lit("x")), s="abc") == "abc"
    assert one(spark, text.replace_first(F.col("s"), F.lit(""), F.lit("x")), s="abc") == "abc"


def test_jaccard_of_empty_sets(spark):
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, text.jaccard(none, none), s="") == 0.0
    assert one(spark, text.jaccard(none, none, 1.0), s="") == 1.0
    assert one(spark, text.jaccard(F.array(F.lit("a")), none), s="") == 0.0


def test_edit_ratio(spark):
    assert one(spark, text.edit_ratio(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, text.edit_ratio(F.col("a"), F.col("b")), a="abcd", b="abce") == 0.75


def test_chrf(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("abc", "xyz"), (None, "x")], "a string, b string").select(text.chrf_plus_plus("a", "b")).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, None]


@pytest.mark.parametrize("a, b, flip", [("do", "do not", True), ("NOT so", "can't", False), ("can't", "cannot", False), ("a", "b", False)])
def test_negation_flip(spark, a, b, flip):
    assert one(spark, text.negation_flip(F.col("a"), F.col("b")), a=a, b=b) is flip


def test_keeps_keywords(spark):
    assert one(spark, text.keeps_keywords(F.col("a"), F.col("b")), a="Legal advice", b="advice") is False
    assert one(spark, text.keeps_keywords(F.col("a"), F.col("b")), a="advice", b="other") is True


def test_reply_lines(spark):
    got = one(spark, text.reply_lines(F.col("s")), s='1. "A first   one"\n\n- second one\n• third one\nshort\nplain line')
    assert got == ["A first one", "second one", "third one", "plain line"]


def test_log_softmax(spark):
    got = one(spark, text.log_softmax(F.array(F.lit(1.0), F.lit(1.0))), s="")
    assert got == pytest.approx([-0.6931471805599453] * 2)


def test_divergences(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "w string, n double")
    q = spark.createDataFrame([("c", 2.0)], "w string, n double")
    assert stats.jensen_shannon(p, p, "w", "n").first()[0] == pytest.approx(0)
    assert stats.jensen_shannon(p, q, "w", "n").first()[0] == pytest.approx(0.6931471805599453)


def test_upper_median_of_even_count(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert stats.upper_median(rows, "v").first()["upper_median"] == 3


def test_histogram_leaves_out_what_no_bin_has(spark):
    rows = spark.createDataFrame([(99,), (100,), (1000,)], "v int")
    assert [(r[0], r[1]) for r in stats.histogram(rows, F.col("v"), [100, 500, 1000]).collect()] == [(100, 1)]


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "k int, p double")
    assert {r["k"]: round(r["q_value"], 6) for r in stats.benjamini_hochberg(rows, "p", "k").collect()} == {1: 0.04, 2: 0.04, 3: 0.04, 4: 0.5}


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    rows = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v"))
    a, b = (stats.bootstrap(rows, "v", F.col("id"), 200).first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"]
