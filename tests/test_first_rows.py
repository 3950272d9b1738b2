"""The first rows and the phrase join move no more than they need."""

from pyspark.sql import functions as F

from promptloom.operators import corpus, importance


def test_first_rows_with_ties_and_nulls(spark):
    data = [(None, "n"), (3, "c"), (1, "a"), (2, "z"), (2, "b"), (2, "y"), (5, "e"), (1, "a")]
    rows = spark.createDataFrame(data, "at long, text string").repartition(3)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for budget in range(10):
        got = sorted(map(tuple, corpus.first_rows(rows, "at", budget, ["text"]).collect()), key=str)
        assert got == sorted(order[:budget], key=str), budget
    assert [r["text"] for r in corpus.first_unique(rows.filter("at is not null"), "text", "at", 2, 4).orderBy("at").collect()] == ["a", "b"]


def test_no_task_holds_all_texts(spark):
    rows = spark.range(1000).select(F.col("id").alias("at"), F.repeat(F.lit("x"), 100).alias("text"))
    plan = corpus.first_rows(rows, "at", 500, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_phrases_by_their_inner_word_and_its_neighbours(spark, monkeypatch):
    texts = ["alpha beta gamma", "xalpha beta gammay", "alpha  beta gamma", "alpha beta", " beta gamma", "a beta gamma d", "alpha beta ", "alpha\tbeta\ngamma", "b b b b", "", "aa bb cc dd ee", "zaa bb cc dd eez", "aa bb\u00a0cc dd"]
    said = ["alpha beta gamma", " beta gamma", "alpha beta ", " beta ", "alpha\tbeta\ngamma", "b b b", "aa bb cc dd ee", "a bb cc d", "bb\u00a0cc dd", "pha beta gam", "a b", "  beta  "]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    want = sorted((i, p) for i, t in enumerate(texts) for p in said if p in t)
    for most in (20_000, 3):
        monkeypatch.setattr(importance, "BROADCAST_ROWS", most)
        for key in ("doc_id", None):
            got = importance.phrases_in_prompts(docs, spark.createDataFrame([(p,) for p in said], "phrase string"), key=key).collect()
            assert sorted((r["doc_id"], r["phrase"]) for r in got) == want


def test_a_common_inner_word_is_no_candidate_alone(spark):
    """Before, each of 400 texts was searched for each of 2,000 phrases around the same word."""
    docs = spark.createDataFrame([(i, "x and y " * 400) for i in range(400)], "doc_id int, text string")
    phrases = spark.createDataFrame([(f"{a}{i} and {b}{i}",) for i in range(500) for a, b in ("pq", "qr", "rs", "st")], "phrase string")
    found = importance.phrases_in_prompts(docs, phrases, key="doc_id")
    assert found.count() == 0
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "0 and q" in keys or "INSET" in keys or " IN (" in keys
