from promptloom.llm import suffix_dedup

from .test_row_numbers import SPLIT, table  # noqa: F401
from .test_suffix_dedup import brute


def test_texts_stay_the_same_when_the_scan_is_dealt_out_anew(spark, table, monkeypatch):  # noqa: F811
    want = brute([tuple(r) for r in table.collect()])
    store = suffix_dedup.materialize

    def materialize(df, tag):
        out = store(df, tag)
        if tag == "facts":
            spark.conf.set(SPLIT, "1k")
            spark.conf.set("spark.sql.files.minPartitionNum", "64")
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", materialize)
    spark.conf.set(SPLIT, "1g")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    got = sorted(map(tuple, suffix_dedup.substring_dedup(table).collect()), key=str)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want
