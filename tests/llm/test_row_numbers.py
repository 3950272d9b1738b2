import pytest

from promptloom.llm import exact_dedup, simhash

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def table(spark, tmp_path):
    """Documents in files of unlike sizes, each text twice, so that a scan deals them out as the setting says."""
    rows = [(i, f"text number {i // 2} " + " ".join(f"w{(i // 2) * 7 + k}" for k in range(40 + 9 * (i % 5)  * (i % 2 == 0)))) for i in range(120)]
    rows = [(i, rows[i - i % 2][1]) for i, _ in rows]
    for f in range(8):
        spark.createDataFrame(rows[f * f * 2 : (f + 1) * (f + 1) * 2 if f < 7 else 120], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    yield spark.read.parquet(str(tmp_path / "t"))
    spark.conf.unset(SPLIT)


@pytest.mark.parametrize("operator", [exact_dedup, simhash])
def test_rows_stay_the_same_when_the_scan_is_dealt_out_anew(spark, table, operator):
    spark.conf.set(SPLIT, "1g")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    kept = operator.kept_documents(table)  # the rows to drop are found here
    spark.conf.set(SPLIT, "1k")
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    got = sorted(r["doc_id"] for r in kept.collect())
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == list(range(0, 120, 2))
