"""Exact dedup by content-defined chunk recipes, DataFrame functions only.

A normalised text is cut where its own characters say so; each chunk becomes an identifier, a text the ordered list
of its identifiers (its recipe). Identifiers are verified: every distinct chunk is moved once, and if two different
chunks share an identifier, all identifiers are made anew with another salt. So equal recipes are equal texts, and
only recipes, not texts, are compared after that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import ROW, attach, materialize, numbered, stored

#: Removed before texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
#: A chunk has 256 to 1024 code points and ends after the first pair of these classes from 256 on.
CHUNK = r"(?s).{254,1022}?[aeioAEIO0-4à-ö一-濿][dgmpuyDGMPUY5-9ø-ÿ瀀-鿿]|.{1,1024}"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(BLANK), F.lit(""))


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, salt: int) -> Column:
    """128 bits as two numbers."""
    return F.array(F.xxhash64(chunk, F.lit(salt)), F.xxhash64(F.lit(salt), chunk))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                make_id: Callable[[Column, int], Column] = identifier, salts: int = 8,
                rid: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, rid (the column of that name, else the
    row's number in this scan).

    Texts are equal when they are identical without space, tab, LF, VT, FF and CR. Of equal texts the one with the
    most code points before that stays, then the smallest doc_id (null last). Null counts as empty, and all empty
    texts are one group. Of rows that tie in all of that exactly one stays. An empty table gives no rows; extra columns
    are ignored, whatever their names."""
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n"), normalized(F.col(text)).alias("norm"),
        (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"),
    )
    for salt in range(salts):
        ids = F.flatten(F.transform(F.col("parts"), lambda c: make_id(c, salt)))  # noqa: B023
        seen = (
            base.select(F.explode(chunks(F.col("norm"))).alias("chunk")).distinct()
            .select(make_id(F.col("chunk"), salt).alias("id")).groupBy("id").count().filter("count > 1")
        )
        if seen.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"two chunks share an identifier with each of {salts} salts")
    rows = materialize(
        base.withColumn("parts", chunks(F.col("norm"))).select(
            "doc_id", "n", F.sha2(F.col("norm"), 256).alias("text_sha256"), ids.alias("recipe"),
            "rid",
        ),
        "recipes",
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rid").alias("r")))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best"))
    return attach(rows, groups, "recipe", "group_size", rows.count()).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.r")).alias("kept"), "text_sha256", "rid",
    )


def kept_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay, in the columns of docs. It is scanned again, and rows are told by their place in their
    files; what isn't a stored table is stored first."""
    docs = stored(docs)
    found = exact_dedup(numbered(docs, text, doc_id), text, doc_id, rid=ROW, **options)
    gone = materialize(found.filter("not kept").select("rid"), "dropped")
    rows = numbered(docs, F.struct(*docs.columns).alias("row")).withColumnRenamed(ROW, "rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, n, norm, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER g = 1 AS kept
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""
