"""Mixing sources to target weights: systematic sampling, DataFrame functions only.

Each document of a source is expected the same number of times, target / size of its source. Within the source the
documents stand in a fixed order; the expected copies are summed along it, one offset is added, and a document is
taken once for each whole number that the sum crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: A source's target is at most so many times its size.
CEILING = 2
#: The one random offset, a fixed multiple of 2^-20, so that sums with it are exact.
OFFSET = 663_608 / 1_048_576
#: Order buckets within a source and size class.
BUCKETS = 256

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """sizes(source, source_size), one row a source -> the same with target (double).

    Sharing the excess again and again until no source is above its ceiling ends at one level: each source gets
    least(ceiling * size, weight * level). With the sources ordered by ceiling * size / weight, the level follows
    from running sums. The null source comes last in the weights' order."""
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("__i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("__i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("__w", w)
        .withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__cap", F.col("source_size") * F.lit(float(ceiling)))
    )
    order = everything.orderBy(F.col("__cap") / F.col("__w"), "__i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    return (
        ranked.withColumn("__level", level)
        .withColumn("__level", F.max(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__w")), F.col("__cap")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS,
        share: float = SHARE, ceiling: float = CEILING, offset: float = OFFSET, keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken; with keep=True all columns
    of docs in a struct `row` too.

    Null text: size 0; null source: a source of its own, last in the weights' order; an empty table: no rows; rows
    that repeat are mixed as separate documents (equal ones may swap places, which changes no result). Extra columns
    are ignored, whatever their names. A document of size 0 may be taken, which adds no words.

    Within a source the order is size class, hash bucket, size, doc_id; so the sample is stratified by size. The
    position in the source is that of the bucket plus that in the bucket, so no task needs all rows of a source."""
    size = word_count(F.col(text))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        # a null source has a key of its own; window and join have the same keys, so rows move once
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("__s"), *([F.struct(*docs.columns).alias("row")] if keep else []),
    ).withColumn(
        "__class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    ).withColumn(
        "__bucket", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 6), 16, 10).cast("int"), F.lit(BUCKETS))
    )
    groups = rows.groupBy("source", "__s", "__class", "__bucket").agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    ahead = Window.partitionBy("source").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = groups.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    goal = targets(groups.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, ceiling)
    keys = ["__s", "__class", "__bucket"]
    places = places.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(*keys, "__ahead", "source_size", "target")
    here = Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_last())
    placed = rows.withColumn("__k", F.row_number().over(here)).join(places, keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("__k") + F.col("__ahead")
    crossed = F.floor(k * rate + F.lit(offset)) - F.floor((k - 1) * rate + F.lit(offset))
    return placed.withColumn("copies", F.least(crossed, F.floor(F.lit(ceiling))).cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *(["row"] if keep else []),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, in the columns of docs."""
    out = mix(docs, keep=True, **options).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s
), w AS (
  SELECT *, [5, 2, 1][((i - 1) % 3 + 1)::INT] AS w, (SELECT sum(source_size)::BIGINT FROM s) * 1.5::DOUBLE AS total, source_size * 2.0::DOUBLE AS cap FROM r
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w
), t AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT max(lev) FROM l WHERE lev * w <= cap)), cap) AS target FROM l
), k AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size + 1) * 8)::INT,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::INT % 256, size, doc_id NULLS LAST) AS k FROM d
), c AS (
  SELECT k.doc_id, k.size, k.source, t.source_size, t.target, k.k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(k * rate + 663608::DOUBLE / 1048576) - floor((k - 1) * rate + 663608::DOUBLE / 1048576), 2)::BIGINT * size) AS taken
FROM c
"""
