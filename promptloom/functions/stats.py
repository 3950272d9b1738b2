"""Statistics over scores: group summaries and the measures known from their published definitions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, keys: list[str], parts: int = 64, name: str = "__r") -> DataFrame:
    """rows with the number of their range in the order of the keys, nulls first. The ranges' bounds come from a sample by
    hash, so they are the same whenever the plan runs; a few thousand values reach the driver."""
    found = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(32 * parts).collect()
    found = sorted(map(tuple, found), key=lambda r: [(x is not None, x) for x in r])
    types = [rows.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(x).cast(t).alias(f"c{i}") for i, (x, t) in enumerate(zip(r, types))]) for r in found[31::32]]
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    own = F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)])
    return rows.withColumn(name, F.size(F.filter(F.array(*bounds), lambda b: b < own)))


def group_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, population deviation, least and greatest; null for groups without values."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """Count, least, greatest, mean, and the upper median, sorted[n // 2], of the whole table.

    Values are counted first, so what is sorted is the distinct ones, and that in ranges."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = ranges(counted, ["v"], name="r")
    ahead = ranged.groupBy("r").agg(F.sum("n").alias("k")).select("r", (F.sum("k").over(Window.orderBy("r")) - F.col("k")).alias("ahead"), F.sum("k").over(Window.partitionBy()).alias("all"))
    running = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("r").orderBy("v"))).join(F.broadcast(ahead), "r")
    return running.agg(
        F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(F.when(F.col("upto") + F.col("ahead") > F.floor(F.col("all") / 2), F.col("v"))).alias("upper_median"),
    )


def histogram(rows: DataFrame, value: Column, bounds: list[int], name: str = "bin") -> DataFrame:
    """Counts and shares in half-open bins [a, b); the last bound may be None for no end. Values outside are left out."""
    lower = F.lit(None).cast("int")
    for a, b in reversed(list(zip(bounds, bounds[1:]))):
        lower = F.when((value >= a) & ((value < b) if b is not None else F.lit(True)), F.lit(a)).otherwise(lower)
    counted = rows.groupBy(lower.alias(name)).agg(F.count("*").alias("n")).filter(F.col(name).isNotNull())
    total = rows.agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(total)).select(name, "n", (F.col("n") / F.col("total")).alias("share"))


def length_categories(rows: DataFrame, words: Column) -> DataFrame:
    """Short to 3 words, medium to 7, long from 8."""
    return rows.agg(F.count_if(words <= 3).alias("short"), F.count_if((words >= 4) & (words <= 7)).alias("medium"), F.count_if(words >= 8).alias("long"))


def jensen_shannon(p: DataFrame, q: DataFrame, item: str, weight: str) -> DataFrame:
    """One row, `js`, of two weighted item tables, in nats."""
    def share(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(item).agg(F.sum(weight).cast("double").alias("__w"))
        return counted.join(F.broadcast(counted.agg(F.sum("__w").alias("__all")))).select(item, (F.col("__w") / F.col("__all")).alias(name))

    both = share(p, "p").join(share(q, "q"), item, "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2

    def part(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)

    return both.agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("js"))


def kl_divergence(p: DataFrame, q: DataFrame, item: str, p_weight: str, q_weight: str) -> DataFrame:
    """Exact KL(p || q) in nats, one row `kl`; items that q lacks make it infinite."""
    both = p.join(q, item, "left").filter(F.col(p_weight) > 0)
    term = F.when(F.coalesce(F.col(q_weight), F.lit(0.0)) > 0, F.col(p_weight) * F.log(F.col(p_weight) / F.col(q_weight))).otherwise(F.lit(float("inf")))
    return both.agg(F.sum(term).alias("kl"))


def bootstrap(rows: DataFrame, value: str, key: Column, iterations: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean: mean, low, high.

    Poisson bootstrap: in each iteration every row counts 0, 1, 2, ... times, by the CRC-32 of its key, a colon and the
    iteration, so resampling is a map with partial sums, without a join or a row for each iteration; `key` makes it
    repeatable."""
    below, p = [0.0], 0.36787944117144233
    for k in range(1, 8):
        below.append(below[-1] + p)
        p /= k
    times = np.searchsorted(below[1:], np.arange(1_000_003) / 1_000_003.0, "right").astype(np.uint8)
    names = [f"{i}".encode() for i in range(1, iterations + 1)]

    def run(batches):
        # crc32(a + b) is that of a, moved on by the length of b, xor that of b
        step = np.array([zlib.crc32(bytes(3) + bytes([i])) ^ zlib.crc32(bytes(4)) for i in range(256)], np.uint32)
        sums, counts, seen, any_value = np.zeros(iterations), np.zeros(iterations, np.int64), False, False
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                value, start = b.column(0).slice(at, 8192), b.column(1).slice(at, 8192)
                v = value.fill_null(0.0).to_numpy(zero_copy_only=False)
                moved, known = start.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32), start.is_valid().to_numpy(zero_copy_only=False)
                seen, any_value, length = True, any_value or value.null_count < len(value), 0
                for i, name in enumerate(names):
                    while length < len(name):
                        moved, length = step[moved & np.uint32(255)] ^ (moved >> np.uint32(8)), length + 1
                    h = moved ^ np.uint32(zlib.crc32(name))
                    c = times[h - h // np.uint32(1_000_003) * np.uint32(1_000_003)]
                    if start.null_count:
                        c = c * known
                    sums[i] += v @ c.astype(float)
                    counts[i] += int(c.sum(dtype=np.int64))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, iterations + 1, dtype=np.int32)), pa.array(sums if any_value else [None] * iterations, pa.float64()), pa.array(counts)], names=["it", "s", "c"])

    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    start = F.crc32(F.concat(key.cast("string"), F.lit(":")).cast("binary"))
    found = rows.select(F.col(value).cast("double").alias("v"), start.alias("h")).repartition(tasks, "h").sortWithinPartitions("h", "v").mapInArrow(run, "it int, s double, c long")
    # a fixed order of the tasks' sums, so that it is repeatable to the last bit
    total = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda x, y: x + y)
    means = found.groupBy("it").agg((F.when(F.count("s") > 0, total) / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", 1 - (1 - level) / 2).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(F.broadcast(ends))


def cohens_d(rows: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """One row `d`, by the pooled sample deviation; null if that is 0 or undefined."""
    def of(x, f):
        return f(F.when(F.col(group) == x, F.col(value)))

    s = rows.agg(*(f.alias(n) for n, f in (("n1", of(first, F.count)), ("n2", of(second, F.count)), ("m1", of(first, F.avg)), ("m2", of(second, F.avg)), ("v1", of(first, F.var_samp)), ("v2", of(second, F.var_samp)))))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    return s.select(F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("d"))


def benjamini_hochberg(rows: DataFrame, p: str, order: str) -> DataFrame:
    """Rows with `q_value`; `order` settles ties. p isn't null.

    Ranks and the minimum from above need one order over all p-values: ranges of p are ranked and scanned where they are,
    and only each range's count and least value meet."""
    ranged = ranges(rows, [p, order])
    inside = Window.partitionBy("__r").orderBy(p, order)
    counts = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    ahead = counts.withColumn("__ahead", F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).withColumn("__m", F.sum("__n").over(Window.partitionBy())).drop("__n")
    ranked = ranged.withColumn("__k", F.row_number().over(inside)).join(F.broadcast(ahead), "__r")
    raw = ranked.withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__k") + F.col("__ahead")))
    above = raw.groupBy("__r").agg(F.min("__raw").alias("__least")).withColumn("__above", F.min("__least").over(Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1))).drop("__least")
    upward = Window.partitionBy("__r").orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("__raw").over(upward), F.col("__above"))
    return raw.join(F.broadcast(above), "__r").withColumn("q_value", q).drop("__r", "__k", "__ahead", "__m", "__raw", "__above")


def importance(base: Column, length: Column, effect: Column, confidence: Column, similarity: Column) -> Column:
    """The product of the factors."""
    return base * length * effect * confidence * similarity


def normalized_kl(kl: Column, vocabulary: Column) -> Column:
    """Kl / ln(vocabulary size)."""
    return F.try_divide(kl, F.log(vocabulary))


def direction(logp: Column, logq: Column) -> Column:
    """X7, inside an aggregation."""
    return F.signum(F.avg(logp - logq))


def interactions(single: DataFrame, pairs: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Joint score of each pair less those of its items. pairs: (group, item_a, item_b, score)."""
    a = single.select(F.col(group), F.col(item).alias("item_a"), F.col(score).alias("score_a"))
    b = single.select(F.col(group), F.col(item).alias("item_b"), F.col(score).alias("score_b"))
    return pairs.join(a, [group, "item_a"]).join(b, [group, "item_b"]).withColumn("interaction", F.col(score) - F.col("score_a") - F.col("score_b"))


def truncate_tokens(c: Column, n: int = 100) -> Column:
    """X10"""
    return F.slice(c, 1, n)
