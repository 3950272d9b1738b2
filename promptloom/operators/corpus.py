"""Preparation of prompt corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions.stats import ranges
from promptloom.functions.text import assistant_name, py_strip, word_count

# What marks JSON near the word "tool".
JSON_MARKS = ('{"', '{ "', "[\n", "[ \n", '"type":', '"name":', '"description":', "json", "JSON")
# Prices in dollars of a call.
CALL_PRICE = {"together": 0.001, "openai": 0.003, "anthropic": 0.004}


def long_enough(c: Column, least: int = 20, inclusive: bool = True) -> Column:
    """F2"""
    return F.length(c) >= least if inclusive else F.length(c) > least


def length_band(rows: DataFrame, text: str, low: int = 100, high: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows within [low, high] characters, and one row of counts."""
    n = F.length(text)
    return rows.filter(n.between(low, high)), rows.agg(F.count_if(n.between(low, high)).alias("kept"), F.count_if(n < low).alias("too_short"), F.count_if(n > high).alias("too_long"))


def mentions_tools(c: Column, needle: str = "tool", marks: tuple[str, ...] = JSON_MARKS, plural: str = r"(?i)tools?\s*:\s*[\[{]") -> Column:
    """the needle in lower case, and a mark of JSON anywhere or the needle's own opening bracket."""
    near = reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])
    return F.contains(F.lower(c), F.lit(needle)) & (near | c.rlike(plural))


def renumber(rows: DataFrame, order: str, name: str = "number") -> DataFrame:
    """places from 1 in the order of `order`, without one task for all rows: ranges are numbered where they are,
    and start at the count of the ranges before."""
    placed = ranges(rows, [order], name="__p")
    inside = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    ahead = placed.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__ahead", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    return inside.join(F.broadcast(ahead), "__p").withColumn(name, F.col("__k") + F.col("__ahead")).drop("__p", "__k", "__ahead")


def excerpts(rows: DataFrame, text: str, order: str, needle: str = "tool", n: int = 3, before: int = 50, after: int = 200) -> DataFrame:
    """of the first n rows, the text around the needle."""
    t, at = F.col(text), F.call_function("instr", F.lower(text), F.lit(needle)) - 1
    a, b = F.greatest(F.lit(0), at - before), F.least(F.length(t), at + after)
    cut = F.concat(F.when(a > 0, "...").otherwise(""), F.call_function("substr", t, a + 1, b - a), F.when(b < F.length(t), "...").otherwise(""))
    return rows.orderBy(order).limit(n).withColumn("excerpt", cut)


def first_of_role(turns: DataFrame, role: str = "system") -> DataFrame:
    """conv_id, turn and trimmed text of each conversation's first turn of a role."""
    first = turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("x"))
    return first.select("conv_id", "x.turn", py_strip(F.col("x.text")).alias("text"))


def system_of_messages(messages: Column) -> Column:
    """F7 on an array of (role, content)."""
    return py_strip(F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"])


def coalesce_text(*columns: Column) -> Column:
    """F8: the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def first_rows(rows: DataFrame, order: str, budget: int, ties: list[str]) -> DataFrame:
    """The first `budget` rows in `order`, nulls first, then in that of `ties`. Only values of `order` meet in one task: the
    last one that still counts is found first, and whole rows stay where they are but for those of that value."""
    if budget <= 0:
        return rows.limit(0)
    last = rows.select(order).orderBy(order).limit(budget).agg(F.count("*").alias("n"), F.max(F.struct(F.col(order).isNotNull(), F.col(order).alias("v"))).alias("x")).first()
    if last["n"] < budget:
        return rows
    end = F.lit(last["x"]["v"]).cast(rows.schema[order].dataType)
    before = rows.filter((F.col(order).isNull() & end.isNotNull()) | F.coalesce(F.col(order) < end, F.lit(False)))
    at = rows.filter(F.col(order).eqNullSafe(end))
    room, n = budget - before.count(), at.limit(budget + 1).count()
    return before.unionByName(at if n <= room else at.orderBy(*ties).limit(room))


def first_unique(rows: DataFrame, text: str, order: str, n: int = 300, budget: int | None = None) -> DataFrame:
    """L4: the n first distinct texts, by first appearance, of the first `budget` rows in `order`; a distributed top-n."""
    seen = first_rows(rows, order, budget, [text]) if budget is not None else rows
    return seen.groupBy(text).agg(F.min(order).alias(order)).orderBy(order).limit(n)


def cyclic(rows: DataFrame, spark: SparkSession, n: int, number: str = "number") -> DataFrame:
    """Rows numbered from 0, repeated in order until there are n."""
    total = rows.count()
    if not total:
        return rows.withColumn("place", F.lit(None).cast("long"))
    return spark.range(n).withColumnRenamed("id", "place").join(rows, F.pmod("place", F.lit(total)) == F.col(number))


def sample_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in the order of a seeded hash of the key; repeatable, however the rows are dealt."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def fill(template: Column, phrase: Column, slot: str = "[PHRASE]") -> Column:
    """J13"""
    return F.replace(template, F.lit(slot), phrase)


def base_prompt(name: Column, identity: Column, personality: Column, behaviors: Column, constraints: Column) -> Column:
    """R18"""
    return F.concat_ws(" ", F.format_string("You are %s, %s.", name, identity), F.format_string("You are %s.", personality), behaviors, constraints)


def styled_variants(prompts: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Each prompt's assistant name in each template (kind, ord, template with {name})."""
    return prompts.join(F.broadcast(templates)).withColumn("variant", F.replace(F.col("template"), F.lit("{name}"), assistant_name(F.col(text))))


def assemble(spark: SparkSession, canonical: DataFrame, base: DataFrame, templates: DataFrame, extended: DataFrame, n: int = 100, varied: int = 3) -> DataFrame:
    """Place, text: canonical, base, variants of the first `varied` base prompts, then the extended ones again
    and again, to n. Inputs: (ord, text), ord from 0; templates: (kind, ord, template)."""
    variants = styled_variants(base.filter(F.col("ord") < varied), templates.withColumnRenamed("ord", "t"))
    head = (
        canonical.select(F.lit(0).alias("part"), "ord", F.lit(0).alias("sub"), "text").unionByName(base.select(F.lit(1).alias("part"), "ord", F.lit(0).alias("sub"), "text"))
        .unionByName(variants.select(F.lit(2).alias("part"), "ord", F.col("t").alias("sub"), F.col("variant").alias("text")))
    )
    numbered = head.select(F.row_number().over(Window.orderBy("part", "ord", "sub")).alias("place"), "text")
    missing = n - head.count()
    if missing <= 0:
        return numbered.filter(F.col("place") <= n)
    tail = cyclic(extended.withColumnRenamed("ord", "number"), spark, missing)
    return numbered.unionByName(tail.select((F.col("place") + (n - missing) + 1).cast("int").alias("place"), "text"))


def validate_user_prompts(prompts: DataFrame) -> DataFrame:
    """One row: total, categories, prompts_per_category, average_words, all_unique."""
    per = prompts.groupBy("category").agg(F.count("*").alias("n")).agg(F.count("*").alias("categories"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("prompts_per_category"))
    total = prompts.agg(F.count("*").alias("total"), F.avg(word_count(F.col("text"))).alias("average_words"), (F.count_distinct("text") == F.count("*")).alias("all_unique"))
    return total.join(F.broadcast(per))


def run_summary(phrases: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: phrases, those with variants, variants, average of those, and the similarities' figures.

    Similarities from -1 to 1 are averaged as decimals, so their mean doesn't hang on the order of the rows."""
    exact = F.avg(F.col("similarity").try_cast("decimal(38,18)")).cast("double")
    v = variants.agg(
        F.count_distinct("phrase").alias("with_variants"), F.count("*").alias("variants"),
        F.when(F.max(F.abs("similarity")) <= 1, exact).otherwise(F.avg("similarity")).alias("mean_similarity"),
        F.stddev_pop("similarity").alias("std_similarity"), F.min("similarity").alias("least_similarity"), F.max("similarity").alias("greatest_similarity"),
    )
    return phrases.agg(F.count("*").alias("total")).join(F.broadcast(v)).withColumn("average", F.try_divide("variants", "with_variants"))


def cost(calls: Column, provider: Column, prices: dict[str, float] = CALL_PRICE) -> Column:
    """G17"""
    table = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return calls * F.try_element_at(table, provider)
