"""Sinks (K1-K11): results and reports. Reports are built as tables of text and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions.stats import length_categories
from promptloom.functions.text import decimals, ellipsis
from promptloom.operators.corpus import run_summary
from promptloom.operators.ranking import best_of_group, frequency, top_winners


def checkpoint_results(ranked: DataFrame, path: str) -> None:
    """K1: one folder a prompt; a run that is taken up again overwrites only the prompts it has."""
    ranked.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("prompt_id").parquet(path)


def unfinished(prompts: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """K1: prompts without stored results."""
    from promptloom.sources.files import first_path

    if first_path(spark, [path]) is None:
        return prompts
    return prompts.join(spark.read.parquet(path).select("prompt_id").distinct(), "prompt_id", "left_anti")


def summary(ranked: DataFrame) -> DataFrame:
    """K2: prompt_id, num_phrases, ranked_phrases."""
    items = F.array_sort(F.collect_list(F.struct("rank", "phrase", "kl_score")))
    return ranked.groupBy("prompt_id").agg(F.count("*").cast("int").alias("num_phrases"), items.alias("ranked_phrases"))


def prompt_report(ranked: DataFrame, prompts: DataFrame) -> DataFrame:
    """K3: prompt_id and the report's text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase", "kl_score"))), lambda x: F.format_string('%3d. %s  "%s"', x["rank"], decimals(x["kl_score"].cast("double")), x["phrase"])), "\n")
    stats = ranked.groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.avg("kl_score").alias("mean"), F.median("kl_score").alias("median"), F.stddev_pop("kl_score").alias("std"),
        F.min("kl_score").alias("least"), F.max("kl_score").alias("greatest"), lines.alias("lines"),
    )
    body = F.concat_ws(
        "\n", F.concat(F.lit("PHRASE RANKING OF PROMPT "), F.col("prompt_id").cast("string")), F.lit("=" * 80), F.col("text"), F.lit("-" * 80),
        *[F.concat(F.lit(f"{n}: "), decimals(F.col(n))) for n in ("mean", "median", "std", "least", "greatest")], F.lit("-" * 80), F.col("lines"),
    )
    return stats.join(prompts, "prompt_id").select("prompt_id", body.alias("value"))


def overall_summary(ranked: DataFrame, top: int = 10, frequent: int = 20) -> DataFrame:
    """K4: one row: top_phrases_per_prompt, top_overall, most_common_phrases."""
    winners = best_of_group(ranked, "prompt_id", "kl_score", "rank").select("prompt_id", "phrase", "kl_score")
    best = winners.agg(F.array_sort(F.collect_list(F.struct("prompt_id", "phrase", "kl_score"))).alias("top_phrases_per_prompt"))
    first = top_winners(ranked, "prompt_id", "kl_score", "rank", top).agg(F.collect_list(F.struct("prompt_id", "phrase", "kl_score")).alias("top_overall"))
    common = frequency(ranked, "phrase", "prompt_id", "rank", frequent).agg(F.array_sort(F.collect_list(F.struct("place", "phrase", "frequency"))).alias("most_common_phrases"))
    return best.join(F.broadcast(first)).join(F.broadcast(common))


def chart(ranked: DataFrame, width: int = 50) -> DataFrame:
    """K5: the bars of the chart of each prompt's best phrase: place, label, kl_score."""
    best = best_of_group(ranked, "prompt_id", "kl_score", "rank")
    place = F.row_number().over(Window.orderBy(F.desc("kl_score"), "prompt_id"))
    return best.select(place.alias("place"), ellipsis(F.col("phrase"), width).alias("label"), "kl_score")


def phrase_lines(phrases: DataFrame) -> DataFrame:
    """K6: the lines that phrases_strict() reads."""
    return phrases.select("prompt_id", "ord", F.format_string('"%s" | %d words | prompt_%d', "phrase", "word_count", "prompt_id").alias("value"))


def stamp(at: Column | None = None) -> Column:
    """A report's time, the current one by default."""
    return F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def phrase_report(phrases: DataFrame) -> DataFrame:
    """K6: section, ord, value: the lines of phrase_lines(), then the number of phrases, those of each word count, and the
    length categories."""
    words = F.col("word_count")
    lines = phrase_lines(phrases).select(F.lit(1).alias("section"), F.struct("prompt_id", "ord").alias("o"), "value")
    body = lines.select("section", F.col("o.prompt_id").cast("long").alias("major"), F.col("o.ord").cast("long").alias("minor"), "value")

    def section(n: int, minor: Column, value: Column) -> list[Column]:
        return [F.lit(n).alias("section"), F.lit(0).cast("long").alias("major"), minor.cast("long").alias("minor"), value.alias("value")]

    total = phrases.agg(F.count("*").alias("n")).select(*section(2, F.lit(0), F.format_string("Total unique phrases: %d", "n")))
    counted = phrases.groupBy(words).agg(F.count("*").alias("n")).select(*section(3, words, F.format_string("  %d words: %d phrases", "word_count", "n")))
    names = ("Short (2-3 words)", "short"), ("Medium (4-7 words)", "medium"), ("Long (8+ words)", "long")
    kinds = length_categories(phrases, words).select(F.posexplode(F.array(*[F.concat(F.lit(f"  {a}: "), F.col(b).cast("string")) for a, b in names])).alias("k", "v")).select(*section(4, F.col("k"), F.col("v")))
    return body.unionByName(total).unionByName(counted).unionByName(kinds)


def paraphrase_totals(phrases: DataFrame, variants: DataFrame) -> DataFrame:
    """K7: ord, value: the report's closing lines: phrases, those with variants, variants, and their average if any."""
    s = run_summary(phrases, variants)
    lines = (
        F.format_string("  Total original phrases: %d", "total"), F.format_string("  Phrases with variants: %d", "with_variants"),
        F.format_string("  Total variants generated: %d", "variants"), F.when(F.col("with_variants") > 0, F.concat(F.lit("  Average variants per successful phrase: "), decimals(F.col("average"), 1))),
    )
    return s.select(F.posexplode(F.array(*lines)).alias("ord", "value")).filter("value is not null")


def paraphrase_blocks(variants: DataFrame) -> DataFrame:
    """K7: the blocks that paraphrases() reads, one row a phrase."""
    score = F.when(F.col("similarity").isNotNull(), F.concat(F.lit(" (similarity: "), decimals(F.col("similarity"), 3), F.lit(")"))).otherwise("")
    line = F.concat(F.format_string('    %d. "%s"', "variant_no", "variant"), score)
    grouped = variants.withColumn("line", line).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("variant_no", "line"))).alias("x"))
    no = F.row_number().over(Window.orderBy("phrase"))
    return grouped.select(F.concat(F.format_string('%3d. ORIGINAL: "%s"\n', no, "phrase"), F.array_join("x.line", "\n")).alias("value"))


def paraphrase_json(variants: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """K8: one row `value` a phrase: its paraphrases, similarities and their count, with the run's metadata."""
    each = F.array_sort(F.collect_list(F.struct("variant_no", "variant", "similarity")))
    items = variants.groupBy("phrase").agg(each.alias("x")).select("phrase", F.struct(F.col("x.variant").alias("paraphrases"), F.col("x.similarity").alias("similarities"), F.size("x").alias("count")).alias("v"))
    meta = F.create_map(*[F.lit(y) for kv in (metadata or {}).items() for y in kv]).cast("map<string,string>") if metadata else F.lit(None).cast("map<string,string>")
    return items.select(F.to_json(F.struct(meta.alias("metadata"), F.map_from_arrays(F.array("phrase"), F.array("v")).alias("paraphrases"))).alias("value"))


def prompt_blocks(prompts: DataFrame) -> DataFrame:
    """K9: the blocks that the prompt scans read."""
    return prompts.select("prompt_id", F.concat(F.format_string("Prompt %d:\n", "prompt_id"), "text", F.lit("\n\n" + "=" * 80 + "\n")).alias("value"))


def user_prompt_json(prompts: DataFrame, description: str = "") -> DataFrame:
    """One row `value` from (category, ord, text)."""
    by = prompts.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"), F.min("ord").alias("o"))
    doc = by.agg(F.array_sort(F.collect_list(F.struct("o", "category", F.col("x.text").alias("t")))).alias("g"))
    texts = F.flatten("g.t")
    return doc.select(F.to_json(F.struct(
        F.struct(F.size(texts).alias("total_prompts"), F.col("g.category").alias("categories"), F.lit(description).alias("description")).alias("metadata"),
        F.map_from_arrays("g.category", "g.t").alias("prompts_by_category"), texts.alias("all_prompts"),
    )).alias("value"))


def similarity_report(stats: DataFrame, pairs: DataFrame, clusters: DataFrame, subset: DataFrame, shown: int = 15) -> DataFrame:
    """Section, ord, value: diversity figures, the closest pairs, the largest clusters, the diverse subset."""
    figures = stats.select(F.posexplode(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in stats.columns])).alias("ord", "value")).select(F.lit(1).alias("section"), "ord", "value")
    close = pairs.select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy(F.desc("similarity"), "a", "b")).alias("ord"), F.format_string("%s  %s | %s", decimals(F.col("similarity"), 3), F.col("a").cast("string"), F.col("b").cast("string")).alias("value"))
    large = clusters.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("size"), "representative"))).filter(F.col("ord") <= shown).select(F.lit(3).alias("section"), "ord", F.format_string("%d  %s  %s", "size", decimals(F.col("avg_similarity"), 3), F.col("representative").cast("string")).alias("value"))
    chosen = subset.select(F.lit(4).alias("section"), "ord", F.concat(F.col("ord").cast("string"), F.lit(". "), F.col("phrase").cast("string")).alias("value"))
    return figures.unionByName(close).unionByName(large).unionByName(chosen)
