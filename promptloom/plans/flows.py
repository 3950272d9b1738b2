"""The flows end to end and their command line.

python -m promptloom.plans.flows extract|importance|report|similarity|paraphrase|generate|sample|corpus|users --help
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import phrase_key, word_count
from promptloom.operators import corpus, edits, extract, importance, similarity
from promptloom.providers import CountingProvider, Generation, Verifier, filter_generated, hashed_embedding
from promptloom.session import session
from promptloom.sources import files, sinks


def phrase_importance(prompts: DataFrame, phrases: DataFrame, variants: DataFrame, users: DataFrame, provider) -> DataFrame:
    """Flow A: prompt_id, rank, phrase, kl_score and more. Repeated phrases count once, at their first place."""
    once = phrases.groupBy("phrase").agg(F.min("ord").alias("ord"))
    found = importance.phrases_in_prompts(prompts, once)
    requests = importance.scoring_requests(found, variants, users)
    samples = provider.sample(requests)
    kl = importance.kl_scores(samples, provider.score(requests, samples).select("prompt_id", "phrase", "variant_no", "user_no", "cache_key", "sample_no", "logq"))
    scores = importance.phrase_scores(kl).join(once, "phrase")
    return importance.ranked(scores, order="ord")


def neighbour_paraphrases(phrases: DataFrame, encoder=hashed_embedding, n: int = 10) -> DataFrame:
    """A4: phrase, variant_no, variant, similarity: of each phrase other phrases of the table, by R7. phrases(ord, phrase),
    of which repeats count once."""
    once = phrases.groupBy("phrase").agg(F.min("ord").alias("id"))
    emb = encoder(once, "id", "phrase")
    words = once.select("id", word_count(F.col("phrase")).alias("n"))
    found = similarity.combined_neighbours(emb, words, n)
    other = once.select(F.col("id").alias("other"), F.col("phrase").alias("variant"))
    return found.join(once, "id").join(other, "other").select("phrase", F.col("pos").alias("variant_no"), "variant", "similarity")


def edited_paraphrases(phrases: DataFrame, verifier: Verifier, k: int = 5) -> DataFrame:
    """A4: phrase, variant_no, variant, similarity: minimal edits of each phrase that pass the verifier's gates, by R14."""
    made = edits.minimal_edits(phrases.select("phrase").distinct(), "phrase")
    judged = verifier.failed_gates(made, "phrase", "variant").withColumnRenamed("failed_gate", "failed")
    good = edits.verified(judged, "phrase", "phrase", "variant", F.col("failed"), k=k)
    return good.select("phrase", F.col("place").alias("variant_no"), "variant", F.col("cosine").alias("similarity"))


def generated_paraphrases(phrases: DataFrame, generation: Generation, encoder=hashed_embedding, n: int = 5) -> DataFrame:
    """A5: phrase, variant_no, variant, similarity: a hosted model's paraphrases within the settings' band, by R15."""
    c = generation.config
    asked = generation.batch(phrases.groupBy("phrase").agg(F.min("ord").alias("id")), "id", "phrase", n)
    rows = asked.select("id", "phrase", F.posexplode("variants").alias("ord", "variant"))
    scored = Verifier(encoder=encoder, inference=None).failed_gates(rows, "phrase", "variant").withColumnRenamed("cosine", "similarity").drop("failed_gate")
    kept = filter_generated(scored, "id", "phrase", c.least_similarity, c.greatest_similarity, n)
    return kept.select("phrase", F.col("place").alias("variant_no"), "variant", "similarity")


def sampled_prompts(rows: DataFrame, target: int = 300, low: int = 100, high: int = 1000, budget: int = 50_000) -> DataFrame:
    """Prompt blocks of the first distinct texts of low to high characters among the first `budget` rows(text, at);
    what a data set's download left is read as a stored table."""
    read = corpus.first_rows(rows, "at", budget, ["text"])
    kept, _ = corpus.length_band(read, "text", low, high)
    found = corpus.renumber(corpus.first_unique(kept, "text", "at", target), "at", "prompt_id")
    return sinks.prompt_blocks(found).orderBy("prompt_id").select("value")


def write_paraphrases(phrases: DataFrame, variants: DataFrame, output: str) -> None:
    """K7, K8: blocks, totals and JSON. The variants are written first, so that no model is asked twice."""
    variants.write.mode("overwrite").parquet(f"{output}/variants")
    variants = variants.sparkSession.read.parquet(f"{output}/variants")
    sinks.paraphrase_blocks(variants).write.mode("overwrite").text(f"{output}/blocks")
    sinks.paraphrase_totals(phrases.select("phrase").distinct(), variants).orderBy("ord").select("value").write.mode("overwrite").text(f"{output}/totals")
    sinks.paraphrase_json(variants).write.mode("overwrite").text(f"{output}/json")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="promptloom")
    sub = parser.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="prompt blocks -> phrase lines")
    e.add_argument("--input", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--jaccard", type=float, default=extract.JACCARD)
    e.add_argument("--keep-overlaps", action="store_true")
    i = sub.add_parser("importance", help="rank the phrases of each prompt")
    for name in ("phrases", "paraphrases", "prompts", "user-prompts", "continuations", "output"):
        i.add_argument(f"--{name}", required=True)
    i.add_argument("--num-samples", type=int, default=50)
    r = sub.add_parser("report", help="texts and summaries of stored results")
    r.add_argument("--results", required=True)
    r.add_argument("--prompts", required=True)
    r.add_argument("--output", required=True)
    s = sub.add_parser("similarity", help="closest pairs, diversity, a diverse subset")
    s.add_argument("--phrases", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--subset", type=int, default=50)
    p = sub.add_parser("paraphrase", help="paraphrases from the phrases themselves")
    p.add_argument("--phrases", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--method", choices=("neighbours", "edits"), default="neighbours")
    p.add_argument("--count", type=int, default=10)
    g = sub.add_parser("generate", help="paraphrases by a hosted model")
    g.add_argument("--phrases", required=True)
    g.add_argument("--output", required=True)
    g.add_argument("--ask", required=True, help="module:function, prompt -> reply, importable on the executors")
    g.add_argument("--count", type=int, default=5)
    m = sub.add_parser("sample", help="the first distinct texts of a stored data set, as prompt blocks")
    m.add_argument("--rows", required=True)
    m.add_argument("--kind", default="parquet")
    m.add_argument("--text", default="text")
    m.add_argument("--order", required=True)
    m.add_argument("--output", required=True)
    for name, value in (("target", 300), ("min", 100), ("max", 1000), ("budget", 50_000)):
        m.add_argument(f"--{name}", type=int, default=value)
    k = sub.add_parser("corpus", help="a corpus of prompts from JSON tables, as prompt blocks")
    for name in ("canonical", "base", "templates", "extended", "output"):
        k.add_argument(f"--{name}", required=True)
    k.add_argument("--count", type=int, default=100)
    u = sub.add_parser("users", help="check user prompts and write them as JSON")
    u.add_argument("--input", required=True)
    u.add_argument("--output", required=True)
    a = parser.parse_args(args)
    spark = session()
    if a.command == "extract":
        prompts = files.prompts_labelled(files.whole(spark, a.input))
        rows = extract.extract(prompts).withColumn("word_count", F.size(F.split("phrase", r"(?U)\s+"))) if a.keep_overlaps else extract.extract_distinct(prompts, threshold=a.jaccard)
        sinks.phrase_lines(rows).orderBy("prompt_id", "ord").select("value").write.mode("overwrite").text(a.out)
    elif a.command == "importance":
        prompts = files.prompts_scored(files.whole(spark, a.prompts))
        phrases = files.phrases_strict(files.whole(spark, a.phrases))
        key = phrase_key(F.col("phrase"))
        variants = files.paraphrases(files.whole(spark, a.paraphrases), key=key).select(key.alias("phrase_key"), "variant_no", "variant")
        users = files.user_prompts(files.whole(spark, a.user_prompts)).select(F.col("ord").alias("user_no"), F.col("text").alias("user"))
        said = spark.read.json(a.continuations, schema="user string, sample_no int, text string").filter(F.col("sample_no") < a.num_samples)
        ranked = phrase_importance(prompts, phrases, variants, users, CountingProvider(said, prompts.select("text").unionByName(said.select("text"))))
        sinks.checkpoint_results(ranked, f"{a.output}/results")
        sinks.summary(spark.read.parquet(f"{a.output}/results")).write.mode("overwrite").json(f"{a.output}/summary")
    elif a.command == "report":
        ranked = files.results(spark, a.results)
        sinks.prompt_report(ranked, files.prompts_scored(files.whole(spark, a.prompts))).select("value").write.mode("overwrite").text(f"{a.output}/prompts")
        sinks.overall_summary(ranked).write.mode("overwrite").json(f"{a.output}/overall")
        sinks.chart(ranked).write.mode("overwrite").json(f"{a.output}/chart")
    elif a.command in ("paraphrase", "generate"):
        phrases = files.phrases_strict(files.whole(spark, a.phrases))
        if a.command == "generate":
            module, _, function = a.ask.partition(":")
            made = generated_paraphrases(phrases, Generation(getattr(importlib.import_module(module), function)), n=a.count)
        else:
            made = neighbour_paraphrases(phrases, n=a.count) if a.method == "neighbours" else edited_paraphrases(phrases, Verifier(), a.count)
        write_paraphrases(phrases, made, a.output)
    elif a.command == "sample":
        rows = files.rows(spark, a.rows, a.kind).select(F.col(a.text).alias("text"), F.col(a.order).alias("at"))
        sampled_prompts(rows, a.target, a.min, a.max, a.budget).write.mode("overwrite").text(a.output)
    elif a.command == "corpus":
        tables = {n: spark.read.json(getattr(a, n), schema="ord int, kind string, text string, template string, name string, identity string, personality string, behaviors string, constraints string") for n in ("canonical", "base", "templates", "extended")}
        base = tables["base"].select("ord", corpus.base_prompt(*map(F.col, ("name", "identity", "personality", "behaviors", "constraints"))).alias("text"))
        made = corpus.assemble(spark, tables["canonical"].select("ord", "text"), base, tables["templates"].select("kind", "ord", "template"), tables["extended"].select("ord", "text"), a.count)
        sinks.prompt_blocks(made.withColumnRenamed("place", "prompt_id")).orderBy("prompt_id").select("value").write.mode("overwrite").text(a.output)
    elif a.command == "users":
        users = files.categories(files.whole(spark, a.input))
        corpus.validate_user_prompts(users).write.mode("overwrite").json(f"{a.output}/check")
        sinks.user_prompt_json(users).write.mode("overwrite").text(f"{a.output}/prompts")
    else:
        phrases = files.phrases_prefixed(files.whole(spark, a.phrases))
        emb = hashed_embedding(phrases, "ord", "phrase")
        groups = similarity.clusters(emb, means=True).join(phrases.withColumnRenamed("ord", "id"), "id")
        subset = similarity.diverse_subset(emb, a.subset).join(phrases.select(F.col("ord").alias("id"), "phrase"), "id")
        report = sinks.similarity_report(similarity.diversity_of(emb), similarity.closest(emb), similarity.cluster_stats(groups), subset)
        report.orderBy("section", "ord").select("value").write.mode("overwrite").text(a.output)


if __name__ == "__main__":
    main()
