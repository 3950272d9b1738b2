"""Model providers (M1-M12): what needs a language model, an encoder, an inference model or a hosted model.

Each interface has a kind that reads precomputed tables and one that runs on Spark alone. The latter don't equal neural
models in numbers; the operators around them are the same. Models are loaded once a worker, on first use.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.text import PROTECTED, chrf_plus_plus, cosine, edit_ratio, jaccard, norm_tokens, reply_lines, tokens
from promptloom.operators.edits import GATES, gate_chain


class LogProbProvider(Protocol):
    def sample(self, requests: DataFrame) -> DataFrame:
        """M1: requests(cache_key, text, user) -> cache_key, sample_no, tokens, logp."""

    def score(self, requests: DataFrame, samples: DataFrame) -> DataFrame:
        """M2: requests(..., changed, cache_key) and samples -> the requests' columns, sample_no, logq."""


@dataclass(frozen=True)
class TableProvider:
    """Reads samples and scores that were made elsewhere; scores are keyed by cache_key, phrase, variant_no, sample_no."""

    samples: DataFrame
    scores: DataFrame

    def sample(self, requests: DataFrame) -> DataFrame:
        return self.samples.join(requests.select("cache_key").distinct(), "cache_key", "left_semi")

    def score(self, requests: DataFrame, samples: DataFrame) -> DataFrame:
        return requests.join(self.scores, ["cache_key", "phrase", "variant_no"])


@dataclass(frozen=True)
class CountingProvider:
    """A cache model: words of the prompt mixed with the corpus's. Continuations come from a table
    (user, sample_no, text); P and Q are scored alike, on one scale."""

    continuations: DataFrame
    corpus: DataFrame
    mix: float = 0.5

    def _share(self) -> DataFrame:
        words = self.corpus.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
        return words.join(F.broadcast(words.agg(F.sum("c").alias("all")))).select("w", (F.col("c") / F.col("all")).alias("u"))

    def _logp(self, rows: DataFrame, text: str, keys: list[str], name: str) -> DataFrame:
        c = tokens(F.col(text))
        each = rows.withColumn("__c", c).select(*keys, "__c", F.explode("tokens").alias("w")).join(self._share(), "w", "left")
        p = self.mix * F.when(F.size("__c") > 0, F.size(F.filter("__c", lambda x: x == F.col("w"))) / F.size("__c")).otherwise(0.0) + (1 - self.mix) * F.coalesce("u", F.lit(1e-12))
        return each.groupBy(*keys).agg(F.sum(F.ln(p)).alias(name))

    def sample(self, requests: DataFrame) -> DataFrame:
        own = requests.select("cache_key", "text", "user").distinct().join(self.continuations.withColumnRenamed("text", "said"), "user").withColumn("tokens", tokens(F.col("said")))
        return own.join(self._logp(own, "text", ["cache_key", "sample_no"], "logp"), ["cache_key", "sample_no"]).select("cache_key", "sample_no", "tokens", "logp")

    def score(self, requests: DataFrame, samples: DataFrame) -> DataFrame:
        keys = ["prompt_id", "phrase", "variant_no", "user_no", "cache_key", "sample_no"]
        return self._logp(requests.join(samples.select("cache_key", "sample_no", "tokens"), "cache_key"), "changed", keys, "logq")


def hashed_embedding(rows: DataFrame, key: str, text: str, dim: int = 64, n: int = 3) -> DataFrame:
    """M3: id, vec: signed hashing of character n-grams, of length 1."""
    grams = F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.lower(text), i, F.lit(n)))).otherwise(F.array(F.lower(text)))
    each = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.explode(grams).alias("g")).select("id", F.xxhash64("g").alias("h"))
    summed = each.groupBy("id", F.pmod("h", F.lit(dim)).alias("d")).agg(F.sum(F.when(F.shiftright("h", 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).alias("v"))
    made = summed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("int"), "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return made.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0))).alias("vec"))


def overlap_nli(premise: Column, hypothesis: Column) -> Column:
    """M4, a stand-in: entailment, neutral, contradiction from the share of the hypothesis's words in the premise."""
    a, b = F.array_distinct(tokens(premise)), F.array_distinct(tokens(hypothesis))
    share = F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    return F.struct(share.alias("entailment"), (share * (1 - share)).alias("neutral"), ((1 - share) * (1 - share)).alias("contradiction"))


@dataclass(frozen=True)
class GenerationConfig:
    """A provider's settings. The key is read by the driver's caller and isn't part of it."""

    provider: str = "table"
    model: str | None = None
    endpoint: str | None = None
    temperature: float = 0.7
    max_tokens: int = 500
    variants_per_call: int = 5
    least_similarity: float = 0.5
    greatest_similarity: float = 0.9


# The models and the address that are used if none is named.
DEFAULT_MODELS = {"together": "meta-llama/Meta-Llama-3.1-70B-Instruct", "openai": "gpt-4-turbo-preview", "anthropic": "claude-3-opus-20240229"}
ENDPOINTS = {"together": "https://api.together.xyz/v1/completions"}
# Environment variables that keys are read from.
KEY_VARIABLES = {"together": "TOGETHER_API_KEY", "openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}


def resolved(config: GenerationConfig, environment: Mapping[str, str] = os.environ) -> tuple[GenerationConfig, str | None]:
    """The settings with the provider's default model and endpoint where none is given, and its key. To be called on
    the driver; of an unknown provider both must be given."""
    if config.provider not in DEFAULT_MODELS and not (config.model and config.endpoint):
        raise ValueError(f"no defaults for the provider {config.provider}")
    model, endpoint = config.model or DEFAULT_MODELS[config.provider], config.endpoint or ENDPOINTS.get(config.provider)
    return replace(config, model=model, endpoint=endpoint), environment.get(KEY_VARIABLES.get(config.provider, ""))


Model = TypeVar("Model")


def first_loaded(loaders: Sequence[Callable[[], Model]], missing: str = "error") -> Model | None:
    """The first model that loads. If none does: an error, or None with missing="pass", and then what the model
    would have measured is null, which the gates let pass. Only a model that isn't there counts as missing."""
    if missing not in ("error", "pass"):
        raise ValueError(missing)
    failed: Exception | None = None
    for load in loaders:
        try:
            return load()
        except (ImportError, OSError) as e:
            failed = e
    if missing == "error":
        raise RuntimeError("no model could be loaded") from failed
    return None


@dataclass(frozen=True)
class Verifier:
    """What R12 measures candidates with, and its gates. encoder(rows, key, text) -> id, vec;
    inference(premise, hypothesis) -> struct with `entailment`, or None for no filtering by it."""

    encoder: Callable[[DataFrame, str, str], DataFrame] = hashed_embedding
    inference: Callable[[Column, Column], Column] | None = overlap_nli
    gates: Mapping[str, float] = field(default_factory=lambda: dict(GATES))

    def failed_gates(self, rows: DataFrame, source: str, candidate: str) -> DataFrame:
        """rows with `cosine` and `failed_gate`, null for candidates that pass all. Each distinct text is encoded once."""
        texts = rows.select(F.col(source).alias("t")).union(rows.select(candidate)).filter("t is not null").distinct()
        vectors = self.encoder(texts, "t", "t")
        both = rows.join(vectors.select(F.col("id").alias(source), F.col("vec").alias("__a")), source, "left").join(vectors.select(F.col("id").alias(candidate), F.col("vec").alias("__b")), candidate, "left")
        a, b = F.col(source), F.col(candidate)
        none = F.lit(None).cast("double")
        forward, backward = (none, none) if self.inference is None else (self.inference(a, b)["entailment"], self.inference(b, a)["entailment"])
        measured = both.withColumn("cosine", cosine(F.col("__a"), F.col("__b")))
        lemmas = jaccard(norm_tokens(a), norm_tokens(b), empty=1.0)
        failed = gate_chain(a, b, F.col("cosine"), chrf_plus_plus(b, a), edit_ratio(a, b), lemmas, forward, backward, gates=dict(self.gates))
        return measured.withColumn("failed_gate", failed).select(*rows.columns, "cosine", "failed_gate")


@dataclass(frozen=True)
class Generation:
    """`ask` (prompt -> reply) is called in Arrow batches on the executors, with retries after 1, 2, ...
    seconds; a request that keeps failing has a null reply, which yields no paraphrase."""

    ask: Callable[[str], str]
    retries: int = 3
    pause: float = 0.0
    config: GenerationConfig = field(default_factory=GenerationConfig)

    def replies(self, requests: DataFrame, prompt: str = "prompt") -> DataFrame:
        ask, retries, pause = self.ask, self.retries, self.pause

        @F.pandas_udf("string")
        def call(prompts: pd.Series) -> pd.Series:
            def one(p):
                for k in range(retries):
                    try:
                        return ask(p)
                    except Exception:
                        if k + 1 < retries:
                            time.sleep(2**k)
                    finally:
                        if pause:
                            time.sleep(pause)
                return None

            return prompts.map(one)

        return requests.withColumn("reply", call(F.col(prompt)))

    def batch(self, phrases: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
        """Key, text, variants (an array, empty where the model failed or gave none)."""
        asked = phrases.select(key, text, generation_prompt(F.col(text), n).alias("prompt"))
        made = self.paraphrases(asked, key, text, n=n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "variant"))), lambda x: x["variant"]).alias("variants"))
        return phrases.select(key, text).join(made, key, "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))

    def paraphrases(self, requests: DataFrame, key: str, text: str, prompt: str = "prompt", n: int | None = None) -> DataFrame:
        """key, text, ord, variant; without the source itself."""
        rows = self.replies(requests, prompt).select(key, text, F.posexplode(reply_lines(F.col("reply"))).alias("ord", "variant")).filter(F.col("variant") != F.col(text))
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("__n") <= (n or 1 << 30)).drop("__n")


def generation_prompt(phrase: Column, n: int, existing: Column | None = None, keywords: tuple[str, ...] = PROTECTED) -> Column:
    """Asks for n paraphrases; with existing ones (at most 5 are listed) for different ones."""
    head = F.format_string(f'Write {n} paraphrases of the phrase below. Keep its meaning, length and tone, and these words if it has them: {", ".join(keywords)}.\nOne on each line, numbered.\n\nPhrase: "%s"', phrase)
    return head if existing is None else F.concat(head, F.lit("\nThey must differ from:\n"), F.array_join(F.transform(F.slice(existing, 1, 5), lambda x: F.concat(F.lit("- "), x)), "\n"))


def simple_prompt(phrase: Column, n: int = 10) -> Column:
    """The simple form: n rewordings, one a line."""
    return F.format_string(f'Give {n} rewordings of the phrase "%s" that say the same. One a line, nothing else.', phrase)


def adaptive_prompt(phrase: Column, n: int = 8, keywords: tuple[str, ...] = PROTECTED) -> Column:
    """The adaptive form: smallest possible edits, no negation added or dropped."""
    return F.format_string(
        f'Change as few words as possible in the phrase "%s", {n} times, so that its meaning stays exactly the same. '
        f'Add or drop no negation; keep {", ".join(keywords)}. One a line, nothing else.', phrase,
    )


def filter_generated(rows: DataFrame, key: str, text: str, low: float = 0.5, high: float = 0.9, n: int = 10) -> DataFrame:
    """rows(key, text, ord, variant, similarity) within the band, without repeats in any case, the n most
    similar."""
    own = rows.filter(F.col("similarity").between(low, high) & (F.lower("variant") != F.lower(text)))
    once = own.withColumn("__n", F.row_number().over(Window.partitionBy(key, F.lower("variant")).orderBy("ord"))).filter("__n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "ord"))).filter(F.col("place") <= n).drop("__n")


def top_up(keys: DataFrame, first: DataFrame, more: Callable[[DataFrame], DataFrame], key: str, n: int, rounds: int = 3, store: Callable[[DataFrame], DataFrame] = lambda df: df.cache()) -> DataFrame:
    """U4: asks again for keys with fewer than n distinct variants (in any case), those without any too, at most `rounds`
    times; new rows come after old ones. `store` keeps what a round brought, so that no request is made twice."""
    have = first.withColumn("round", F.lit(0))
    for i in range(1, rounds + 1):
        counted = have.groupBy(key).agg(F.count_distinct(F.lower("variant")).alias("have"))
        short = keys.join(counted, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < n)
        got = store(more(short).withColumn("round", F.lit(i)))
        have = have.unionByName(got)
    once = have.withColumn("__n", F.row_number().over(Window.partitionBy(key, F.lower("variant")).orderBy("round", "ord"))).filter("__n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("round", "ord"))).filter(F.col("place") <= n).drop("__n")


def seeded(seed: int = 42) -> np.random.Generator:
    """Random choices take this generator or hash a key with the seed; nothing global is set."""
    return np.random.default_rng(seed)
