"""Edit rules and verifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.text import keeps_keywords, negation_flip, word_count

# Minimal edits, used from left to right and then from right to left.
MINIMAL_EDITS = (
    ("do not", "don't"), ("does not", "doesn't"), ("you are", "you're"), ("it is", "it's"), ("cannot", "can't"), ("should not", "shouldn't"),
    ("will not", "won't"), ("in order to", "to"), ("you should", "please"), ("you must", "you need to"), ("when", "if"), ("about", "regarding"),
    ("say so", "state that"), ("unsure", "uncertain"), ("advice", "guidance"), ("explicitly", "clearly"),
)
# Contractions, used in both directions; substitutions; insertions.
CONTRACTIONS = (
    ("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("you are", "you're"), ("I am", "I'm"), ("we are", "we're"),
    ("it is", "it's"), ("cannot", "can't"), ("should not", "shouldn't"),
)
SUBSTITUTIONS = (
    ("say so", "state that"), ("say so", "make that clear"), ("say so", "say that"), ("unsure", "uncertain"), ("unsure", "not sure"),
    ("avoid", "do not provide"), ("avoid", "refrain from giving"), ("advice", "guidance"), ("explicitly", "clearly"), ("about", "regarding"),
    ("when", "if"), ("you should", "please"), ("you should", "you ought to"),
)
INSERTIONS = (
    ("you should", "you should explicitly"), ("state that", "clearly state that"), ("say so", "clearly say so"),
    ("do not provide", "do not explicitly provide"),
)
# Strictness levels (least and greatest cosine, greatest contradiction, least entailment), and gates.
LEVELS = ((0.95, 0.99, 0.05, 0.85), (0.93, 0.98, 0.08, 0.80), (0.90, 0.97, 0.10, 0.75))
FALLBACK_COSINE = 0.93
GATES = {"cosine": 0.86, "chrf": 0.80, "edit": 0.85, "lemmas": 0.70, "pos": 0.90, "entailment": 0.90}

_EDGE = r"(?iu)(?<![\p{L}\p{N}_])%s(?![\p{L}\p{N}_])"


def apply_rule(text: Column, old: str, new: str) -> Column:
    """The first whole-word occurrence, in any case, replaced by `new` as written; null if there is none."""
    found = F.regexp_extract(text, _EDGE % re.escape(old), 0)
    at = F.call_function("instr", text, found)
    # instr finds the match's text, maybe earlier inside a word; the split keeps to whole words
    head = F.element_at(F.call_function("split", text, F.lit(_EDGE % re.escape(old)), F.lit(2)), 1)
    cut = F.concat(head, F.lit(new), F.call_function("substr", text, F.length(head) + F.length(found) + 1))
    return F.when((found != "") & (at > 0), cut)


def _variants(texts: DataFrame, rules: list[tuple[int, str, str]], text: str) -> DataFrame:
    """One row a rule that changes the text: columns of texts, ord, variant."""
    made = F.array(*[F.struct(F.lit(n).alias("ord"), apply_rule(F.col(text), a, b).alias("variant")) for n, a, b in rules])
    return texts.select("*", F.explode(F.filter(made, lambda x: x["variant"].isNotNull() & (x["variant"] != F.col(text)))).alias("__v")).select(*texts.columns, "__v.ord", "__v.variant")


def minimal_edits(texts: DataFrame, text: str = "text") -> DataFrame:
    """Candidates by each rule in both directions."""
    rules = [*MINIMAL_EDITS, *((b, a) for a, b in MINIMAL_EDITS)]
    return _variants(texts, [(i, a, b) for i, (a, b) in enumerate(rules)], text)


def staged_edits(texts: DataFrame, key: str, text: str = "text", k: int = 6) -> DataFrame:
    """Contractions and expansions, substitutions, insertions, light rewrites; the first k that differ in lower case."""
    rules = [*CONTRACTIONS, *((b, a) for a, b in CONTRACTIONS), *SUBSTITUTIONS, *INSERTIONS, ("when", "if"), ("about", "regarding"), ("say so", "say that so"), ("say it", "say that it"), ("state it", "state that it")]
    made = _variants(texts, [(i, a, b) for i, (a, b) in enumerate(rules)], text).filter(F.lower("variant") != F.lower(text))
    once = made.withColumn("__n", F.row_number().over(Window.partitionBy(key, F.lower("variant")).orderBy("ord"))).filter("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("__n") <= k).drop("__n")


def candidates(rule_made: DataFrame, model_made: DataFrame, key: str, text: str = "text", n: int = 24) -> DataFrame:
    """Both kinds without repeats, the source and its lower case; rules' order first, so that the cut is repeatable."""
    both = rule_made.select(key, text, F.lit(0).alias("kind"), "ord", "variant").unionByName(model_made.select(key, text, F.lit(1).alias("kind"), "ord", "variant"))
    other = both.filter((F.col("variant") != F.col(text)) & (F.col("variant") != F.lower(text)))
    once = other.withColumn("__n", F.row_number().over(Window.partitionBy(key, "variant").orderBy("kind", "ord"))).filter("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("kind", "ord"))).filter(F.col("__n") <= n).drop("__n", "kind")


def length_kept(a: Column, b: Column, tolerance: float = 0.10) -> Column:
    """the word count changes by at most the tolerance; null for an empty source."""
    return F.try_divide(F.abs(word_count(b) - word_count(a)), word_count(a)) <= tolerance


def nli_gate(contradiction: Column, entailment: Column, cosine: Column, most: float | Column, least: float | Column, fallback: float = FALLBACK_COSINE) -> Column:
    """Contradiction rules out, entailment lets pass, else the cosine decides; without a model, only the cosine."""
    return F.when(contradiction > most, False).when(entailment >= least, True).otherwise(cosine >= fallback)


def either_entails(forward: Column, backward: Column, least: float = 0.5) -> Column:
    """G19"""
    return F.greatest(forward, backward) > least


def rerank(rows: DataFrame, key: str, source: str, candidate: str, low: float, high: float, ties: str | None = None) -> DataFrame:
    """F9, F10 and F12, then place by falling similarity, then the candidate's text; `ties` tells equal texts apart."""
    ok = F.col("cosine").between(low, high) & length_kept(F.col(source), F.col(candidate)) & keeps_keywords(F.col(source), F.col(candidate))
    return rows.filter(ok).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), candidate, *([ties] if ties else []))))


def first_passing_level(rows: DataFrame, key: str, candidate: str, levels=LEVELS, target: int = 3, dedupe: bool = True) -> DataFrame:
    """rows(key, candidate, cosine, contradiction, entailment) -> the target best by level, then cosine.

    dedupe=False lets a candidate return at each level it passes, as lists made level by level do."""
    def passes(level) -> Column:
        low, high, most, least = level
        return F.col("cosine").between(low, high) & nli_gate(F.col("contradiction"), F.col("entailment"), F.col("cosine"), most, least)

    if dedupe:
        level = reduce(lambda rest, i: F.when(passes(levels[i]), i + 1).otherwise(rest), reversed(range(len(levels))), F.lit(None).cast("int"))
        passed = rows.withColumn("level", level).filter("level is not null")
    else:
        passed = rows.withColumn("level", F.explode(F.filter(F.array(*[F.when(passes(x), i + 1) for i, x in enumerate(levels)]), lambda x: x.isNotNull())))
    return passed.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("level", F.desc("cosine"), candidate))).filter(F.col("place") <= target)


def gate_chain(source: Column, candidate: Column, cosine: Column, chrf: Column, edit: Column, lemmas: Column, forward: Column, backward: Column, pos: Column | None = None, gates=GATES) -> Column:
    """The first gate that fails, or null if all pass. A measure that is missing (null) passes its gate."""
    def fails(c: Column, gate: str) -> Column:
        return F.coalesce(c < gates[gate], F.lit(False))

    chain = F.when(fails(cosine, "cosine"), "cosine").when(negation_flip(source, candidate), "negation").when(~keeps_keywords(source, candidate), "keywords")
    chain = chain.when(fails(chrf, "chrf"), "chrf").when(fails(edit, "edit"), "edit").when(fails(lemmas, "lemmas"), "lemmas")
    if pos is not None:
        chain = chain.when(fails(pos, "pos"), "pos")
    return chain.when(fails(F.least(forward, backward), "entailment"), "entailment")


def verified(rows: DataFrame, key: str, source: str, candidate: str, failed: Column, order: str = "ord", k: int = 5) -> DataFrame:
    """The first k candidates that pass, without the source and repeats in any case."""
    other = rows.filter(F.lower(candidate) != F.lower(source)).withColumn("__n", F.row_number().over(Window.partitionBy(key, F.lower(candidate)).orderBy(order))).filter("__n = 1")
    good = other.withColumn("failed_gate", failed).filter("failed_gate is null")
    return good.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("place") <= k).drop("__n", "failed_gate")
