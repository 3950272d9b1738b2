"""Text functions on columns (C1-C22): built-in expressions only, except NFKC and chrF++, which are Arrow functions.

White space is Unicode white space throughout, as the (?U) flag makes it.
"""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that don't count in token comparisons, and words that negate.
STOPWORDS = (
    "the a an your you and or to of in on for with by as that this these those be is are was were will should must not do does did can could would "
    "might may when if unless"
).split()
NEGATIONS = ("not", "never", "no", "cannot", "can't", "won't", "shouldn't", "doesn't", "don't", "didn't")
#: Parts of words that a paraphrase must keep, in lower case.
PROTECTED = ("legal", "medical", "financial", "ai", "assistant", "claude", "anthropic")
#: Stripped from the end of a key.
TRAILING = " .,!?:;\"'"


def py_strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.regexp_replace(py_strip(c), r"(?U)\s+", " ")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def phrase_key(c: Column, compatibility: bool = False) -> Column:
    """The key that phrases are looked up by; with compatibility=True after NFKC, which needs Python."""
    base = nfkc(c) if compatibility else c
    return F.regexp_replace(collapse(F.lower(base)), r"""[ .,!?:;"']+\z""", "")


def replace_first(text: Column, phrase: Column, value: Column) -> Column:
    """The first literal occurrence of phrase is replaced; nothing in value is special."""
    at = F.call_function("instr", text, phrase)
    cut = F.concat(F.call_function("left", text, at - 1), value, F.call_function("substr", text, at + F.length(phrase)))
    return F.when((at > 0) & (F.length(phrase) > 0), cut).otherwise(text)


def replace_occurrences(text: Column, phrase: Column, value: Column, count: int = 1) -> Column:
    """The first `count` occurrences, left to right; 0 replaces all of them."""
    if count == 0:
        return F.replace(text, phrase, value)
    parts = F.call_function("split", text, F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(count + 1))
    return F.when(F.length(phrase) > 0, F.call_function("array_join", parts, value)).otherwise(text)


def prompt_prefix(system: Column, user: Column) -> Column:
    """C3"""
    return F.concat(system, F.lit("\n\nUser: "), user, F.lit("\nAssistant:"))


def cache_key(system: Column, user: Column, samples: int = 50, tokens: int = 150, temperature: float = 0.7, top_p: float = 0.9) -> Column:
    """C4: the key of a sample set."""
    digest = F.sha1(F.concat(F.encode(system, "utf-8"), F.lit(bytearray(b"\0")), F.encode(user, "utf-8")))
    return F.concat(digest, F.lit(f"|M={samples}|N={tokens}|T={temperature}|p={top_p}"))


def word_count(c: Column) -> Column:
    """C5"""
    s = py_strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))


def norm_tokens(c: Column) -> Column:
    """Lower-case tokens without stopwords, repeats kept."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(c), lambda t: ~F.array_contains(stop, t))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two token arrays as sets; `empty` if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / either)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


class EditDistances:
    """Levenshtein distances of one text to each of many, all at once: the columns of the table as bit vectors, one for
    each beginning that several of the texts may share."""

    def __init__(self, texts: list[str]):
        self.size, self.groups, letters = np.array([len(t) for t in texts], np.int64), [], {}
        for length in np.unique(self.size):
            own = np.flatnonzero(self.size == length)
            codes = np.array([[letters.setdefault(c, len(letters)) for c in texts[i]] for i in own], np.int64).reshape(len(own), length)
            place, levels = np.zeros(len(own), np.int64), []
            for j in range(length):
                found, first, place = np.unique(place * (len(letters) + 1) + codes[:, j], return_index=True, return_inverse=True)
                levels.append((found // (len(letters) + 1), codes[first, j]))
            self.groups.append((own, levels, place))
        self.letters = letters

    def __call__(self, text: str) -> np.ndarray:
        out, m = np.empty(len(self.size), np.int64), len(text)
        if not m:
            return self.size.copy()
        kind = np.uint32 if m <= 32 else np.uint64 if m <= 64 else object
        full, one = (1 << m) - 1, kind(1) if kind is not object else 1
        equal = [0] * (len(self.letters) + 1)
        for i, c in enumerate(text):
            equal[self.letters.get(c, -1)] |= 1 << i
        equal, full, last = np.array(equal, kind), np.array(full, kind), kind(m - 1) if kind is not object else m - 1
        for own, levels, place in self.groups:
            up, down, score = np.array([full], kind), np.array([0 * one], kind), np.array([m], np.int64)
            for parent, letter in levels:
                up, down, score, eq = up[parent], down[parent], score[parent], equal[letter]
                level = eq | down
                across = (((eq & up) + up) ^ up) | eq
                more, less = down | (full & ~(across | up)), up & across
                score = score + ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
                more, less = ((more << one) | one) & full, (less << one) & full
                up, down = less | (full & ~(level | more)), more & level
            out[own] = score[place]
        return out


def edit_ratios(left: DataFrame, right: DataFrame, digits: int) -> DataFrame:
    """C9 of all pairs of equal key: left(key, k, x), right(key, y) -> k, y, ratio, rounded. `right` goes to every task, so
    it is the table of fewer rows; left is dealt by k, not by the key, of which there may be few."""
    spark = left.sparkSession
    by_key: dict = {}
    for row in right.filter("key is not null").select("key", "y").toArrow().to_pylist():
        by_key.setdefault(row["key"], []).append(row["y"])
    sent = spark.sparkContext.broadcast(by_key)
    kind = left.schema["k"].dataType.simpleString()

    def run(batches):
        ready, rounded = {}, {}

        def ratio(distance: int, longer: int) -> float:
            if (distance, longer) not in rounded:
                exact = 1 - distance / longer if longer else 1.0
                rounded[distance, longer] = float(Decimal(repr(exact)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
            return rounded[distance, longer]

        def batch(kind, held):
            k = pa.array([h[0] for h in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held])))
            ratios = pa.array(np.concatenate([h[2] for h in held]), mask=np.concatenate([h[3] for h in held]))
            return pa.RecordBatch.from_arrays([k, pa.concat_arrays([h[1] for h in held]), ratios], names=["k", "y", "ratio"])

        for b in batches:
            held, count = [], 0
            for key, k, x in zip(*(b.column(c).to_pylist() for c in ("key", "k", "x"))):
                if key not in sent.value:
                    continue
                if key not in ready:
                    names = sent.value[key]
                    ready[key] = pa.array(names, pa.string()), np.array([y is None for y in names]), EditDistances([y or "" for y in names])
                names, none, distances = ready[key]
                if x:
                    found, longer = distances(x), np.maximum(distances.size, len(x))
                    width = int(longer.max()) + 1
                    pair = found * width + longer
                    table = np.zeros(int(pair.max()) + 1)
                    at = np.flatnonzero(np.bincount(pair))
                    table[at] = [ratio(*divmod(int(p), width)) for p in at]
                    found, missing = table[pair], none
                else:
                    # as Spark has it: a missing text counts as of no letters beside an empty one
                    found, missing = np.where(distances.size > 0, 0.0, 1.0), none if x is None else none & (distances.size > 0)
                    missing = missing | (distances.size > 0) if x is None else missing
                for first in range(0, len(names), 50_000):
                    part = slice(first, first + 50_000)
                    held.append((k, names[part], found[part], missing[part]))
                    count += len(found[part])
                    if count >= 50_000:
                        yield batch(b.schema.field("k").type, held)
                        held, count = [], 0
            if held:
                yield batch(b.schema.field("k").type, held)

    dealt = left.select("key", "k", "x").repartition(8 * spark.sparkContext.defaultParallelism, "k")
    return dealt.mapInArrow(run, f"k {kind}, y string, ratio double")


def _chrf_words(s: str) -> list[str]:
    out = []
    for w in s.split():
        if len(w) > 1 and w[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
            out += [w[:-1], w[-1]]
        else:
            out.append(w)
    return out


def _letters(s: str) -> np.ndarray:
    return np.frombuffer("".join(s.split()).encode("utf-32-le", "surrogatepass"), np.uint32)


class _Grams:
    """How often each n-gram of a short text stands in it, and how often, at most that often, in another.

    The n-grams are the nodes of a tree; a place in the other text moves from a node to the next by one look-up, and out
    of the tree for good once its n-gram isn't in the short text."""

    def __init__(self, symbols: np.ndarray, n: int, most: int):
        self.length, self.levels = len(symbols), []
        node = np.zeros(len(symbols), np.int64)
        for k in range(1, min(n, len(symbols)) + 1):
            key = node[: len(symbols) - k + 1] * most + symbols[k - 1 :]
            found, node, count = np.unique(key, return_inverse=True, return_counts=True)
            size = int(found[-1]) + 1
            table = np.full(size, -1, np.int32)
            table[found] = np.arange(len(found))
            self.levels.append((table, count))
        self.n, self.most = n, most

    def scores(self, symbols: np.ndarray, beta: float) -> list[float]:
        """F of each n that both have; symbols that the short text lacks are -1."""
        out, at, node = [], np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for k, (table, count) in enumerate(self.levels, 1):
            if len(symbols) < k:
                break
            inside = at + k <= len(symbols)
            at, node = at[inside], node[inside]
            symbol = symbols[at + k - 1]
            key = node * self.most + symbol
            ok = (symbol >= 0) & (key < len(table))
            at, node = at[ok], table[key[ok]]
            ok = node >= 0
            at, node = at[ok], node[ok].astype(np.int64)
            same = int(np.minimum(np.bincount(node, minlength=len(count)), count).sum())
            p, q = same / (self.length - k + 1), same / (len(symbols) - k + 1)
            out.append(0.0 if not same else (1 + beta**2) * p * q / (beta**2 * p + q))
        return out


class _Hypothesis:
    def __init__(self, text: str, chars: int = 6, words: int = 2):
        self.letters = np.unique(_letters(text))
        self.words = {w: i for i, w in enumerate(dict.fromkeys(_chrf_words(text)))}
        self.chars_of = _Grams(np.searchsorted(self.letters, _letters(text)), chars, len(self.letters) + 1)
        self.words_of = _Grams(np.array([self.words[w] for w in _chrf_words(text)], np.int64), words, len(self.words) + 1)

    def score(self, reference: str, beta: float = 2.0) -> float:
        found = []
        own = _letters(reference)
        if len(self.letters):
            place = np.minimum(np.searchsorted(self.letters, own), len(self.letters) - 1)
            found += self.chars_of.scores(np.where(self.letters[place] == own, place, -1), beta)
        found += self.words_of.scores(np.array([self.words.get(w, -1) for w in _chrf_words(reference)], np.int64), beta)
        return sum(found) / len(found) if found else 0.0


@F.pandas_udf(T.DoubleType())
def chrf_plus_plus(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Mean F2 of character n-grams to 6 and word n-grams to 2, from 0 to 1."""
    known, out = {}, []
    for a, b in zip(hypothesis, reference):
        if a is None or b is None:
            out.append(None)
            continue
        if a not in known:
            if len(known) >= 1000:
                known.clear()
            known[a] = _Hypothesis(a)
        out.append(known[a].score(b))
    return pd.Series(out, dtype="float64")


def position_overlap(a: Column, b: Column) -> Column:
    """C11: share of equal positions of two tag arrays, by the longer."""
    longer = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(longer == 0, F.lit(1.0)).otherwise(same / longer)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """C12; null if a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norm)


def length_weighted(similarity: Column, difference: Column, slope: float = 0.1) -> Column:
    """C13"""
    return similarity / (1 + slope * difference)


def similarity_bin(similarity: Column) -> Column:
    """C14: to two decimals, halves to even."""
    return F.bround(similarity, 2)


def reply_lines(reply: Column) -> Column:
    """The paraphrases of a model's reply: numbered, bulleted or plain lines over 5 characters."""
    body = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(py_strip(x), r"^(?:\d+\.\s*|[-•*]\s*)", ""))
    clean = F.transform(body, lambda x: collapse(F.regexp_replace(py_strip(x), r"""^["']+|["']+\z""", "")))
    return F.filter(clean, lambda x: F.length(x) > 5)


def assistant_name(prompt: Column) -> Column:
    """What stands between `You are ` and the next comma."""
    name = F.regexp_extract(prompt, r"(?s)You are ([^,]+),", 1)
    return F.when(name == "", F.lit("Assistant")).otherwise(name)


def ellipsis(c: Column, width: int = 50) -> Column:
    """C17"""
    return F.when(F.length(c) > width, F.concat(F.call_function("left", c, F.lit(width)), F.lit("..."))).otherwise(c)


def clean_divider(c: Column, least: int = 3) -> Column:
    """Without rows of =, trimmed."""
    return py_strip(F.regexp_replace(c, "={%d,}" % least, ""))


def rstrip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+\z", "")


def label(c: Column) -> Column:
    """C19"""
    return F.upper(F.replace(c, F.lit("_"), F.lit(" ")))


def decimals(c: Column, places: int = 6, percent: bool = False) -> Column:
    """C20: for reports only. The stored double decides, as in C and Python, and exact halves go to even; Java's %f rounds its
    shortest decimal form up, which can be half where the double is below."""
    whole = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    said = F.when(whole, F.format_string(f"%.{places}f", c)).otherwise(F.translate(F.format_number(c, places), ",", ""))
    return F.concat(said, F.lit("%")) if percent else said


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda mentions from outside is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(scores: Column) -> Column:
    """Of an array of doubles, in linear time."""
    def shifted(own: Column, top: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return bound(top + F.log(total), lambda z: F.transform(own, lambda x: x - z))

    return bound(scores, lambda own: bound(F.array_max(own), lambda top: shifted(own, top)))


def gathered_sum(scores: Column, chosen: Column) -> Column:
    """The sum of the scores at positions (from 0)."""
    return bound(scores, lambda own: F.aggregate(chosen, F.lit(0.0), lambda s, i: s + F.element_at(own, (i + 1).cast("int"))))


def negation_flip(a: Column, b: Column) -> Column:
    """exactly one of two texts negates."""
    words = F.array(*map(F.lit, NEGATIONS))

    def negates(c: Column) -> Column:
        return F.arrays_overlap(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)), words)

    return negates(a) != negates(b)


def keeps_keywords(source: Column, candidate: Column, keywords=PROTECTED) -> Column:
    """every keyword in the source is in the candidate too, in any case."""
    s, c = F.lower(source), F.lower(candidate)
    return reduce(lambda x, y: x & y, [~F.contains(s, F.lit(k)) | F.contains(c, F.lit(k)) for k in keywords], F.lit(True))
