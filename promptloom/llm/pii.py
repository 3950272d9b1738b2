"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail and IP addresses, card and phone numbers in their standard forms) are the seeds. The words around
a seed are its lexical patterns. Spark scores the graph of patterns and instances for a few rounds: a pattern is as good
as the share of its instances that are known, an instance as good as its best pattern; patterns above CONFIDENCE with
enough instances behind them make the other identifiers in their place known too.

What may be discovered are identifier-like tokens in general: words with an @ or a spelled one, and groups of digits with
or without a plus or an opening bracket. A pattern tells these two types apart and nothing finer; a discovered instance
must only have a number of digits, or dots, that its kind can have.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import bound_batches, materialize, trimmed

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Least share of known instances of a pattern, and least number of distinct known ones.
CONFIDENCE, SUPPORT = 0.9, 5
#: Longest word of a pattern, in code points; longer ones are no context.
LONGEST = 24
#: Digits of an identifier, and those that a discovered phone or card number may have.
FEWEST, MOST = 5, 19
PHONE_DIGITS, CARD_DIGITS = (5, 15), (12, 19)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?:@|[\x20]?[\[(][\x20]?at[\x20]?[\])][\x20]?)[A-Za-z0-9-]{1,64}"
    r"(?:(?:\.|[\x20]?[\[(][\x20]?dot[\x20]?[\])][\x20]?)[A-Za-z0-9-]{1,64}){0,8}", re.I
)
_RUN = re.compile(r"[0-9](?:[0-9 ().\-]*[0-9])?")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[+(]?[0-9][0-9 ().\-]*\Z")
_DOTTED = re.compile(r"[0-9]\.(?=[0-9])")
_AFTER = re.compile(r"[^\S\n]*(\S+)")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Base spans by kind, in order, and runs of digits and their separators (in which all numeric ones lie)."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    at, done = text.find("@"), 0
    while at >= 0:
        m, start = _DOMAIN.match(text, at), at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                found[0].append((start, done))
        at = text.find("@", at + 1)
    runs = []
    for run in _RUN.finditer(text):
        a, b = run.span()
        runs.append((a, b))
        if b - a < 3:
            continue
        part = run[0]
        if "." in part:
            found[1] += [(a + m.start(), a + m.end()) for m in _IP.finditer(part) if all(map(_byte, m[0].split(".")))]
        if b - a >= 13:
            for m in _CARD.finditer(part):
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found[2].append((a + m.start(), a + m.end()))
        if a and text[a - 1] == "+" and (m := _PHONE.match(text, a - 1, b)) and 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found[3].append(m.span())
    return found, runs


def _word(text: str) -> str:
    word = text.strip(".,;:!?()[]\"'").lower()
    return word if 0 < len(word) <= LONGEST and not any(c.isdigit() or c == "@" for c in word) else ""


def _patterns(text: str, a: int, b: int, shape: str) -> list[str]:
    """What stands around a span, with the span's type."""
    left = text[max(0, a - 3 * LONGEST) : a].rsplit("\n", 1)[-1].split(" ")
    glued = left[-1] if left else ""
    words = [w for w in map(_word, left[:-1] if not glued else left) if w] if not glued or not glued[-1].isalnum() else []
    right = _AFTER.match(text, b, b + 3 * LONGEST)
    after = _word(right[1]) if right else ""
    out = []
    if words:
        out.append(f"L {words[-1]} {shape}")
        if len(words) > 1:
            out.append(f"LL {words[-2]} {words[-1]} {shape}")
        if after:
            out.append(f"LR {words[-1]} {after} {shape}")
    return out


def _type(span: str) -> str:
    return "0" if _DIGITS.match(span) else "@"


def _may_be(run: str) -> int:
    """Bits of the kinds that a group of digits may be of."""
    n = len(_NOT_DIGIT.sub("", run))
    dotted = len(_DOTTED.findall(run)) >= 3
    return 2 * dotted + 4 * (CARD_DIGITS[0] <= n <= CARD_DIGITS[1] and not dotted) + 8 * (PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1] and not dotted)


def observe(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, list[str]]]]:
    """Base spans (kind, start, end), and all identifiers with patterns: (kind, start, end, span, patterns). The kind of
    what isn't a base span is -1 less the bits of the kinds that it may be of."""
    text = text or ""
    found, runs = base_spans(text)
    spans = [(k, a, b) for k, own in enumerate(found) for a, b in own]
    taken = sorted((a, b) for _, a, b in spans)
    seen = [(k, a, b) for k, a, b in spans]

    def free(candidates):
        """Those that don't overlap what is taken."""
        i = 0
        for a, b, kinds in candidates:
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                yield -1 - kinds, a, b

    if "@" in text or "at]" in text or "at)" in text:
        mails = list(free((*m.span(), 1) for m in _MAIL.finditer(text)))
        seen += mails
        taken = sorted(taken + [(a, b) for _, a, b in mails])
    numbers = []
    for a, b in runs:
        if b - a < FEWEST or not FEWEST <= len(_NOT_DIGIT.sub("", text[a:b])) <= MOST:
            continue
        kinds = _may_be(text[a:b])
        if a and (text[a - 1] == "+" or text[a - 1] == "(" and ")" in text[a:b]):
            a -= 1
        whole = not (a and (text[a - 1].isalnum() or text[a - 1] in "_@")) and not (b < len(text) and (text[b].isalnum() or text[b] in "_@"))
        if whole and kinds:
            numbers.append((a, b, kinds))
    seen += free(numbers)
    out = []
    for k, a, b in seen:
        if b - a <= 100 and (p := _patterns(text, a, b, _type(text[a:b]))):
            out.append((k, a, b, text[a:b], p))
    return spans, out


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    spans lists base and discovered spans as kind:start:end, by kind and start, in code points. A null or empty text
    has none. A span that is discovered doesn't overlap a base one, nor another one. Repeated rows count as further evidence. An empty
    table gives no rows; extra columns are ignored."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    seen = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, sights, digests = [], [], []
            for x in b.column(1):
                base, sight = observe(x.as_py())
                bases.append([dict(zip("kse", y)) for y in base])
                sights.append([dict(zip(("k", "s", "e", "instance", "patterns"), y)) for y in sight])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), pa.array(bases, pa.list_(span)), pa.array(sights, pa.list_(seen))], names=["doc_id", "base_sha256", "base", "seen"])

    one = "array<struct<k:int,s:int,e:int>>"
    rows = materialize(
        frame.mapInArrow(trimmed(run), f"doc_id long, base_sha256 string, base {one}, seen array<struct<k:int,s:int,e:int,instance:string,patterns:array<string>>>")
        .withColumn("rid", F.monotonically_increasing_id()), "identifiers",
    )
    sights = rows.select("rid", F.explode("seen").alias("x")).select("rid", "x.*")
    graph = materialize(
        sights.select(F.explode("patterns").alias("pattern"), "instance", "k").groupBy("pattern", "instance").agg(F.max("k").alias("k")), "graph"
    )
    known = graph.filter("k >= 0").select("instance", F.col("k").alias("kind"), F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        # a pattern's kind is that of its known instances; its confidence their scores' share
        scored = graph.join(known.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")), "instance", "left")
        per = scored.groupBy("pattern", F.col("b.kind").alias("kind")).agg(F.sum("b.score").alias("weight"), F.count("*").alias("n"))
        total = per.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("weight", "n", "kind"))).alias("top"))
        good = total.filter((F.col("top.n") >= support) & (F.col("top.weight") / F.col("all") >= confidence)).select(
            "pattern", F.col("top.kind").alias("kind"), (F.col("top.weight") / F.col("all")).alias("score")
        )
        new = graph.filter("k < 0").join(good, "pattern").filter("shiftright(-1 - k, kind) % 2 = 1").groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"))
        found = materialize(new.select("instance", "b.kind", "b.score"), "found")
        known = graph.filter("k >= 0").select("instance", F.col("k").alias("kind"), F.lit(1.0).alias("score")).distinct().unionByName(found)
    more = sights.filter("k < 0").select("rid", "s", "e", "instance").join(found, "instance")
    added = more.groupBy("rid").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("more"))
    out = rows.select("rid", "doc_id", "base_sha256", "base").join(added, "rid", "left").withColumn(
        "all", F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {one})"))))
    )
    count = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    text_of = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return out.select("doc_id", *count, "base_sha256", text_of.alias("spans"))
