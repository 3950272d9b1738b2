"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every text of the training folds. The classifier is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample, at most SAMPLE documents a language, and
its scores are calibrated by a temperature that is fitted on every fifth document of that sample, which training
doesn't see. The model (2^16 features a language) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.shared import bound_batches, trimmed

#: Labelled documents per language that the classifier is trained and calibrated on.
SAMPLE = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
FEATURES = 1 << 16
#: Characters that are turned into n-grams at a time.
STEP = 1 << 20
UNKNOWN = "und"
#: The pipeline rejects documents below this score.
ACCEPT = 0.3
MAX_LANGUAGES = 500

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _hashes(code: np.ndarray, fresh: int) -> np.ndarray:
    """Features of the n-grams of 1 to 3 codes that end at or after place `fresh`."""
    two = code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    parts = code[fresh:] * np.uint32(0x165667B1), two[max(0, fresh - 1) :], (three ^ (three >> np.uint32(7)))[max(0, fresh - 2) :]
    return np.concatenate([(h ^ (h >> np.uint32(15))).astype(np.uint16) for h in parts])


#: The feature of a space.
_END = int(_hashes(np.array([32], np.uint32), 0)[0])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (hashed n-grams of 1 to 3 letters, words padded by a space) and their counts; empty without letters.

    A text is read in steps, which carry its last two codes on, so each n-gram counts once, however long the text is."""
    table, total, some = _letter_table(), None, False
    low = (text or "").lower()
    last, space = np.array([32], np.uint32), np.array([32], np.uint32)
    for at in range(0, len(low), STEP):
        code = np.frombuffer(low[at : at + STEP].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[code]
        some = some or bool(letter.any())
        code = np.concatenate((last, np.where(letter, code, 32).astype(np.uint32), space if at + STEP >= len(low) else space[:0]))
        keep = np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))
        keep[: len(last)] = True
        code = code[keep]
        found = _hashes(code, len(last))
        last = code[-2:]
        if len(low) > STEP:
            total = np.bincount(found, minlength=FEATURES) + (0 if total is None else total)
    if not some:
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    # the space after the last word is no feature by itself
    if total is None:
        found = np.sort(found, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        f, n = found[first], np.diff(np.append(first, len(found)))
    else:
        f = np.flatnonzero(total).astype(np.uint16)
        n = total[f]
    n[f == _END] -= 1
    return f[n > 0], n[n > 0]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / np.sqrt(x @ x)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        f, n = grams(text)
        if not len(f) or not self.languages:
            return UNKNOWN, 0.0
        z = (weigh(n, self.idf[f]) @ self.weights[f]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: weights of each feature and class, most of them exactly 0."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, x = rows[i]
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
            n[f] = nf + g * g
    return weights(z, n)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.02, 20, 200)

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text, lang): learns from those with a language whose crc32(doc_id) mod 3 is not 1."""
    train_rows = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 1))

    bound_batches(docs.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for x in b.column(0):
                f, _ = grams(x.as_py())
                df[f] += 1
                n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], names=["f", "df"])

    counted = train_rows.select("text").mapInArrow(trimmed(frequencies), "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).toPandas()
    n = int(counted.loc[counted.f == -1, "df"].sum())
    df = np.zeros(FEATURES)
    known = counted[counted.f >= 0]
    df[known.f.to_numpy()] = known.df.to_numpy()
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    # rows whose hash is small enough for about 4 times the sample, so that no task sees many more; then the sample
    sizes = train_rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    chosen = (
        train_rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("at")).join(sizes, "lang")
        .filter(F.pmod("at", F.lit(1_000_000_007)) <= share * 1_000_000_007)
        .withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("doc_id", "lang", "k")
    )
    names = sorted(x[0] for x in chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return Model([], idf, np.zeros((FEATURES, 0), np.float32), 1.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                f, c = grams(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), pa.array([f.tobytes()]), pa.array([np.minimum(c, 1 << 30).astype("<i4").tobytes()])], names=["lang", "k", "f", "c"])

    ids = F.broadcast(chosen.select("doc_id", "k"))  # at most sample rows a language
    got = train_rows.join(ids, "doc_id").select("lang", "k", "text").mapInArrow(trimmed(vectors), "lang string, k int, f binary, c binary").toPandas()
    got = got.sort_values(["k", "lang", "f"]).reset_index(drop=True)
    rows, labels, held = [], [], []
    for r in got.itertuples():
        f = np.frombuffer(r.f, np.uint16)
        if len(f):
            rows.append((f, weigh(np.frombuffer(r.c, "<i4"), idf[f]).astype(np.float64)))
            labels.append(names.index(r.lang))
            held.append(r.k % 5 == 0)
    labels, held = np.array(labels, np.int64), np.array(held, bool)
    weights = train([x for x, h in zip(rows, held) if not h], labels[~held], len(names)) if len(rows) else np.zeros((FEATURES, len(names)))
    scores = np.array([x @ weights[f] for (f, x), h in zip(rows, held) if h]).reshape(-1, len(names))
    return Model(names, idf, weights.astype(np.float32), calibrate(scores, labels[held]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each row; with keep=True all columns of docs in a struct `row`. Only the text is
    looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.col("doc_id"), F.col(text).alias("text"), *([F.struct(*docs.columns).alias("row")] if keep else []))

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [m.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), *b.columns[2:]],
                names=["doc_id", "lang_pred", "score", *b.schema.names[2:]],
            )

    row = f", row {frame.schema['row'].dataType.simpleString()}" if keep else ""
    return frame.mapInArrow(trimmed(run), f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{row}")


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    A null text or one without letters is `und` with score 0; so is every text if no document is labelled. Null
    languages are never learned; a null doc_id is neither learned from nor held out. Repeated rows are predicted
    alike. An empty table gives no rows; extra columns are ignored, whatever their names. More than MAX_LANGUAGES
    languages are an error, as the model is broadcast."""
    own = docs.select("doc_id", "text", "lang")
    return predict(own, fit(own, sample)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def accepted_documents(docs: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose language can be told, in the columns of docs: a text with letters and a score of at
    least `accept`, which is little above chance."""
    model = fit(docs.select("doc_id", "text", "lang"), sample)
    return predict(docs, model, keep=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= accept)).select("row.*")
