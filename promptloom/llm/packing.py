"""Best-fit packing by sums of squares: a document goes where the squared numbers of open bins per residual gap become
smallest in sum.

Documents are tokenised where they are read; only the lengths of their pieces move. Full pieces are sequences by
themselves; the others are dealt by hash to groups of about GROUP pieces, and each group is packed on its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import bound_batches, materialize, trimmed

CAPACITY = 4096
#: Ends each document.
END = 1
#: Pieces that are packed together.
GROUP = 100_000
#: Cached words of a Python worker, and the bytes of the longest one that is cached: 100 MB at most.
CACHE, LONGEST = 100_000, 64


class Tokenizer:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    A text is cut at ASCII white space, which the vocabulary drops, and words are cached. Plain words, letters that
    keep their form under NFC and lower case one by one, go to the model directly; others through the whole tokenizer."""

    PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]|[0-9]|[!-&(-/:-@\[-`{-~])+\Z")
    PLAIN_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~ ]+\Z")
    PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Full

        self.full = Full.from_file(path)
        self.model = self.full.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the public byte-level alphabet
        table = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.table, self.words, self.parts = table, {}, {}

    def part(self, x: str) -> bytes:
        if (got := self.parts.get(x)) is None:
            shown = x if x.isascii() else x.encode().decode("latin-1").translate(self.table)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(x) <= LONGEST:
                self.parts[x] = got
        return got

    def word(self, raw: bytes) -> bytes:
        x = raw.decode()
        if self.PLAIN.match(x) and "<|" not in x:
            return b"".join(map(self.part, self.PART.findall(x.lower())))
        return np.array(self.full.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Caches words, and returns those that are too long for that. Plain words are looked at together."""
        words, rare, known, part = self.words, {}, self.parts.get, self.part
        shown = b" ".join(fresh).decode()
        if not self.PLAIN_WORDS.match(shown) or "<|" in shown:
            for x in fresh:
                (words if len(x) <= LONGEST else rare)[x] = self.word(x)
            return rare
        for x, y in zip(fresh, shown.lower().split(" ")):
            got = known(y) or part(y) if y.isalpha() else b"".join([known(z) or part(z) for z in self.PART.findall(y)])
            if len(x) <= LONGEST:
                words[x] = got
            else:
                rare[x] = got
        return rare

    def encode(self, text: str) -> bytes:
        words, found = self.words, text.encode().split()  # bytes are cut at ASCII white space only
        if len(words) > CACHE:
            words.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        fresh = set(found).difference(words)
        rare = self.learn(list(fresh)) if fresh else None
        return b"".join([words[x] if x in words else rare[x] for x in found] if rare else map(words.__getitem__, found))


_loaded: dict[str, Tokenizer] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32 and uid (of the document's row)."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = Tokenizer(vocabulary)
        t, end = _loaded[vocabulary], np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for uid, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = t.encode(x.as_py() or "") + end
                for i, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    rows.append((uid, d, i, s // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        trimmed(run), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given; lengths from 1 to capacity - 1.

    open[g] counts bins with gap g. Placing a piece in a bin of gap g turns one gap g into g - length, and the sum of
    squares changes by 2 * (open[g - length] - open[g] + 1); a gap of 0 isn't counted, and a new bin has only the gain
    of its own gap. Ties go to the smallest gap, and a new bin comes last."""
    opened = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used, never = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 1 << 60
    for i, n in enumerate(lengths.tolist()):
        here = opened[n:capacity]
        change = np.where(here > 0, 2 * (opened[: capacity - n] - here) + 2, never)
        change[0] -= 1
        g = int(change.argmin())
        if change[g] > 2 * opened[capacity - n] + 1:
            at, gap = used, capacity
            used += 1
        else:
            gap = g + n
            at = stacks[gap].pop()
            opened[gap] -= 1
        bins[i], offsets[i] = at, capacity - gap
        if left := gap - n:
            stacks[left].append(at)
            opened[left] += 1
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end token. Texts over the capacity are cut every capacity tokens. Repeated
    rows are packed as separate documents. An empty table gives no rows; extra columns are ignored. A sequence's
    pieces lie gapless from offset 0, in any order."""
    table = materialize(pieces(docs, vocabulary, capacity, text, doc_id), "pieces")
    rest = table.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=bins * groups + key[0], offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    packed = rest.groupBy(F.pmod(F.xxhash64("uid", "piece"), F.lit(groups)).alias("g")).applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    full = table.filter(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed)
