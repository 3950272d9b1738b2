"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is cut into three segments on a ring. If two fingerprints differ in at most 2 bits, then from at
least one segment on every chain of 1, 2, 3 consecutive segments differs in at most 0, 1, 2 bits (its proportional
share of the budget, rounded down). The candidate join asks for the first two links of the chain at once: its key is
the first segment together with the second, and one side of the join carries the second segment's one-bit variants. So
a key has about 43 bits, which keeps groups small however many documents there are; the full Hamming check follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import ROW, attach, bound_batches, components, materialize, numbered, stored, trimmed, without_rows

SHINGLE = 3
DISTANCE = 2
#: Offset and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are summed at a time.
STEP = 1 << 15

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    shingles = map(" ".join, zip(*(islice(words, i, None) for i in range(size)))) if len(words) >= size else iter([" ".join(words)])
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while part := [digest(x, 42) for x in islice(shingles, STEP)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """doc_id, rid, fp (long, the fingerprint's bits) for each row; rid is the column of that name, else it numbers the
    rows of the scan."""
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), number.alias("rid"), F.col(text).alias("text"))

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py()) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["doc_id", "rid", "fp"])

    return frame.mapInArrow(trimmed(run), "doc_id long, rid long, fp long")


def pigeonring_pairs(nodes: DataFrame) -> DataFrame:
    """nodes(fp), distinct -> pairs (u, v), u < v, of fingerprints that differ in at most 2 bits; none is missed."""

    def segment(i: int):
        start, width = SEGMENTS[i]
        return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))

    def key(i: int, second):
        return F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(F.shiftleft(segment(i), 22)).bitwiseOR(second)

    starts = range(len(SEGMENTS))
    exact = nodes.select("fp", F.explode(F.array(*[key(i, segment((i + 1) % 3)) for i in starts])).alias("key"))
    near = nodes.select("fp", F.explode(F.array(*[
        key(i, segment((i + 1) % 3).bitwiseXOR(F.lit(flip).cast("long")))
        for i in starts for flip in (0, *(1 << b for b in range(SEGMENTS[(i + 1) % 3][1])))
    ])).alias("key"))
    # by a hint: the planner takes the exploded sides to be as small as the fingerprints and would broadcast one
    return (
        exact.select(F.col("fp").alias("u"), "key").hint("merge").join(near.select(F.col("fp").alias("v"), "key"), "key")
        .filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, kept, rid.

    Null and wordless texts have fingerprint 0 and are linked like any other. component_id is the smallest doc_id
    reachable over links; null only if every doc_id of the component is null. Of each component one row is kept: the
    first with that doc_id. Equal fingerprints are one node, so copies, however many, cost no pairs. An empty table
    gives no rows; extra columns are ignored, whatever their names."""
    rows = materialize(fingerprints(docs, text, doc_id, rid), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    nodes = materialize(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(pigeonring_pairs(nodes.select("fp")))
    marked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = marked.groupBy("root").agg(F.min("first").alias("first"))
    groups = marked.select("fp", "root", "n").join(first, "root")
    return attach(rows, groups, "fp", "n", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.d").alias("component_id"), (F.col("rid") == F.col("first.r")).alias("kept"), "rid"
    )


def kept_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row of each component that stays, in the columns of docs. It is scanned again, and rows are told by their
    place in their files; what isn't a stored table is stored first."""
    docs = stored(docs)
    return without_rows(docs, near_dedup(numbered(docs, text, doc_id), text, doc_id, ROW).filter("not kept").select("rid"))
