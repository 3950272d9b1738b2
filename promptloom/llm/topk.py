"""Exact top-k search by a three-phase uniform threshold.

The dimensions are cut into slices; a slice of a block of candidates is a node with a list of local scores for each
query, and a score is the sum over slices. Phase 1 gathers, from every node, the heads of its lists, resolves those
candidates' scores, and takes each query's k-th best as a safe cutoff. Phase 2 broadcasts the cutoffs; a candidate with a
score of at least the cutoff must reach cutoff / slices in at least one slice, so every node gives the entries from there
on, and nothing else. Phase 3 looks up the local scores that these entries lack, and keeps the k best of a query.

So only phase 3 sums scores, and only of sufficient entries; work() counts them. Queries are taken in chunks of at most
CHUNK, the proven bound of what is broadcast; all candidates pass in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.shared import materialize

K = 5
#: With more slices the share of the cutoff that one of them must reach is easier to reach.
SLICES = 2
#: Queries that are broadcast at once, candidates in a block, queries that meet a block at once.
CHUNK, BLOCK, PANEL = 16_384, 4096, 256
#: Entries whose scores are looked up at once.
ENTRIES = 1 << 16
#: Sums of products below this are exact in floats; from WRAPS on they wrap, and no cutoff is safe.
EXACT, WRAPS = 1 << 53, 1 << 63


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v: floor(scale * x) of each component, at the ends of a long if beyond; without vectors that are null, empty, or
    hold null, NaN or infinity."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(
        "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    ).select("id", F.transform("v", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; by floats where those are exact, else by integers, which wrap at 64 bits."""
    return (a.astype(np.float64) @ b.astype(np.float64).T) if exact else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, ties to the smaller id, then the earlier row."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((uids[some], ids[some], -scores[some]))[:k]]


def _resolve(q, x, row, col, bounds, known, exact) -> np.ndarray:
    """Scores of the entries (row, col): local scores that are known, by slice, and the others, which are looked up."""
    total = np.zeros(len(row), np.float64 if exact else np.int64)
    for (a, b), (at, scores) in zip(bounds, known):
        total[at] += scores
        lacking = np.ones(len(row), bool)
        lacking[at] = False
        for s in range(0, len(row), ENTRIES):
            some = np.flatnonzero(lacking[s : s + ENTRIES]) + s
            left, right = q[row[some], a:b], x[col[some], a:b]
            total[some] += np.einsum("ij,ij->i", *(y.astype(np.float64) for y in (left, right))) if exact else (left * right).sum(1)
    return total


def _heads(q, uid, x, ids, own, k, bounds, exact):
    """Phase 1: (query, score) of the heads of a block's lists."""
    for s in range(0, len(own), PANEL):
        part = q[s : s + PANEL]
        take, mine = min(k + 1, len(uid)), own[s : s + PANEL]
        heads = []
        for a, b in bounds:
            local = _product(part[:, a:b], x[:, a:b], exact)
            heads.append(np.argpartition(-local, take - 1, axis=1)[:, :take])
        pair = np.unique((np.arange(len(part))[:, None] * len(uid) + np.concatenate(heads, axis=1)).ravel())
        row, col = pair // len(uid), pair % len(uid)
        other = uid[col] != mine[row]
        row, col = row[other], col[other]
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        total = _resolve(part, x, row, col, bounds, [none] * len(bounds), exact)
        for i, (c, t) in _by_row(row, col, total, len(part)):
            yield mine[i], np.sort(t)[::-1][:k]


def _sufficient(q, cut, x, bounds, exact):
    """Phase 2: entries (row, col) that reach their share of the cutoff in a slice, and these slices' local scores: by
    slice, the entries' places and scores."""
    share = np.ceil(cut / len(bounds))[:, None] if exact else -(-cut // len(bounds))[:, None]
    lists = []
    for a, b in bounds:
        local = _product(q[:, a:b], x[:, a:b], exact)
        r, c = np.nonzero(local >= share)
        lists.append((r * len(x) + c, local[r, c]))
    pair = np.unique(np.concatenate([p for p, _ in lists]))
    return pair // len(x), pair % len(x), [(np.searchsorted(pair, p), scores) for p, scores in lists]


def _by_row(row, col, total, n):
    ends = np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        if ends[i] < ends[i + 1]:
            yield i, (col[ends[i] : ends[i + 1]], total[ends[i] : ends[i + 1]])


def _entries(q, own, cut, uid, x, ids, k, bounds, exact, safe=True):
    """Phases 2 and 3: (query, places in the block, scores) of a block's entries that reach the cutoff, its k best."""
    for s in range(0, len(own), PANEL):
        part, mine, least = q[s : s + PANEL], own[s : s + PANEL], cut[s : s + PANEL]
        if safe:
            row, col, known = _sufficient(part, least, x, bounds, exact)
        else:
            row, col = (y.ravel() for y in np.indices((len(part), len(x))))
            known = [(np.empty(0, np.int64),) * 2] * len(bounds)
        total = _resolve(part, x, row, col, bounds, known, exact)
        keep = ((total >= least[row]) | (not safe)) & (uid[col] != mine[row])
        for i, (c, t) in _by_row(row[keep], col[keep], total[keep], len(part)):
            best = _best(t, ids[c], uid[c], k)
            yield mine[i], c[best], t[best]


def work(q: np.ndarray, x: np.ndarray, k: int = K, slices: int = SLICES) -> dict[str, int]:
    """Of one block against queries: local scores that phases 1 and 2 compute, sufficient entries, scores looked up."""
    edges = np.linspace(0, q.shape[1], min(slices, q.shape[1]) + 1).astype(int).tolist()
    bounds = list(zip(edges, edges[1:]))
    none = np.full(len(q), -1)
    cut = np.array([t[-1] for _, t in _heads(q, np.arange(len(x)), x, np.arange(len(x)), none, k, bounds, True)], np.int64)
    row, _, known = _sufficient(q, cut, x, bounds, True)
    return {"local": len(q) * len(x) * len(bounds), "sufficient": len(row), "looked_up": len(row) * len(bounds) - sum(len(at) for at, _ in known)}


def top_k(vectors: DataFrame, every: int = 50, k: int = K, slices: int = SLICES, chunk: int = CHUNK, **columns) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by `every`; candidates all rows but the query's own. Ties go to the smaller
    vec_id; fewer than k candidates give fewer rows. A vector is compared with those of its own length only, and each
    length that the table has costs a series of jobs. Null vectors and ids, and vectors with null or non-finite
    components, take no part. Rows of the same id are queries and candidates of their own each, so a repeated query id has
    as many lists. Components beyond a long end at its ends, and scores beyond 64 bits wrap. An empty table gives no rows;
    extra columns are ignored."""
    spark = vectors.sparkSession
    table = materialize(quantized(vectors, **columns).withColumn("dim", F.size("v")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    queries = table.filter(F.col("id") % every == 0)
    # of a negative number one less than its size, which a long can hold
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x, -(x + 1)))
    shapes = table.groupBy("dim").agg(F.max(size).alias("top")).collect()
    results = []
    for shape in shapes:
        dim, most = shape["dim"], (shape["top"] + 1) ** 2 * shape["dim"]
        exact, safe = most < EXACT, most < WRAPS
        edges = np.linspace(0, dim, min(slices, dim) + 1).astype(int).tolist()
        bounds = list(zip(edges, edges[1:]))
        own = queries.filter(F.col("dim") == dim)
        parts = max(1, -(-own.count() // chunk))
        rows = table.filter(F.col("dim") == dim).select("uid", "id", "v")
        for p in range(parts):
            got = own.filter(F.pmod(F.xxhash64("uid"), F.lit(parts)) == p).select("uid", "id", "v").toPandas()
            if not len(got):
                continue
            sent = spark.sparkContext.broadcast((got["uid"].to_numpy(np.int64), np.stack(got["v"].to_numpy()).astype(np.int64)))

            def gather(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim, bounds=bounds, exact=exact) -> Iterator[pa.RecordBatch]:
                asked, q = sent.value
                for b in _blocks(batches):
                    uid, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)
                    found = list(_heads(q, uid, x, ids, asked, k, bounds, exact))
                    n = [len(s) for _, s in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([u for u, _ in found], n), pa.int64()), pa.array(np.concatenate([np.empty(0), *(s for _, s in found)]).astype(np.int64))], names=["query", "score"])

            low = -(1 << 62)  # fewer than k candidates were gathered, or no cutoff is safe: all are sufficient
            cut = {}
            if safe:
                best = Window.partitionBy("query").orderBy(F.desc("score"))
                heads = rows.mapInArrow(gather, "query long, score long").withColumn("r", F.row_number().over(best)).filter(F.col("r") == k)
                cut = dict(heads.select("query", "score").toPandas().itertuples(index=False))
            cuts = spark.sparkContext.broadcast(np.array([cut.get(u, low) for u in sent.value[0].tolist()], np.int64))

            def collect(batches: Iterator[pa.RecordBatch], sent=sent, cuts=cuts, dim=dim, bounds=bounds, exact=exact, safe=safe) -> Iterator[pa.RecordBatch]:
                asked, q = sent.value
                for b in _blocks(batches):
                    uid, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)
                    found = list(_entries(q, asked, cuts.value, uid, x, ids, k, bounds, exact, safe))
                    if found:
                        at = np.concatenate([c for _, c, _ in found])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.repeat([u for u, _, _ in found], [len(c) for _, c, _ in found]), pa.int64()), pa.array(uid[at]), pa.array(ids[at]),
                            pa.array(np.concatenate([t for _, _, t in found]).astype(np.int64)),
                        ], names=["query", "uid", "vec_id", "score"])

            entries = rows.mapInArrow(collect, "query long, uid long, vec_id long, score long")
            results.append(entries.join(F.broadcast(own.filter(F.pmod(F.xxhash64("uid"), F.lit(parts)) == p).select(F.col("uid").alias("query"), F.col("id").alias("query_id"))), "query"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    if not results:
        none = F.lit(None).cast("long")
        return spark.range(0).select(none.alias("query_id"), none.cast("int").alias("rank"), none.alias("vec_id"), none.alias("score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


ORACLE_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
