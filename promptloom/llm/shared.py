"""What the operators of this package share: materialised tables, skew-safe lookups, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

#: Groups with more than 1/HOT_SHARE of all rows count as hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Bits of a table of rows, and the parts that it is gathered in.
TABLE_BITS, TABLE_PARTS = 1 << 27, 64
#: A row's number, and the bits of it that are the row's place in its file.
ROW, PLACES = "__rid", 40


#: Rows in an Arrow batch of whole texts.
BATCH = 1024


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows at most, where the session has Spark's default of 10,000: batches hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) in (0, 10_000):
        spark.conf.set(name, str(BATCH))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at a task's end the Python worker, which lives on, gives the memory back that it freed."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not the GNU library

    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A temporary one where that is unset and all of Spark
    runs on this machine; on a cluster, whose executors wouldn't see it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="promptloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts the lineage: what follows
    survives the loss of any executor and never recomputes what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that materialize() made and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished rounds go: Spark deletes them when the driver's garbage is collected, which
    else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups (unique in key) by key, safe for hot keys.

    Groups that hold over 1/HOT_SHARE of the total rows are fewer than HOT_SHARE, a fixed bound, so they are
    broadcast and their rows never meet in one task; all other groups are joined by a shuffle."""
    limit = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links(u long, v long): returns node, root (the smallest node reachable).

    Alternates large-star and small-star contraction; every round is written to the shared folder, and only the
    number and checksum of the edges reach the driver. Nodes without a link are not returned."""

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        )
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())

    edges = materialize(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after = materialize(stars(stars(edges, True), False), "links")
        drop_table(edges)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """A table of TABLE_BITS bits that has those of the hashed long keys: of a fixed size, whatever their number, so it
    may be broadcast. It takes some keys for members that aren't, ever more as it fills; so it only saves work, and an
    exact join decides on its hits."""
    size = TABLE_BITS // TABLE_PARTS
    at = F.pmod(F.xxhash64(column), F.lit(TABLE_BITS))
    hashed = keys.select(at.alias("at")).select((F.col("at") / size).cast("int").alias("part"), F.pmod("at", F.lit(size)).cast("int").alias("bit")).distinct()

    def merge(table: pa.Table) -> pa.Table:
        flags = np.zeros(size, bool)
        flags[table["bit"].to_numpy()] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "raw": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    out = np.zeros(TABLE_BITS // 8, np.uint8)
    for part, raw in hashed.groupBy("part").applyInArrow(merge, "part int, raw binary").collect():
        out[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(raw, np.uint8)
    return out


def hits(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_rows(rows: DataFrame, key: str, table, wanted: bool) -> DataFrame:
    """Rows whose key is (not) in a broadcast bit table."""
    marked = rows.select("*", F.pmod(F.xxhash64(key), F.lit(TABLE_BITS)).alias("__at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hits(table.value, b.column(b.num_columns - 1).to_numpy()) == wanted)).select(b.schema.names[:-1])

    return marked.mapInArrow(trimmed(run), rows.schema)


def stored(docs: DataFrame, *columns) -> DataFrame:
    """docs if it is a stored table whose rows have a place in a file; else the given columns of it (all by default), as
    such a table."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select(docs.metadataColumn("_metadata").getField("row_index"))
            return docs
        except AnalysisException:
            pass
    docs = docs.select(*columns) if columns else docs
    # Parquet can't hold columns without a type
    void = {f.name for f in docs.schema if isinstance(f.dataType, NullType)}
    table = materialize(docs.drop(*void), "rows")
    return table.select(*[F.lit(None).alias(c) if c in void else c for c in docs.columns]) if void else table


def numbered(docs: DataFrame, *columns) -> DataFrame:
    """The given columns of docs, which stored() gave, and ROW, the row's number: that of its file among the sorted
    files and its place in the file. So it is the same in every scan, whatever partitions the scan has."""
    meta = docs.metadataColumn("_metadata")
    file = meta.getField("file_path")
    paths = sorted(r[0] for r in docs.select(file.alias("f")).distinct().collect())
    files = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(paths)), "__n long, __file string"))
    rows = docs.select(*columns, file.alias("__file"), meta.getField("row_index").alias("__at"))
    number = F.shiftleft("__n", PLACES).bitwiseOR(F.col("__at")).alias(ROW)
    return rows.join(files, "__file").select(*[c for c in rows.columns if c not in ("__file", "__at")], number)


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, which stored() gave, without the rows whose number, by numbered(), is in dropped(rid). Rows that the bit
    table clears stay where they are; only its hits are moved, to be joined exactly."""
    dropped = materialize(dropped, "dropped")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(dropped, "rid"))
    rows = numbered(docs, F.struct(*docs.columns).alias("row")).withColumnRenamed(ROW, "rid")
    maybe = split_rows(rows, "rid", table, True).join(dropped, "rid", "left_anti")
    return split_rows(rows, "rid", table, False).unionByName(maybe).select("row.*")
