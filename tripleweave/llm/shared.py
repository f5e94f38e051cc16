"""Tables in the shared folder, size checks, memory of Python workers and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.sources.folders import scratch

#: Largest side, in bytes, that an operator may broadcast after having counted it.
BROADCAST_BYTES = 32 << 20


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Where the tables of this session lie.
_PATHS: dict[int, str] = {}


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives lost executors.

    ``instead_of``: an earlier table that nothing reads any more, which is deleted once this one is there.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if instead_of is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(id(instead_of)))
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    return out


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted now, stay below ``limit`` bytes; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python workers batches of ``BATCH_BYTES`` at most, however long the texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with the memory that it held given back at the end of a partition.

    Workers are used again by later stages, and free memory that they keep is missing to all others.
    """

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # only where the C library has it
                trim(0)

    return kept


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows ``(node, component)``.

    ``component`` is the smallest node that can be reached. Nodes without an edge to another
    node do not appear. Alternating large-star and small-star rounds; each ends in a table in
    the shared folder, and only a count and a checksum reach the driver.
    """
    pair = F.struct(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    state = edges.where("src <> dst").select(pair.alias("p")).select("p.src", "p.dst").distinct()
    state, seen = written(state, name), None
    while True:
        found = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if found[0] == 0 or found == seen:
            break
        seen = found
        both = state.union(state.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(least, "src")
        small = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        state = written(small.union(joined.select("src", F.col("m").alias("dst"))).distinct(), name, instead_of=state)
    roots = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
