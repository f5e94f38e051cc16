"""Shapes over streams: rows that arrive are checked by the same expressions as stored ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleweave.operators import shacl as S
from tripleweave.sources.tables import TableMap, VirtualGraph


def stream_violations(table: TableMap, shapes: list[S.NodeShape]) -> DataFrame:
    """Violations of a streaming table. Shapes may use constraints on single values, and counts where a row
    gives one value at most: these need no state."""
    return S.validate(VirtualGraph(table.df.sparkSession, [table]), shapes).df


def validated(table: TableMap, shapes: list[S.NodeShape], each: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run any shapes on every micro-batch; ``each`` gets the batch, its violations and its number."""

    def batch(df: DataFrame, number: int) -> None:
        each(df, S.validate(VirtualGraph(df.sparkSession, [replace(table, source=df)]), shapes).df, number)

    return table.df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(violations: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Violations by time window and constraint, with late rows up to a watermark."""
    return violations.withWatermark(time, late).groupBy(F.window(time, width), "source_constraint").count()
