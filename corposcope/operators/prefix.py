"""Exact running sums and ranks over groups of any size.

A SQL window keeps a whole group in one task, so a group holding a third of
all rows makes one task do a third of the work.  Here rows are range-sorted by
(group, order), summed inside each range partition, and shifted by the totals
of the earlier ranges of the same group.  A group spans a range boundary at
most once per partition, so the offset table has fewer than two rows for each
partition and can be broadcast whatever the data size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.session import parallelism, staged

PID = "__range"


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                 sums: dict[str, str | Column], tag: str = "prefix") -> DataFrame:
    """Add inclusive running sums of integer columns along ``order`` within ``group``.

    Rows that tie on the whole order key fall into one range and share the sum of
    all of them (RANGE semantics), so the result does not depend on arrival order.
    Null group keys form a group of their own; null inputs count as zero; an
    empty input gives an empty result.
    """
    keys = [F.col(g) for g in group]
    n = parallelism(df.sparkSession)
    ranged = (df.repartitionByRange(n, *keys, *order)
                .withColumn(PID, F.spark_partition_id()))
    ranged = staged(ranged, tag)
    local = (Window.partitionBy(PID, *group).orderBy(*order)
                   .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inner = {f"__in_{k}": F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(0))
             for k, v in sums.items()}
    out = ranged.withColumns(inner)
    totals = out.groupBy(PID, *group).agg(*[F.sum(f"__in_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group)
    offsets = (totals
               .withColumn("__spans", F.count(F.lit(1)).over(over))
               .where("__spans > 1")
               .withColumns({f"__o_{k}": F.sum(f"__t_{k}").over(before) for k in sums})
               .select(F.col(PID).alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                       *[f"__o_{k}" for k in sums]))
    cond = F.col(PID) == F.col("__p")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = out.withColumns({k: F.sum(f"__in_{k}").over(local) for k in sums})
    out = out.join(F.broadcast(offsets), cond, "left")
    return (out.withColumns({k: F.col(k) + F.coalesce(F.col(f"__o_{k}"), F.lit(0)) for k in sums})
               .drop(PID, "__p", *[f"__g{i}" for i in range(len(group))],
                     *[f"__o_{k}" for k in sums], *[f"__in_{k}" for k in sums]))


def ranks(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank",
          tag: str = "rank") -> DataFrame:
    """1-based position within the group; the order must be total to be deterministic."""
    return running_sums(df, group, order, {name: F.lit(1)}, tag)
