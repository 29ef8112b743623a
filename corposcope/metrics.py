"""Output and benchmark statistics."""
from __future__ import annotations

from math import ceil, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.functions.text import token_estimate

CACHE_SHARE = 0.1  #: share of a cached prompt's cost that is still paid


def output_metrics(rows: DataFrame, n_bytes: Column, results: Column, files: Column) -> DataFrame:
    """Adds estimated tokens, files per 1,000 tokens and results per KB."""
    t = token_estimate(n_bytes)
    per = lambda a, b, k: F.when(b > 0, a / b * F.lit(k)).otherwise(F.lit(0.0))
    return rows.withColumns({"tokens": t, "density": per(files, t, 1000.0), "per_kb": per(results, n_bytes, 1024.0)})


def savings_percent(ours: Column, theirs: Column) -> Column:
    return F.when(theirs > 0, (theirs - ours) / theirs * 100.0).otherwise(F.lit(0.0))


def break_even(schema_bytes: int, pairs: list[tuple[int, int]]) -> tuple[float, float]:
    """(queries, queries with a cached prompt) after which savings pay for the schema; pairs are (ours, theirs) in bytes."""
    saved = sum(b - a for a, b in pairs) / len(pairs) / 4.0 if pairs else 0.0
    if saved <= 0:
        return inf, inf
    tokens = (schema_bytes + 2) // 4
    return ceil(tokens / saved), ceil(ceil(tokens * CACHE_SHARE) / saved)


def summary(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """mean, median, population deviation, its share of the mean in percent, min and max, per group."""
    x = F.col(column)
    mean, dev = F.avg(x), F.stddev_pop(x)
    return rows.groupBy(*by).agg(mean.alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), dev.alias("std_dev"),
                                 F.when(mean != 0, dev / mean * 100.0).otherwise(F.lit(0.0)).alias("cv_percent"),
                                 F.min(x).alias("min"), F.max(x).alias("max"))
