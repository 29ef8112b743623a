"""n-gram index: candidates of a pattern, their score and their use as a scan filter."""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.functions import ngram
from corposcope.functions.regexq import literals

SELECTIVITY = 0.8


def pattern_ngrams(pattern: str) -> list[bytes]:
    """n-grams that every text matching the pattern holds; empty means the index cannot filter."""
    return list(dict.fromkeys(g for text in literals(pattern) for g in ngram.covering(text.encode())))


def candidates(index: DataFrame, grams: list[bytes]) -> DataFrame:
    """(file_id): files that hold every n-gram. Only posting rows of these keys are read."""
    keys = [ngram.key(g) for g in dict.fromkeys(grams)]
    return (index.where(F.col("ngram").isin(keys)).groupBy("file_id")
                 .agg(F.countDistinct("ngram").alias("n")).where(F.col("n") == len(keys)).select("file_id"))


def idf_score(total: int, matching: int) -> float:
    """Score of an n-gram hit: rarer is better; 0.5 if either number is zero."""
    if not total or not matching:
        return 0.5
    return min(1.0, max(0.1, log(total / matching) / max(log(total), 1.0)))


def useful(total: int, matching: int) -> bool:
    """Whether filtering by the candidates saves enough of the scan."""
    return matching < total * SELECTIVITY


def filtered(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus restricted to candidate files."""
    return corpus.join(found, "file_id", "left_semi")


def holds(pattern: str, content: Column) -> Column:
    return ngram.contains_all(content, pattern_ngrams(pattern))


def cardinalities(index: DataFrame) -> DataFrame:
    """(unique_ngrams, total_refs)."""
    return index.agg(F.countDistinct("ngram").alias("unique_ngrams"), F.count(F.lit(1)).alias("total_refs"))


def compact(index: DataFrame) -> DataFrame:
    """(ngram, bucket, bits, files): postings as bitmaps of 32,768 ids."""
    return (index.groupBy("ngram", F.bitmap_bucket_number("file_id").alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("bits"))
                 .withColumn("files", F.bitmap_count("bits")))
