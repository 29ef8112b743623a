"""Fusion of full-text, grep and n-gram evidence into one ranked list."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.functions.text import clamp

DEFAULT = {"fts": 0.4, "grep": 0.4, "ngram": 0.2}
WEIGHTS = {"regex": {"fts": 0.0, "grep": 0.7, "ngram": 0.3}, "natural_language": {"fts": 0.6, "grep": 0.2, "ngram": 0.2}}
BONUS = 0.1
SNIPPETS = "array<struct<line_no:int,line:string,match_start:int,match_end:int>>"
#: Line starts that mark a definition. Fixed values.
DEFINITION_STARTS = ("fn ", "pub fn ", "struct ", "class ", "def ", "function ")


@dataclass(frozen=True)
class SearchConfig:
    """Weights of the sources for queries that are neither regular expressions nor natural language, and the bonus for several sources."""

    fts_weight: float = DEFAULT["fts"]
    grep_weight: float = DEFAULT["grep"]
    ngram_weight: float = DEFAULT["ngram"]
    multi_source_bonus: float = BONUS

    def weights(self, intent: str) -> dict[str, float]:
        return WEIGHTS.get(intent, {"fts": self.fts_weight, "grep": self.grep_weight, "ngram": self.ngram_weight})


def weights(intent: str) -> dict[str, float]:
    return SearchConfig().weights(intent)


def fused(rows: DataFrame, w: dict[str, float], bonus: float = BONUS) -> DataFrame:
    """Adds ``score`` (weighted mean over the sources that hit, raised for several sources) and ``sources``."""
    have = {s: F.col(s).isNotNull() for s in w}
    total = sum((F.when(have[s], F.lit(w[s])).otherwise(0.0) for s in w), F.lit(0.0))
    gained = sum((F.when(have[s], F.col(s) * w[s]).otherwise(0.0) for s in w), F.lit(0.0))
    n = sum((have[s].cast("int") for s in w), F.lit(0))
    base = F.when(total > 0, gained / total).otherwise(F.lit(0.0))
    raised = F.when(n >= 2, base * (F.lit(1.0) + F.lit(bonus) * (F.pow(F.lit(2.0), n - 1) - 1))).otherwise(base)
    sources = F.concat(F.when(have["fts"], "f").otherwise(""), F.when(have["grep"], "g").otherwise(""),
                       F.when(have["ngram"], "t").otherwise(""))
    return rows.withColumns({"base": clamp(base), "n_sources": n, "score": clamp(raised), "sources": sources})


def boosted(rows: DataFrame) -> DataFrame:
    """Adds 0.03 for a match in the first five lines, else 0.02 for a match on a definition line."""
    start = lambda s: F.ltrim(s["line"])
    any_of = lambda s: sum((F.startswith(start(s), F.lit(k)).cast("int") for k in DEFINITION_STARTS), F.lit(0)) > 0
    snippets = F.coalesce("snippets", F.array().cast(SNIPPETS))
    boost = (F.when(F.exists(snippets, lambda s: s["line_no"] <= 5), 0.03)
              .when(F.exists(snippets, any_of), 0.02).otherwise(0.0))
    return rows.withColumn("boost", boost).withColumn("score", clamp(F.col("score") + F.col("boost")))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best by rounded score, ties by path; the boost then reorders them but rescues no other row."""
    cut = rows.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "path").limit(k)
    return boosted(cut).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "path")
