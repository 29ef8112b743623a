"""Regular-expression scan over lines and its file scores. Every match counts; nothing is sampled."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.functions.regexq import check_pattern, covers_lines, java, literals
from corposcope.functions.text import clamp
from corposcope.session import spread, staged
from corposcope.sources.corpus import line_array, lines

SNIPPETS = 3


def _may_match(content: Column, pattern: str) -> Column:
    """A test of the whole text that every text with a matching line passes: the strings that each match
    holds and, where the pattern means the same inside a longer text, the pattern itself."""
    out = F.lit(True)
    for text in literals(pattern):
        out = out & F.contains(content, F.lit(text))
    return out & content.rlike("(?m)" + java(pattern)) if covers_lines(pattern) else out


def matches(corpus: DataFrame, pattern: str) -> DataFrame:
    """(file_id, path, line_no, line, match_start, match_end): the first match of each matching line, in characters.

    Files that cannot match are filtered on the whole content before lines are made.
    """
    rx = check_pattern(pattern)
    hits = lines(corpus.where(_may_match(F.col("content"), pattern)), F.col("line").rlike(rx))
    start = F.regexp_instr("line", F.lit(rx)) - 1
    found = F.regexp_extract("line", f"({rx})", 1)
    return hits.select("file_id", "path", "line_no", F.regexp_replace("line", r"\s+$", "").alias("line"), start.alias("match_start"),
                       (start + F.length(found)).alias("match_end"))


def hit_array(content: Column, pattern: str) -> Column:
    """Matching lines of a text as an array of (line_no, line, match_start, match_end), without leaving the row.

    Lines are only made for texts that may match; others have null or an empty array.
    """
    rx = check_pattern(pattern)
    numbered = F.transform(line_array(content), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    found = F.filter(numbered, lambda s: s["line"].rlike(rx))
    start = lambda s: F.regexp_instr(s["line"], F.lit(rx)) - 1
    hits = F.transform(found, lambda s: F.struct(
        s["line_no"].alias("line_no"), F.regexp_replace(s["line"], r"\s+$", "").alias("line"), start(s).alias("match_start"),
        (start(s) + F.length(F.regexp_extract(s["line"], f"({rx})", 1))).alias("match_end")))
    return F.when(_may_match(content, pattern), hits)


@dataclass(frozen=True)
class GrepConfig:
    """How lines are matched and shown; 0 matches means all."""

    case_insensitive: bool = False
    before_context: int = 0
    after_context: int = 0
    max_matches: int = 0


def with_context(corpus: DataFrame, pattern: str, config: GrepConfig = GrepConfig()) -> DataFrame:
    """(file_id, path, line_no, line, match_start, match_end, before, after): matching lines with their neighbours, as arrays.

    Neighbours come from the same row, so nothing is joined.  With ``max_matches``
    the first ones by path and line are kept.
    """
    pattern = f"(?i){pattern}" if config.case_insensitive else pattern
    rows = corpus.select("file_id", "path", line_array(F.col("content")).alias("all"), F.explode(hit_array(F.col("content"), pattern)).alias("h"))
    at = F.col("h.line_no")
    begin = F.greatest(at - config.before_context, F.lit(1))
    out = rows.select("file_id", "path", "h.*", F.slice("all", begin, at - begin).alias("before"), F.slice("all", at + 1, F.lit(config.after_context)).alias("after"))
    return out.orderBy("path", "line_no").limit(config.max_matches) if config.max_matches else out


def scores(count: Column, max_line: Column, most_count: float, most_density: float) -> Column:
    """0.6 for many matches, 0.4 for density, each relative to the largest of all files."""
    density = count / max_line / F.lit(max(most_density, 2.220446049250313e-16))
    return clamp(F.lit(0.6) * F.log1p(count) / F.log1p(F.lit(most_count)) + F.lit(0.4) * density)


def file_stats(hits: DataFrame) -> DataFrame:
    """(file_id, path, count, max_line, snippets): map-side combined; at most three snippets a file are kept."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line", "match_start", "match_end"))), 1, SNIPPETS)
    return hits.groupBy("file_id", "path").agg(F.count(F.lit(1)).alias("count"), F.max("line_no").alias("max_line"),
                                               first.alias("snippets"))


def scored(stats: DataFrame) -> DataFrame:
    """Adds ``grep_score``."""
    stats = staged(stats, "grep")  # one pass over the text; the two maxima are two numbers
    most = stats.agg(F.max("count").alias("c"), F.max(F.col("count") / F.col("max_line")).alias("d")).first()
    return stats.withColumn("grep_score", scores(F.col("count"), F.col("max_line"), float(most["c"] or 1), float(most["d"] or 1)))


def grep(corpus: DataFrame, pattern: str) -> DataFrame:
    """(file_id, path, count, max_line, snippets, grep_score): one pass over the text and no shuffle of lines."""
    hits = spread(corpus.select("file_id", "path", "content")).select("file_id", "path", hit_array(F.col("content"), pattern).alias("h")).where("size(h) > 0")
    return scored(hits.select("file_id", "path", F.size("h").cast("long").alias("count"), F.element_at("h", -1)["line_no"].alias("max_line"),
                              F.slice("h", 1, SNIPPETS).alias("snippets")).dropDuplicates(["file_id"]))


def top(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The k best rows; ties go to the smaller path. A partial top-k runs in every task."""
    return scores.orderBy(F.col(column).desc(), F.col("path").asc()).limit(k)
