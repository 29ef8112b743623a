"""References of a symbol: whole-word lines, classified by how the line uses it."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions.text import trim_around
from corposcope.sources.corpus import lines

#: Line starts of definitions and imports. Fixed values.
DEFINITIONS = ("fn ", "pub fn ", "def ", "function ", "class ", "struct ", "enum ", "type ", "interface ")
IMPORTS = ("use ", "import ", "from ")


def reference_kind(line: Column, symbol: str, definitions=DEFINITIONS) -> Column:
    """definition, import, type_usage or usage."""
    t = F.trim(F.regexp_replace(line, r"\t", " "))
    starts = lambda words: sum((F.startswith(t, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    has = lambda text: F.contains(t, F.lit(text))
    return (F.when(starts(definitions) & has(f" {symbol}"), "definition")
             .when(starts(IMPORTS) | has("require("), "import")
             .when(has(f": {symbol}") | has(f"-> {symbol}") | has(f"<{symbol}"), "type_usage")
             .otherwise("usage"))


def references(corpus: DataFrame, symbol: str, *, per_file: int | None = 3) -> DataFrame:
    """(path, line_no, content, ref_type): the first ``per_file`` lines of each file, or all with None."""
    word = rf"\b{re.escape(symbol)}\b"
    hits = lines(corpus.where(F.contains("content", F.lit(symbol))), F.col("line").rlike(word)).dropDuplicates(["file_id", "line_no"])
    if per_file is not None:
        first = Window.partitionBy("file_id").orderBy("line_no")
        hits = hits.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_file)
    shown = F.trim(F.regexp_replace("line", r"\t", " "))
    return hits.select("path", "line_no", trim_around(shown, symbol).alias("content"), reference_kind(F.col("line"), symbol).alias("ref_type"))
