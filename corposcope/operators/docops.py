"""Document tools: line ranges, context, directory tree, line diff, index statistics."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.functions.text import extension, human_bytes, numbered
from corposcope.sources.corpus import lines

COLUMNS = 8192  #: lines of the second text that one machine word of the diff spans


def _joined(rows: DataFrame, text: str) -> DataFrame:
    """One row per file: the lines joined in order."""
    ordered = F.array_sort(F.collect_set(F.struct("line_no", F.col(text).alias("t"))))
    return rows.groupBy("file_id", "path").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("content"),
                                               F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def get_range(corpus: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    """(file_id, path, content, first_line, last_line) for lines start..end; end 0 is the end of the file.

    Files that end before ``start``, and ranges with start > end, give no row.
    """
    keep = (F.col("line_no") >= max(start, 1)) & ((F.col("line_no") <= end) if end else F.lit(True))
    return _joined(lines(corpus, keep), "line")


def context(corpus: DataFrame, line: int, around: int = 10) -> DataFrame:
    """Numbered lines around a line, which gets the marker '>'; the centre is clamped to the last line."""
    x = lines(corpus)
    last = x.groupBy("file_id").agg(F.max("line_no").alias("n"))
    x = x.join(last, "file_id")
    centre = F.least(F.lit(line), F.col("n"))
    x = x.where(F.col("line_no").between(centre - around, centre + around))
    shown = numbered(F.when(F.col("line_no") == line, ">").otherwise(" "), F.col("line_no"), F.col("line"))
    return _joined(x.withColumn("shown", shown), "shown")


def tree(corpus: DataFrame, base: str = "", depth: int = 3) -> DataFrame:
    """(sort_key, level, is_dir, name, line): entries below ``base`` in pre-order, directories first then by name.

    Sorting by ``sort_key`` gives the listing; it is left to the caller, since a
    sorted result of any size needs no single task.
    """
    prefix = base.rstrip("/") + "/" if base else ""
    rel = F.substring("path", len(prefix) + 1, 1_000_000)
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    x = corpus.where(F.startswith("path", F.lit(prefix))).select(parts.alias("p")).where(F.size("p") > 0)
    x = x.select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("level"))
    x = x.select(F.slice("p", 1, F.col("level")).alias("p"), "level", (F.col("level") < F.size("p")).alias("is_dir")).distinct()
    marks = F.transform("p", lambda v, i: F.concat(F.when((i < F.col("level") - 1) | F.col("is_dir"), "0").otherwise("1"), v))
    name = F.element_at("p", -1)
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), name, F.when(F.col("is_dir"), "/").otherwise(""))
    return x.select(F.array_join(marks, "\u0001").alias("sort_key"), "level", "is_dir", name.alias("name"), line.alias("line"))


def tree_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.when(F.col("is_dir"), 1)).alias("total_dirs"), F.count(F.when(~F.col("is_dir"), 1)).alias("total_files"))


def by_type(corpus: DataFrame) -> DataFrame:
    """(ext, files) of every extension."""
    return corpus.groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def index_stats(n_files: int, n_ngrams: int, spark) -> DataFrame:
    """(total_files, ngram_count, bytes, human): estimated index size."""
    row = spark.range(1).select(F.lit(n_files).cast("long").alias("total_files"), F.lit(n_ngrams).cast("long").alias("ngram_count"))
    size = F.col("total_files") * 1000 + F.col("ngram_count") * 20
    return row.withColumn("bytes", size).withColumn("human", human_bytes(F.col("bytes")))


# ---- line diff ---------------------------------------------------------------------------------------------------

def split_lines(text: str | None) -> list[str]:
    rows = (text or "").split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    return [r[:-1] if r.endswith("\r") else r for r in rows]


def lcs_row(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b``, bit-parallel (Hyyrö 2004).

    ``b`` is taken in blocks of ``COLUMNS`` lines with carries between them, so memory is
    bounded by one block and one bit for each line of ``a``.
    """
    out = np.zeros(len(b) + 1, np.int64)
    carry = bytearray(len(a))
    for at in range(0, len(b), COLUMNS):
        part = b[at:at + COLUMNS]
        n = len(part)
        where: dict[str, int] = {}
        for i, x in enumerate(part):
            where[x] = where.get(x, 0) | 1 << i
        full = (1 << n) - 1
        v = full
        for i, y in enumerate(a):
            u = v & where.get(y, 0)
            if u or carry[i]:
                s = v + u + carry[i]
                carry[i] = s >> n
                v = (s | (v - u)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little")
        out[at + 1:at + n + 1] = out[at] + np.cumsum(1 - bits.astype(np.int64))
    return out


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return int(lcs_row(a, b)[-1])


def alignment(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines of one longest common subsequence (Hirschberg 1975: linear space)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    # Lines that stand in one text only align with nothing.
    both = set(a[lo:len(a) - hi]) & set(b[lo:len(b) - hi])
    ia = [i for i in range(lo, len(a) - hi) if a[i] in both]
    ib = [j for j in range(lo, len(b) - hi) if b[j] in both]
    x, y = [a[i] for i in ia], [b[j] for j in ib]
    stack = [(0, len(x), 0, len(y))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        if i1 - i0 == 1:
            for j in range(j0, j1):
                if y[j] == x[i0]:
                    out.append((ia[i0], ib[j]))
                    break
            continue
        mid = (i0 + i1) // 2
        left, right = lcs_row(x[i0:mid], y[j0:j1]), lcs_row(x[mid:i1][::-1], y[j0:j1][::-1])
        cut = int(np.argmax(left + right[::-1]))
        stack += [(i0, mid, j0, j0 + cut), (mid, i1, j0 + cut, j1)]
    out += [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    return sorted(out)


def hunks(a: list[str], b: list[str], around: int = 3, pairs: list[tuple[int, int]] | None = None) -> list[str]:
    """Unified hunks with ``around`` lines of context on both sides."""
    script, i, j = [], 0, 0
    for x, y in [*(alignment(a, b) if pairs is None else pairs), (len(a), len(b))]:
        script += [("-", k, j, a[k]) for k in range(i, x)] + [("+", x, k, b[k]) for k in range(j, y)]
        if x < len(a):
            script.append((" ", x, y, a[x]))
        i, j = x + 1, y + 1
    changed = [k for k, s in enumerate(script) if s[0] != " "]
    out, k = [], 0
    while k < len(changed):
        last = k
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * around:
            last += 1
        part = script[max(0, changed[k] - around):changed[last] + around + 1]
        old, new = sum(s[0] != "+" for s in part), sum(s[0] != "-" for s in part)
        head = f"@@ -{part[0][1] + 1},{old} +{part[0][2] + 1},{new} @@"
        out.append("\n".join([head, *(s[0] + s[3] for s in part)]))
        k = last + 1
    return out


def diffs(pairs: DataFrame, around: int = 3, max_lines: int = 5000) -> DataFrame:
    """(key, additions, deletions, hunks, truncated) of rows (key, old, new); all Arrow batches, any number of pairs.

    Output beyond ``max_lines`` is cut; the stats stay complete.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for old, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = split_lines(old), split_lines(new)
                pairs = alignment(a, b)
                same, shown, used, cut = len(pairs), [], 0, False
                for h in hunks(a, b, around, pairs):
                    used += h.count("\n") + 1
                    if used > max_lines:
                        cut = True
                    else:
                        shown.append(h)
                rows.append((len(b) - same, len(a) - same, shown, cut))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())),
                 pa.array(cols[3], pa.bool_())], ["key", "additions", "deletions", "hunks", "truncated"])

    return pairs.select(F.col("key").cast("string").alias("key"), "old", "new").mapInArrow(
        run, "key string, additions long, deletions long, hunks array<string>, truncated boolean")
