"""Symbol outlines of source files, from line shapes; ends of blocks from brace depth or indentation."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.functions.text import extension
from corposcope.sources.corpus import line_array

#: (language, kind, pattern with the name as group 1), in order of precedence.
RULES = (
    ("rs", "fn", r"^(?:pub(?:\([a-z]+\))? )?(?:async )?(?:unsafe )?fn ([A-Za-z_]\w*)"),
    ("rs", "struct", r"^(?:pub(?:\([a-z]+\))? )?struct ([A-Za-z_]\w*)"),
    ("rs", "enum", r"^(?:pub(?:\([a-z]+\))? )?enum ([A-Za-z_]\w*)"),
    ("rs", "impl", r"^impl(?:<[^>]*>)? ([^{<]*[^{< ])"),
    ("rs", "trait", r"^(?:pub(?:\([a-z]+\))? )?trait ([A-Za-z_]\w*)"),
    ("rs", "mod", r"^(?:pub(?:\([a-z]+\))? )?mod ([A-Za-z_]\w*)"),
    ("py", "fn", r"^(?:async )?def ([A-Za-z_]\w*)"),
    ("py", "class", r"^class ([A-Za-z_]\w*)"),
    ("js", "fn", r"^(?:export )?(?:async )?function ([A-Za-z_$][\w$]*)"),
    ("js", "class", r"^(?:export )?class ([A-Za-z_$][\w$]*)"),
    ("js", "fn", r"^(?:export )?const ([A-Za-z_$][\w$]*)[^=]*= .*(?:=>|function)"),
    ("go", "fn", r"^func (?:\([^)]*\) *)?([A-Za-z_]\w*)"),
    ("go", "struct", r"^type ([A-Za-z_]\w*).* struct"),
    ("go", "iface", r"^type ([A-Za-z_]\w*).* interface"),
)
BRACES = ("rs", "go", "js")
#: First words of the lines that a rule can match.
_HEADS = r"^[ \t]*(?:pub|async|unsafe|fn|struct|enum|impl|trait|mod|def|class|export|function|const|func|type)\b"
HEAD_DDL = "file_id long, path string, lang string, line_no int, line string, end_line int"


def language(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin("js", "ts", "jsx", "tsx"), "js").when(ext.isin("rs", "py", "go"), ext)


def _heads(corpus: DataFrame) -> DataFrame:
    """(file_id, path, lang, content, heads): possible symbol lines of each file, found inside the row."""
    numbered = F.transform(line_array(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    x = corpus.select("file_id", "path", language(F.col("path")).alias("lang"), "content").where("lang is not null and content is not null")
    return x.withColumn("heads", F.filter(numbered, lambda s: s["line"].rlike(_HEADS))).where("size(heads) > 0")


def _named(heads: DataFrame) -> DataFrame:
    """Adds kind, name, level and indent; lines that are no symbol drop out."""
    x = heads.withColumn("body", F.regexp_replace("line", r"^[ \t]+", ""))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, k, rx in reversed(RULES):
        hit = (F.col("lang") == lang) & F.col("body").rlike(rx)
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("body", rx, 1)).otherwise(name)
    indent = F.length("line") - F.length("body")
    return x.withColumns({"kind": kind, "name": name, "indent": indent, "level": F.floor(indent / 4).cast("int")}).where("kind is not null").drop("body")


def symbols(corpus: DataFrame) -> DataFrame:
    """(file_id, path, lang, kind, name, line_no, level, indent); other file types have no symbols."""
    heads = _heads(corpus).select("file_id", "path", "lang", F.explode("heads").alias("h")).select("file_id", "path", "lang", "h.line_no", "h.line")
    return _named(heads).select("file_id", "path", "lang", "kind", "name", "line_no", "level", "indent")


def brace_end(raw: bytes, at: list[int]) -> list[int | None]:
    """End line of the block that begins on each line of ``at`` (from 1), None if it never closes.

    Braces count from the line on, those in text and comments too; the block ends where
    the count returns to zero, at a closing brace or a line end behind the first opening one.
    """
    flat = np.frombuffer(raw, np.uint8)
    place = np.flatnonzero((flat == 123) | (flat == 125) | (flat == 10))
    sign = np.r_[flat[place], np.uint8(10)]  # the text's end ends its last line
    depth = np.cumsum((sign == 123).astype(np.int64) - (sign == 125))
    line = np.r_[0, np.cumsum(sign == 10)[:-1]]  # line of each event, from 0
    opens = np.flatnonzero(sign == 123)
    ends = np.flatnonzero(sign != 123)
    order = np.lexsort((ends, depth[ends]))
    ends, level = ends[order], depth[ends[order]]
    out: list[int | None] = []
    for n in at:
        first = int(np.searchsorted(line, n - 1))
        base = int(depth[first - 1]) if first else 0
        k = int(np.searchsorted(opens, first))
        if k == opens.size:
            out.append(None)
            continue
        a, b = np.searchsorted(level, base), np.searchsorted(level, base, side="right")
        i = a + int(np.searchsorted(ends[a:b], opens[k]))
        out.append(int(line[ends[i]]) + 1 if i < b else None)
    return out


def indent_end(raw: bytes, at: list[int]) -> list[int | None]:
    """Last line that is not blank before the indentation returns to that of each line of ``at`` (from 1)."""
    rows = [(n, len(x) - len(x.lstrip())) for n, x in enumerate(raw.split(b"\n"), 1) if x.strip()]
    stop: dict[int, int] = {}
    open_: list[tuple[int, int]] = []
    last = 0
    for n, indent in rows:
        while open_ and open_[-1][1] >= indent:
            stop[open_.pop()[0]] = last
        open_.append((n, indent))
        last = n
    return [stop.get(n, last) for n in at]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = batch.column(4)
        size = pc.list_value_length(heads).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = heads.flatten()
        numbers = flat.field("line_no").to_pylist()
        done, k = [], 0
        for lang, text, n in zip(batch.column(2).to_pylist(), batch.column(3), size.tolist()):
            done += (brace_end if lang in BRACES else indent_end)(text.as_buffer().to_pybytes(), numbers[k:k + n])
            k += n
        row = pa.array(np.repeat(np.arange(batch.num_rows), size))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(3)), flat.field("line_no"), flat.field("line"), pa.array(done, pa.int32())],
                                         ["file_id", "path", "lang", "line_no", "line", "end_line"])


def outline(corpus: DataFrame) -> DataFrame:
    """(file_id, path, lang, kind, name, line_no, end_line, level): one pass over the text, no join and no shuffle.

    Blocks of Rust, Go and JavaScript end by braces, those of Python by indentation.
    """
    return _named(_heads(corpus).mapInArrow(_ended, HEAD_DDL)).select("file_id", "path", "lang", "kind", "name", "line_no", "end_line", "level")


def brace_ends(corpus: DataFrame) -> DataFrame:
    """(file_id, line_no, end_line) of the symbols whose blocks close by braces."""
    return outline(corpus).where(F.col("lang").isin(*BRACES) & F.col("end_line").isNotNull()).select("file_id", "line_no", "end_line")


def indent_ends(corpus: DataFrame) -> DataFrame:
    """(file_id, line_no, end_line) of the symbols whose blocks end by indentation."""
    return outline(corpus).where("lang = 'py'").select("file_id", "line_no", "end_line")
