"""Corpus tables ``(file_id, path, content)`` and their line view.

Any table can be bound; a directory tree is read as binary files.  Repeated rows of
one file id are delivered again, not other files, and collapse.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.functions.text import filename
from corposcope.session import table

MAX_FILE_BYTES = 1024 * 1024
#: Extensions (or whole file names) that are indexed. Fixed values.
EXTENSIONS = (
    "rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala", "cs", "fs",
    "ml", "hs", "clj", "ex", "exs", "erl", "lua", "vim", "sh", "bash", "zsh", "fish", "ps1", "bat", "md", "txt", "json", "yaml",
    "yml", "toml", "xml", "html", "css", "scss", "sql", "graphql", "proto", "dockerfile", "makefile", "cmake",
)


@dataclass(frozen=True)
class IndexConfig:
    """Which files a walk delivers."""

    include_hidden: bool = False
    max_file_size: int = MAX_FILE_BYTES
    extensions: tuple[str, ...] = EXTENSIONS


def indexable(path: Column, extensions=EXTENSIONS) -> Column:
    """Whether the extension or the whole file name is on the list, case ignored."""
    name = F.lower(filename(path))
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1).isin(*extensions) | name.isin(*extensions)


def hidden(path: Column) -> Column:
    """Whether any part of the path starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def files(spark: SparkSession, d: str, columns=("path", "content")) -> DataFrame:
    """The indexed files, one row per file id."""
    t = table(spark, d, "files").where("file_id is not null")
    return t.groupBy("file_id").agg(*[F.min(c).alias(c) for c in columns])


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("doc_id is not null")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                       F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("content"))


def walk(spark: SparkSession, root: str, *, include_hidden: bool = False, max_bytes: int = MAX_FILE_BYTES,
         extensions=EXTENSIONS, ignored: tuple[str, ...] = (), load: list[str] | None = None) -> DataFrame:
    """(path, content) of the readable UTF-8 files below a directory.

    Hidden files, files over the size limit, other extensions and paths matching one
    of the ``ignored`` SQL LIKE patterns are left out before their content is read;
    content that is not UTF-8 is dropped.  ``load`` names the paths below ``root`` that are read instead of all.
    """
    if load is not None:
        load = ["".join("\\" + c if c in "*?[]{}\\," else c for c in f"{root.rstrip('/')}/{p}") for p in load]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root if load is None else load)
    path = F.regexp_replace("path", r"^file:(//)?", "")
    rows = raw.where(F.col("length") <= max_bytes).withColumn("path", path).where(indexable(F.col("path"), extensions))
    if not include_hidden:
        base = F.lit(root.rstrip("/") + "/")
        rows = rows.where(~hidden(F.replace(F.col("path"), base, F.lit(""))))
    for pattern in ignored:
        rows = rows.where(~F.col("path").like(pattern))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.select("path", text.alias("content")).where("content is not null")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the index as delivered; an id may come several times with the same path and content."""
    return table(spark, d, "files").where("file_id is not null").select("file_id", "path", "content")


def _split(content: Column) -> Column:
    """Raw lines, split once; a final line end starts no further line, and an empty text has none."""
    body = F.when(F.endswith(content, F.lit("\n")), F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    return F.when(content != "", F.split(body, "\n"))


def line_array(content: Column) -> Column:
    """Lines of a text as an array, split as in ``lines``."""
    return F.transform(_split(content), lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines(corpus: DataFrame, keep: Column | None = None) -> DataFrame:
    """(file_id, path, line_no, line): lines from 1; one trailing carriage return is removed, and no empty
    line follows a final line end. ``keep`` filters lines before anything else is computed."""
    x = corpus.select("file_id", "path", F.posexplode(_split(F.col("content"))).alias("pos", "raw"))
    line = F.when(F.endswith("raw", F.lit("\r")), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    x = x.select("file_id", "path", (F.col("pos") + 1).alias("line_no"), line.alias("line"))
    return x.where(keep) if keep is not None else x
