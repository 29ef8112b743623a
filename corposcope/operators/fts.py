"""Full-text search: tokens, postings, BM25 with field weights, prefixes, phrases and field filters.

Terms of a query are counted inside each row's token arrays, so only files that
hold every term leave the scan; corpus statistics are a handful of numbers.  The
index for repeated queries holds ``posting_rows``, written sorted by stem.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.functions.regexq import parse_query
from corposcope.functions.text import clamp, filename, fold, tokens
from corposcope.session import spread, staged

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"path": 5.0, "filename": 10.0, "content": 1.0}
SCALE = 15.0


def token_columns() -> list[Column]:
    """t_path, t_filename, t_content: token arrays of each field."""
    return [tokens(F.col("path")).alias("t_path"), tokens(filename(F.col("path"))).alias("t_filename"),
            tokens(F.coalesce("content", F.lit(""))).alias("t_content")]


def tokenized(corpus: DataFrame) -> DataFrame:
    return corpus.select("file_id", "path", *token_columns())


def postings(corpus: DataFrame) -> DataFrame:
    """(term, file_id, field, tf): the inverted index of a corpus with one row per file, counted before the shuffle."""
    t = tokenized(corpus)
    every = None
    for field in FIELD_WEIGHTS:
        one = t.select("file_id", F.lit(field).alias("field"), F.explode(f"t_{field}").alias("term"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("term", "file_id", "field").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """(file_id, length): tokens over all fields."""
    return tokenized(corpus).select("file_id", sum((F.size(f"t_{f}") for f in FIELD_WEIGHTS), F.lit(0)).alias("length"))


POSTING_DDL = "stem string, term string, file_id long, path_tf int, filename_tf int, content_tf int, length int"


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token arrays of each file -> one row for each of its terms, and one without a term that has its length."""
    from corposcope.functions.stem import stem

    stems: dict[str, str] = {}
    for batch in batches:
        n = batch.num_rows
        lists = [batch.column(c) for c in (1, 2, 3)]
        size = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        owner = np.concatenate([pc.list_parent_indices(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        field = np.repeat(np.arange(3), [len(x.flatten()) for x in lists])
        words = len(coded.dictionary)
        key, at = np.unique(owner * words + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        tf = np.bincount(at * 3 + field, minlength=3 * key.size).reshape(-1, 3).astype(np.int32)
        if len(stems) > 2_000_000:
            stems.clear()
        named = []
        for w in coded.dictionary.to_pylist():
            s = stems.get(w)
            if s is None:
                s = stems[w] = stem(w)
            named.append(s)
        row, code = (pa.array(x) for x in np.divmod(key, max(words, 1)))
        ids = batch.column(0)
        length = pa.array(size.astype(np.int32))
        if key.size:
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()).take(code), coded.dictionary.take(code), ids.take(row), *(pa.array(tf[:, j]) for j in range(3)), length.take(row)],
                                             ["stem", "term", "file_id", "path_tf", "filename_tf", "content_tf", "length"])
        none, zero = pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32))
        yield pa.RecordBatch.from_arrays([none, none, ids, zero, zero, zero, length], ["stem", "term", "file_id", "path_tf", "filename_tf", "content_tf", "length"])


def posting_rows(corpus: DataFrame) -> DataFrame:
    """(stem, term, file_id, tf of each field, length) of a corpus with one row per file; the row without a term has a file's length.

    Terms are counted and stemmed inside the row, so nothing is shuffled before the index is written.
    """
    return tokenized(spread(corpus.select("file_id", "path", "content"))).select("file_id", "t_path", "t_filename", "t_content").mapInArrow(_posting_rows, POSTING_DDL)


def term_df(corpus: DataFrame) -> DataFrame:
    """(term, df): number of files with the term in any field."""
    all_tokens = F.array_distinct(F.concat("t_path", "t_filename", "t_content"))
    pairs = tokenized(corpus).select("file_id", F.explode(all_tokens).alias("term")).distinct()
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _frequency(words: str, term: str | tuple, prefix: bool) -> Column:
    """How many elements of an array column are the term (or one of several), or start with it."""
    if isinstance(term, tuple):
        return F.size(F.filter(words, lambda x: x.isin(*term)))
    return F.size(F.filter(words, (lambda x: F.startswith(x, F.lit(term))) if prefix else (lambda x: x == term)))


def frequencies(terms: list[tuple[str, bool]], fields=tuple(FIELD_WEIGHTS), weights=FIELD_WEIGHTS) -> dict[str, Column]:
    """length and f0, f1, ... (weighted frequency of each query term) over the columns of ``tokenized``."""
    out = {"length": sum((F.size(f"t_{f}") for f in FIELD_WEIGHTS), F.lit(0))}
    for i, (term, prefix) in enumerate(terms):
        out[f"f{i}"] = sum((F.lit(weights[f]) * _frequency(f"t_{f}", term, prefix) for f in fields), F.lit(0.0))
    return out


def statistics(n_terms: int) -> list[Column]:
    """Corpus numbers for ``bm25_score``: n, avg and df0, df1, ..."""
    return [F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"df{i}") for i in range(n_terms)]]


def bm25_score(n_terms: int, stats) -> Column:
    """Published BM25 (k1=1.2, b=0.75) of rows with every term, else null; the idf is floored at 1e-6."""
    n, avg = float(stats["n"]), float(stats["avg"] or 1.0) or 1.0
    score, keep = F.lit(0.0), F.lit(n_terms > 0)
    for i in range(n_terms):
        f, df = F.col(f"f{i}"), F.lit(float(stats[f"df{i}"]))
        idf = F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / avg))
        keep = keep & (f > 0)
    return F.when(keep, score)


def bm25(corpus: DataFrame, terms: list[tuple[str, bool]], fields=tuple(FIELD_WEIGHTS), weights=FIELD_WEIGHTS) -> DataFrame:
    """(file_id, path, bm25) of the files that hold every term; a prefix counts as one term, no terms give no rows."""
    cols = frequencies(terms, fields, weights)
    narrow = tokenized(spread(corpus.select("file_id", "path", "content"))).select("file_id", "path", *[c.alias(k) for k, c in cols.items()]).dropDuplicates(["file_id"])
    narrow = staged(narrow, "fts")
    stats = narrow.agg(*statistics(len(terms))).first()
    return narrow.select("file_id", "path", bm25_score(len(terms), stats).alias("bm25")).where("bm25 is not null")


def search(corpus: DataFrame, query: str) -> DataFrame:
    """(file_id, path, fts_score) of a query string, scaled to [0, 1]."""
    field, terms = parse_query(query)
    found = bm25(corpus, terms, (field,) if field else tuple(FIELD_WEIGHTS))
    return found.select("file_id", "path", clamp(F.col("bm25") / SCALE).alias("fts_score"))


def phrase(corpus: DataFrame, words: str) -> DataFrame:
    """(file_id, path, hits): files whose content has the words next to each other, quotes ignored."""
    _, terms = parse_query(words.replace('"', " "))
    want = [t for t, _ in terms]
    # Token streams with single spaces; a zero-width match also counts phrases that overlap themselves.
    stream = F.concat(F.lit(" "), F.array_join("t_content", " "), F.lit(" "))
    hit = F.regexp_count(stream, F.lit(f"(?= {' '.join(want)} )")) if want else F.lit(0)
    t = tokenized(corpus.where(F.contains(fold(F.col("content")), F.lit(want[0] if want else ""))))
    return t.select("file_id", "path", hit.alias("hits")).where("hits > 0")


def filename_search(corpus: DataFrame, query: str) -> DataFrame:
    """Files whose name holds every word of the query."""
    return search(corpus, "filename:" + query)
