"""Evaluation texts inside a training corpus, verbatim or with other parameters.

Words are canonicalised: numbers, units and names become typed placeholders, and
only template words (those of at least ``template_share`` of the items) stay.  Every
window of ``width`` canonical words of the items is hashed, and every window of
every document is looked up among these hashes.  A hit is then judged by its
slots: equal words mean a verbatim passage; different words that replace the item's
words one to one along a stretch of the aligned run mean the same question with new
parameters; the longest such stretch counts.  Verbatim passages cannot be missed, since equal words have equal
canonical forms.

Item windows are a table.  Tasks over the documents keep only windows whose hash is
marked in a bit table of the item windows (``1 << BITS`` bits, whatever the number of
items); these are joined with the item windows by hash, and the aligned windows of
one document and item are judged as a stream sorted by position.  So documents are
read once, no item text reaches the driver, and Spark picks the join by size.

Edge cases: null or empty texts, and texts shorter than the window, have no
windows; repeated items or documents give one row per pair of ids; a word is a
maximal run of letters or digits of any script, case ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm.textarrays import CHUNK, chunks, run_hashes, utf8, windows
from corposcope.session import spread, staged

WIDTH = 13
BITS = 26  #: the bit table has 8 MB
#: Words that count or measure. Fixed values.
UNITS = ("ns", "us", "ms", "s", "sec", "secs", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "b", "kb", "mb", "gb",
         "tb", "byte", "bytes", "bit", "bits", "char", "chars", "characters", "line", "lines", "row", "rows", "column", "columns", "entry", "entries", "item",
         "items", "unit", "units", "time", "times", "percent", "hz", "khz", "mhz", "ghz", "m", "km", "cm", "mm", "kg", "g", "px", "usd", "eur")
NUM, UNIT, NAME = (np.uint64(k) for k in (11, 12, 13))
_tables: list[np.ndarray] = []


def _unicode() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter or digit, digit, lower case) of every code point, built once per process."""
    if not _tables:
        every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        _tables.append(np.fromiter((c.isalnum() for c in every), bool, len(every)))
        _tables.append(np.fromiter((c.isdigit() for c in every), bool, len(every)))
        _tables.append(np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.uint32, len(every)))
    return tuple(_tables)


class Words:
    """Words of several texts: hash, number flag and text number of each."""

    def __init__(self, texts: list[str | None]):
        word, digit, lower = _unicode()
        joined = "\n".join(t or "" for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        base = np.cumsum([0] + [len(t or "") + 1 for t in texts])
        inside = word[cp]
        start, end, self.hash = run_hashes(lower[cp], inside)
        digits = np.r_[0, np.cumsum(digit[cp], dtype=np.int32)]
        self.number = digits[end] - digits[start] == end - start
        self.text = np.searchsorted(base, start, side="right") - 1

    def canonical(self, template: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Code of each word: its own hash for template words, else a placeholder's."""
        code = np.full(self.hash.size, NAME)
        code[_among(self.hash, units)] = UNIT
        code[self.number] = NUM
        own = _among(self.hash, template)
        code[own] = self.hash[own]
        return code

    def windows(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each window, whether it lies within one text)."""
        h = windows(codes, width)
        return h, self.text[:h.size] == self.text[width - 1:][:h.size]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not ordered.size:
        return np.zeros(x.size, bool)
    at = np.minimum(np.searchsorted(ordered, x), ordered.size - 1)
    return ordered[at] == x


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(Words(list(words)).hash) if words else np.zeros(0, np.uint64)


def _at(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """[n, width] word hashes of the windows that begin at ``at``."""
    return hashes[at[:, None] + np.arange(width)]


def _exact(words: np.ndarray) -> np.ndarray:
    """Hash of each row of words, as ``windows`` gives it."""
    return windows(words.ravel(), words.shape[1])[::words.shape[1]] if words.size else np.zeros(0, np.uint64)


WINDOW_DDL = "canon long, id long, t long, pos long, exact long, words array<long>"


def _window_rows(template: np.ndarray, width: int, marked: np.ndarray | None):
    """Windows (canon, id, text number, position, exact hash, words) of (id, text) rows; only those whose bit is marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        units = _hashes(list(UNITS))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, off = utf8(batch.column(1))
            for a, b in chunks(off, CHUNK):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                w = Words(texts)
                h, ok = w.windows(w.canonical(template, units), width)
                if marked is not None and h.size:
                    bit = h >> np.uint64(64 - BITS)
                    ok = ok & (marked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(ok)
                if not at.size:
                    continue
                text = w.text[at]
                base = np.searchsorted(w.text, text)  # positions count from the text's first word
                number = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) for t in texts], np.uint64)
                for i in range(0, at.size, 100_000):
                    k = slice(i, i + 100_000)
                    words = _at(w.hash, at[k], width)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(words.shape[0] + 1, dtype=np.int32) * width), pa.array(words.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[at[k]].view(np.int64)), pa.array(ids[a:b][text[k]]), pa.array(number[text[k]].view(np.int64)), pa.array(at[k] - base[k]),
                         pa.array(_exact(words).view(np.int64)), lists], ["canon", "id", "t", "pos", "exact", "words"])
    return run


def _consistent(doc: np.ndarray, item: np.ndarray) -> bool:
    """Whether words of the document replace those of the item one to one."""
    pairs = np.unique(np.stack((item, doc)), axis=1)
    return np.unique(pairs[0]).size == pairs.shape[1] == np.unique(pairs[1]).size


def _longest_consistent(doc: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest stretch in which words of the document replace those of the item one to one."""
    if _consistent(doc, item):
        return doc.size
    best = left = 0
    by_item: dict[int, tuple[int, int]] = {}  # word -> its last position and the word opposite
    by_doc: dict[int, tuple[int, int]] = {}
    for k, (d, i) in enumerate(zip(doc.tolist(), item.tolist())):
        for seen, own, other in ((by_item, i, d), (by_doc, d, i)):
            at, opposite = seen.get(own, (-1, other))
            if opposite != other:
                left = max(left, at + 1)
            seen[own] = (k, other)
        best = max(best, k + 1 - left)
    return best


LEAK_DDL = "doc_id long, item_id long, verbatim_windows long, template_run long"


def _judge(width: int, least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Aligned windows sorted by (document, text, item, text, shift, position) -> counts and longest consistent runs."""
        held: tuple | None = None  # key, next position, document words, item words of the run that is open

        def close(out):
            if held is not None and len(held[2]) >= least_run:
                n = _longest_consistent(np.array(held[2]), np.array(held[3]))
                if n >= least_run:
                    out.append((held[0][0], held[0][2], 0, n))

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            doc_words, item_words = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for k in (7, 8))
            for i, (*key, pos, same) in enumerate(zip(*(c.tolist() for c in cols))):
                if same:
                    out.append((key[0], key[2], 1, 0))
                if held is not None and held[0] == key and held[1] == pos:
                    held[2].append(int(doc_words[i, -1])), held[3].append(int(item_words[i, -1]))
                    held = (key, pos + 1, held[2], held[3])
                else:
                    close(out)
                    held = (key, pos + 1, doc_words[i].tolist(), item_words[i].tolist())
            yield _rows(out)
        out = []
        close(out)
        yield _rows(out)
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "verbatim_windows", "template_run"])


def template_words(items: DataFrame, share: float) -> list[str]:
    """Words that at least ``share`` of the items (and two) use; their number is bounded by item length / share."""
    n = items.count()
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("item_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return [r["w"] for r in items.select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") >= max(2, share * n)).orderBy("w").collect()]


def leaks(documents: DataFrame, items: DataFrame, *, width: int = WIDTH, template_share: float = 0.05, least_run: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, verbatim_windows, template_run) of every document and item that share a passage.

    ``verbatim_windows`` counts windows of ``width`` equal words; ``template_run`` is
    the longest aligned run of at least ``least_run`` words with consistent slots, else 0.
    """
    items = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("long").alias("item_id"), "item_text").distinct()
    template = _hashes(template_words(items, template_share))
    known = staged(items.mapInArrow(_window_rows(template, width, None), WINDOW_DDL), "item-windows")
    bit = F.shiftrightunsigned("canon", 64 - BITS)
    marks = (known.select(F.shiftright(bit, 15).alias("block"), bit.bitwiseAND(F.lit((1 << 15) - 1).cast("long")).alias("bit")).groupBy("block")
                  .agg(F.bitmap_construct_agg("bit").alias("bits")).collect())  # at most 2,048 rows of 4 KB
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for r in marks:
        table[r["block"] << 12:(r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    shipped = documents.sparkSession.sparkContext.broadcast(table)

    def hits(batches):
        yield from _window_rows(template, width, shipped.value)(batches)

    docs = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = docs.mapInArrow(hits, WINDOW_DDL).join(known.select("canon", *[F.col(c).alias(f"i{c}") for c in ("id", "t", "pos", "exact", "words")]), "canon")
    keys = ["id", "t", "iid", "it", "shift"]
    aligned = found.select("id", "t", "iid", "it", (F.col("pos") - F.col("ipos")).alias("shift"), "pos", (F.col("exact") == F.col("iexact")).alias("same"), "words", "iwords")
    judged = aligned.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(_judge(width, least_run), LEAK_DDL)
    return (judged.groupBy("doc_id", "item_id").agg(F.sum("verbatim_windows").alias("verbatim_windows"), F.max("template_run").alias("template_run")))
