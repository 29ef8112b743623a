"""Sparse n-grams over bytes, vectorised.

A byte pair has a fixed pseudo-random weight.  The n-gram from pair L to pair R is
valid if both end weights exceed every weight between them; its length is 3 to 16
bytes.  Validity depends only on the bytes of the n-gram, so each n-gram of a
literal is found in every text that holds the literal, and a text holds an n-gram
exactly if it contains its bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LEN, MAX_LEN = 3, 16
CHUNK = 1_000_000
_OFFSET_BASIS, _PRIME, _MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF  #: published FNV-1a constants


def weight_table() -> np.ndarray:
    """[256, 256] weights: FNV-1a over both bytes, folded to 16 bits."""
    a = np.arange(256, dtype=np.uint64)[:, None]
    b = np.arange(256, dtype=np.uint64)[None, :]
    h = ((a ^ np.uint64(_OFFSET_BASIS)) * np.uint64(_PRIME)) & np.uint64(_MASK)
    h = ((h ^ b) * np.uint64(_PRIME)) & np.uint64(_MASK)
    return ((h >> np.uint64(16)) ^ (h & np.uint64(0xFFFF))).astype(np.int32)


_WEIGHTS = weight_table()


def weight_column(a: Column, b: Column) -> Column:
    """Weight of a byte pair, from two byte values."""
    step = lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(_PRIME).cast("long"), F.lit(_MASK + 1))
    h = step(step(F.lit(_OFFSET_BASIS).cast("long"), a.cast("long")), b.cast("long"))
    return F.shiftright(h, 16).bitwiseXOR(h.bitwiseAND(F.lit(0xFFFF).cast("long")))


def spans(flat: np.ndarray, text_end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts of valid n-grams of that length); ``text_end[i]`` is the end of the text of byte i."""
    if flat.size < MIN_LEN:
        return
    w = _WEIGHTS[flat[:-1], flat[1:]]
    inner = np.zeros(w.size, np.int32)
    for k in range(1, MAX_LEN - 1):
        if w.size <= k:
            return
        left, right, most = w[:-k], w[k:], inner[:w.size - k]
        ok = (left > most) & (right > most) & (np.arange(w.size - k) + k + 2 <= text_end[:w.size - k])
        yield k + 2, np.flatnonzero(ok)
        inner = np.maximum(inner[:w.size - k], right)  # pairs L+1 .. L+k


def ngrams(text: bytes) -> set[bytes]:
    """All valid n-grams of a text."""
    flat = np.frombuffer(text, np.uint8)
    ends = np.full(flat.size, flat.size)
    return {text[i:i + n] for n, at in spans(flat, ends) for i in at.tolist()}


def covering(text: bytes) -> list[bytes]:
    """Few n-grams that cover a literal: from left to right the longest valid one, else one byte further.

    A literal of less than three bytes has none, which means that it cannot filter.
    """
    flat = np.frombuffer(text, np.uint8)
    longest = np.zeros(flat.size + 1, int)
    for n, at in spans(flat, np.full(flat.size, flat.size)):
        longest[at] = n
    out, i = [], 0
    while i + MIN_LEN <= flat.size:
        if longest[i]:
            out.append(text[i:i + longest[i]])
            i += longest[i]
        else:
            i += 1
    return out


def key(ngram: bytes) -> int:
    """64-bit key of an n-gram as stored in the index."""
    return int(_keys(np.frombuffer(ngram, np.uint8), np.zeros(1, int), len(ngram)).view(np.int64)[0])


_M = np.uint64(0x9E3779B97F4A7C15)


def _keys(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(at.size, n, np.uint64)
    for j in range(n):
        h = (h ^ flat[at + j]) * _M
        h ^= h >> np.uint64(29)
    return h


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, content) -> distinct (ngram, file_id) keys, many files per vector operation."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).fill_null("").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
            b = min(b, len(texts))
            flat, local = raw[off[a]:off[b]], off[a:b + 1] - off[a]
            doc = np.repeat(np.arange(b - a), np.diff(local))
            keys, docs = [], []
            for n, at in spans(flat, local[1:][doc] if flat.size else flat):
                keys.append(_keys(flat, at, n)), docs.append(doc[at])
            if keys:
                k, d = np.concatenate(keys).view(np.int64), np.concatenate(docs)
                order = np.lexsort((k, d))
                k, d = k[order], d[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(ids[a:b][d[new]])], ["ngram", "file_id"])
            a = b


def contains_all(content: Column, keys: list[bytes]) -> Column:
    """Whether a text holds every n-gram: the index test without an index, inside the scan."""
    raw = content.cast("binary")
    out = F.lit(True)
    for k in dict.fromkeys(keys):
        out = out & F.contains(raw, F.lit(bytearray(k)))
    return out


def index(corpus: DataFrame) -> DataFrame:
    """(ngram, file_id): distinct keys per file."""
    return corpus.select("file_id", "content").mapInArrow(extract, "ngram long, file_id long")
