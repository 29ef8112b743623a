"""The best files of many full-text queries at once, on one narrow row for each file.

A file's row lists the asked words that it holds, so it never has to be joined with
the queries: a task takes its files in blocks and answers every query on each block
with a few vector operations.  A query starts from its rarest word in the block, and
files that cannot reach the k-th score found so far leave first.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corposcope.operators import fts

HELD_DDL = "file_id long, length int, ws array<long>, fs array<double>"
BEST_DDL = "q long, file_id long, fts_score double"
UNIT = 1_000_000  #: scores are whole multiples of 1 / UNIT
BLOCK = 4096  #: files of a block, at most
FIRST = 256  #: files of a task's first block, which gives the first bounds
CELLS = 4_000_000  #: gains of a block as a table of words and files, about as many at most
PIECE = 120_000  #: pairs of queries and files at a time, few enough for a core's cache
NEW = 1_000_000  #: rows found, at least, before they are merged with the best so far
_SMALL = 1e-9  #: above the rounding errors of a sum of gains


def held_words(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, str, bool]]) -> Iterator[pa.RecordBatch]:
    """(file_id, t_path, t_filename, t_content) -> HELD_DDL; ``asked`` has (w, stem, is prefix)."""
    from corposcope.functions.stem import stem

    ids = np.array([w for w, _, _ in asked], np.int64)
    whole = {s: i for i, (_, s, prefix) in enumerate(asked) if not prefix}
    heads = {s: i for i, (_, s, prefix) in enumerate(asked) if prefix}
    sizes = sorted({len(s) for s in heads})
    known: dict[str, list[int]] = {}

    def words(term: str) -> list[int]:
        s = stem(term)
        return [x for x in (whole.get(s), *(heads.get(s[:n]) for n in sizes if n <= len(s))) if x is not None]

    weights = np.array(list(fts.FIELD_WEIGHTS.values()))
    for batch in batches:
        n, lists = batch.num_rows, [batch.column(c) for c in (1, 2, 3)]
        sizes_of = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        if len(known) > 2_000_000:
            known.clear()
        named = []
        for term in coded.dictionary.to_pylist():
            found = known.get(term)
            if found is None:
                found = known[term] = words(term)
            named.append(found)
        many = np.array([len(x) for x in named], np.int64)
        first = np.cumsum(many) - many
        flat = np.array([w for x in named for w in x], np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(many[code]) if code.size else np.zeros(0, np.int64)  # tokens of asked words
        owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes_of])[at]
        weight = np.repeat(weights, [s.sum() for s in sizes_of])[at]
        times = many[code[at]] if at.size else at
        word = flat[np.repeat(first[code[at]], times) + _inside(times)] if at.size else at
        key, place = np.unique(np.repeat(owner, times) * max(len(asked), 1) + word, return_inverse=True)
        row, word = np.divmod(key, max(len(asked), 1))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
        fs = np.bincount(place, np.repeat(weight, times), key.size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sum(sizes_of).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids[word], pa.int64())),
                                          pa.ListArray.from_arrays(offsets, pa.array(fs, pa.float64()))], ["file_id", "length", "ws", "fs"])


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass(frozen=True)
class Asked:
    """Queries as sets of words: their ids, the words of all (sorted) with their idf, and by number of words (rows of ids, words of each)."""

    ids: np.ndarray
    words: np.ndarray
    idf: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray]]
    average: float

    @classmethod
    def of(cls, table: pa.Table, n: float, average: float) -> Asked:
        """``table`` has (q, ws, dfs); every word of a query is held by some file."""
        ids = table.column("q").to_numpy().astype(np.int64)
        sizes = pc.list_value_length(table.column("ws")).to_numpy().astype(np.int64)
        words, first, place = np.unique(pc.list_flatten(table.column("ws")).to_numpy().astype(np.int64), return_index=True, return_inverse=True)
        df = pc.list_flatten(table.column("dfs")).to_numpy().astype(float)[first]
        starts = np.cumsum(sizes) - sizes
        groups = [(rows, place[starts[rows][:, None] + np.arange(m)]) for m in np.unique(sizes) for rows in [np.flatnonzero(sizes == m)]]
        return cls(ids, words, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6), groups, average)


def best_files(batches: Iterator[pa.RecordBatch], asked: Asked, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of HELD_DDL -> the k best files of each query among them, ties by id."""
    if not asked.ids.size:
        return
    least = np.full(asked.ids.size, -1, np.int64)  # score, in units, that a file must reach to be among the k best
    best = (np.zeros(0, np.int64),) * 3
    new: list[tuple] = []
    for block in _blocks(batches, int(np.clip(CELLS // asked.words.size, 64, BLOCK))):
        new += _answers(block, asked, k, least)
        if sum(x[0].size for x in new) > max(NEW, best[0].size):
            best, new = _merged([best, *new], k, least), []
    q, score, file = _merged([best, *new], k, least)
    for i in range(0, q.size, 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q[s]]), pa.array(file[s]), pa.array(score[s] / UNIT)], ["q", "file_id", "fts_score"])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    size = min(FIRST, most)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, size)
            at, size = at + size, min(2 * size, most)


def _merged(parts: list[tuple], k: int, least: np.ndarray) -> tuple:
    """The k best (query, score, file) of each query; raises the bounds to their last scores."""
    q, score, file = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((file, -score, q))
    q, score, file = q[order], score[order], file[order]
    return _first(q, k, least, q, score, file)


def _first(group: np.ndarray, k: int, least: np.ndarray, q: np.ndarray, score: np.ndarray, file: np.ndarray) -> tuple:
    """The first k rows of each group of sorted rows."""
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if group.size else np.zeros(0, np.int64)
    rank = _inside(np.diff(np.append(begins, group.size)))
    last = rank == k - 1
    least[q[last]] = np.maximum(least[q[last]], score[last])
    keep = rank < k
    return q[keep], score[keep], file[keep]


def _answers(block: pa.RecordBatch, asked: Asked, k: int, least: np.ndarray) -> Iterator[tuple]:
    """(query, score, file) arrays with the k best files of a block for each query, less those below the bounds."""
    n = block.num_rows
    file = block.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(file)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    file = file[order]
    sizes = pc.list_value_length(block.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, length = np.repeat(place, sizes), np.repeat(block.column(1).to_numpy(zero_copy_only=False), sizes)
    w, f = block.column(2).flatten().to_numpy(zero_copy_only=False), block.column(3).flatten().to_numpy(zero_copy_only=False)
    word = np.minimum(np.searchsorted(asked.words, w), asked.words.size - 1)
    mine = asked.words[word] == w
    owner, length, word, f = owner[mine], length[mine], word[mine], f[mine]
    gain = asked.idf[word] * f * (fts.K1 + 1) / (f + fts.K1 * (1 - fts.B + fts.B * length / asked.average))
    # Entries by word and falling gain, and as a table of the words that the block has.
    top = gain.max(initial=_SMALL)
    fall = 2.0 * word + (1.0 - gain / top)
    by = np.argsort(fall)
    owner, gain, word, fall = owner[by], gain[by], word[by], fall[by]
    held = np.bincount(word, minlength=asked.words.size)
    begin = np.cumsum(held) - held
    row = np.cumsum(held > 0) - 1
    most = np.zeros(asked.words.size)
    most[held > 0] = np.maximum.reduceat(gain, begin[held > 0]) if gain.size else 0.0
    cells, lacks = np.zeros(int((held > 0).sum()) * n), np.full(int((held > 0).sum()) * n, -np.inf)
    lack = gain - most[word]  # what a file has less than the word's most; without the word it is out
    cells[row[word] * n + owner], lacks[row[word] * n + owner] = gain, lack
    for rows, words in asked.groups:
        need = (least[rows] - 0.5) * (fts.SCALE / UNIT) - _SMALL
        total = most[words].sum(axis=1)
        on = np.flatnonzero((held[words] > 0).all(axis=1) & (total >= need))
        rows, words, need, total = rows[on], words[on], need[on], total[on]
        # Of each word the files whose gain is enough if all others give their most; a query starts from the shortest such list.
        enough = (need - total)[:, None] + most[words]
        count = np.searchsorted(fall, 2.0 * words + np.clip(1.0 - enough / top + 1e-6, 0.0, 1.5), "right") - begin[words]
        order = np.argsort(count, axis=1, kind="stable")
        words, count = np.take_along_axis(words, order, axis=1), np.take_along_axis(count, order, axis=1)[:, 0]
        cuts = np.flatnonzero(np.diff(np.cumsum(count) // PIECE)) + 1
        for piece in np.split(np.arange(rows.size), cuts):
            ws, c = words[piece], count[piece]
            at_row = row[ws] * n
            at = np.repeat(begin[ws[:, 0]], c) + _inside(c)
            q, at_file = np.repeat(np.arange(piece.size), c), owner[at]
            spare = np.repeat(total[piece] - need[piece], c) + lack[at]  # what other words may lack
            for j in range(1, ws.shape[1]):
                spare += lacks[at_row[:, j][q] + at_file]
                able = np.flatnonzero(spare >= 0)
                q, at_file, spare = q[able], at_file[able], spare[able]
            total_of = sum((cells[at_row[:, j][q] + at_file] for j in range(ws.shape[1])), np.zeros(q.size))
            score = np.floor(np.minimum(total_of / fts.SCALE, 1.0) * UNIT + 0.5).astype(np.int64)
            key = np.sort(((q << 20) + (UNIT - score) << 13) + at_file)  # UNIT < 2 ** 20, BLOCK < 2 ** 13
            q, score, at_file = key >> 33, UNIT - ((key >> 13) & (2**20 - 1)), key & (2**13 - 1)
            q = rows[piece][q]
            yield _first(q, k, least, q, score, file[at_file])
