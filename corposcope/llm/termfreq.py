"""Occurrences and document frequency of every distinct term, by merged bitmaps.

Vertical layout: each term owns compressed bitmaps of record ids, one container
per 65,536 ids, holding either sorted 16-bit offsets or 8 KB of bits, whichever
is smaller.  Tasks build containers for their own rows, only containers are
shuffled, and they merge by union; document frequency is their cardinality.
A container is at most 8 KB, so a hot term cannot make a group grow with its
occurrences: it adds one bounded container per task and id range, and these are
merged as a stream.

Edge cases: null terms are not terms, but their ids count as ids of the table;
null ids and null or empty lists add nothing, so a term met only with empty
lists has no row; repeated rows repeat occurrences but not records; negative
ids are ordinary ids; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.session import staged

SPARSE = 4096  #: offsets beyond this many take more room than the bits
FLUSH = 2_000_000  #: ids a task holds before it emits containers
OPEN = 1000  #: rows of an unfinished group that are held, at most 8 KB each
CELL = pa.schema([("term", pa.string()), ("block", pa.int64()), ("occ", pa.int64()),
                  ("n", pa.int32()), ("bits", pa.binary())])
CELL_DDL = "term string, block long, occ long, n int, bits binary"


def _pack(low: np.ndarray) -> bytes:
    if low.size <= SPARSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(low: np.ndarray, start: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Containers of the ranges [start, ends) of ``low``, which follow each other; offsets stay where they lie."""
    if start.size and (ends - start).max() <= SPARSE and low.size < 1 << 30:
        edge = np.r_[start, ends[-1]].astype(np.int32) * 2
        return pa.Array.from_buffers(pa.binary(), start.size, [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(low, "<u2"))])
    return pa.array([_pack(low[a:b]) for a, b in zip(start, ends)], pa.binary())


def _unpack(n: int, raw: bytes) -> np.ndarray:
    if n <= SPARSE:
        return np.frombuffer(raw, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).astype(np.uint16)


def _cells(codes: np.ndarray, ids: np.ndarray, names: list) -> Iterator[pa.RecordBatch]:
    """Containers of (code, id) pairs; code -1 is the set of all ids."""
    if not codes.size:
        return
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    first = np.r_[True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]
    at = np.flatnonzero(first)
    times = np.diff(np.r_[at, codes.size])
    codes, ids = codes[at], ids[at]
    block = ids >> 16
    start = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[start[1:], codes.size]
    low = (ids & 0xFFFF).astype("<u2")
    occ = np.add.reduceat(times, start)
    code = codes[start]
    term = pa.array(names, pa.string()).take(pa.array(np.maximum(code, 0), mask=code < 0)) if names else pa.nulls(start.size, pa.string())
    cells = pa.RecordBatch.from_arrays(
        [term, pa.array(block[start]), pa.array(occ), pa.array((ends - start).astype(np.int32)), _packed(low, start, ends)], schema=CELL)
    for i in range(0, cells.num_rows, 20_000):
        yield cells.slice(i, 20_000)


def build_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, ids) of one task -> containers, flushed at a bounded number of ids."""
    code_of: dict[str, int] = {}
    names: list[str] = []
    codes, ids, held = [], [], 0

    def flush():
        nonlocal codes, ids, held
        if held:
            c, i = np.concatenate(codes), np.concatenate(ids)
            yield from _cells(c, i, names)
            every = np.unique(i)
            yield from _cells(np.full(every.size, -1), every, names)
        code_of.clear(), names.clear()
        codes, ids, held = [], [], 0

    for batch in batches:
        lists = batch.column(1)
        values = lists.flatten()
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        keep = np.asarray(values.is_valid())
        flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[keep]
        parent = parent[keep]
        enc = batch.column(0).dictionary_encode()
        words = enc.dictionary.to_pylist()
        local = np.empty(len(words) + 1, np.int64)
        for k, w in enumerate(words):
            c = code_of.get(w)
            if c is None:
                c = code_of[w] = len(names)
                names.append(w)
            local[k] = c
        local[-1] = -2  # null term: its ids count only towards the set of all ids
        code = local[enc.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)][parent]
        codes.append(code), ids.append(flat)
        held += flat.size
        if held >= FLUSH:
            yield from flush()
    yield from flush()


def _union(rows: pa.Table) -> pa.RecordBatch:
    """Complete groups of equal (term, block), neighbours of each other -> one container for each."""
    rows = rows.combine_chunks()
    term, block, occ, n, raw = (rows.column(k).combine_chunks() if rows.column(k).num_chunks != 1 else rows.column(k).chunk(0) for k in range(5))
    begin = np.flatnonzero(_first_of_group(term, block))
    count = n.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[begin[1:], count.size]
    group = np.repeat(np.arange(begin.size), ends - begin)
    total = np.add.reduceat(occ.to_numpy(zero_copy_only=False), begin)
    dense = np.zeros(begin.size, bool)
    dense[group[count > SPARSE]] = True
    # Offsets of all other groups at once: sorted without repeats by group and offset.
    few = np.flatnonzero(~dense[group])
    part = raw.take(pa.array(few)).cast(pa.large_binary())
    edge = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + few.size + 1] if few.size else np.zeros(1, np.int64)
    data = np.frombuffer(part.buffers()[2], "<u2")[edge[0] // 2:edge[-1] // 2] if few.size and edge[-1] > edge[0] else np.zeros(0, "<u2")
    both = np.unique(np.repeat(group[few].astype(np.int64), count[few]) << 16 | data)
    size = np.bincount(both >> 16, minlength=begin.size)
    low = (both & 0xFFFF).astype("<u2")
    at = np.cumsum(size) - size
    if not dense.any():
        cells = _packed(low, at, at + size)
    else:
        parts = []
        for g in range(begin.size):
            if not dense[g]:
                parts.append(_pack(low[at[g]:at[g] + size[g]]))
                continue
            bits = np.zeros(8192, np.uint8)
            for i in range(begin[g], ends[g]):
                if count[i] > SPARSE:
                    bits |= np.frombuffer(raw[i].as_py(), np.uint8)
                else:
                    one = np.unpackbits(bits, bitorder="little")
                    one[np.frombuffer(raw[i].as_py(), "<u2")] = 1
                    bits = np.packbits(one, bitorder="little")
            found = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            size[g] = found.size
            parts.append(_pack(found.astype(np.uint16)))
        cells = pa.array(parts, pa.binary())
    first = pa.array(begin)
    return pa.RecordBatch.from_arrays([term.take(first), block.take(first), pa.array(total), pa.array(size.astype(np.int32)), cells], schema=CELL)


def _first_of_group(term: pa.Array, block: pa.Array) -> np.ndarray:
    code = term.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    b = block.to_numpy(zero_copy_only=False)
    return np.r_[True, (code[1:] != code[:-1]) | (b[1:] != b[:-1])]


def merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of containers that arrive sorted by (term, block).

    Complete groups of a batch are united together; the last group stays open, and what it
    holds is united whenever it has grown to ``OPEN`` rows, so its size does not follow its length.
    """
    held: list[pa.RecordBatch] = []

    def key(batch, i):
        return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[0], 0) != key(batch, 0):
            yield _union(pa.Table.from_batches(held))
            held = []
        last = int(np.flatnonzero(_first_of_group(batch.column(0), batch.column(1)))[-1])
        if last:
            yield _union(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
        if sum(b.num_rows for b in held) > OPEN:
            held = [_union(pa.Table.from_batches(held))]
    if held:
        yield _union(pa.Table.from_batches(held))


def merged_cells(rows: DataFrame, term: str, ids: str) -> DataFrame:
    """(term, block, occ, n, bits): the merged index; the null term holds all ids of the table."""
    partial = rows.select(F.col(term).alias("term"), F.col(ids).alias("ids")).mapInArrow(build_cells, CELL_DDL)
    return (partial.repartition("term", "block").sortWithinPartitions("term", "block")
                   .mapInArrow(merge_cells, CELL_DDL))


def term_frequencies(rows: DataFrame, term: str, ids: str, *, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, occurrences, records, share, mark) for every term that has a record.

    ``mark`` is 'rare' for at most ``rare`` records, else 'common' for at least
    the ``common`` share of all distinct ids in the table, else null.
    """
    cells = merged_cells(rows, term, ids)
    sums = staged(cells.groupBy("term").agg(F.sum("occ").alias("occurrences"),
                                            F.sum(F.col("n").cast("long")).alias("records")), "termfreq")
    total = (sums.where("term is null").agg(F.sum("records")).first()[0]) or 0  # one number
    share = F.col("records") / F.lit(float(max(total, 1)))
    return (sums.where("term is not null")
                .select("term", "occurrences", "records", share.alias("share"),
                        F.when(F.col("records") <= rare, "rare")
                         .when(F.col("records") >= F.lit(common) * F.lit(float(total)), "common").alias("mark")))
