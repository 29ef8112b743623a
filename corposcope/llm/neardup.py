"""Near-duplicate files, by a byte-position inverted index with count filtering.

A text is the set of its runs of five tokens.  Min-hashes of that set give one byte
for each of ``POSITIONS`` positions: the signature.  Two sets of similarity J agree
in each position with probability at least J, so a pair at the threshold reaches
``minimum_matches()`` equal bytes except with probability 1e-9; this is the count
filter.  The inverted index posts a text under four positions and their bytes at a
time (``KEYS`` such keys from two groupings of the positions; a single byte would
make every posting list a 256th of the corpus).  A pair at the threshold shares no key
with probability 7e-6, measured by simulation; the chance falls fast above it.

Exact copies collapse to one class first.  A posting list is cut into blocks before
anything is paired, and each pair of blocks is one task group of at most two blocks:
there the equal bytes of every pair are tallied, and a pair leaves only if the tally
reaches the minimum and this key is the first that both signatures share.  So every
candidate leaves the index once, whatever number of keys it shares, and no list is
held whole anywhere.  Candidates are verified exactly on their token runs.  A family
of m distinct near-copies has m*(m-1)/2 links; that is the size of the asked output.

Edge cases: a null text equals an empty one; texts of fewer than five tokens
have no runs and link only to equal texts; null ids are ignored; repeated rows
of one id count once (of differing texts under one id, each is compared); an
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.llm.textarrays import chunks, mix, run_hashes, utf8, windows
from corposcope.session import spread, staged

WIDTH = 5
POSITIONS, GROUP = 112, 4
SPAN = POSITIONS // GROUP
KEYS = 2 * SPAN  #: neighbouring positions, then positions that lie SPAN apart
BLOCK, RUNS = 256, 4_000_000  #: classes and token runs of one block of a posting list
TALLY = 100_000  #: pairs compared in one vector operation
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_A = (mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64)).astype(np.uint32)
SIG_DDL = "file_id long, ck1 long, ck2 long, runs int, sig binary"
SET_DDL = "doc binary, runs binary"
PAIR_DDL = "own long, bi int, bj int, a binary, b binary"


def minimum_matches(threshold: float, positions: int = POSITIONS, miss: float = 1e-9) -> int:
    """Largest count that a pair at the threshold fails to reach with probability below ``miss``."""
    total = 0.0
    for m in range(positions + 1):
        total += comb(positions, m) * threshold**m * (1 - threshold) ** (positions - m)
        if total > miss:
            return m
    return positions


def _runs(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each token run, its hash) for the documents in ``off``."""
    start, _, token = run_hashes(flat, _WORD[flat])
    doc = np.searchsorted(off, start, side="right") - 1
    h = windows(token, WIDTH)
    same = doc[:h.size] == doc[WIDTH - 1:] if h.size else np.zeros(0, bool)
    return doc[:h.size][same], h[same]


def _separated(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a zero byte after each, so no token crosses a document end."""
    n = len(off) - 1
    out = np.zeros(flat.size + n, np.uint8)
    out[np.arange(flat.size) + np.repeat(np.arange(n), np.diff(off))] = flat
    return out, off + np.arange(n + 1)


def _signature(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with runs, min-hashes of those rows, runs per row)."""
    count = np.bincount(doc, minlength=n)
    rows = np.flatnonzero(count)
    at = np.r_[0, np.cumsum(count[rows])[:-1]]
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((rows.size, POSITIONS), np.uint32)
    if rows.size:
        for k in range(POSITIONS):
            least[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return rows, least, count


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, content) -> content key, number of runs and signature bytes."""
    import xxhash

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in _ranges(texts):
            flat, off = utf8(texts.slice(a, b - a))
            raw = memoryview(flat)
            digest = [xxhash.xxh3_128_intdigest(raw[off[i]:off[i + 1]]) for i in range(b - a)]
            key = np.array([(x >> 64, x & ((1 << 64) - 1)) for x in digest], np.uint64).reshape(-1, 2).view(np.int64)
            doc, h = _runs(*_separated(flat, off))
            rows, least, count = _signature(doc, h, b - a)
            byte = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            sig: list = [None] * (b - a)
            for i, r in enumerate(rows):
                sig[r] = byte[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(count.astype(np.int32)), pa.array(sig, pa.binary())],
                ["file_id", "ck1", "ck2", "runs", "sig"])


def index_keys(sig: Column) -> Column:
    """Keys of a signature: a hash of the bytes of each group of positions, with the group's number in the low bits."""
    near = [F.substring(sig, GROUP * g + 1, GROUP) for g in range(SPAN)]
    far = [F.concat(*[F.substring(sig, g + SPAN * j + 1, 1) for j in range(GROUP)]) for g in range(SPAN)]
    return F.array(*[F.shiftleft(F.xxhash64(x, F.lit(g)), 6).bitwiseOR(F.lit(g).cast("long")) for g, x in enumerate(near + far)])


def _ranges(texts: pa.Array) -> list[tuple[int, int]]:
    _, off = utf8(texts)
    return list(chunks(off))


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """[n, width] bytes of a binary column whose values all have this width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, width), np.uint8)
    wide = column.cast(pa.large_binary())
    at = int(np.frombuffer(wide.buffers()[1], np.int64)[wide.offset])
    return np.frombuffer(wide.buffers()[2], np.uint8)[at:at + n * width].reshape(n, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), rows.shape[0], [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _groups_pairs(size: np.ndarray, begin: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, first row, second row) of all row pairs inside groups of neighbouring rows, about ``most`` at a time."""
    total = np.cumsum(size.astype(np.int64) * (size - 1) // 2)
    a = 0
    while a < size.size:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        n, at = size[a:b], begin[a:b]
        left = np.repeat(np.arange(b - a), n)  # one entry for each row as the first of a pair
        within = np.arange(left.size) - np.repeat(np.cumsum(n) - n, n)
        partners = n[left] - 1 - within
        first = np.repeat(at[left] + within, partners)
        second = first + 1 + np.arange(first.size) - np.repeat(np.cumsum(partners) - partners, partners)
        yield np.repeat(left, partners) + a, first, second
        a = b


def _tally(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, bi, bj, mine, doc, sig) sorted by block pair -> candidates, each from the first key it shares."""
        held: list[pa.RecordBatch] = []

        def pairs(batch):
            key, bi, bj, mine = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            doc, sig = _bytes(batch.column(4), 16), _bytes(batch.column(5), POSITIONS)
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            size = np.diff(np.r_[begin, key.size])
            for _, x, y in _groups_pairs(size, begin, TALLY):
                cross = (bi[x] == bj[x]) | (mine[x] != mine[y])  # a pair of one block belongs to that block alone
                x, y = x[cross], y[cross]
                same = sig[x] == sig[y]
                good = np.flatnonzero(same.sum(1) >= least)
                x, y, same = x[good], y[good], same[good]
                near = same.reshape(-1, SPAN, GROUP).all(2)
                far = same.reshape(-1, GROUP, SPAN).all(1)
                first = np.concatenate((near, far), 1).argmax(1)
                own = np.flatnonzero(first == (key[x] & 63))
                x, y = x[own], y[own]
                if x.size:
                    word = doc.view(">u8")
                    swap = (word[x, 0] > word[y, 0]) | (word[x, 0] == word[y, 0]) & (word[x, 1] > word[y, 1])
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(bi[x]), pa.array(bj[x]), _binary(doc[x]), _binary(doc[y])], ["own", "bi", "bj", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]
            k = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)])
            cut = int(np.flatnonzero((k != np.array(last)[:, None]).any(0))[-1] + 1) if (k != np.array(last)[:, None]).any() else 0
            if cut:  # rows before the last group are complete
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            elif held and [held[0].column(j)[0].as_py() for j in range(3)] != last:
                yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, content) -> (doc, distinct token runs as sorted 64-bit hashes); texts of another class drop out."""
    import xxhash

    for batch in batches:
        texts = batch.column(1)
        for a, b in _ranges(texts):
            flat, off = utf8(texts.slice(a, b - a))
            raw = memoryview(flat)
            doc, h = _runs(*_separated(flat, off))
            ends = np.searchsorted(doc, np.arange(b - a + 1))
            own = [i for i, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()) if xxhash.xxh3_128_digest(raw[off[i]:off[i + 1]]) == key]
            sets = [np.unique(h[ends[i]:ends[i + 1]]).tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + i for i in own], pa.int64())), pa.array(sets, pa.binary())], ["doc", "runs"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of equal values of two sorted arrays without repeats."""
    if x.size > y.size:
        x, y = y, x
    if not x.size:
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), y.size - 1)] == x))


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block pair, kind): the run sets of two blocks as sorted arrays, then their pairs."""
        bucket, sets = None, {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for own, bi, bj, a, b, runs in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                if (own, bi, bj) != bucket:
                    bucket, sets = (own, bi, bj), {}
                if b is None:
                    sets[a] = np.frombuffer(runs, np.uint64)
                else:
                    x, y = sets[a], sets[b]
                    both = _common(x, y)
                    either = x.size + y.size - both
                    if both >= threshold * either:
                        out[0].append(a), out[1].append(b), out[2].append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
                                              pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return verify


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(own, bi, bj, a, b) of ``classes(doc, runs, sig)``: every pair that shares a key and reaches the minimum, once."""
    posts = classes.where("sig is not null").select(F.explode(index_keys(F.col("sig"))).alias("key"), "doc", "runs")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("runs") / RUNS)).cast("int")
    # Keys met once cannot link anything and drop out before signatures join in.
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).where("n > 1").select("key", "blocks")
    shared = posts.select("key", "doc").join(sizes, "key").join(classes.select("doc", "sig"), "doc")
    mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    shared = shared.select("key", "doc", "sig", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    rows = shared.select("key", F.least("mine", "k").alias("bi"), F.greatest("mine", "k").alias("bj"), "mine", "doc", "sig")
    return (rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
                .mapInArrow(_tally(minimum_matches(threshold)), PAIR_DDL))


def classes_and_links(files: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.7
                      ) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(file_id, doc, rep)`` maps every id to the class of each of its texts, by content
    key and smallest id; ``links(a, b, similarity)`` holds every pair of content keys that reaches the threshold, a < b."""
    rows = files.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("file_id"),
                                                         F.col(text_col).alias("content"))
    signed = staged(spread(rows).mapInArrow(signatures, SIG_DDL), "sig")
    key = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("ck1", "ck2"))).alias("doc")
    one = staged(signed.groupBy("ck1", "ck2").agg(F.min(F.struct("file_id", "runs", "sig")).alias("c"))
                       .select("ck1", "ck2", key, "c.file_id", "c.runs", "c.sig"), "classes")
    members = (signed.select("file_id", "ck1", "ck2").distinct().join(one.select("ck1", "ck2", "doc", F.col("file_id").alias("rep")), ["ck1", "ck2"])
                     .select("file_id", "doc", "rep"))
    pairs = staged(candidates(one, threshold), "pairs")
    ends = lambda *c: pairs.select(*c, F.col("a").alias("doc")).union(pairs.select(*c, F.col("b").alias("doc"))).distinct()
    reps = staged(one.select("doc", "file_id").join(ends(), "doc", "left_semi"), "reps")
    texts = rows.join(reps.select("file_id").distinct(), "file_id", "left_semi").join(reps, "file_id").groupBy("doc", "content").agg(F.lit(1)).select("doc", "content")
    sets = staged(texts.mapInArrow(run_sets, SET_DDL), "sets")
    none = F.lit(None).cast("binary")
    kinds = (ends("own", "bi", "bj").join(sets, "doc").select("own", "bi", "bj", F.lit(0).alias("kind"), F.col("doc").alias("a"), none.alias("b"), "runs")
             .union(pairs.select("own", "bi", "bj", F.lit(1), "a", "b", none)))
    links = (kinds.repartition("own", "bi", "bj").sortWithinPartitions("own", "bi", "bj", "kind")
                  .mapInArrow(_verifier(threshold), "a binary, b binary, similarity double"))
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id_a, file_id_b): links and copies expanded to pairs of ids, a < b."""
    x = members.select(F.col("doc").alias("a"), F.col("file_id").alias("fa"))
    y = members.select(F.col("doc").alias("b"), F.col("file_id").alias("fb"))
    linked = links.select("a", "b").join(x, "a").join(y, "b").select("fa", "fb")
    copies = x.join(y, F.col("a") == F.col("b")).where("fa < fb").select("fa", "fb")
    either = linked.where("fa != fb").unionByName(copies)
    return either.select(F.least("fa", "fb").alias("file_id_a"), F.greatest("fa", "fb").alias("file_id_b")).distinct()


def linked_documents(members: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, class_id, links): one row per id, with the number of other classes its class links to."""
    ends = links.select(F.col("a").alias("doc")).union(links.select(F.col("b").alias("doc")))
    degree = ends.groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    return (members.join(degree, "doc", "left")
                   .select("file_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")))
