"""One ranking from several differently scaled scores, by outranking net flow.

Each backend's scores become percentiles among all files of the search, and a
pair of files is compared by a preference that grows linearly with the
percentile difference up to ``threshold`` and is then full.  A file's net flow
is the mean preference over the others minus theirs over it, and flows are
averaged with the backend weights, so a backend's range never matters.  The
pairwise sums are never formed: with mid-ranks R = 2*below + equal, they follow
from counts and sums of R at R-T, R and R+T, which sorted prefix sums give
exactly in integers.

All hits move once, to the task of their search, where millions of rows of many
searches are ranked by the same few vector operations.  A search of more than
``HOT`` hits never enters one task: its sorted prefix sums are computed over range
partitions (operators.prefix).  Both ways give the same integers.

Edge cases: null and NaN scores are no hits; the best of repeated hits counts;
a file without a hit in a backend ties with all others like it, below every
hit; a backend without hits adds no flow; a search with one file gets flow 0;
a search without intent, or with an unknown one, uses the weights of 'default';
a null or negative weight counts as zero; if all weights are zero every file
has flow 0 and files rank by id.  Rows with a null query or file are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.operators.prefix import ranks, running_sums
from corposcope.session import staged

BACKENDS = ("fts", "grep", "trigram")
LOWER_IS_BETTER = ("fts",)
HOT = 500_000  #: hits of a search beyond which it is ranked over range partitions
BUFFER = 200_000  #: rows that a task gathers before it ranks the complete searches among them
FLOW_DDL = "query_id long, file_id long, flow double, tops long, needs long, rank long"


def oriented(results: DataFrame) -> DataFrame:
    """(query_id, backend, file_id, s): hits with higher scores better; repeated hits are still there."""
    score = F.when(F.col("backend").isin(*LOWER_IS_BETTER), -F.col("score")).otherwise(F.col("score"))
    return results.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("backend").isin(*BACKENDS) & F.col("query_id").isNotNull()
                         & F.col("file_id").isNotNull()).select("query_id", "backend", "file_id", score.alias("s"))


def best_hits(results: DataFrame) -> DataFrame:
    """The best of repeated hits."""
    return oriented(results).groupBy("query_id", "backend", "file_id").agg(F.max("s").alias("s"))


def weights(searches: DataFrame, config: DataFrame) -> DataFrame:
    """(query_id, backend, w): weights of each search by its intent."""
    known = config.select(F.col("intent").alias("known")).distinct()
    s = searches.select("query_id", "intent").join(known, F.col("intent") == F.col("known"), "left")
    s = s.select("query_id", F.coalesce("known", F.lit("default")).alias("intent"))
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("backend"),
                                         F.greatest(F.coalesce(F.col(f"{b}_weight"), F.lit(0.0)), F.lit(0.0)).alias("w"))
                                for b in BACKENDS]))
    per = config.select("intent", pairs.alias("p")).select("intent", "p.backend", "p.w")
    return s.join(per, "intent").select("query_id", "backend", "w")


def flows(hits: DataFrame, threshold: float) -> DataFrame:
    """(query_id, backend, s, is_hit, flow, top): net flow of each distinct score of a backend.

    ``top`` tells that the score is met once and beats every other file of the
    search.  The row with null ``s`` stands for the files without a hit.
    """
    size = hits.groupBy("query_id", "file_id").agg(F.lit(1)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    scores = hits.groupBy("query_id", "backend", "s").agg(F.count(F.lit(1)).alias("c"))
    absent = (hits.groupBy("query_id", "backend").agg(F.count(F.lit(1)).alias("h")).join(size, "query_id")
                  .where("n > h").select("query_id", "backend", F.lit(None).cast("double").alias("s"),
                                         (F.col("n") - F.col("h")).alias("c")))
    ladder = running_sums(scores.unionByName(absent), ["query_id", "backend"], [F.col("s").asc_nulls_first()],
                          {"upto": "c"}, "ladder").join(size, "query_id")
    r = F.lit(2) * (F.col("upto") - F.col("c")) + F.col("c")
    t = F.greatest(F.lit(1), F.round(F.lit(2.0 * threshold) * F.col("n")).cast("long"))
    ladder = staged(ladder.withColumns({"r": r, "t": t}), "ladder-r")
    # Each score asks for counts and sums at r-t, r and r+t: three points on one sorted line.
    ask = lambda k, at: ladder.select("query_id", "backend", F.lit(k).alias("k"), F.col("r").alias("own"),
                                      at.alias("x"), (F.col("c") if k == 2 else F.lit(0)).cast("long").alias("dc"),
                                      (F.col("c") * F.col("r") if k == 2 else F.lit(0)).cast("long").alias("ds"))
    line = (ask(1, F.col("r") - F.col("t")).unionByName(ask(2, F.col("r")))
            .unionByName(ask(3, F.col("r") + F.col("t"))))
    line = running_sums(line, ["query_id", "backend"], [F.col("x").asc()], {"cc": "dc", "ss": "ds"}, "line")
    pick = [F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}{k}") for k in (1, 2, 3) for v in ("cc", "ss")]
    at = line.groupBy("query_id", "backend", "own").agg(*pick)
    both = ladder.join(at.withColumnRenamed("own", "r"), ["query_id", "backend", "r"])
    num = (F.expr("t*cc1 + r*(cc2-cc1) - (ss2-ss1) - t*(n-cc3) - (ss3-ss2) + r*(cc3-cc2)"))
    flow = F.when(F.col("n") > 1, num / (F.col("t") * (F.col("n") - 1))).otherwise(F.lit(0.0))
    return both.select("query_id", "backend", "s", F.col("s").isNotNull().alias("is_hit"),
                       flow.alias("flow"), (F.col("s").isNotNull() & (F.col("r") == 2 * F.col("n") - 1)).alias("top"))


def large_flows(results: DataFrame, searches: DataFrame, config: DataFrame, *, threshold: float = 0.25) -> DataFrame:
    """(query_id, file_id, flow, tops, needs) without gathering a search in one task.

    ``needs`` counts the backends weighted above zero and ``tops`` those of them in
    which the file alone is best.
    """
    hits = staged(best_hits(results).join(searches.select("query_id").distinct(), "query_id", "left_semi"), "hits")
    w = weights(searches, config)
    per = flows(hits, threshold)
    scored = hits.join(per.where("is_hit"), ["query_id", "backend", "s"]).select(
        "query_id", "file_id", "backend", "flow", "top")
    # A file missing in a backend takes the flow of that backend's null score.
    none = per.where("not is_hit").select("query_id", F.col("backend"), F.col("flow").alias("low"))
    base = (w.join(none, ["query_id", "backend"], "left")
             .groupBy("query_id").agg(F.sum("w").alias("sw"), F.count(F.when(F.col("w") > 0, 1)).alias("needs"),
                                      F.sum(F.col("w") * F.coalesce("low", F.lit(0.0))).alias("floor")))
    gain = (scored.join(w, ["query_id", "backend"])
                  .join(none, ["query_id", "backend"], "left")
                  .groupBy("query_id", "file_id")
                  .agg(F.sum(F.col("w") * (F.col("flow") - F.coalesce("low", F.lit(0.0)))).alias("gain"),
                       F.count(F.when(F.col("top") & (F.col("w") > 0), 1)).alias("tops")))
    flow = F.when(F.col("sw") > 0, (F.col("floor") + F.col("gain")) / F.col("sw")).otherwise(F.lit(0.0))
    # Rounded so that the order of a floating sum can never decide a rank.
    return gain.join(base, "query_id").select("query_id", "file_id", F.round(flow, 9).alias("flow"), "tops", "needs")


def ranked_groups(q, kind, f, s, w, threshold: float):
    """Columns of FLOW_DDL for whole searches.

    ``kind`` is the backend's number, or 3 for a row that carries the weights ``w``
    of its search; hits of a search without such a row are dropped.
    """
    ids, g = np.unique(q, return_inverse=True)
    weight = np.full((ids.size, 3), np.nan)
    at = np.flatnonzero(kind == 3)[::-1]
    weight[g[at]] = w[at]
    ok = (kind < 3) & ~np.isnan(weight[g, 0])
    g, b, f, s = g[ok], kind[ok].astype(np.int64), f[ok], s[ok]
    order = np.lexsort((-s, f, b, g))  # the best of repeated hits comes first
    g, b, f, s = g[order], b[order], f[order], s[order]
    new = np.ones(g.size, bool)
    new[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (f[1:] != f[:-1])
    g, b, f, s = g[new], b[new], f[new], s[new]
    if not g.size:
        return tuple(np.zeros(0, np.int64) for _ in range(2)) + (np.zeros(0),) + tuple(np.zeros(0, np.int64) for _ in range(3))
    order = np.lexsort((f, g))
    first = np.ones(g.size, bool)
    first[1:] = (g[order][1:] != g[order][:-1]) | (f[order][1:] != f[order][:-1])
    file_of = np.empty(g.size, np.int64)
    file_of[order] = np.cumsum(first) - 1
    fg, ff = g[order][first], f[order][first]
    n_of = np.bincount(fg, minlength=ids.size)
    # Mid-ranks on each search's and backend's sorted line; files without a hit stand together at its low end.
    order = np.lexsort((s, b, g))
    seg, s = (g * 3 + b)[order], s[order]
    start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    size = np.diff(np.r_[start, seg.size])
    missing = n_of[seg[start] // 3] - size
    step = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (s[1:] != s[:-1])])
    equal = np.diff(np.r_[step, seg.size])
    line = np.searchsorted(start, step, side="right") - 1
    r = 2 * (missing[line] + step - start[line]) + equal
    low = np.flatnonzero(missing > 0)
    entry_line, entry_r = np.r_[line, low], np.r_[r, missing[low]]
    entry_c = np.r_[equal, missing[low]]
    n = n_of[seg[start] // 3][entry_line]
    t = np.maximum(1, np.floor(2 * threshold * n + 0.5).astype(np.int64))
    span = 8 * int(n_of.max()) + 16
    key = entry_line * span + entry_r + span // 2
    by = np.argsort(key, kind="stable")
    cc, ss = np.r_[0, np.cumsum(entry_c[by])], np.r_[0, np.cumsum((entry_c * entry_r)[by])]
    base = np.searchsorted(key[by], entry_line * span)

    def upto(x):
        p = np.searchsorted(key[by], entry_line * span + x + span // 2, side="right")
        return cc[p] - cc[base], ss[p] - ss[base]

    (c1, s1), (c2, s2), (c3, s3) = upto(entry_r - t), upto(entry_r), upto(entry_r + t)
    num = t * c1 + entry_r * (c2 - c1) - (s2 - s1) - t * (n - c3) - (s3 - s2) + entry_r * (c3 - c2)
    phi = np.where(n > 1, num / np.maximum(t * (n - 1), 1), 0.0)
    low_phi = np.zeros(start.size)
    low_phi[low] = phi[line.size:]
    row_entry = np.repeat(np.arange(step.size), equal)
    row_line = line[row_entry]
    wl = np.nan_to_num(weight).reshape(-1)[seg[start]]
    floor = np.bincount(seg[start] // 3, weights=wl * low_phi, minlength=ids.size)
    gain = np.bincount(file_of[order], weights=wl[row_line] * (phi[row_entry] - low_phi[row_line]), minlength=fg.size)
    top = (equal == 1) & (r == 2 * n[:step.size] - 1)
    tops = np.bincount(file_of[order], weights=top[row_entry] & (wl[row_line] > 0), minlength=fg.size).astype(np.int64)
    sw, needs = np.nansum(weight, 1), (weight > 0).sum(1)
    flow = np.where(sw[fg] > 0, np.round((floor[fg] + gain) / np.where(sw[fg] > 0, sw[fg], 1), 9), 0.0) + 0.0
    order = np.lexsort((ff, -flow, fg))
    fg = fg[order]
    begin = np.searchsorted(fg, fg)
    return ids[fg], ff[order], flow[order], tops[order], needs[fg], np.arange(fg.size) - begin + 1


def _group_runner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by search; the last search of what has arrived waits for its next rows."""
        held: list[tuple] = []
        rows = 0

        def done(parts):
            cols = ranked_groups(*(np.concatenate(c) for c in zip(*parts)), threshold)
            for i in range(0, cols[0].size, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 50_000]) for c in cols], ["query_id", "file_id", "flow", "tops", "needs", "rank"])

        for batch in batches:
            if not batch.num_rows:
                continue
            q, kind, f, s, *w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            part = (q, kind, f, s, np.stack(w, 1))
            last = int(np.searchsorted(q, q[-1]))  # rows before it belong to searches that are complete
            if rows >= BUFFER and last:
                yield from done([*held, tuple(c[:last] for c in part)])
                held, rows = [], 0
                part = tuple(c[last:] for c in part)
            held.append(part)
            rows += part[0].size
        if held:
            yield from done(held)

    return run


def net_flows(results: DataFrame, searches: DataFrame, config: DataFrame, *, threshold: float = 0.25) -> DataFrame:
    """(query_id, file_id, flow, tops, needs, rank): weighted net flow and rank of every file of every search.

    ``needs`` counts the backends weighted above zero and ``tops`` those of them in
    which the file alone is best; ties of flow rank by file id.
    """
    hits = oriented(results)
    hot = staged(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("query_id"), "hot")
    n_hot = hot.count()
    usual, rest = hits, None
    if n_hot:
        few = F.broadcast(hot) if n_hot <= 100_000 else hot
        usual = hits.join(few, "query_id", "left_anti")
        rest = results.join(few, "query_id", "left_semi")
    w = weights(searches, config).groupBy("query_id").pivot("backend", list(BACKENDS)).agg(F.max("w"))
    none = [F.lit(None).cast("double").alias(b) for b in BACKENDS]
    code = F.when(F.col("backend") == "fts", 0).when(F.col("backend") == "grep", 1).otherwise(2).cast("byte")
    rows = usual.select("query_id", code.alias("kind"), "file_id", "s", *none).union(
        w.select("query_id", F.lit(3).cast("byte"), F.lit(0).cast("long"), F.lit(0.0), *BACKENDS))
    out = (rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_group_runner(threshold), FLOW_DDL))
    if rest is not None:
        big = large_flows(rest, searches.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "query_id", "left_semi"), config, threshold=threshold)
        out = out.unionByName(ranks(big, ["query_id"], [F.col("flow").desc(), F.col("file_id").asc()]))
    return out


def ranking(flow_table: DataFrame) -> DataFrame:
    """(query_id, file_id, flow, rank)."""
    return flow_table.select("query_id", "file_id", "flow", "rank")


def undisputed(flow_table: DataFrame) -> DataFrame:
    """(query_id, file_id): first-ranked files that are strictly best in every weighted backend.

    The first rank comes from the flow; dominance is then checked exactly.
    """
    return flow_table.where("rank = 1 and needs > 0 and tops = needs").select("query_id", "file_id")
