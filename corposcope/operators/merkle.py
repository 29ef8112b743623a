"""Merkle trees over key ranges: process only new or changed records.

A record is (partition, key, value).  Keys hash into a fixed tree of ``LEVELS``
levels per partition; a node's digest is the wrapping sum of the
record digests below it, so it is order-free and merges map-side.  Two trees
are compared level by level and only children of differing nodes are visited;
records are read only from leaves that differ.  The tree of the published state
is stored beside the output and both become current by one atomic rename of a
pointer file (``segments``), so a crashed run leaves the earlier state untouched.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.operators.segments import MOST_SEGMENTS, Segments
from corposcope.session import staged

LEVELS, BITS = 3, 6  #: 64 children a node, 64**3 leaves for each partition


def records(df: DataFrame, partition: str, key: str, value: str) -> DataFrame:
    """(part, key, value, h): ``h`` is the position of the key in the tree."""
    return df.select(F.col(partition).alias("part"), F.col(key).alias("key"),
                     F.col(value).alias("value")).withColumn("h", F.xxhash64("key"))


def node(level: int) -> "F.Column":
    """Node number at a level: the top bits of the key hash."""
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * level)


def leaves(recs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf digests: (part, leaf, digest, n). Partial sums combine before the shuffle."""
    one = F.xxhash64("key", "value").cast("decimal(20,0)")
    return (recs.groupBy("part", node(levels).alias("leaf"))
                .agg(F.sum(one).alias("digest"), F.count(F.lit(1)).alias("n")))


def differing_leaves(current: DataFrame, saved: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(part, leaf) of leaves whose digests differ, found by descending from the roots.

    The two leaf tables (at most 64**levels rows a partition) are paired once and
    fixed in shared storage.  Each level sums digests up to that level and keeps
    only what lies below differing nodes, so equal subtrees drop out at once.
    """
    pair = staged(
        current.select("part", "leaf", F.col("digest").alias("da"), F.col("n").alias("na"))
        .join(saved.select("part", "leaf", F.col("digest").alias("db"), F.col("n").alias("nb")),
              ["part", "leaf"], "full_outer"), "merkle")
    differ = lambda c: ~(F.col(f"{c}a").eqNullSafe(F.col(f"{c}b")))
    for level in range(levels):
        up = F.shiftrightunsigned(F.col("leaf"), BITS * (levels - level)) if level else F.lit(0)
        below = pair.withColumn("node", up)
        bad = (below.groupBy("part", "node")
                    .agg(*[F.sum(c).alias(c) for c in ("da", "na", "db", "nb")])
                    .where(differ("d") | differ("n")).select("part", "node"))
        pair = below.join(bad, ["part", "node"], "left_semi").drop("node")
    return pair.where(differ("d") | differ("n")).select("part", "leaf")


def changed_records(current: DataFrame, saved: DataFrame, levels: int = LEVELS, *, leaf: DataFrame | None = None) -> DataFrame:
    """(part, key, status, value): 'added', 'changed' or 'removed' records.

    Differing leaves that are known already can be given.

    Both inputs are ``records()`` with one row per (part, key).  Null values are
    compared null-safe; null keys are records too.  Rows are joined only inside
    differing leaves.
    """
    if leaf is None:
        leaf = differing_leaves(leaves(current, levels), leaves(saved, levels), levels)
    pick = lambda r: r.withColumn("leaf", node(levels)).join(leaf, ["part", "leaf"], "left_semi")
    a = pick(current).select("part", F.col("key").alias("ka"), F.col("value").alias("va"),
                             F.lit(True).alias("ina"))
    b = pick(saved).select(F.col("part").alias("pb"), F.col("key").alias("kb"),
                           F.col("value").alias("vb"), F.lit(True).alias("inb"))
    both = a.join(b, F.col("part").eqNullSafe(F.col("pb")) & F.col("ka").eqNullSafe(F.col("kb")), "full_outer")
    status = (F.when(F.col("inb").isNull(), "added").when(F.col("ina").isNull(), "removed")
               .when(~F.col("va").eqNullSafe(F.col("vb")), "changed"))
    return (both.select(F.coalesce("part", "pb").alias("part"),
                        F.when(F.col("ina"), F.col("ka")).otherwise(F.col("kb")).alias("key"),
                        status.alias("status"), F.col("va").alias("value"))
                .where("status is not null"))


def incremental_run(store: Segments, current: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One run over ``records()``: only records added or changed since the last published run reach ``process``.

    ``process`` gets (part, key, status, value) and returns rows with ``part`` and
    ``key``.  The run writes one segment: the output and the records of what changed,
    the keys that it replaces, and the leaf digests of the leaves that differ.  All
    become current together, so a run that fails anywhere leaves the last state, and the
    next run finds the same records again.  ``current`` is read once.  Returns the changes.
    """
    current = staged(current, "current")
    tree, was = leaves(current), store.manifest()
    saved, saved_tree = store.live("records", ["part", "key"], was), latest_tree(store, was)
    if saved is None:
        saved, saved_tree = current.limit(0), tree.limit(0)
    tree = staged(tree, "tree")
    leaf = staged(differing_leaves(tree, saved_tree), "differing")
    changed = staged(changed_records(current, saved, leaf=leaf), "changed")
    fresh = process(changed.where("status != 'removed'"))
    recs = current.join(changed.where("status != 'removed'").select(F.col("part").alias("__p"), F.col("key").alias("__k")),
                        F.col("part").eqNullSafe(F.col("__p")) & F.col("key").eqNullSafe(F.col("__k")), "left_semi")
    digests = leaf.join(tree, ["part", "leaf"], "left").select("part", "leaf", "digest", F.coalesce("n", F.lit(0)).alias("n"))
    entry = store.add({"output": fresh, "records": recs, "tree": digests}, changed.where("status != 'added'").select("part", "key") if was else None)
    now = was | {"segments": [*was.get("segments", []), entry]}
    if len(now["segments"]) > MOST_SEGMENTS:
        now |= {"segments": [store.add({"output": store.live("output", ["part", "key"], now), "records": store.live("records", ["part", "key"], now),
                                        "tree": latest_tree(store, now)})]}
    store.publish(now)
    return changed


def latest_tree(store: Segments, manifest: dict | None = None) -> DataFrame | None:
    """(part, leaf, digest, n) of the published state: the newest digest of each leaf; emptied leaves have none."""
    rows = None
    for i, entry in enumerate((manifest or store.manifest()).get("segments", [])):
        one = store.part(entry, "tree").withColumn("seg", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return None
    return (rows.groupBy("part", "leaf").agg(F.max_by(F.struct("digest", "n"), "seg").alias("d"))
                .select("part", "leaf", "d.digest", "d.n").where("n > 0"))
