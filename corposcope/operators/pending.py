"""Paths that the next index run must index or remove.

Inputs are the index (``files``), the walk log (``file_scan``), the run log
(``index_runs``) and the change lists (``git_diffs``).  Each root follows one
of two plans: replay of the change lists after a usable cursor, or comparison
of everything.  Both take their 'index' cases from one Merkle comparison of
the disk state with the indexed state, so unchanged key ranges are never joined.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.operators import merkle
from corposcope.session import staged


def root_of(path) -> "F.Column":
    """First two parts of a path: ``/ws/<name>``."""
    return F.regexp_extract(path, r"^(/[^/]*/[^/]*)", 1)


def current_state(scan: DataFrame) -> DataFrame:
    """(root, path, hash, seen): newest non-null hash of each path; ``seen`` paths may have none.

    Equal ``seen_at`` with different hashes is settled by the larger hash; a null
    ``seen_at`` is older than any time.  Null paths are not records.
    """
    old = F.lit("0001-01-01").cast("timestamp")
    best = F.max(F.when(F.col("hash").isNotNull(),
                        F.struct(F.coalesce("seen_at", old).alias("at"), F.col("hash").alias("hash"))))
    return (scan.where("path is not null")
                .groupBy(root_of(F.col("path")).alias("root"), "path")
                .agg(best["hash"].alias("hash")))


def indexed_state(files: DataFrame) -> DataFrame:
    """(root, path, hash): one row per indexed path; repeated deliveries collapse."""
    return (files.where("path is not null")
                 .groupBy(root_of(F.col("path")).alias("root"), "path").agg(F.max("hash").alias("hash")))


def cursors(runs: DataFrame, diffs: DataFrame) -> DataFrame:
    """(root, cursor_no): commit number of a root's usable cursor; roots without one are absent.

    The cursor is the head of the 'ok' run with the highest run number; it is
    usable if the change lists of that root hold that commit.  Several rows of one
    commit count as one.
    """
    last = (runs.where("outcome = 'ok'").groupBy("root")
                .agg(F.max(F.struct("run_no", "head_oid"))["head_oid"].alias("head_oid")))
    known = (diffs.where("head_oid is not null").groupBy("root", "head_oid")
                  .agg(F.max("commit_no").alias("cursor_no")))
    return last.join(known, ["root", "head_oid"]).select("root", "cursor_no")


def mentions(diffs: DataFrame, cursor: DataFrame) -> DataFrame:
    """(root, path, last): last mention of each path after the root's cursor.

    Within one commit a path named in both lists counts as changed: the lists of
    one commit carry no order, and an index case is checked against the disk.
    """
    after = diffs.join(cursor, "root").where("commit_no > cursor_no")
    row = lambda c, v: after.select(
        "root", "commit_no", F.explode(c).alias("path"), F.lit(v).alias("rank"))
    every = row("changed", 1).unionByName(row("deleted", 0)).where("path is not null")
    return (every.groupBy("root", "path").agg(F.max(F.struct("commit_no", "rank"))["rank"].alias("rank"))
                 .select("root", "path", F.when(F.col("rank") == 1, "changed").otherwise("deleted").alias("last")))


def pending_paths(files: DataFrame, scan: DataFrame, diffs: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, todo): 'index' or 'delete' for exactly the paths the next run must touch.

    Empty change lists, missing runs and nulls are allowed anywhere; an empty
    index gives only 'index' rows, an empty walk log only 'delete' rows.
    """
    # Both states are narrow and read several times: for digests, for the leaves that differ, and for deletions.
    seen, index = staged(current_state(scan), "disk"), staged(indexed_state(files), "index")
    # A path seen without a readable hash is a record with a null value: it is not
    # 'removed', and it has nothing to index.
    changed = merkle.changed_records(merkle.records(seen, "root", "path", "hash"),
                                     merkle.records(index, "root", "path", "hash"))
    cursor = cursors(runs, diffs)
    told = mentions(diffs, cursor)
    state = (changed.select(F.col("part").alias("root"), F.col("key").alias("path"), "status", "value")
                    .join(cursor.select("root", F.lit(True).alias("replay")), "root", "left")
                    .join(told, ["root", "path"], "left"))
    replay, full = F.col("replay"), F.col("replay").isNull()
    todo = (F.when(F.col("value").isNotNull() & (full | (replay & (F.col("last") == "changed"))), "index")
             .when((F.col("status") == "removed") & full, "delete"))
    told_gone = (index.join(told.where("last = 'deleted'"), ["root", "path"], "left_semi")
                      .select("path", F.lit("delete").alias("todo")))
    return state.select("path", todo.alias("todo")).where("todo is not null").unionByName(told_gone)
