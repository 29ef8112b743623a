"""Queries of the incremental-change problem and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.operators import merkle
from corposcope.operators.pending import current_state, indexed_state, pending_paths
from corposcope.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pending_paths(table(spark, d, "files").select("path", "hash"),
                         table(spark, d, "file_scan").select("path", "hash", "seen_at"),
                         table(spark, d, "git_diffs").select("root", "commit_no", "head_oid", "changed", "deleted"),
                         table(spark, d, "index_runs").select("root", "run_no", "outcome", "head_oid"))


def p4_tree_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every path whose disk state and indexed state differ, by Merkle descent."""
    disk = current_state(table(spark, d, "file_scan")).where("hash is not null")
    index = indexed_state(table(spark, d, "files"))
    out = merkle.changed_records(merkle.records(disk, "root", "path", "hash"),
                                 merkle.records(index, "root", "path", "hash"))
    return out.select(F.col("part").alias("root"), F.col("key").alias("path"), "status")


QUERIES = {"p4_found": p4_found, "p4_tree_diff": p4_tree_diff}

_STATE = r"""
seen as (select regexp_extract(path, '^(/[^/]*/[^/]*)', 1) as root, path,
                max(hash) filter (where hash is not null and seen_at = m) as hash
         from (select *, max(case when hash is not null then seen_at end) over (partition by path) as m
               from file_scan where path is not null) group by 1, 2),
disk as (select * from seen where hash is not null),
idx as (select regexp_extract(path, '^(/[^/]*/[^/]*)', 1) as root, path, max(hash) as hash
        from files where path is not null group by 1, 2)
"""

ORACLE = {
    "p4_tree_diff": f"""
with {_STATE}
select coalesce(disk.root, idx.root) as root, coalesce(disk.path, idx.path) as path,
       case when idx.path is null then 'added' when disk.path is null then 'removed' else 'changed' end as status
from disk full outer join idx on disk.path = idx.path
where idx.path is null or disk.path is null or disk.hash is distinct from idx.hash
""",
    "p4_found": f"""
with {_STATE},
lastok as (select root, arg_max(head_oid, run_no) as head_oid from index_runs where outcome = 'ok' and head_oid is not null group by root),
cur as (select l.root, max(g.commit_no) as cursor_no from lastok l join git_diffs g on g.root = l.root and g.head_oid = l.head_oid group by l.root),
m as (select g.root, unnest(changed) as path, commit_no, 1 as r from git_diffs g join cur on cur.root = g.root where commit_no > cursor_no
      union all
      select g.root, unnest(deleted) as path, commit_no, 0 as r from git_diffs g join cur on cur.root = g.root where commit_no > cursor_no),
lm as (select root, path, arg_max(r, commit_no * 2 + r) as r from m where path is not null group by 1, 2)
select d.path, 'index' as todo from disk d left join idx on idx.path = d.path
where d.hash is distinct from idx.hash and
      (exists (select 1 from lm where lm.path = d.path and lm.root = d.root and lm.r = 1)
       or d.root not in (select root from cur))
union all
select i.path, 'delete' from idx i
where exists (select 1 from lm where lm.path = i.path and lm.root = i.root and lm.r = 0)
   or (i.root not in (select root from cur) and i.path not in (select path from seen))
""",
}
