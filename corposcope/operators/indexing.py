"""Incremental index maintenance: change sets, stable ids, and an index that grows by segments."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.functions import ngram
from corposcope.operators import fts
from corposcope.operators.prefix import running_sums
from corposcope.operators.segments import MOST_SEGMENTS, Segments
from corposcope.session import staged
from corposcope.sources.corpus import indexable

SCHEMA_VERSION = 5


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of old(path, hash) against new(path, hash): added, changed, unchanged or deleted."""
    o = old.select(F.col("path"), F.col("hash").alias("oh"), F.lit(True).alias("ino"))
    n = new.select(F.col("path"), F.col("hash").alias("nh"), F.lit(True).alias("inn"))
    status = (F.when(F.col("inn").isNull(), "deleted").when(F.col("ino").isNull(), "added")
               .when(F.col("oh").eqNullSafe(F.col("nh")), "unchanged").otherwise("changed"))
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def run_counters(change: DataFrame) -> DataFrame:
    """One row: processed, indexed, unchanged, deleted."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return change.agg(n("added", "changed", "unchanged").alias("processed"), n("added", "changed").alias("indexed"),
                      n("unchanged").alias("unchanged"), n("deleted").alias("deleted"))


def union_change_lists(lists: DataFrame) -> DataFrame:
    """(root, path, status) of (root, ordinal, changed, deleted): the last list that names a path wins."""
    row = lambda c, s: lists.select("root", "ordinal", F.explode(c).alias("path"), F.lit(s).alias("status"))
    every = row("changed", "changed").unionByName(row("deleted", "deleted")).where("path is not null")
    return every.groupBy("root", "path").agg(F.min_by("status", F.struct(-F.col("ordinal"), F.col("status"))).alias("status"))


def parse_change_text(text: str) -> list[tuple[str, str]]:
    """(status, path) of lines 'M<TAB>path'; renames give a deletion and an addition."""
    out = []
    for line in text.splitlines():
        kind, _, rest = line.partition("\t")
        if not rest:
            continue
        paths = rest.split("\t")
        if kind[:1] == "R" and len(paths) == 2:
            out += [("D", paths[0]), ("A", paths[1])]
        else:
            out.append((kind[:1], paths[-1]))
    return out


def with_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``file_id``: kept for known paths, then counted on from the largest in order of path.

    The numbering is a distributed prefix sum, so no task sees all new paths.
    """
    known = old.select("path", "file_id")
    top = old.agg(F.max("file_id")).first()[0] or 0
    fresh = new.join(known, "path", "left_anti").withColumn("all", F.lit(0))
    fresh = running_sums(fresh, ["all"], [F.col("path").asc()], {"file_id": F.lit(1)}, "ids").drop("all")
    fresh = fresh.withColumn("file_id", F.col("file_id") + F.lit(top))
    return new.join(known, "path").unionByName(fresh.select(*new.columns, "file_id"))


class IndexStore(Segments):
    """The index of a corpus: files, postings by stem, n-grams and lengths, in segments with one pointer.

    The manifest also holds the number of live files and tokens and the largest id, so
    no search counts the corpus.  A schema version other than the current one means that
    the index is rebuilt.
    """

    TABLES = ("files", "postings", "ngrams", "lengths")

    def read(self, table: str, where=None) -> DataFrame | None:
        return self.live(table, ["file_id"], where=where)

    def metadata(self) -> dict:
        """Version, commit cursor and counts of the published index; empty before the first run."""
        return {k: v for k, v in self.manifest().items() if k != "segments"}

    def usable(self) -> bool:
        return self.manifest().get("version") == SCHEMA_VERSION

    def write(self, files: DataFrame, last_commit: str | None = None, *, force: bool = False, given_ids: bool = False, dirty: list[str] = ()) -> dict[str, int]:
        """Index all of ``files(path, content, hash)``; paths that it lacks are removed, and only changed files are tokenised unless ``force``.

        ``given_ids`` takes the ids from a column ``file_id`` instead of numbering new paths.
        """
        was = self.manifest() if self.usable() and not force else {}
        files = files.where(indexable(F.col("path"))) if not given_ids else files
        before, state = self._known(was), {"last_indexed_commit": last_commit, "dirty": list(dirty)}
        if not was:  # nothing to compare with, so the text is not read for that
            n = self._apply(was, files, before, state, given_ids)
            return {"processed": n, "indexed": n, "unchanged": 0, "deleted": 0}
        change = staged(changes(before, files), "change")
        counters = run_counters(change).first().asDict()
        touched = change.where("status in ('added', 'changed')").select("path")
        self._apply(was, files.join(touched, "path", "left_semi"), before.join(change.where("status in ('changed', 'deleted')"), "path", "left_semi"), state, given_ids)
        return counters

    def update(self, files: DataFrame, deleted: DataFrame, last_commit: str | None = None, *, dirty: list[str] = ()) -> dict[str, int]:
        """Index ``files(path, content, hash)`` and remove ``deleted(path)``; every other path stays as it is."""
        was = self.manifest() if self.usable() else {}
        files = staged(files.where(indexable(F.col("path"))), "delta")
        named = files.select("path").union(deleted.select("path")).distinct()
        before = self._known(was).join(named, "path", "left_semi")
        change = staged(changes(before, files), "change")
        counters = run_counters(change).first().asDict()
        self._apply(was, files.join(change.where("status in ('added', 'changed')").select("path"), "path", "left_semi"),
                    before.join(change.where("status in ('changed', 'deleted')"), "path", "left_semi"),
                    {"last_indexed_commit": last_commit if last_commit is not None else was.get("last_indexed_commit"), "dirty": list(dirty)}, False)
        return counters

    def _known(self, was: dict) -> DataFrame:
        known = self.live("files", ["file_id"], was) if was else None
        return known.select("file_id", "path", "hash") if known is not None else self.spark.createDataFrame([], "file_id long, path string, hash long")

    def _apply(self, was: dict, rows: DataFrame, replaced: DataFrame, state: dict, given_ids: bool) -> int:
        """Write one segment with ``rows``, and the ids of ``replaced(file_id, path)`` as gone; then publish. Returns the number of rows."""
        replaced = staged(replaced.select("file_id", "path"), "replaced")
        if not given_ids:
            rows = self._numbered(rows, replaced, was.get("last_id", 0))
        # Ids follow the order of paths in the input, so sorting inside tasks is enough for a scan to skip other ids.
        entry = self.add({"files": rows.select("file_id", "path", "content", "hash", F.length("content").cast("long").alias("size"), F.current_timestamp().alias("indexed_at")).sortWithinPartitions("file_id")},
                         replaced.select("file_id") if was and not replaced.isEmpty() else None)
        now = self.part(entry, "files")
        posts = staged(fts.posting_rows(now), "postings")
        lengths = posts.where("term is null").select("file_id", "length")
        entry = self.add({"postings": self.ordered("postings", posts.where("term is not null")), "lengths": lengths,
                          "ngrams": self.ordered("ngrams", staged(ngram.index(now), "ngrams"))}, to=entry)
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"), F.max("file_id").alias("m")).first()
        new = count(lengths)
        old = count(self.live("lengths", ["file_id"], was).join(replaced, "file_id", "left_semi")) if was else {"n": 0, "t": 0}
        made = {"version": SCHEMA_VERSION, **state, "segments": [*was.get("segments", []), entry], "files": was.get("files", 0) + new["n"] - old["n"],
                "tokens": was.get("tokens", 0) + (new["t"] or 0) - (old["t"] or 0), "last_id": max(was.get("last_id", 0), new["m"] or 0), "dead": was.get("dead", 0) + old["n"]}
        if len(made["segments"]) > MOST_SEGMENTS or made["dead"] > made["files"] / 4 + 1000:
            made = self.compacted(made, ["file_id"]) | {"dead": 0}
        self.publish(made)
        return new["n"]

    def ordered(self, table: str, rows: DataFrame) -> DataFrame:
        """Postings by stem and n-grams by key, both split inside long lists, so that a search skips other row groups."""
        if table == "postings":
            return rows.repartitionByRange("stem", "file_id").sortWithinPartitions("stem", "term", "file_id")
        return rows.repartitionByRange("ngram", "file_id").sortWithinPartitions("ngram") if table == "ngrams" else rows.sortWithinPartitions("file_id")

    def _numbered(self, rows: DataFrame, replaced: DataFrame, top: int) -> DataFrame:
        """``rows`` with ids: kept for known paths, then counted on from the largest ever given, in order of path."""
        fresh = rows.select("path").join(replaced, "path", "left_anti").withColumn("all", F.lit(0))
        fresh = running_sums(fresh, ["all"], [F.col("path").asc()], {"file_id": F.lit(1)}, "ids")
        ids = replaced.unionByName(fresh.select((F.col("file_id") + F.lit(top)).alias("file_id"), "path"))
        return rows.join(ids, "path")
