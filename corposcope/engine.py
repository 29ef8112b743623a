"""Facade: one workspace, its index and its tools.

Methods return DataFrames; nothing is collected except the few numbers that a plan
needs as constants.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.errors import FileNotIndexed, StaleIndex, ToolError
from corposcope.functions import ngram
from corposcope.operators import docops, outline, refs, security
from corposcope.operators.fusion import SearchConfig
from corposcope.operators.indexing import IndexStore
from corposcope.plans import search as plans
from corposcope.session import staged
from corposcope.sources import corpus as sources
from corposcope.sources import vcs
from corposcope.sources.corpus import IndexConfig


class Engine:
    def __init__(self, spark: SparkSession, index_path: str, root: str = "", config: SearchConfig = SearchConfig()):
        self.spark, self.root, self.config = spark, root, config
        self.store = IndexStore(spark, index_path)

    @classmethod
    def open(cls, spark: SparkSession, root: str, index_path: str) -> "Engine":
        """A workspace directory, checked, with an incremental run if an index exists already."""
        engine = cls(spark, index_path, security.workspace_root(root))
        if engine.store.metadata():
            engine.index()
        return engine

    def index(self, *, force: bool = False, files: DataFrame | None = None, commit: str | None = None, config: IndexConfig = IndexConfig()) -> dict[str, int]:
        """Index the workspace, or the given (path, content); returns the run's counters.

        Below version control a run reads only the paths that changed since the indexed
        commit, and those that were uncommitted then; without a usable cursor, and with
        ``force``, it walks all files but the ignored ones.
        """
        text = lambda rows: security.visible(rows.select("path", "content")).withColumn("hash", F.xxhash64("content"))
        options = {"include_hidden": config.include_hidden, "max_bytes": config.max_file_size, "extensions": config.extensions}
        if files is not None:
            return self.store.write(text(files), commit, force=force)
        head = vcs.head_or_none(self.root)
        if head is None:
            return self.store.write(text(sources.walk(self.spark, self.root, **options)), commit, force=force)
        before = self.store.metadata()
        since = before.get("last_indexed_commit")
        told = vcs.changes(self.root, since if since and vcs.is_ancestor(self.root, since) else None)
        dirty = sorted({p for i, _, p in told if i > 0})
        if force or not self.store.usable() or not since or not vcs.is_ancestor(self.root, since):
            rows = sources.walk(self.spark, self.root, ignored=vcs.ignored(self.root), **options)
            return self.store.write(text(rows), commit or head, force=force, dirty=dirty)
        paths = sorted({p for _, _, p in told} | set(before.get("dirty", [])))
        there = [p for p in paths if os.path.isfile(os.path.join(self.root, p))]
        rows = text(sources.walk(self.spark, self.root, load=there, **options)) if there else self._nothing()
        whole = [(f"{self.root}/{p}",) for p in paths]
        gone = self.spark.createDataFrame(whole, "path string") if whole else self._nothing().select("path")
        # A changed path that is not read any more (gone, grown too large, not text) leaves the index.
        rows = staged(rows, "changed-files")
        return self.store.update(rows, gone.join(rows.select("path"), "path", "left_anti"), commit or head, dirty=dirty)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "path string, content string, hash long")

    def corpus(self) -> DataFrame:
        return self._live().read("files").select("file_id", "path", "content")

    def _live(self) -> IndexStore:
        if not self.store.manifest():
            raise ToolError("The index is empty. Run index first.")
        if not self.store.usable():
            raise StaleIndex("The index has another schema version. Run index again.")
        return self.store

    def _file(self, path: str) -> DataFrame:
        whole = security.readable(self.root, path) if self.root else path
        found = self.corpus().where(F.col("path") == whole)
        if found.isEmpty():
            raise FileNotIndexed(f"File not found: {path}")
        return found

    def search(self, query: str, limit: int = 20, mode: str = "combined") -> DataFrame:
        """The best files, with ``has_more`` if others follow."""
        return plans.search_index(self._live(), query, limit, mode, self.config)

    def refs(self, symbol: str, limit: int = 50) -> DataFrame:
        rows = refs.references(security.visible(self.corpus()), symbol)
        return rows.orderBy("path", "line_no").limit(plans.clamped(limit, 500))

    def outline(self, path: str) -> DataFrame:
        return outline.outline(self._file(path)).drop("lang").orderBy("line_no")

    def get(self, path: str, start: int = 1, end: int = 0) -> DataFrame:
        return docops.get_range(self._file(path), start, end)

    def context(self, path: str, line: int, around: int = 10) -> DataFrame:
        return docops.context(self._file(path), line, min(around, 500))

    def toc(self, path: str = "", depth: int = 3) -> DataFrame:
        base = "/".join(p for p in (self.root, path.strip("./")) if p)
        return docops.tree(self.corpus(), base, min(depth, 10))

    def diff(self, a: str, b: str, around: int = 3, max_lines: int = 5000) -> DataFrame:
        old = self._file(a).select(F.lit(f"{a}..{b}").alias("key"), F.col("content").alias("old"))
        new = self._file(b).select(F.lit(f"{a}..{b}").alias("key"), F.col("content").alias("new"))
        return docops.diffs(old.join(new, "key"), around, max_lines)

    def stats(self) -> DataFrame:
        n = self._live().read("ngrams").select("ngram").distinct().count()
        return docops.index_stats(self.store.metadata()["files"], n, self.spark)

    def paths(self, ids: list[int]) -> DataFrame:
        """(file_id, path) of the given ids; unknown ids give no row."""
        return self._live().read("files", where=F.col("file_id").isin(ids)).select("file_id", "path")

    def ids(self, paths: list[str]) -> DataFrame:
        """(path, file_id) of the given paths below the root; unknown paths give no row."""
        whole = [f"{self.root}/{p}" if self.root and not p.startswith("/") else p for p in paths]
        return self._live().read("files", where=F.col("path").isin(whole)).select("path", "file_id")

    def by_type(self) -> DataFrame:
        return docops.by_type(self.corpus())

    def candidates(self, pattern: str) -> DataFrame:
        """Files that may match a pattern, from the stored n-gram index."""
        from corposcope.operators.ngram_index import candidates, pattern_ngrams

        grams = pattern_ngrams(pattern)
        return candidates(self._live().read("ngrams", where=F.col("ngram").isin([ngram.key(g) for g in grams])), grams)

    def compacted_ngrams(self) -> DataFrame:
        from corposcope.operators.ngram_index import compact

        return compact(self.store.read("ngrams"))

