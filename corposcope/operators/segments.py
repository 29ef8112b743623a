"""Tables that grow by immutable segments, published by one atomic rename.

A run writes one segment: the new rows of every table and, for rows of earlier
segments that it replaces or removes, their keys (``gone``).  A row is live if no
later segment lists its key.  The pointer file holds the list of segments and any
further state of the run, so output and state become current together: readers see
the old list or the new one, and a run that dies leaves folders that nothing names.
What a run writes follows the change; when many segments or replaced keys have come
together, ``compacted`` writes the live rows as one segment.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_SEGMENTS = 12


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The published state; empty before the first run."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, *, to: dict | None = None) -> dict:
        """Write one segment, or more tables of one, which nothing reads before its entry is published; returns the entry."""
        name = to["name"] if to else f"seg-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{table}")
        entry = (to or {"name": name}) | {"schema": (to or {}).get("schema", {}) | {t: df.schema.jsonValue() for t, df in tables.items()}}
        if gone is not None:
            gone.distinct().write.parquet(f"{self.path}/{name}/gone")
            entry["gone"] = gone.schema.jsonValue()
        return entry

    def part(self, entry: dict, table: str) -> DataFrame:
        """The rows of one table in one segment, live or not."""
        schema = entry["gone"] if table == "gone" else entry["schema"][table]
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/{entry['name']}/{table}")

    def live(self, table: str, keys: list[str], manifest: dict | None = None, where=None) -> DataFrame | None:
        """Live rows of a table; ``where`` filters each segment's scan. ``keys`` are the columns of ``gone`` (null-safe)."""
        entries = (manifest or self.manifest()).get("segments", [])
        if not entries:
            return None
        rows, gone = None, None
        for i, entry in enumerate(entries):
            one = self.part(entry, table)
            one = (one if where is None else one.where(where)).withColumn("__seg", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
            if "gone" in entry:
                g = self.part(entry, "gone").select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(i).alias("__later"))
                gone = g if gone is None else gone.unionByName(g)
        if gone is not None:
            same = F.col("__seg") < F.col("__later")
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            rows = rows.join(gone.groupBy(*[f"__{k}" for k in keys]).agg(F.max("__later").alias("__later")), same, "left_anti")
        return rows.drop("__seg")

    def compacted(self, manifest: dict, keys: list[str]) -> dict:
        """The manifest with all live rows in one fresh segment."""
        tables = {t: self.ordered(t, self.live(t, keys, manifest)) for t in manifest["segments"][-1]["schema"]}
        return manifest | {"segments": [self.add(tables)]}

    def ordered(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows in the order in which a table is written."""
        return rows

    def publish(self, manifest: dict) -> None:
        """Make a manifest current: one atomic rename over the pointer."""
        jvm, fs = self._fs()
        new = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.next-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        opts = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT"), opts)

    def vacuum(self) -> list[str]:
        """Delete the segments that the current manifest does not name; to be run when no reader or writer is active."""
        jvm, fs = self._fs()
        keep = {e["name"] for e in self.manifest().get("segments", [])}
        dead = [s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)) if s.getPath().getName().startswith(("seg-", ".next-")) and s.getPath().getName() not in keep]
        for s in dead:
            fs.delete(s.getPath(), True)
        return [s.getPath().getName() for s in dead]
