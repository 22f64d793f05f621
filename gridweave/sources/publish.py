"""Several tables published at once: all of a version's tables are written first, one small manifest makes them visible.

A version's tables lie in a folder of its own below `data`, written by Spark as Parquet. Its manifest is written under
another name and renamed last; manifests are numbered, and a reader takes the highest. A failure before the rename leaves
the version before it as it was. Of two writers of one number only one's rename succeeds; the other is told so.

The rename goes through Hadoop's file system, so the folder may lie in any store that renames a file as one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import GridError

_DIGITS = 12


class _Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.files = self.path("").getFileSystem(self._conf)

    def path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        place = self.path("manifests")
        if not self.files.exists(place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:_DIGITS].isdigit())

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self.path(name), False)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def publish(tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> int:
    """Write all tables and make them visible at once; returns the version. Tables are what readers find, no others."""
    if not tables:
        raise GridError("E106", "nothing to publish")
    for name, df in tables.items():
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise GridError("E413", f"column titles of {name} must differ in more than case")
    spark = next(iter(tables.values())).sparkSession
    folder, stage = _Folder(spark, root), f"data/{uuid.uuid4().hex}"
    version = (folder.versions() or [0])[-1] + 1
    places = {}
    try:
        for i, (name, df) in enumerate(tables.items()):
            places[name] = {"path": f"{stage}/{i}", "schema": df.schema.jsonValue()}
            df.write.parquet(f"{folder.root}/{stage}/{i}", partitionBy=list((partition_by or {}).get(name, ())) or None)
        folder.write(f"{stage}/manifest.json", json.dumps({"version": version, "tables": places}))
        folder.files.mkdirs(folder.path("manifests"))
        last = folder.path(f"manifests/{version:0{_DIGITS}d}.json")
        if folder.files.exists(last) or not folder.files.rename(folder.path(f"{stage}/manifest.json"), last):
            raise GridError("E106", f"version {version} was published by another writer")
    except BaseException:
        folder.files.delete(folder.path(stage), True)
        raise
    return version


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last version, or of a given one."""
    from pyspark.sql.types import StructType

    folder = _Folder(spark, root)
    known = folder.versions()
    if not known or (version is not None and version not in known):
        raise GridError("E106", f"no version {version or ''} at {root}")
    manifest = json.loads(folder.read(f"manifests/{version or known[-1]:0{_DIGITS}d}.json"))
    schemas = {name: StructType.fromJson(t["schema"]) for name, t in manifest["tables"].items()}
    return {name: spark.read.schema(schemas[name]).parquet(f"{folder.root}/{t['path']}") for name, t in manifest["tables"].items()}


def prune(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last `keep` versions and what failed writers left; nobody may be reading or writing them."""
    folder = _Folder(spark, root)
    known = folder.versions()
    gone, kept = known[: max(0, len(known) - max(keep, 1))], known[max(0, len(known) - max(keep, 1)) :]
    used = {t["path"].split("/")[1] for v in kept for t in json.loads(folder.read(f"manifests/{v:0{_DIGITS}d}.json"))["tables"].values()}
    for v in gone:
        folder.files.delete(folder.path(f"manifests/{v:0{_DIGITS}d}.json"), False)
    if folder.files.exists(folder.path("data")):
        for found in folder.files.listStatus(folder.path("data")):
            if found.getPath().getName() not in used:
                folder.files.delete(found.getPath(), True)
    return len(gone)
