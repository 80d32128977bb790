"""Index snapshots: a folder of Parquet tables that counts once its manifest, written last, is there."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, POINTER, INDEX_SCHEMA = "manifest.json", "current.json", 1


def safe_path(rel: str) -> str:
    """A relative path without empty, . or .. parts, drive letters or controls; anything else raises ValueError."""
    parts = rel.split("/")
    if not rel or rel.startswith("/") or "\\" in rel or any(p in ("", ".", "..") for p in parts) or re.search(r"[\x00-\x1f:]", rel):
        raise ValueError("unsafe path")
    return str(PurePosixPath(rel))


class Store:
    """Files under a root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, rel: str):
        return self._path(f"{self.root}/{safe_path(rel)}")

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._at(rel))

    def list(self, rel: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(rel))) if self.exists(rel) else []

    def read(self, rel: str) -> str:
        stream = self._fs.open(self._at(rel))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, rel: str, text: str) -> None:
        """Written beside, then renamed: readers see the old or the new text."""
        tmp = self._path(f"{self.root}/{safe_path(rel)}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        # FileContext replaces the target in one step, where FileSystem.rename would refuse.
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration()) if tmp.toUri().getScheme() else hadoop.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context.rename(tmp, self._at(rel), options)

    def delete(self, rel: str) -> None:
        if self.exists(rel):
            self._fs.delete(self._at(rel), True)


def config_hash(config: dict) -> str:
    """Ten hex digits of the canonical form of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10]


def write_snapshot(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], config: dict, partial: bool = False) -> dict:
    """Write all tables, then the manifest; a manifest of an earlier attempt goes first."""
    store, folder = Store(spark, root), safe_path(name)
    store.delete(f"{folder}/{MANIFEST}")
    files = []
    for t, df in tables.items():
        path = f"{store.root}/{folder}/{t}.parquet"
        df.write.mode("overwrite").parquet(path)
        files.append({"table": t, "rows": spark.read.parquet(path).count()})
    sums = checksums(spark, f"{store.root}/{folder}").collect()  # a row for each file of the snapshot
    manifest = {"index_schema": INDEX_SCHEMA, "cfg": config_hash(config), "partial": partial, "tables": files, "files": [{"path": r["path"], "size": r["size"], "sha256": r["sha256"]} for r in sums]}
    store.write(f"{folder}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    return manifest


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every Parquet file of a snapshot, hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    rel = F.regexp_replace(F.col("path"), r"^.*/([^/]+\.parquet/[^/]+)$", "$1")
    return files.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, root: str, name: str) -> dict:
    m = json.loads(Store(spark, root).read(f"{safe_path(name)}/{MANIFEST}"))
    if m["index_schema"] != INDEX_SCHEMA:
        raise ValueError("another index schema")
    return m


def check_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, problem): files missing, added or changed against the manifest; empty if all is well."""
    m = read_manifest(spark, root, name)
    want = spark.createDataFrame([(f["path"], f["size"], f["sha256"]) for f in m["files"]], "path string, want_size long, want_sha string")
    have = checksums(spark, f"{root.rstrip('/')}/{safe_path(name)}")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("want_size").isNull(), "added").when(F.col("size") != F.col("want_size"), "size").when(F.col("sha256") != F.col("want_sha"), "content")
    return want.join(have, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def read_table(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A table of a complete snapshot; without a manifest there is none."""
    read_manifest(spark, root, name)
    return spark.read.parquet(f"{root.rstrip('/')}/{safe_path(name)}/{safe_path(table)}.parquet")


def set_current(spark: SparkSession, root: str, name: str) -> None:
    read_manifest(spark, root, name)
    Store(spark, root).write(POINTER, json.dumps({"snapshot": safe_path(name)}))


def current(spark: SparkSession, root: str) -> str:
    return json.loads(Store(spark, root).read(POINTER))["snapshot"]
