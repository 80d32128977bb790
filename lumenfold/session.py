"""Session helpers: a local session for tests, table reading, and scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def local_session(cores: int = 4, shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Spark send the package to Python workers that can't import it from the driver's PYTHONPATH or folder.

    Done once for an application; the archive is served by the driver, so executors need no copy of the repository.
    """
    package = Path(__file__).resolve().parent
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if spark.sparkContext.master.startswith("local["):  # the workers start in the driver's folder
        known.append(os.getcwd())
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and Path(p).resolve() == package.parent for p in known):
        return
    folder = tempfile.mkdtemp(prefix="lumenfold-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where a local session names none (tests on one machine) a temporary folder is made once and set; on a cluster, where a folder
    of one machine would lose tables, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage and survives the loss of an executor. `drop` deletes tables that
    nothing reads any more; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._at: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return the written table."""
        return self.save_counted(df, name)[0]

    def save_counted(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
        """The same with the number of rows, observed while writing."""
        out, seen = self.save_observed(df, name, n=F.count(F.lit(1)))
        return out, int(seen["n"])

    def save_observed(self, df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
        """The same with aggregates of the rows by name, observed while writing."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation()
        df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]
        return out, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later plan reads."""
        for t in tables:
            path = self._at.pop(id(t), None) if t is not None else None
            if path:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def bench_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
