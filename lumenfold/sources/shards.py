"""Shard tables of a scan: reading them with their validations, what is done and what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.ordering import numbered
from lumenfold.session import Scratch


def load_shards(spark: SparkSession, path: str, tables: tuple[str, ...] = ("items_raw", "sidecars_raw", "videos_raw", "skipped_raw")) -> dict[str, DataFrame]:
    """The union of all shards' tables, partitioned by cfg, zipkey and shard; raises if they don't belong together."""
    out = {t: spark.read.parquet(f"{path.rstrip('/')}/{t}") for t in tables}
    bad = shard_problems(spark.read.parquet(f"{path.rstrip('/')}/shard_info")).take(1)
    if bad:
        raise ValueError(bad[0]["problem"])
    return out


def shard_problems(info: DataFrame) -> DataFrame:
    """(problem, key): missing keys, a shard given twice, an archive with two names, mixed configurations."""
    missing = info.where("zipkey is null or shard is null or cfg is null").select(F.lit("missing key").alias("problem"), F.col("zip_name").alias("key"))
    twice = info.groupBy("zipkey", "shard").count().where("count > 1").select(F.lit("duplicate shard").alias("problem"), F.concat_ws("/", "zipkey", "shard").alias("key"))
    names = info.groupBy("zipkey").agg(F.count_distinct("zip_name").alias("n")).where("n > 1").select(F.lit("two names").alias("problem"), F.col("zipkey").alias("key"))
    mixed = info.agg(F.count_distinct("cfg").alias("n")).where("n > 1").select(F.lit("mixed configurations").alias("problem"), F.col("n").cast("string").alias("key"))
    return missing.unionByName(twice).unionByName(names).unionByName(mixed)


def without_repeated_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs once; all rows of a repeated name go. Names are counted by partial sums, so a hot one is no burden."""
    once = df.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
    return df.join(once, name, "left_semi")


def extend_plan(plan: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The shard plan with the archives found: ids stay, `present` follows what is there, new archives are appended."""
    here = found.select("zipkey").distinct().withColumn("here", F.lit(True))
    old = plan.drop("present").join(here, "zipkey", "left").withColumn("present", F.coalesce("here", F.lit(False))).drop("here")
    last = plan.agg(F.coalesce(F.max("shard_id"), F.lit(-1)).alias("last")).first()["last"]
    new = found.join(plan.select("zipkey").distinct(), "zipkey", "left_anti")
    added = numbered(new, ["zipkey", "shard"], "shard_id", scratch).withColumn("shard_id", (F.col("shard_id") + last).cast(plan.schema["shard_id"].dataType)).withColumn("present", F.lit(True))
    return old.unionByName(added.select(*old.columns))


def pending(plan: DataFrame, done: DataFrame, key: str = "shard_id", size: str = "size") -> DataFrame:
    """Present shards without a checkpoint that isn't empty."""
    return plan.where("present").join(done.where(F.col(size) > 0).select(key).distinct(), key, "left_anti")


def split_work(plan: DataFrame, workers: int, key: str = "shard_id") -> DataFrame:
    """Add worker: shards go round the workers by id."""
    return plan.withColumn("worker", F.pmod(F.col(key), F.lit(workers)))
