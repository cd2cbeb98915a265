"""The corpus jobs: file funnel with exact dedup, and the metadata funnel with its joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value: licences that may be kept.
LICENSES = ("MIT", "Apache-2.0", "BSD-3-Clause")
MIN_SIZE_KB = 5


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by order. Catalyst limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def exact_dedup(files: DataFrame, content: Column, *order: Column) -> DataFrame:
    """One row per content, by its sha1."""
    return first_per_key(files.withColumn("sha1", F.sha1(content)), ["sha1"], *order)


def files_job(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of stage counts) of extracted files: structurally sound, free of secrets, then one per content.

    The counts are one pass with conditional aggregates; a distinct count stands for the window.
    """
    clean = F.col("parse_ok") & ~F.col("has_secret")
    counts = files.agg(
        F.count("*").alias("files"), F.count_if(F.col("parse_ok")).alias("parse_ok"), F.count_if(clean).alias("no_secret"), F.count_distinct(F.when(clean, F.col("sha1"))).alias("unique")
    )
    return first_per_key(files.filter(clean), ["sha1"], F.col("repo_id"), F.col("path")), counts


def run_files_job(files: DataFrame, path: str) -> DataFrame:
    """Run the files job into a folder partitioned by extension, and count its stages: one row.

    files is read once, whatever it costs to make: the rows that pass are written while all are observed, and what is
    written is then taken one per content, observed again. Both observations are made in the tasks that write, so a lost
    executor's tasks count once; no scan serves counting. The rows in between are deleted.
    """
    spark = files.sparkSession
    seen, kept = Observation(), Observation()
    clean = F.col("parse_ok") & ~F.col("has_secret")
    counted = files.observe(seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("parse_ok")).alias("parse_ok"), F.count_if(clean).alias("no_secret"))
    between = scratch_path(spark, "extracted")
    counted.filter(clean).write.parquet(between)
    rows = spark.read.schema(files.schema).parquet(between)
    unique = first_per_key(rows, ["sha1"], F.col("repo_id"), F.col("path"))
    unique.observe(kept, F.count(F.lit(1)).alias("unique")).write.mode("overwrite").partitionBy("ext").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(between)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    counts = seen.get | kept.get
    return spark.createDataFrame([tuple(int(counts[c]) for c in ("files", "parse_ok", "no_secret", "unique"))], 'files long, parse_ok long, no_secret long, `unique` long')


def metadata_stages(repos: DataFrame, *, licenses: tuple[str, ...] = LICENSES, min_size_kb: int = MIN_SIZE_KB) -> dict[str, DataFrame]:
    """licensed, active, deduped, sized - in this order, which matters: a size filter must not move across the dedup."""
    licensed = repos.filter(F.col("License").isin(*licenses))
    active = licensed.filter(F.col("Archived") == 0)
    deduped = first_per_key(active, ["FullName"], F.desc("StarCount"), F.asc("Id"))
    return {"licensed": licensed, "active": active, "deduped": deduped, "sized": deduped.filter(F.col("SizeInKb") > min_size_kb)}


def metadata_join(sized: DataFrame, modules: DataFrame, resources: DataFrame) -> DataFrame:
    repos = sized.select(F.col("Id").alias("RepoId"), "FullName", "License", "StarCount")
    mine = modules.select(F.col("Id").alias("ModuleId"), "RepositoryId", "Path").join(repos, F.col("RepositoryId") == F.col("RepoId"))
    return mine.join(resources.withColumnRenamed("Id", "ResourceId"), "ModuleId")


def metadata_counts(repos: DataFrame, modules: DataFrame, resources: DataFrame) -> DataFrame:
    """The funnel in one row. The stages before the dedup are one pass over the repositories."""
    s = metadata_stages(repos)
    ok = F.col("License").isin(*LICENSES)
    first = repos.agg(F.count("*").alias("raw"), F.count_if(ok).alias("licensed"), F.count_if(ok & (F.col("Archived") == 0)).alias("active"))
    second = s["deduped"].agg(F.count("*").alias("deduped"), F.count_if(F.col("SizeInKb") > MIN_SIZE_KB).alias("sized"))
    joined = metadata_join(s["sized"], modules, resources).agg(F.count_distinct("ModuleId").alias("modules"), F.count("*").alias("resources"))
    return first.join(second).join(joined)  # three one-row tables


def top_groups(df: DataFrame, column: str, n: int = 25) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
