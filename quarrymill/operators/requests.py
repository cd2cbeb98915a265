"""What a request means in a tree: component types, environments, references and modules, and the verdict of a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_env
from . import catalog, index


def named_types(vocabulary: DataFrame, text: str, primary: str | None = None) -> DataFrame:
    """(component, position): the component types of a vocabulary (component) that a request names as whole words, by where
    they first stand; a hyphen stands for a blank as well. The primary type is always there, first if it isn't named."""
    spark = vocabulary.sparkSession
    known = vocabulary.select("component").filter("component <> ''")
    if primary:
        known = known.unionByName(spark.createDataFrame([(primary,)], "component string"))
    quoted = F.concat(F.lit("\\Q"), F.replace("component", F.lit("-"), F.lit("\\E[-\\s]\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    found = known.distinct().withColumn("position", F.regexp_instr(F.lit((text or "").lower()), pattern))
    return found.filter((F.col("position") > 0) | (F.col("component") == F.lit(primary or ""))).orderBy("position", "component")


def real_type(vocabulary: DataFrame, text: str, primary: str) -> DataFrame:
    """(component, remapped): the primary type if the tree has it, else the first type of the tree that the request names, else as it was."""
    real = vocabulary.select("component", F.lit(True).alias("real")).distinct()
    rows = named_types(vocabulary, text, primary).join(real, "component", "left").withColumn("own", F.col("component") == primary)
    tier = F.when(F.col("real") & F.col("own"), 0).when(F.col("real"), 1).otherwise(2)
    best = rows.orderBy(tier, "position", "component").limit(1)
    return best.select("component", (F.col("component") != primary).alias("remapped"))


def pick_env(hits: DataFrame, candidates: list[str]) -> DataFrame:
    """(env): the first of some environments whose directory a ranked hit (file, rank) lies in: by the hits' order, then the candidates'."""
    inside = [F.when(F.contains("file", F.lit(f"/{c}/")) | F.endswith("file", F.lit(f"/{c}")), F.lit(c)) for c in candidates]
    env = F.coalesce(*inside, F.lit(None).cast("string"))
    return hits.select("rank", env.alias("env")).filter("env is not null").orderBy("rank").limit(1).select("env")


def component_dir(file: Column, project: str, provider: str, component: str) -> Column:
    """The directory .../project/provider/<environment>/component that a file lies in, or null."""
    p = F.split(file, "/")
    there = F.filter(F.sequence(F.lit(4), F.size(p)), lambda k: (F.get(p, k - 1) == component) & (F.get(p, k - 3) == provider) & (F.get(p, k - 4) == project))
    return F.when((F.size(p) >= 4) & (F.size(there) > 0), F.array_join(F.slice(p, F.lit(1), F.get(there, F.lit(0))), "/"))


def envs_with(components: DataFrame, component: str) -> DataFrame:
    """(project, provider, env) that hold a component's inputs."""
    return components.filter(F.col("component") == component).select("project", "provider", "env").distinct()


def reference(components: DataFrame, hits: DataFrame, *, project: str, provider: str, component: str, env: str | None = None) -> DataFrame:
    """(file, dir, env, how): the component a request refers to. The environment asked for if that holds the component, else
    the closest hit (file, rank) in one, else any environment, by name."""
    mine = components.filter((F.col("project") == project) & (F.col("provider") == provider) & (F.col("component") == component))
    close = hits.select(component_dir(F.col("file"), project, provider, component).alias("dir"), "rank").filter("dir is not null").groupBy("dir").agg(F.min("rank").alias("rank"))
    asked = (norm_env(F.col("env")) == norm_env(F.lit(env))) if env else F.lit(False)
    rows = mine.join(close, "dir", "left").withColumn("how", F.when(asked, "requested").when(F.col("rank").isNotNull(), "retrieved").otherwise("any"))
    order = F.when(F.col("how") == "requested", 0).when(F.col("how") == "retrieved", 1).otherwise(2)
    return rows.orderBy(order, F.col("env") != F.lit(env or ""), F.col("rank").asc_nulls_last(), "env").limit(1).select("file", "dir", "env", "how")


def find_module(modules: DataFrame, resource_type: str) -> DataFrame:
    """The module of a type, one row at most: those that are called so or have the type before those that hold it in part; the most reused of equals."""
    t = F.lit(resource_type.lower())
    key, types = F.lower("dir"), F.transform("resource_types", F.lower)
    exact = (key == t) | F.array_contains(types, t)
    part = F.contains(key, t) | F.exists(types, lambda x: F.contains(x, t))
    tier = F.when(exact, 2).when(part, 1)
    return modules.withColumn("tier", tier).filter(F.col("tier").isNotNull() & F.lit(bool(resource_type))).orderBy(F.desc("tier"), F.desc("reuse_count"), "dir").limit(1)


def nearest_module(hits: DataFrame, modules: DataFrame, resource_type: str) -> DataFrame:
    """The module that the first of the ranked hits (file, rank) lies in whose module is related to a type, one row at most."""
    owned = index.longest_prefix(hits.select("file"), modules, "dir").withColumnRenamed("owner", "dir")
    related = modules.filter(catalog.module_relates(F.lit(resource_type), F.col("dir"), F.col("resource_types")))
    return hits.join(owned, "file").join(related, "dir").orderBy("rank").limit(1)


def entry_of(modules: DataFrame, component: str, tier_module: str) -> DataFrame:
    """A component's own module, one row at most: by the end of its path, else by its name below infrastructure, else a related one."""
    at = F.concat(F.lit("/"), F.rtrim(F.col("dir"), F.lit("/")))
    tier = F.when(F.endswith(at, F.lit(f"/infrastructure/{tier_module}/{component}")), 0).when((F.col("name") == component) & F.contains("dir", F.lit("infrastructure")), 1)
    tier = tier.when(catalog.module_relates(F.lit(component), F.col("dir"), F.col("resource_types")), 2)
    return modules.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.desc("reuse_count"), "dir").limit(1)


def verdict(stages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ok, failed): whether all stages (stage, ok, skipped) that were not skipped are well, and those that are not."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("skipped") & ~F.col("ok"), F.col("stage"))))
    return stages.groupBy(*by).agg(bad.alias("failed")).select(*by, (F.size("failed") == 0).alias("ok"), "failed")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random: by a hash of their key, so that a seed gives the same rows again."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)

