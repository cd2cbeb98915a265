"""Conventions, root files, environments and paths, from the table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename, dirname, norm_env

# Patterns of root files.
MODULE_BLOCK = r'\bmodule\s+"[^"]+"\s*\{'
FIND_PARENT = r"""\bfind_in_parent_folders\s*\(\s*(?:"([^"]+)"|'([^']+)')\s*\)"""
ENV_FIELD = r"\blocal\.env_cfg\.([A-Za-z_]\w*)\b"
BACKEND = r'\bbackend\s*=\s*"([^"]+)"'
PROVIDER = r'\bprovider\s+"([^"]+)"\s*\{'


def convention(files: DataFrame, by: str = "repo") -> DataFrame:
    """(repo, kind, confidence): terragrunt over modules over flat."""
    tg = F.bool_or(basename(F.col("file")) == "terragrunt.hcl")
    mod = F.bool_or((F.col("file").endswith(".tf") & F.col("text").rlike(MODULE_BLOCK)) | F.col("file").startswith("modules/"))
    flat = F.bool_or(F.col("file").endswith(".tf"))
    out = files.groupBy(by).agg(tg.alias("tg"), mod.alias("mod"), flat.alias("flat"))
    kind = F.when(F.col("tg"), "terragrunt").when(F.col("mod"), "tf-modules").otherwise("tf-flat")
    return out.select(by, kind.alias("kind"), F.when(F.col("tg") | F.col("mod"), "high").when(F.col("flat"), "medium").otherwise("low").alias("confidence"))


def root_schema(text: Column) -> Column:
    """What a root file fixes: the environment's config file and fields, backend, provider, and how much of it was found."""
    config = F.regexp_extract(text, FIND_PARENT, 1)
    fields = F.array_distinct(F.regexp_extract_all(text, F.lit(ENV_FIELD), F.lit(1)))
    backend, provider = F.regexp_extract(text, BACKEND, 1), F.regexp_extract(text, PROVIDER, 1)
    found = (config != "").cast("int") + (F.size(fields) > 0).cast("int") + (backend != "").cast("int") + (provider != "").cast("int")
    return F.struct(config.alias("env_config"), fields.alias("fields"), backend.alias("backend"), provider.alias("provider"), F.when(found == 4, "full").when(found > 0, "partial").otherwise("fallback").alias("confidence"))


#: More patterns of root files, the names a root file may have without being included, and what holds without one.
FIND_PARENT_NOARG = r"\bfind_in_parent_folders\s*\(\s*\)"
ROOT_SOURCE = r'\bsource\s*=\s*"([^"]+)"'
DYNAMIC_SOURCE = r"modules//([^/]+)/infrastructure/?\$\{[^}]+terraform_module[^}]*\}/\$\{[^}]+\}"
INTERPOLATION = r"\$\{[^}]+\}"
ROOT_NAMES = ("root.hcl", "terragrunt.hcl", "account.hcl", "common.hcl")
TEMPLATE = "modules/{provider}/infrastructure/{terraform_module}/{component}"
CONFIG, FIELDS, BACKEND_NAME, PROVIDER_NAME = "config.yml", ("terraform_module", "region", "account_id"), "s3", "aws"
PLAIN_CONFIG, PLAIN_FIELDS = "terraform.tfvars", ("environment", "region")
ENV_ROOTS = ("environments", "envs", "env", "live", "stacks", "deployments")


def source_template(source: Column) -> Column:
    """The path a module source stands for, with {terraform_module} and {component} where the source computes them; a source
    without computed parts is its own template from `modules/` on, and one without that has none."""
    provider = F.regexp_extract(source, DYNAMIC_SOURCE, 1)
    literal = F.btrim(F.regexp_replace(source, INTERPOLATION, ""), F.lit("/"))
    tail = F.btrim(F.regexp_extract(literal, r"modules/.*", 0), F.lit("/"))
    return F.when(provider != "", F.concat(F.lit("modules/"), provider, F.lit("/infrastructure/{terraform_module}/{component}"))).when(F.contains(tail, F.lit("/")), tail)


def static_prefix(template: Column) -> Column:
    """What stands before the first hole of a template."""
    return F.regexp_replace(F.regexp_replace(template, r"(?s)\{.*$", ""), "/+$", "")


def fill(template: Column, provider: Column, tier: Column, component: Column) -> Column:
    """A template with its holes filled."""
    out = template
    for name, value in (("provider", provider), ("terraform_module", tier), ("component", component)):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def include_block(target: Column) -> Column:
    """The block by which a new component includes its root file; terragrunt.hcl is what the function looks for unasked."""
    said = F.when(target == "terragrunt.hcl", F.lit("")).otherwise(F.concat(F.lit('"'), target, F.lit('"')))
    return F.concat(F.lit("include {\n  path = find_in_parent_folders("), said, F.lit(")\n}\n"))


def include_target(text: Column) -> Column:
    """The file name that a component looks for in the folders above, or null."""
    named = F.coalesce(F.nullif(F.regexp_extract(text, FIND_PARENT, 1), F.lit("")), F.nullif(F.regexp_extract(text, FIND_PARENT, 2), F.lit("")))
    return F.when(named.isNotNull(), named).when(text.rlike(FIND_PARENT_NOARG), F.lit("terragrunt.hcl"))


def included_roots(files: DataFrame, by: str = "repo") -> DataFrame:
    """(by, file, target, found) of each component's terragrunt.hcl that includes a file: the nearest of that name above it.

    The name differs by row, so it is part of the key of one equi-join on ancestors. A terragrunt.hcl that looks for that
    very name starts a folder higher, or it would find itself.
    """
    hidden = F.exists(F.split(dirname(F.col("file")), "/"), lambda x: x.startswith(".") | (x == "node_modules"))
    leaves = files.filter((basename(F.col("file")) == "terragrunt.hcl") & ~hidden).select(by, "file", include_target(F.col("text")).alias("target")).filter("target is not null")
    up = leaves.select(by, "file", "target", F.explode(ancestors(F.col("file"))).alias("dir")).filter((F.col("target") != "terragrunt.hcl") | (F.col("dir") != dirname(F.col("file"))))
    there = files.select(by, dirname(F.col("file")).alias("dir"), basename(F.col("file")).alias("target"), F.col("file").alias("found"))
    return up.join(there, [by, "dir", "target"]).groupBy(by, "file", "target").agg(F.max_by("found", F.length("dir")).alias("found"))


def repo_schemas(files: DataFrame, by: str = "repo") -> DataFrame:
    """One row for each repository: root_file, include_target, template, env_config, fields, backend, provider, confidence, and
    prefix, below which its modules lie. files: (by, file, text), all repositories at once.

    The root file is what the first component by path includes, else one of the usual names at the top, else none.
    Repositories of plain modules, or of none, have schemas of their own.
    """
    found = included_roots(files, by).groupBy(by).agg(F.min(F.struct("file", "found", "target")).alias("r")).select(by, F.lit(0).alias("tier"), F.col("r.found").alias("root_file"), F.col("r.target").alias("include_target"))
    rank = F.array_position(F.array(*map(F.lit, ROOT_NAMES)), F.col("file"))
    usual = files.filter(F.col("file").isin(*ROOT_NAMES)).select(by, rank.alias("tier"), F.col("file").alias("root_file"), F.col("file").alias("include_target"))
    best = found.unionByName(usual).groupBy(by).agg(F.min(F.struct("tier", "root_file", "include_target")).alias("r")).select(by, "r.root_file", "r.include_target")
    roots = best.join(files.select(by, F.col("file").alias("root_file"), "text"), [by, "root_file"])
    text, target = F.col("text"), F.col("include_target")
    template, config = source_template(F.regexp_extract(text, ROOT_SOURCE, 1)), F.regexp_extract(text, FIND_PARENT, 0)
    config = F.when(config != "", F.coalesce(F.nullif(F.regexp_extract(text, FIND_PARENT, 1), F.lit("")), F.regexp_extract(text, FIND_PARENT, 2)))
    read = roots.select(
        by, "root_file", "include_target", template.alias("template"), F.when(config != target, config).alias("env_config"), F.array_distinct(F.regexp_extract_all(text, F.lit(ENV_FIELD), F.lit(1))).alias("fields"),
        F.nullif(F.regexp_extract(text, BACKEND, 1), F.lit("")).alias("backend"), F.nullif(F.regexp_extract(text, PROVIDER, 1), F.lit("")).alias("provider"),
    )
    some = F.col("template").isNotNull() | (F.size("fields") > 0) | F.col("backend").isNotNull() | F.col("provider").isNotNull()
    read = read.withColumn("known", F.when(F.col("template").isNotNull() & (F.size("fields") > 0), "full").when(some, "partial").otherwise("fallback"))
    all_ = convention(files, by).join(read, by, "left")
    plain = (F.col("kind") != "terragrunt") & (F.col("confidence") != "low")
    either = lambda value, otherwise: F.when(plain, value).otherwise(otherwise)
    words = lambda xs: F.array(*map(F.lit, xs))
    out = all_.select(
        by, either(F.lit(None).cast("string"), F.col("root_file")).alias("root_file"), either(F.lit(""), F.coalesce("include_target", F.lit(ROOT_NAMES[0]))).alias("include_target"),
        either(F.when(F.col("kind") == "tf-modules", "modules/{component}").otherwise(""), F.coalesce("template", F.lit(TEMPLATE))).alias("template"),
        either(F.lit(PLAIN_CONFIG), F.coalesce("env_config", F.lit(CONFIG))).alias("env_config"),
        either(words(PLAIN_FIELDS), F.when(F.size("fields") > 0, F.col("fields")).otherwise(words(FIELDS))).alias("fields"),
        either(F.lit(""), F.coalesce("backend", F.lit(BACKEND_NAME))).alias("backend"), either(F.lit(""), F.coalesce("provider", F.lit(PROVIDER_NAME))).alias("provider"),
        either(F.lit("full"), F.coalesce("known", F.lit("fallback"))).alias("confidence"),
    )
    return out.withColumn("prefix", static_prefix(F.col("template")))


def plain_env_dirs(files: DataFrame, project: str, env: str) -> DataFrame:
    """(dir): where a plain repository keeps an environment, one row at most: below the usual folders, at the top, below the
    project, in this order."""
    bases = [*ENV_ROOTS, "", *([project, *(f"{project}/{r}" for r in ENV_ROOTS)] if project else [])]
    wanted = [f"{b}/{env}".lstrip("/") for b in bases]
    above = files.select(F.explode(ancestors(F.col("file"))).alias("dir")).filter(F.col("dir").isin(wanted)).distinct()
    return above.orderBy(F.array_position(F.array(*map(F.lit, wanted)), F.col("dir"))).limit(1)


def nearest_above(files: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """(file, found): the nearest file of a name in the directories above, by an equi-join on ancestors."""
    there = targets.filter(basename(F.col("file")) == name).select(dirname(F.col("file")).alias("dir"), F.col("file").alias("found"))
    up = files.select("file", F.explode(ancestors(F.col("file"))).alias("dir"))
    return up.join(there, "dir").groupBy("file").agg(F.max_by("found", F.length("dir")).alias("found"))


def match_env(envs: DataFrame, wanted: str) -> DataFrame:
    """(env): directories (env, config_env) that a word for an environment may mean, best tier only: exact, normalised, by the
    config's own word, by containment."""
    w = norm_env(F.lit(wanted))
    tier = F.when(F.col("env") == wanted, 0).when(norm_env(F.col("env")) == w, 1).when(norm_env(F.col("config_env")) == w, 2).when(F.contains(norm_env(F.col("env")), w), 3)
    rows = envs.withColumn("tier", tier).filter("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("best"))), F.col("tier") == F.col("best")).select("env").distinct()  # one row


def directories(files: DataFrame, depth: int, under: str = "") -> DataFrame:
    """(dir): distinct directories of a depth below a prefix."""
    p = F.split("file", "/")
    return files.filter(F.col("file").startswith(under) & (F.size(p) > depth)).select(F.array_join(F.slice(p, 1, depth), "/").alias("dir")).filter(~basename(F.col("dir")).startswith(".")).distinct()


def component_path(project: Column, provider: Column, env: Column, component: Column) -> Column:
    """A component's directory; a project's prefix of the environment is never doubled."""
    full = F.when(F.startswith(env, F.concat(project, F.lit("_"))), env).otherwise(F.concat_ws("_", project, env))
    return F.concat_ws("/", project, provider, full, component)


def module_path(provider: Column, tier: Column, component: Column) -> Column:
    return F.concat_ws("/", F.lit("modules"), provider, F.lit("infrastructure"), tier, component)
