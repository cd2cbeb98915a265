"""The catalog of reusable modules, its reuse evidence, and the ranking of modules for a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, plain_tokens, tokenize_code
from .retrieval import bm25

# Patterns of a variable's body, and the catalog's boosts.
DEFAULT = r"(^|\n)[ \t]*default[ \t]*="
TYPE = r"(?:^|\n)[ \t]*type[ \t]*=[ \t]*([^\n]+)"
DESCRIPTION = r'description[ \t]*=[ \t]*"([^"]*)"'
TOKEN_BOOST, REUSE_BOOST = 3.0, 0.25

# Request words that say nothing about a module's type.
GENERIC = (
    "aws", "azurerm", "google", "resource", "resources", "module", "modules", "main", "this", "the", "a", "an", "for", "in", "of", "to", "with",
    "and", "or", "on", "at", "create", "deploy", "provision", "new", "my", "i", "we", "want", "need", "please", "project", "like", "similar", "same",
    "as", "env", "environment", "nonprod", "prod", "dev", "staging", "just", "some", "add", "make", "set", "up",
)

# What a request's word may be called in a path or a type.
ALIASES = {
    "ec2": ["instance", "ec2"], "vm": ["instance"], "instance": ["instance", "ec2"], "sg": ["security", "group"], "security_group": ["security", "group"],
    "database": ["db", "rds", "aurora", "postgres", "mysql"], "db": ["db", "rds"], "rds": ["db", "rds", "aurora"], "lb": ["lb", "alb", "elb", "nlb"], "alb": ["lb", "alb"],
    "vpc": ["vpc", "network"], "network": ["vpc", "network", "subnet"], "k8s": ["eks", "kubernetes"], "kubernetes": ["eks", "kubernetes"], "bucket": ["s3", "bucket"], "s3": ["s3", "bucket"],
}


def with_aliases(word: Column) -> Column:
    """A word and what may stand for it."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.concat(F.array(word), F.coalesce(table[word], F.array().cast("array<string>")))


def module_relates(resource_type: Column, module: Column, types: Column) -> Column:
    """Whether a module's key (the whole path) or provider types share a word with a resource type, aliases counted, `aws` not."""
    ignored = F.array(F.lit("aws"))
    split = lambda c: F.array_except(plain_tokens(F.translate(c, "_-", "  ")), ignored)
    words = F.concat(F.array(F.lower(resource_type)), split(resource_type))
    want = F.array_except(F.array_distinct(F.flatten(F.transform(words, with_aliases))), ignored)
    return F.arrays_overlap(want, split(F.concat_ws(" ", module, F.concat_ws(" ", types))))


def build(blocks: DataFrame, edges: DataFrame, prefix: str = "") -> DataFrame:
    """(dir, name, resource_types, inputs, outputs, reuse_count, used_by) of each directory below a prefix that has a resource, a
    variable or a data source; outputs alone make no module.

    Reuse counts distinct files that import a module by its key or by the last part of a key. Keys that are equal have the same
    last part, so this is one join on last parts, of which each has one row of importers; blocks and edges are read once.
    """
    top = blocks.filter((F.col("depth") == 0) & F.col("file").endswith(".tf") & F.col("type").isin("resource", "variable", "data", "output") & F.col("file").startswith(prefix))
    top = top.withColumn("dir", dirname(F.col("file")))
    order = lambda *c: F.struct("file", "char_start", *c)
    listed = lambda cond, value: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, order(value.alias("v"))))), lambda r: r["v"]))
    body = F.col("body")
    one = F.struct(F.col("labels")[0].alias("name"), (~body.rlike(DEFAULT)).alias("required"), F.regexp_extract(body, TYPE, 1).alias("type"), F.regexp_extract(body, DESCRIPTION, 1).alias("description"))
    modules = top.groupBy("dir").agg(
        listed(F.col("type") == "resource", F.col("labels")[0]).alias("resource_types"),
        listed(F.col("type") == "variable", one).alias("inputs"),
        listed(F.col("type") == "output", F.col("labels")[0]).alias("outputs"),
        F.bool_or(F.col("type") != "output").alias("defines"),
    ).filter("defines").drop("defines")
    used = edges.filter("edge_type = 'module_source'").select("file", "module")
    by = used.groupBy(basename(F.col("module")).alias("name")).agg(F.array_sort(F.collect_set("file")).alias("used_by"))
    out = modules.withColumn("name", basename(F.col("dir"))).join(by, "name", "left").withColumn("used_by", F.coalesce("used_by", F.array().cast("array<string>")))
    return out.select("dir", "resource_types", "inputs", "outputs", "used_by", "name", F.size("used_by").alias("reuse_count"))


def contract(inputs: Column) -> Column:
    """The declared types of a module's inputs by name, empty where none is declared; the required ones first."""
    pairs = lambda wanted: F.transform(F.filter(inputs, lambda i: i["required"] == wanted), lambda i: F.struct(i["name"], F.coalesce(i["type"], F.lit(""))))
    return F.map_from_entries(F.concat(pairs(F.lit(True)), pairs(F.lit(False))))


def required_inputs(inputs: Column) -> Column:
    return F.transform(F.filter(inputs, lambda i: i["required"]), lambda i: i["name"])


def document(name: Column, dir_: Column, types: Column, inputs: Column, outputs: Column) -> Column:
    """The text a module is searched by."""
    return F.concat_ws(" ", name, F.regexp_replace(dir_, "/", " "), F.concat_ws(" ", types), F.concat_ws(" ", F.transform(inputs, lambda i: i["name"])), F.concat_ws(" ", outputs))


def match(modules: DataFrame, id_col: str, text: Column, name_tokens: Column, reuse: Column, intent: str, top: int = 3) -> DataFrame:
    """(id, score): BM25 plus a boost for a shared token plus a boost per reuse, which alone suffices."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(_words(modules, intent)))]) if intent else F.array().cast("array<string>")
    boosts = modules.select(F.col(id_col).alias("id"), F.when(F.arrays_overlap(name_tokens, wanted), TOKEN_BOOST).otherwise(0.0).alias("boost"), (REUSE_BOOST * reuse).alias("reuse"))
    scored = boosts.join(bm25(modules, id_col, text, intent, top=None).withColumnRenamed("score", "lexical"), "id", "left")
    return scored.select("id", (F.coalesce("lexical", F.lit(0.0)) + F.col("boost") + F.col("reuse")).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def _words(df: DataFrame, text: str) -> list[str]:
    return df.sparkSession.range(1).select(tokenize_code(F.lit(text)).alias("t")).first()["t"]


def planner_rank(modules: DataFrame, id_col: str, key: Column, types: Column, reuse: Column, intent: str, top: int = 3) -> DataFrame:
    """(id, score): twice the request words among a module's types plus those in its key, the whole path; a request of five words at most
    must have half of them, aliases counted, covered. Ties by reuse, then id."""
    generic = F.array(*map(F.lit, GENERIC))
    words = F.array_except(plain_tokens(F.lit(intent)), generic)
    want = F.array_except(F.array_distinct(F.flatten(F.transform(words, with_aliases))), generic)
    type_words = F.array_except(plain_tokens(F.translate(F.concat_ws(" ", types), "_-", "  ")), generic)
    name_words = F.array_except(plain_tokens(key), generic)
    in_types, in_name = F.size(F.array_intersect(want, type_words)), F.size(F.array_intersect(want, name_words))
    hay = F.array_union(type_words, name_words)
    covered = F.size(F.filter(words, lambda w: F.arrays_overlap(with_aliases(w), hay)))
    rows = modules.select(F.col(id_col).alias("id"), (2 * in_types + in_name).alias("score"), covered.alias("covered"), F.size(words).alias("n"), reuse.alias("reuse"))
    rows = rows.filter((F.col("score") > 0) & ((F.col("n") > 5) | (2 * F.col("covered") >= F.col("n"))))
    return rows.orderBy(F.desc("score"), F.desc("reuse"), "id").limit(top).select("id", "score")


def plan(modules: DataFrame, id_col: str, key: Column, types: Column, reuse: Column, intent: str) -> DataFrame:
    """One row: reuse with its candidates, or write_new."""
    ranked = planner_rank(modules, id_col, key, types, reuse, intent)
    c = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))))
    return ranked.agg(F.when(F.count("*") > 0, "reuse").otherwise("write_new").alias("decision"), F.transform(c, lambda x: x["id"]).alias("candidates"))


def upstream_pattern(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(dir, names): what the consumers of each module read from others, each name where it first stands - by consumer, then
    by kind and line - without the module's own name."""
    users = modules.select("dir", F.col("name").alias("own"), F.explode("used_by").alias("file"))
    reads = edges.filter("edge_type in ('remote_state', 'output_ref') and name <> ''").select("file", F.col("edge_type") == "output_ref", "line", "output", "name").toDF("file", "later", "line", "output", "name")
    first = users.join(reads, "file").filter("name <> own").groupBy("dir", "name").agg(F.min(F.struct("file", "later", "line", "output")).alias("first"))
    return first.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda r: r["name"]).alias("names"))
