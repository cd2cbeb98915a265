"""Native column functions over code, paths, values and requests. None of them is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of leaked secrets.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
    r"(?i)aws_secret_access_key\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{40}",
    r"\bsk-[A-Za-z0-9]{32,}\b",
    r"\bghp_[A-Za-z0-9]{30,}\b",
)

# Words of a request that say nothing about what is sought.
QUERY_STOPWORDS = (
    "create", "make", "build", "add", "want", "need", "new", "similar", "like", "please", "the", "a", "an", "for", "to", "of", "in", "on",
    "with", "and", "me", "my", "our", "give", "set", "up", "setup", "some",
)

# Hints of what a request wants done, in the order they are tried.
OPERATION_HINTS = (
    ("delete", ("delete", "remove", "drop", "tear down", "destroy")),
    ("add", ("add ", "append", "attach", "insert", "add a", "add an")),
    ("update", ("update", "change", "modify", "set ", "increase", "decrease", "bump", "resize", "rename", "edit")),
    ("create", ("create", "new ", "provision", "stand up", "spin up", "bootstrap")),
)

# Inputs that may name a component, by priority.
NAME_INPUTS = ("cluster_name", "bucket_name", "identifier", "function_name", "db_name", "repository_name", "name")

# Provider types by request keyword, in the order they are tried, and the type of requests that hold none.
TYPE_KEYWORDS = {
    "ec2": "aws_instance",
    "instance": "aws_instance",
    "security group": "aws_security_group",
    "sg": "aws_security_group",
    "s3": "aws_s3_bucket",
    "bucket": "aws_s3_bucket",
    "rds": "aws_db_instance",
    "database": "aws_db_instance",
    "alb": "aws_lb",
    "load balancer": "aws_lb",
    "lambda": "aws_lambda_function",
    "sqs": "aws_sqs_queue",
}
UNKNOWN_TYPE = "aws_RESOURCE"

# The keywords of plain layouts, where the longest match wins, and of equals the first.
PLAIN_TYPE_KEYWORDS = {
    "ec2": "aws_instance",
    "instance": "aws_instance",
    "vm": "aws_instance",
    "security group": "aws_security_group",
    "sg": "aws_security_group",
    "s3": "aws_s3_bucket",
    "bucket": "aws_s3_bucket",
    "rds": "aws_db_instance",
    "database": "aws_db_instance",
    "postgres": "aws_db_instance",
    "alb": "aws_lb",
    "load balancer": "aws_lb",
    "nlb": "aws_lb",
    "lambda": "aws_lambda_function",
    "function": "aws_lambda_function",
    "sqs": "aws_sqs_queue",
    "queue": "aws_sqs_queue",
    "sns": "aws_sns_topic",
    "topic": "aws_sns_topic",
    "iam role": "aws_iam_role",
    "role": "aws_iam_role",
    "vpc": "aws_vpc",
    "network": "aws_vpc",
    "subnet": "aws_subnet",
    "ecs": "aws_ecs_cluster",
    "ecs cluster": "aws_ecs_cluster",
    "dynamodb": "aws_dynamodb_table",
    "dynamo": "aws_dynamodb_table",
    "cloudfront": "aws_cloudfront_distribution",
    "api gateway": "aws_api_gateway_rest_api",
    "resource group": "azurerm_resource_group",
    "aks": "azurerm_kubernetes_cluster",
    "kubernetes": "azurerm_kubernetes_cluster",
    "key vault": "azurerm_key_vault",
    "cosmos": "azurerm_cosmosdb_account",
    "container registry": "azurerm_container_registry",
    "gke": "google_container_cluster",
    "gcs": "google_storage_bucket",
    "cloud run": "google_cloud_run_service",
}
UNKNOWN_PLAIN_TYPE = "UNKNOWN_RESOURCE"


def tokenize_code(text: Column) -> Column:
    """Words of code, lower-cased, each followed by its parts between underscores; a word without any comes twice."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.split(w, "_"), lambda x: x != ""))))


def token_bag(text: Column) -> Column:
    """The tokens of tokenize_code in another order: words, then all runs between underscores. Its array is built without
    a function call for each word, so this is the form for whole corpora."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))


def token_count(text: Column) -> Column:
    """How many tokens tokenize_code gives."""
    words = F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    return words + F.when(F.contains(text, F.lit("_")), F.regexp_count(text, F.lit("[A-Za-z0-9]+"))).otherwise(words)


def spaced(text: Column, kept: str = "A-Za-z0-9_") -> Column:
    """The runs of the kept characters, lower-cased, two blanks between them and one at each end."""
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(text, f"[^{kept}]+", "  "))), F.lit(" "))


def term_count(words: Column, runs: Column, term: str) -> Column:
    """How often tokenize_code gives a term, as a word and as a run between underscores, by byte search: words is
    spaced(text), runs is spaced(text, "A-Za-z0-9")."""
    part = f" {term} "
    found = [((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int") for x in (words, runs)]
    return found[0] if "_" in term else found[0] + found[1]


def plain_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def query_terms(text: Column) -> Column:
    """Distinct code words of a request longer than a letter, without stop words."""
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    return F.array_distinct(F.filter(tokenize_code(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def has_secret(text: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns]), F.lit(False))


def repo_id(path: Column) -> Column:
    """Leading digits of an archive's name, else -1."""
    return F.coalesce(F.regexp_extract(basename(path), r"^(\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.substr(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first, '' last."""
    parts = F.split(path, "/")
    return F.when(path.contains("/"), F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array(F.lit("")))


def resolve_relative(referrer: Column, source: Column) -> Column:
    """A source path as seen from a file: without interpolations, joined where it starts with a dot, normalised."""
    bare = F.regexp_replace(F.regexp_replace(source, r"\$\{[^}]*\}", ""), "^/+", "")
    joined = F.when(bare.startswith("."), F.concat_ws("/", F.when(dirname(referrer) != "", dirname(referrer)), bare)).otherwise(bare)
    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), _step), "/")


def _step(stack: Column, part: Column) -> Column:
    up = (part == "..") & (F.size(stack) > 0) & (F.element_at(F.when(F.size(stack) > 0, stack).otherwise(F.array(F.lit(""))), -1) != "..")
    return F.when((part == "") | (part == "."), stack).when(up, F.slice(stack, 1, F.size(stack) - 1)).otherwise(F.concat(stack, F.array(part)))


def norm_value(raw: Column) -> Column:
    """Trimmed, unquoted once, booleans lower-cased."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    quoted = (F.length(t) >= 2) & (F.substring(t, 1, 1) == F.substring(t, -1, 1)) & F.substring(t, 1, 1).isin('"', "'")
    bare = F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.when(F.lower(bare).isin("true", "false"), F.lower(bare)).otherwise(bare)


def norm_env(word: Column) -> Column:
    return F.translate(F.lower(F.trim(word)), "-_", "")


def namespace(root: Column) -> Column:
    return F.substring(F.md5(root.cast("binary")), 1, 12)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))


def brace_balance(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("}"), F.lit(""))) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def classify_operation(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("create")
    for op, hints in reversed(OPERATION_HINTS):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(h) for h in hints]), F.lit(op)).otherwise(out)
    return out


def guess_type(text: Column, *, longest: bool = False) -> Column:
    """The provider type a request's keywords stand for: the first keyword of the table, or the longest of the plain one."""
    table = PLAIN_TYPE_KEYWORDS if longest else TYPE_KEYWORDS
    keys = sorted(table, key=len, reverse=True) if longest else list(table)
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(table[k])) for k in keys], F.lit(UNKNOWN_PLAIN_TYPE if longest else UNKNOWN_TYPE))


def pick_name(values: Column) -> Column:
    """The component's name among its inputs, by priority."""
    return F.coalesce(*[F.nullif(values[k], F.lit("")) for k in NAME_INPUTS])


def strip_fence(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z0-9_-]*\s*\n?(.*?)\n?```$", "$1"))


def line_of(text: Column, match_start: Column) -> Column:
    """The line a position (from 1) lies in."""
    head = text.substr(F.lit(1), match_start - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
