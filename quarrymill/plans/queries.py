"""The registered queries over the driver's tables, each beside the SQL that gives the same rows.

Each runs an operator of the library over whole tables. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, corpus, dataset, depths, edits, index, inventory, layout, requests, retrieval, search, sweep
from ..operators.encoding import EncodedTexts
from ..operators.kept import KeptIndex
from ..session import scratch_path
from ..sources import ignore, trees
from ..streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------------------
# Corpus jobs

#: The documents hold none of the key shapes, but tokens in this shape.
TOKEN = r'token = "[0-9a-f]{40}"'
_SECRET_SQL = "regexp_matches(text, 'AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}\"|-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----')"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.lit(0).cast("long").alias("repo_id"), F.format_string("%012d", "doc_id").alias("path"), "doc_id", "text", F.sha1(F.col("text").cast("binary")).alias("sha1"),
        (T.brace_balance(F.col("text")) == 0).alias("parse_ok"), T.has_secret(F.col("text"), (*T.SECRET_PATTERNS, TOKEN)).alias("has_secret"),
    )


_FILES_SQL = f"""WITH f AS (SELECT doc_id, text, sha1(text) AS sha1,
  length(replace(text, '{{', '')) = length(replace(text, '}}', '')) AS parse_ok, {_SECRET_SQL} AS has_secret FROM documents)"""


@query(f"""{_FILES_SQL} SELECT count(*) AS files, count(*) FILTER (WHERE parse_ok) AS parse_ok, count(*) FILTER (WHERE parse_ok AND NOT has_secret) AS no_secret,
  count(DISTINCT CASE WHEN parse_ok AND NOT has_secret THEN sha1 END) AS "unique" FROM f""")
def corpus_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: rows are written as they pass, counts come from the writes."""
    return corpus.run_files_job(_files(spark, sf).withColumn("ext", F.lit(".txt")), scratch_path(spark, "files"))


@query(f"""{_FILES_SQL} SELECT min(doc_id) AS doc_id, sha1 FROM f WHERE parse_ok AND NOT has_secret GROUP BY sha1""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.files_job(_files(spark, sf))[0].select("doc_id", "sha1")


@query(f"""SELECT doc_id, length(text) AS n FROM documents WHERE {_SECRET_SQL}""")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).filter("has_secret").select("doc_id", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, 'token = "[0-9a-f]{40}"') AND length(trim(text)) >= 15""")
def secret_free_files(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).filter("parse_ok").filter("not has_secret")
    return f.filter(F.length(F.trim("text")) >= dataset.MIN_CHARS).select("doc_id", "text")


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the role of repositories: the customer is the name, the price the stars, the total in thousands the size."""
    license_ = F.when(F.col("o_orderpriority") == "1-URGENT", "MIT").when(F.col("o_orderpriority") == "2-HIGH", "Apache-2.0").when(F.col("o_orderpriority") == "3-MEDIUM", "BSD-3-Clause").when(F.col("o_orderpriority") == "5-LOW", "GPL-3.0")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Id"), F.col("o_custkey").cast("string").alias("FullName"), license_.alias("License"), F.floor("o_totalprice").cast("long").alias("StarCount"),
        (F.col("o_orderstatus") == "P").cast("int").alias("Archived"), F.floor(F.col("o_totalprice") / 30000).cast("int").alias("SizeInKb"),
    )


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(key.alias("Id"), F.col("l_orderkey").alias("RepositoryId")).agg(F.concat_ws("/", F.lit("modules"), F.min("l_suppkey")).alias("Path"))


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select((F.col("l_orderkey") * 100 + F.col("l_partkey") % 100).alias("Id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ModuleId"), F.col("p_type").alias("ResourceType"), F.col("p_brand").alias("Provider"))


_REPOS_SQL = """WITH repos AS (SELECT o_orderkey AS "Id", CAST(o_custkey AS VARCHAR) AS "FullName",
  CASE o_orderpriority WHEN '1-URGENT' THEN 'MIT' WHEN '2-HIGH' THEN 'Apache-2.0' WHEN '3-MEDIUM' THEN 'BSD-3-Clause' WHEN '5-LOW' THEN 'GPL-3.0' END AS "License",
  CAST(floor(o_totalprice) AS BIGINT) AS "StarCount", CAST(o_orderstatus = 'P' AS INT) AS "Archived", CAST(floor(o_totalprice / 30000) AS INT) AS "SizeInKb" FROM orders),
active AS (SELECT * FROM repos WHERE "License" IN ('MIT', 'Apache-2.0', 'BSD-3-Clause') AND "Archived" = 0),
deduped AS (SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY "FullName" ORDER BY "StarCount" DESC, "Id") = 1),
sized AS (SELECT * FROM deduped WHERE "SizeInKb" > 5),
modules AS (SELECT l_orderkey * 10 + l_linenumber AS "ModuleId", l_orderkey AS "RepositoryId", 'modules/' || min(l_suppkey) AS "Path" FROM lineitem GROUP BY ALL),
resources AS (SELECT l_orderkey * 100 + l_partkey % 100 AS "ResourceId", l_orderkey * 10 + l_linenumber AS "ModuleId", p_type AS "ResourceType", p_brand AS "Provider" FROM lineitem JOIN part ON l_partkey = p_partkey),
joined AS (SELECT "ModuleId", "RepositoryId", "Path", sized."Id" AS "RepoId", "FullName", "License", "StarCount", "ResourceId", "ResourceType", "Provider"
  FROM sized JOIN modules ON "RepositoryId" = sized."Id" JOIN resources USING ("ModuleId"))"""


@query(_REPOS_SQL + "SELECT * FROM sized")
def metadata_filters(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.metadata_stages(_repos(spark, sf))["sized"]


@query(_REPOS_SQL + 'SELECT "Id", "FullName", "StarCount" FROM deduped')
def metadata_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.metadata_stages(_repos(spark, sf))["deduped"].select("Id", "FullName", "StarCount")


@query(_REPOS_SQL + "SELECT * FROM joined")
def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.metadata_join(corpus.metadata_stages(_repos(spark, sf))["sized"], _modules(spark, sf), _resources(spark, sf))


@query(_REPOS_SQL + """SELECT (SELECT count(*) FROM repos) AS raw, (SELECT count(*) FROM repos WHERE "License" IN ('MIT', 'Apache-2.0', 'BSD-3-Clause')) AS licensed,
  (SELECT count(*) FROM active) AS active, (SELECT count(*) FROM deduped) AS deduped, (SELECT count(*) FROM sized) AS sized,
  (SELECT count(DISTINCT "ModuleId") FROM joined) AS modules, (SELECT count(*) FROM joined) AS resources""")
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.metadata_counts(_repos(spark, sf), _modules(spark, sf), _resources(spark, sf))


@query("""SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY n DESC, p_type LIMIT 25""")
def top_groups(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return corpus.top_groups(li.join(p, li["l_partkey"] == p["p_partkey"]), "p_type")


# ---------------------------------------------------------------------------------------------------------------
# Symbols and edges: suppliers as rendered configuration trees

_TREE = """CONCAT('# supplier ', s_suppkey, CHR(10), 'module "s', s_suppkey, '" {', CHR(10), '  source = "../../n', s_nationkey % 5, '/m', s_suppkey % 7, '"', CHR(10), '  size = var.size_', s_suppkey % 3,
  CHR(10), '}', CHR(10), 'resource "aws_t', s_suppkey % 4, '" "r" {', CHR(10), '  tags = { a = 1 }', CHR(10), '  dynamic "x" {', CHR(10), '    y = module.s', s_suppkey, '.id', CHR(10), '  }', CHR(10), '}', CHR(10))"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("concat('live/n', s_nationkey, '/s', s_suppkey, '/main.tf') AS file", f"{_TREE} AS text")


_SYMBOLS_SQL = """WITH f AS (SELECT 'live/n' || s_nationkey || '/s' || s_suppkey || '/main.tf' AS file, s_suppkey AS k, s_nationkey AS n FROM supplier),
symbols AS (SELECT file, 's' || k AS name, 'module' AS kind, 2 AS line_start, 5 AS line_end, 'module "s' || k || '"' AS signature, NULL AS parent FROM f
UNION ALL SELECT file, 'aws_t' || k % 4 || '.r', 'resource', 6, 11, 'resource "aws_t' || k % 4 || '" "r"', NULL FROM f
UNION ALL SELECT file, 'x', 'dynamic', 8, 10, 'dynamic "x"', 'aws_t' || k % 4 || '.r' FROM f),
edges AS (SELECT file, 'module_source' AS edge_type, 'live/n' || n % 5 || '/m' || k % 7 AS module, 's' || k AS name, NULL AS output, 2 AS line,
  '../../n' || n % 5 || '/m' || k % 7 AS raw, 'live/n' || n % 5 || '/m' || k % 7 AS target_file FROM f
UNION ALL SELECT file, 'var_ref', 'size_' || k % 3, 'size_' || k % 3, NULL, 4, 'var.size_' || k % 3, NULL FROM f
UNION ALL SELECT file, 'output_ref', 's' || k, 's' || k, 'id', 9, 'module.s' || k || '.id', NULL FROM f)"""


@query(_SYMBOLS_SQL + "SELECT * FROM symbols")
def hcl_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return index.symbols(index.parse_blocks(_tree(spark, sf)))


def _kept(spark: SparkSession, files: DataFrame) -> KeptIndex:
    """An index of files for queries that read it more than once, so that texts are parsed once."""
    out = KeptIndex(spark, scratch_path(spark, "index"))
    out.refresh(files)
    return out


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    files = _tree(spark, sf)
    return index.edges(index.parse(files))


@query(_SYMBOLS_SQL + "SELECT * FROM edges")
def hcl_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


#: Suppliers in the role of components: a terragrunt.hcl each, and an inputs.hcl for every third.
_COMPONENT = """CONCAT('include "root" {', CHR(10), '  path = find_in_parent_folders("root.hcl")', CHR(10), '}', CHR(10), 'dependency "net" {', CHR(10), '  config_path = "../n', s_suppkey % 4, '"', CHR(10), '}', CHR(10),
  'inputs = {', CHR(10), '  a = dependency.net.outputs.vpc_id', CHR(10), '  b = module.remote_state.components[var.upstream_modules.sg', s_suppkey % 3, ']["sg_id"]', CHR(10), '}', CHR(10))"""


@query("""WITH c AS (SELECT s_suppkey AS k, 'live/n' || s_nationkey AS base, base || '/s' || s_suppkey || '/terragrunt.hcl' AS file FROM supplier)
SELECT file, 'terragrunt' AS edge_type, 'include' AS module, 'root' AS name, NULL AS output, 1 AS line, 'path = find_in_parent_folders("root.hcl")' AS raw, NULL AS target_file FROM c
UNION ALL SELECT file, 'terragrunt', 'find_in_parent_folders', 'find_in_parent_folders', NULL, 2, 'find_in_parent_folders()', NULL FROM c
UNION ALL SELECT file, 'terragrunt', base || '/n' || k % 4, 'net', NULL, 4, 'config_path = "../n' || k % 4 || '"', base || '/n' || k % 4 FROM c
UNION ALL SELECT file, 'output_ref', 'net', 'net', 'vpc_id', 8, 'dependency.net.outputs.vpc_id', NULL FROM c
UNION ALL SELECT file, 'remote_state', 'sg' || k % 3, 'sg' || k % 3, 'sg_id', 9, 'module.remote_state.components[var.upstream_modules.sg' || k % 3 || ']["sg_id"]', NULL FROM c
UNION ALL SELECT file, 'var_ref', 'upstream_modules', 'upstream_modules', NULL, 9, 'var.upstream_modules', NULL FROM c
UNION ALL SELECT replace(file, 'terragrunt', 'inputs'), 'terragrunt', 'inputs.hcl', 'inputs.hcl', NULL, 1, 'inputs.hcl', NULL FROM c WHERE k % 3 = 0""")
def component_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Includes, dependencies, tool functions, remote states and inputs files."""
    s = table(spark, sf, "supplier")
    files = s.selectExpr("concat('live/n', s_nationkey, '/s', s_suppkey, '/terragrunt.hcl') AS file", f"{_COMPONENT} AS text")
    return index.edges(index.parse(files.unionByName(s.filter("s_suppkey % 3 = 0").selectExpr("concat('live/n', s_nationkey, '/s', s_suppkey, '/inputs.hcl') AS file", "'inputs = {}' AS text"))))


@query(_SYMBOLS_SQL + "SELECT module, string_agg(file, ',' ORDER BY file) AS files, count(*) AS reuse_count FROM edges WHERE edge_type = 'module_source' GROUP BY module")
def module_importers(spark: SparkSession, sf: str) -> DataFrame:
    return index.importers(_edges(spark, sf)).select("module", F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("reuse_count"))


@query(_SYMBOLS_SQL + """SELECT DISTINCT q.name, file FROM edges, (VALUES ('m3'), ('elsewhere/m3'), ('live/n1/m3')) q(name) WHERE edge_type = 'module_source'
  AND (module = q.name OR (regexp_extract(module, '[^/]*$') = q.name AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = 'module_source' AND e.module = q.name)))""")
def importers_by_basename(spark: SparkSession, sf: str) -> DataFrame:
    """By the last part of keys, by a path that is no key, by a key."""
    edges = index.edges(_kept(spark, _tree(spark, sf)).facts())
    asked = [index.find_importers(edges, n).select(F.lit(n).alias("name"), "file") for n in ("m3", "elsewhere/m3", "live/n1/m3")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query(_SYMBOLS_SQL + "SELECT file, name, kind FROM symbols WHERE contains(lower(name), 'aws_t2') OR contains(lower(signature), 'aws_t2')")
def symbol_find(spark: SparkSession, sf: str) -> DataFrame:
    return index.find_symbol(index.symbols(index.parse_blocks(_tree(spark, sf))), "AWS_T2").select("file", "name", "kind")


@query(_SYMBOLS_SQL + "SELECT kind, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT edge_type, count(*) FROM edges GROUP BY edge_type")
def kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    facts = _kept(spark, _tree(spark, sf)).facts()
    s = index.symbols(index.blocks(facts)).groupBy("kind").agg(F.count("*").alias("n"))
    return s.unionByName(index.edges(facts).groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


@query(_SYMBOLS_SQL + "SELECT name, kind, line_start, line_end FROM symbols WHERE file = 'live/n15/s0/main.tf' OR file LIKE 'live/n1/%'")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    s = index.symbols(index.parse_blocks(_tree(spark, sf)))
    return s.filter((F.col("file") == "live/n15/s0/main.tf") | F.col("file").startswith("live/n1/")).select("name", "kind", "line_start", "line_end")


#: The suppliers' tree later on: every third file says another size, every tenth is gone.
_LATER_SQL = _SYMBOLS_SQL + """, later AS (SELECT file, k, CASE WHEN k % 3 = 0 THEN 'big_' ELSE 'size_' END || k % 3 AS name FROM f WHERE k % 10 <> 7)"""


def _later(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("file", r"/s(\d+)/", 1).cast("long")
    return _tree(spark, sf).filter(k % 10 != 7).select("file", F.when(k % 3 == 0, F.replace("text", F.lit("var.size_"), F.lit("var.big_"))).otherwise(F.col("text")).alias("text"))


@query(_LATER_SQL + "SELECT file, 'var_ref' AS edge_type, name, 4 AS line FROM later UNION ALL SELECT file, 'output_ref', 's' || k, 9 FROM later")
def kept_index(spark: SparkSession, sf: str) -> DataFrame:
    """What an index says after the tree has changed: only changed files were parsed again."""
    kept = _kept(spark, _tree(spark, sf))
    kept.refresh(_later(spark, sf))
    return index.edges(kept.facts()).filter("edge_type in ('var_ref', 'output_ref')").select("file", "edge_type", "name", "line")


@query(_LATER_SQL + """SELECT 0 AS run, (SELECT count(*) FROM f) AS parsed, 0 AS gone UNION ALL SELECT 1, (SELECT count(*) FROM later WHERE k % 3 = 0), (SELECT count(*) FROM f WHERE k % 10 = 7)
UNION ALL SELECT 2, 0, 0 UNION ALL SELECT 3, (SELECT count(*) FROM f WHERE (k % 3 = 0 OR k % 10 = 7) AND k % 2 = 0), 0""")
def kept_index_runs(spark: SparkSession, sf: str) -> DataFrame:
    """How many files each refresh parses and drops: first, after changes, again without any, and of half of the paths as they were."""
    kept = KeptIndex(spark, scratch_path(spark, "index"))
    first, later = _tree(spark, sf), _later(spark, sf)
    half = first.filter(F.regexp_extract("file", r"/s(\d+)/", 1).cast("long") % 2 == 0)
    done = [kept.refresh(first), kept.refresh(later), kept.refresh(later), kept.refresh(half, half.select("file"))]
    return spark.createDataFrame([(k, d["parsed"], d["gone"]) for k, d in enumerate(done)], "run int, parsed long, gone int")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages""")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query("""SELECT target, count(DISTINCT page_id) AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) GROUP BY target""")
def link_importers(spark: SparkSession, sf: str) -> DataFrame:
    links = link_edges(spark, sf).select(F.lit("module_source").alias("edge_type"), F.col("target").alias("module"), F.col("page_id").alias("file"))
    return index.importers(links).select(F.col("module").alias("target"), F.size("files").cast("long").alias("n"), F.get("files", F.lit(0)).alias("first_page"))


#: Parts in the role of modules; the first 35 are those that the suppliers' files import.
_MODULE = """CONCAT('variable "size" {', CHR(10), '  type = number', CHR(10), '}', CHR(10), 'variable "v', p_partkey % 3, '" {', CHR(10), '  description = "A value"', CHR(10), '  default = 1', CHR(10), '}', CHR(10),
  'resource "aws_t', p_partkey % 4, '" "r" {', CHR(10), '}', CHR(10), 'resource "aws_u" "r" {', CHR(10), '}', CHR(10), 'output "id" {', CHR(10), '  value = 1', CHR(10), '}', CHR(10))"""
_PART_DIR = "CONCAT('live/n', p_partkey % 5, CASE WHEN p_partkey < 35 THEN CONCAT('/m', p_partkey % 7) ELSE CONCAT('/p', p_partkey) END)"
_BOTH_SQL = _SYMBOLS_SQL + f""", parts AS (SELECT p_partkey AS p, {_PART_DIR} AS dir FROM part)"""


def _both(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' files and the modules. Every part is one."""
    modules = table(spark, sf, "part").selectExpr(f"concat({_PART_DIR}, '/main.tf') AS file", f"{_MODULE} AS text")
    return _tree(spark, sf).unionByName(modules)


@query(_BOTH_SQL + """, asked(asked) AS (VALUES ('live/n1/m3/main.tf'), ('live/n15/s15/main.tf'), ('x/m3/main.tf'))
SELECT asked, 'imports' AS how, target_file AS file, edge_type, module, name, output, line FROM edges JOIN asked ON file = asked
UNION ALL SELECT DISTINCT asked, 'importer', file, 'module_source', regexp_replace(asked, '/main.tf$', ''), NULL, NULL, NULL::INT FROM f, asked
  WHERE 'live/n' || n % 5 || '/m' || k % 7 = regexp_replace(asked, '/main.tf$', '') OR 'm' || k % 7 = regexp_extract(asked, '([^/]*)/main.tf$', 1)""")
def related_files(spark: SparkSession, sf: str) -> DataFrame:
    """Of a module, of an importer and of a directory that is nobody's key but ends like one."""
    edges = index.edges(_kept(spark, _tree(spark, sf)).facts())
    asked = [index.related(edges, f).select(F.lit(f).alias("asked"), "*") for f in ("live/n1/m3/main.tf", "live/n15/s15/main.tf", "x/m3/main.tf")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query(_BOTH_SQL + """SELECT DISTINCT regexp_replace(file, '/main.tf$', '') AS dir FROM f UNION SELECT dir FROM parts""")
def module_directories(spark: SparkSession, sf: str) -> DataFrame:
    return index.module_dirs(index.symbols(index.parse_blocks(_both(spark, sf))))


@query(_BOTH_SQL + """SELECT dir || '/main.tf' AS file, min(file) AS via FROM f JOIN parts ON dir = 'live/n' || n % 5 || '/m' || k % 7 WHERE k % 2 = 0 GROUP BY dir""")
def expand_hop(spark: SparkSession, sf: str) -> DataFrame:
    """One hop from every second supplier's file along its module source."""
    files = _both(spark, sf)
    hits = files.filter(F.regexp_extract("file", r"/s(\d+)/", 1).try_cast("long") % 2 == 0).select("file")
    edges = index.edges(index.parse(files)).filter("edge_type = 'module_source'").select("file", F.col("module").alias("target"))
    return retrieval.expand(hits, edges, files.select("file"))


@query(_BOTH_SQL + """SELECT file, 's' || k AS symbol, 'module' AS kind, 2 AS line_start, 5 AS line_end FROM f UNION ALL SELECT file, 'aws_t' || k % 4 || '.r', 'resource', 6, 11 FROM f
UNION ALL SELECT dir || '/main.tf', 'aws_t' || p % 4 || '.r', 'resource', 8, 9 FROM parts UNION ALL SELECT dir || '/main.tf', 'aws_u.r', 'resource', 10, 11 FROM parts""")
def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    files = _both(spark, sf)
    facts = _kept(spark, files).facts()
    return search.build_chunks(files, index.blocks(facts), index.edges(facts)).select("file", "symbol", "kind", "line_start", "line_end")


# ---------------------------------------------------------------------------------------------------------------
# Retrieval

_TOKENS_SQL = """tok AS (SELECT doc_id AS id, flatten(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: list_concat([lower(w)], list_filter(string_split(lower(w), '_'), lambda x: x <> '')))) AS tokens FROM documents)"""
SEARCH = "create the stupid clown trash in the story of pathetic"


@query(f"""WITH {_TOKENS_SQL}, t AS (SELECT id, unnest(tokens) AS term FROM tok), p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term""")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_stats(table(spark, sf, "documents"), F.col("text"))


_BM25_SQL = f"""{_TOKENS_SQL}, q AS (SELECT * FROM (VALUES ('stupid', 2), ('clown', 2), ('trash', 2), ('story', 2), ('pathetic', 2)) v(term, qn)),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
hits AS (SELECT id, dl, term, qn, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hits JOIN df USING (term), stats GROUP BY id),
top AS (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40)"""


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", F.col("text"), SEARCH)


@query(f"WITH {_BM25_SQL} SELECT id, round(score, 6) AS score FROM top")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select("id", F.round("score", 6).alias("score"))


_DENSE_SQL = """vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), qv AS (SELECT v AS q FROM vec WHERE id = 0),
den AS (SELECT id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM vec, qv ORDER BY score DESC, id LIMIT 40)"""


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return retrieval.dense(e.join(F.broadcast(q)), "vec_id", "embedding", F.col("q"), 40)


@query(f"WITH {_DENSE_SQL} SELECT id, round(score, 6) AS score FROM den")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("id", F.round("score", 6).alias("score"))


_RRF_SQL = f"""WITH {_BM25_SQL}, {_DENSE_SQL},
lists AS (SELECT 0 AS l, id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM top UNION ALL SELECT 1, id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM den),
rrf AS (SELECT id, sum(1.0 / (60 + r + 1)) AS rrf, min(l * 1000 + r) AS seen FROM lists GROUP BY id)"""


@query(_RRF_SQL + "SELECT id, round(rrf, 8) AS rrf FROM rrf ORDER BY rrf.rrf DESC, seen LIMIT 40")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fuse([_bm25(spark, sf), _dense(spark, sf)]).orderBy(F.desc("rrf"), "seen").limit(40).select("id", F.round("rrf", 8).alias("rrf"))


_LOCAL_SQL = "len(list_filter(['stupid', 'clown', 'trash', 'story', 'pathetic'], lambda t: contains(lower(source || ' ' || text), t))) / 5.0"


@query(f"SELECT doc_id, round({_LOCAL_SQL}, 6) AS locality FROM documents")
def locality_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(retrieval.locality(F.lit(SEARCH), F.col("source"), F.col("text")), 6).alias("locality"))


@query(f"""{_RRF_SQL}, cand AS (SELECT * FROM rrf ORDER BY rrf DESC, seen LIMIT 40),
n AS (SELECT c.id, d.source AS file, seen, (rrf - min(rrf) OVER ()) / coalesce(nullif(max(rrf) OVER () - min(rrf) OVER (), 0), 1) AS rrf, {_LOCAL_SQL} AS path FROM cand c JOIN documents d ON d.doc_id = c.id),
b AS (SELECT id, file, seen, 0.15 * rrf + 0.40 * path AS score FROM n),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, seen) = 1)
SELECT id, file, round(score, 5) AS score FROM best ORDER BY best.score DESC, seen LIMIT 8""")
def blend_collapse(spark: SparkSession, sf: str) -> DataFrame:
    cand = retrieval.fuse([_bm25(spark, sf), _dense(spark, sf)]).orderBy(F.desc("rrf"), "seen").limit(40)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), "text")
    hits = d.join(F.broadcast(cand), "id")  # forty rows
    path = retrieval.locality(F.lit(SEARCH), F.col("file"), F.col("text"))
    hits = hits.select("id", "file", "seen", retrieval.blend(retrieval.normalised(F.col("rrf")), path).alias("score"))
    return retrieval.collapse(hits, "file", "score", "seen").select("id", "file", F.round("score", 5).alias("score"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda line, k: [{'first': k, 'last': k, 'chars': length(line) + 1}]) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_reduce(lines, lambda a, x: CASE WHEN a[-1].chars + x[1].chars <= 2000
  THEN list_concat(a[1:len(a) - 1], [{'first': a[-1].first, 'last': x[1].last, 'chars': a[-1].chars + x[1].chars}]) ELSE list_concat(a, x) END) AS windows FROM l),
u AS (SELECT doc_id, generate_subscripts(windows, 1) - 1 AS chunk, unnest(windows) AS v FROM w)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(v.first AS INT) AS first, CAST(v.last AS INT) AS last, CAST(v.chars AS INT) AS chars FROM u""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(retrieval.chunk_windows(F.col("text"), 2000)).alias("chunk", "w"))
    return d.select("doc_id", "chunk", "w.first", "w.last", "w.chars")


# ---------------------------------------------------------------------------------------------------------------
# Catalog, planner, paths


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the role of modules, suppliers in that of their importers."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    reuse = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("reuse_count"))
    return p.join(reuse, "p_partkey", "left").withColumn("reuse_count", F.coalesce("reuse_count", F.lit(0)))


_MODULES_SQL = _BOTH_SQL + """, modules AS (SELECT dir, regexp_extract(dir, '[^/]*$') AS name, 'aws_t' || p % 4 || ',aws_u' AS resource_types, 'size,v' || p % 3 AS inputs, 'size' AS required, 'id' AS outputs FROM parts
UNION ALL SELECT regexp_replace(file, '/main.tf$', ''), 's' || k, 'aws_t' || k % 4, '', '', '' FROM f),
used AS (SELECT DISTINCT m.dir, f.file FROM modules m JOIN f ON m.name = 'm' || k % 7)"""


def _catalog_of_both(spark: SparkSession, sf: str) -> DataFrame:
    files = _both(spark, sf)
    facts = _kept(spark, files).facts()
    return catalog.build(index.blocks(facts), index.edges(facts, only=("module_source",)), "live/")


@query(_MODULES_SQL + "SELECT * FROM modules")
def catalog_agg(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform("inputs", lambda i: i["name"])
    return _catalog_of_both(spark, sf).select("dir", "name", F.array_join("resource_types", ",").alias("resource_types"), F.array_join(names, ",").alias("inputs"), F.array_join(catalog.required_inputs(F.col("inputs")), ",").alias("required"), F.array_join("outputs", ",").alias("outputs"))


@query(_MODULES_SQL + "SELECT m.dir, count(file) AS reuse_count, coalesce(string_agg(file, ',' ORDER BY file), '') AS used_by FROM modules m LEFT JOIN used USING (dir) GROUP BY m.dir")
def reuse_count(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog_of_both(spark, sf).select("dir", F.col("reuse_count").cast("long"), F.array_join("used_by", ",").alias("used_by"))


@query(_MODULES_SQL + """SELECT dir, string_agg(regexp_extract(file, '/(s[0-9]+)/', 1), ',' ORDER BY file) AS names FROM used GROUP BY dir""")
def upstream_names(spark: SparkSession, sf: str) -> DataFrame:
    """What the consumers of each module read from others, in order."""
    facts = _kept(spark, _both(spark, sf)).facts()
    reads = index.edges(facts, only=("remote_state", "output_ref"))
    return catalog.upstream_pattern(catalog.build(index.blocks(facts), index.edges(facts, only=("module_source",)), "live/"), reads).select("dir", F.array_join("names", ",").alias("names"))


@query(_BOTH_SQL + """SELECT dir, 'size:number,v' || p % 3 || ':' AS contract FROM parts UNION ALL SELECT DISTINCT regexp_replace(file, '/main.tf$', ''), '' FROM f""")
def module_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Declared types of inputs, the required ones first."""
    entries = F.transform(F.map_entries(catalog.contract(F.col("inputs"))), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return _catalog_of_both(spark, sf).select("dir", F.array_join(entries, ",").alias("contract"))


@query(_MODULES_SQL + """SELECT m.dir, count(file) AS reuse_count FROM modules m LEFT JOIN used USING (dir) WHERE list_contains(string_split(resource_types, ','), 'aws_t2') GROUP BY m.dir ORDER BY 2 DESC, 1 LIMIT 1""")
def module_choice(spark: SparkSession, sf: str) -> DataFrame:
    return requests.find_module(_catalog_of_both(spark, sf), "AWS_T2").select("dir", F.col("reuse_count").cast("long"))


@query("""WITH c AS (SELECT p.p_partkey AS id, p_name, p_type, count(DISTINCT l_suppkey) AS reuse FROM part p LEFT JOIN lineitem ON l_partkey = p.p_partkey GROUP BY ALL),
tok AS (SELECT id, flatten(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z0-9_]+'), lambda w: [lower(w), lower(w)])) AS tokens FROM c),
q AS (SELECT * FROM (VALUES ('blue', 2), ('widget', 2), ('promo', 2)) v(term, qn)), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
hits AS (SELECT id, dl, term, qn, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS lexical FROM hits JOIN df USING (term), stats GROUP BY id)
SELECT c.id, round(coalesce(lexical, 0) + CASE WHEN list_has_any(string_split(lower(p_name), ' '), ['blue', 'widget', 'promo']) THEN 3.0 ELSE 0 END + 0.25 * reuse, 6) AS score
FROM c LEFT JOIN bm USING (id) ORDER BY coalesce(lexical, 0) + CASE WHEN list_has_any(string_split(lower(p_name), ' '), ['blue', 'widget', 'promo']) THEN 3.0 ELSE 0 END + 0.25 * reuse DESC, c.id LIMIT 3""")
def catalog_match(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    got = catalog.match(c, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), T.plain_tokens(F.col("p_name")), F.col("reuse_count"), "blue widget promo")
    return got.select("id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT p.p_partkey AS id, p_name, p_type, count(DISTINCT l_suppkey) AS reuse FROM part p LEFT JOIN lineitem ON l_partkey = p.p_partkey GROUP BY ALL),
s AS (SELECT id, reuse, 2 * len(list_intersect(['promo', 'widget', 'small'], [lower(p_type)])) + len(list_intersect(['promo', 'widget', 'small'], list_distinct(string_split(lower(p_name), ' ')))) AS score,
  len(list_intersect(['promo', 'widget', 'small'], list_distinct(list_concat([lower(p_type)], string_split(lower(p_name), ' '))))) AS covered FROM c)
SELECT id, CAST(score AS INT) AS score FROM s WHERE score > 0 AND 2 * covered >= 3 ORDER BY s.score DESC, reuse DESC, id LIMIT 3""")
def planner_rank(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.planner_rank(_catalog(spark, sf), "p_partkey", F.col("p_name"), F.array("p_type"), F.col("reuse_count"), "create a promo widget for the small project")


@query("""SELECT p_partkey, list_has_any(list_concat(string_split(lower(p_name), ' '), [lower(p_type)]), ['ring', 'small']) AS relates FROM part""")
def module_relates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", catalog.module_relates(F.lit("aws_small_ring"), F.col("p_name"), F.array("p_type")).alias("relates"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("file"))


_PATHS_SQL = """WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file FROM pages),
up AS (SELECT file, array_to_string(string_split(file, '/')[1:k], '/') AS owner, k FROM (SELECT file, unnest(range(1, len(string_split(file, '/')))) AS k FROM (SELECT DISTINCT file FROM f)))"""


@query(_PATHS_SQL + """, owners AS (SELECT DISTINCT owner FROM up WHERE k <= 2 AND length(owner) % 2 = 0)
SELECT file, arg_max(owner, length(owner)) AS owner FROM up JOIN owners USING (owner) GROUP BY file""")
def longest_prefix_owner(spark: SparkSession, sf: str) -> DataFrame:
    files = _paths(spark, sf).select("file").distinct()
    dirs = files.select(F.explode(T.ancestors(F.col("file"))).alias("dir")).filter("dir <> ''").filter((F.size(F.split("dir", "/")) <= 2) & (F.length("dir") % 2 == 0))
    return index.longest_prefix(files, dirs)


#: Pages in the role of files; rules at the top and in the folder of one host each.
_RULES = {".gitignore": "de/\n*7\n*.html\n!*1.html\n", "{host}/.gitignore": "!*7\n/fr/**\n"}


@query(_PATHS_SQL + """, p AS (SELECT DISTINCT file, regexp_extract(file, '^[^/]+') AS host, regexp_extract(file, '[^/]*$') AS name FROM f WHERE NOT file LIKE '%/'), own AS (SELECT min(host) AS own FROM p)
SELECT file FROM p, own WHERE regexp_matches(file, '(^|/)de/') OR regexp_matches(file, '7/') OR (name LIKE '%.html' AND NOT name LIKE '%1.html' AND NOT (host = own AND name LIKE '%7')) OR (name LIKE '%7' AND host <> own)
  OR (host = own AND file LIKE own || '/fr/%')""")
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = _paths(spark, sf).select("file").filter("file not like '%/'").distinct().withColumn("text", F.lit(""))
    host = files.agg(F.min(F.regexp_extract("file", "^[^/]+", 0))).first()[0] or ""
    given = spark.createDataFrame([(k.format(host=host), v) for k, v in _RULES.items()], "file string, text string")
    return ignore.ignored(files, given_in=given)


@query(_PATHS_SQL + "SELECT DISTINCT owner AS dir FROM up WHERE k = 1")
def ancestor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return layout.directories(_paths(spark, sf), 1)


@query(_PATHS_SQL + """, host AS (SELECT regexp_extract(file, '^[^/]+') AS repo, file FROM f)
SELECT repo, CASE WHEN bool_or(file LIKE '%/en/%') THEN 'terragrunt' ELSE 'tf-flat' END AS kind, CASE WHEN bool_or(file LIKE '%/en/%') THEN 'high' ELSE 'low' END AS confidence FROM host GROUP BY repo""")
def convention_detect(spark: SparkSession, sf: str) -> DataFrame:
    f = _paths(spark, sf).select(F.regexp_extract("file", "^[^/]+", 0).alias("repo"), F.when(F.col("file").contains("/en/"), F.lit("live/terragrunt.hcl")).otherwise(F.lit("notes.md")).alias("file"), F.lit("").alias("text"))
    return layout.convention(f)


@query("""SELECT n_name AS env FROM nation WHERE contains(lower(replace(n_name, '_', '')), 'nation2') AND lower(replace(n_name, '_', '')) = 'nation2'""")
def env_match(spark: SparkSession, sf: str) -> DataFrame:
    return layout.match_env(table(spark, sf, "nation").select(F.col("n_name").alias("env"), F.lit("").alias("config_env")), "Nation-2")


@query("SELECT DISTINCT lower(replace(n_name, '_', '')) AS env FROM nation")
def env_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(T.norm_env(F.col("n_name")).alias("env")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'true' ELSE CAST(p_size AS VARCHAR) END AS value FROM part""")
def value_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(' "'), "p_name", F.lit('" '))).when(F.col("p_size") % 3 == 1, F.lit("TRUE")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", T.norm_value(raw).alias("value"))


# ---------------------------------------------------------------------------------------------------------------
# Inventory


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("values", F.from_json("props", "map<string,string>"))


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7' AND json_extract_string(props, '$.k') <> '8'")
def where_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf).filter(inventory.predicate(F.col("values"), ["k=7", "k!=8", "k"])).select("event_id", "event_type")


@query("SELECT DISTINCT w.key FROM (VALUES ('k'), ('nope'), ('also')) w(key) WHERE NOT EXISTS (SELECT 1 FROM events WHERE json_extract_string(props, '$.' || w.key) IS NOT NULL)")
def unresolved_keys(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.unresolved(_inventory(spark, sf), F.col("values"), ["k=7", "nope", "also!=1", "k"])


#: Customers in the role of components.
_INPUTS = """CONCAT('inputs = {', CHR(10), '  cluster_name = "c', c_custkey, '"', CHR(10), '  size = ', c_custkey % 5, CHR(10), '  on = TRUE', CHR(10), '  tags = {', CHR(10), '    seg = "', c_mktsegment, '"', CHR(10), '  }', CHR(10),
  '  nets = [{ id = ', c_nationkey, ' }, "x"]', CHR(10), '}', CHR(10))"""


def _components(spark: SparkSession, sf: str) -> DataFrame:
    file = "concat('p', c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '/x/aws/e' ELSE '/aws/e' END, c_nationkey, '/t', c_custkey % 3, '/inputs.hcl')"
    return trees.components(table(spark, sf, "customer").selectExpr(f"{file} AS file", f"{_INPUTS} AS text"))


@query("""SELECT 'p' || c_custkey AS project, 'e' || c_nationkey AS env, 'c' || c_custkey AS name, CAST(c_custkey % 5 AS VARCHAR) AS size, c_mktsegment AS "tags.seg", 'true' AS on_, CAST(c_nationkey AS VARCHAR) AS net FROM customer
WHERE c_custkey % 10 <> 0 AND c_custkey % 3 = 1 AND c_custkey % 5 <> 2 AND c_mktsegment = 'BUILDING'""")
def inventory_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Values are read from the text by path: plain, nested and indexed ones."""
    found = inventory.find(_components(spark, sf), "t1", where=["size!=2", "tags.seg=BUILDING"])[0]
    return found.select("project", "env", "name", "size", F.col("`tags.seg`"), T.norm_value(F.col("values")["on"]).alias("on_"), F.col("values")["nets[0].id"].alias("net"))


#: Edits of every second customer's inputs, and of a file that isn't there; the fifth finds no place, the seventh says a type.
_EDITS = [(1, "size", "set", '"9"', "number"), (2, "extra", "set", '"x"', None), (3, "on", "remove", None, None), (4, "tags", "add", '{"k": "v"}', None), (5, "nets[5].id", "set", "1", None), (6, "nets", "remove", '"x"', None), (7, "flag", "set", '"Yes"', "bool")]
_HOW = ["replaced", "injected", "removed", "added", "skipped", "removed", "injected"]
_EDITED_SQL = f"""WITH c AS (SELECT *, 'c' || c_custkey || '/inputs.hcl' AS file FROM customer), e(seq, path, op, how) AS (VALUES {", ".join(f"({s}, '{p}', '{o}', '{h}')" for (s, p, o, *_), h in zip(_EDITS, _HOW, strict=True))})
SELECT file, seq, path, op, how, seq <> 5 AS verified, CASE WHEN seq = 5 THEN 'no such path: nets[5].id' ELSE '' END AS error, NULL AS text FROM c, e WHERE c_custkey % 2 = 0
UNION ALL SELECT 'gone', seq, path, op, 'skipped', false, 'no such file', NULL FROM e
UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, CONCAT('inputs = {{', CHR(10), '  cluster_name = "c', c_custkey, '"', CHR(10), '  size = 9', CHR(10), '  tags = {{', CHR(10), '    seg = "', c_mktsegment, '"', CHR(10), '  k = "v"', CHR(10), '  }}', CHR(10),
  '  nets = [{{ id = ', c_nationkey, ' }}]', CHR(10), '  extra = "x"', CHR(10), '  flag = true', CHR(10), '}}', CHR(10)) FROM c WHERE c_custkey % 2 = 0"""


@query(_EDITED_SQL)
def edited_inputs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    files = c.selectExpr("concat('c', c_custkey, '/inputs.hcl') AS file", f"{_INPUTS} AS text")
    said = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("seq"), F.lit(p).alias("path"), F.lit(o).alias("op"), F.lit(v).cast("string").alias("value"), F.lit(k).cast("string").alias("kind")) for s, p, o, v, k in _EDITS])).alias("e")
    named = c.filter("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey, '/inputs.hcl') AS file").unionByName(spark.createDataFrame([("gone",)], "file string"))
    null = F.lit(None)
    asked = named.select("file", said).select("file", "e.*", null.cast("int").alias("index"), null.cast("string").alias("match"))
    return edits.apply_edits(files, asked)


#: Suppliers in the role of repositories of five kinds: a root included by name with a computed source, one included without a
#: name with a literal source, a usual name that nobody includes, plain modules, a component without any root.
_ROOTS_SQL = """SELECT 'r' || s_suppkey AS repo, [CASE WHEN s_suppkey % 2 = 0 THEN 'live/root.hcl' ELSE 'live/a/root.hcl' END, 'terragrunt.hcl', 'account.hcl', NULL, NULL][s_suppkey % 5 + 1] AS root_file,
  ['root.hcl', 'terragrunt.hcl', 'account.hcl', '', 'root.hcl'][s_suppkey % 5 + 1] AS include_target,
  ['modules/p' || s_nationkey || '/infrastructure/{terraform_module}/{component}', 'modules/aws/x' || s_suppkey, 'modules/{provider}/infrastructure/{terraform_module}/{component}', 'modules/{component}', 'modules/{provider}/infrastructure/{terraform_module}/{component}'][s_suppkey % 5 + 1] AS template,
  ['env.yml', 'config.yml', 'config.yml', 'terraform.tfvars', 'config.yml'][s_suppkey % 5 + 1] AS env_config, ['tier,region', 'terraform_module,region,account_id', 'terraform_module,region,account_id', 'environment,region', 'terraform_module,region,account_id'][s_suppkey % 5 + 1] AS fields,
  ['gcs', 's3', 's3', '', 's3'][s_suppkey % 5 + 1] AS backend, ['aws', 'aws', 'google', '', 'aws'][s_suppkey % 5 + 1] AS provider, ['full', 'partial', 'partial', 'full', 'fallback'][s_suppkey % 5 + 1] AS confidence,
  ['modules/p' || s_nationkey || '/infrastructure', 'modules/aws/x' || s_suppkey, 'modules', 'modules', 'modules'][s_suppkey % 5 + 1] AS prefix FROM supplier"""


@query(_ROOTS_SQL)
def root_schemas(spark: SparkSession, sf: str) -> DataFrame:
    k, lit = F.col("s_suppkey") % 5, F.lit
    include = lambda said: lit(f"include {{\n  path = find_in_parent_folders({said})\n}}\n")
    source = F.concat(lit('source = "${get_parent_terragrunt_dir()}/modules//p'), "s_nationkey", lit('/infrastructure/${local.env_cfg.tier_terraform_module}/${basename(get_original_terragrunt_dir())}/"\n'))
    dynamic = F.concat(lit("c = find_in_parent_folders('env.yml')\nt = local.env_cfg.tier\nr = local.env_cfg.region\nt = local.env_cfg.tier\nbackend = \"gcs\"\n"), F.replace(source, lit("local.env_cfg.tier_"), lit("x.")))
    literal = F.concat(lit('source = "../../modules/aws/x'), F.col("s_suppkey").cast("string"), lit('/"\n'))
    near = F.when(F.col("s_suppkey") % 2 == 0, "live/root.hcl").otherwise("live/a/root.hcl")
    entry = lambda when, file, text: F.when(when, F.struct((file if not isinstance(file, str) else lit(file)).alias("file"), text.alias("text")))
    files = F.array(
        entry(k == 0, "live/a/b/terragrunt.hcl", include('"root.hcl"')), entry(k == 0, near, dynamic), entry(k == 0, "root.hcl", lit("")),
        entry(k == 1, "live/terragrunt.hcl", include("")), entry(k == 1, "terragrunt.hcl", literal),
        entry(k == 2, "live/terragrunt.hcl", include('"none.hcl"')), entry(k == 2, "common.hcl", lit("")), entry(k == 2, "account.hcl", lit('provider "google" {\n}\n')),
        entry(k == 3, "main.tf", lit('module "m" {\n}\n')), entry(k == 3, "root.hcl", literal), entry(k == 4, "live/terragrunt.hcl", include('"root.hcl"')),
    )
    rows = table(spark, sf, "supplier").select(F.concat(lit("r"), "s_suppkey").alias("repo"), F.explode(files).alias("f")).filter("f is not null").select("repo", "f.*")
    return layout.repo_schemas(rows).withColumn("fields", F.array_join("fields", ","))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'top/p1/aws/e' || c_nationkey || '/t1' WHEN c_custkey % 4 = 2 THEN 'p1/aws/e' || c_nationkey || '/t1' END AS dir FROM customer""")
def component_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """The component a hit's path lies in: below other folders, at the top, of another project, and too short."""
    ends = F.array(F.lit("p2/aws/e/t1/inputs.hcl"), F.concat(F.lit("top/p1/aws/e"), "c_nationkey", F.lit("/t1/sub/main.tf")), F.concat(F.lit("p1/aws/e"), "c_nationkey", F.lit("/t1/inputs.hcl")), F.lit("p1/aws/t1"))
    file = F.get(ends, (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", requests.component_dir(file, "p1", "aws", "t1").alias("dir"))


@query("SELECT 'p' || c_custkey AS project, 'aws' AS provider, 'e' || c_nationkey AS env FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 = 2")
def envs_with_component(spark: SparkSession, sf: str) -> DataFrame:
    return requests.envs_with(_components(spark, sf), "t2")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'delete' WHEN '2-HIGH' THEN 'add' WHEN '3-MEDIUM' THEN 'update' ELSE 'create' END AS operation FROM orders")
def operation_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    said = F.when(p == "1-URGENT", "please remove and add this").when(p == "2-HIGH", "attach a disk, then change it").when(p == "3-MEDIUM", "Resize the new one").otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", T.classify_operation(said).alias("operation"))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 9 AS k FROM customer)
SELECT c_custkey, ['aws_instance', 'aws_security_group', 'aws_security_group', 'aws_instance', 'aws_lb', 'aws_lambda_function', 'aws_s3_bucket', 'aws_RESOURCE', 'aws_db_instance'][k + 1] AS first,
  ['aws_instance', 'aws_security_group', 'aws_instance', 'aws_instance', 'aws_lb', 'aws_lambda_function', 'aws_s3_bucket', 'azurerm_key_vault', 'aws_db_instance'][k + 1] AS longest FROM r""")
def type_guess(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with one keyword and with several, of equal and of different lengths."""
    said = ["An EC2 box", "a security group for the bucket", "a VM with SG", "ec2 behind an alb", "load balancer on alb", "lambda queue function", "S3", "a key vault", "one RDS postgres"]
    text = F.get(F.array(*map(F.lit, said)), (F.col("c_custkey") % 9).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.guess_type(text).alias("first"), T.guess_type(text, longest=True).alias("longest"))


# ---------------------------------------------------------------------------------------------------------------
# Quality, datasets, checks


@query("""SELECT count(*) AS n, round(avg(CAST((CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) = quality AS DOUBLE)), 6) AS strict,
  round(avg(CAST((CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) = quality OR length(text) < 200 AS DOUBLE)), 6) AS lenient,
  round(count(*) FILTER (WHERE length(text) > 1000 AND quality = 0) / count(*), 6) AS false_reuse FROM documents JOIN labels USING (doc_id)""")
def precision_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf, "labels"), "doc_id")
    q = dataset.decision_quality(d, (F.col("n") > 1000).cast("int"), F.col("quality"), F.col("n") < 200)
    return q.select("n", *[F.round(c, 6).alias(c) for c in ("strict", "lenient", "false_reuse")])


#: Orders in the role of repositories: each part ordered is a module, its type made of the part's type and noun, some with a second one.
_SWEEP_SQL = """WITH m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS scope, 'live/p' || p_partkey || '/' || lower(split_part(p_name, ' ', 1)) AS dir, 'aws_' || lower(p_type) || '_' || split_part(p_name, ' ', 2) AS t,
  CASE WHEN p_size % 2 = 0 THEN [t] ELSE [t, 'aws_' || split_part(p_name, ' ', 2)] END AS types, p_size % 5 AS reuse FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, list_sort(types)[1] AS first_type, list_distinct(flatten(list_transform(types, lambda x: regexp_extract_all(x, '[a-z0-9]+')))) AS type_words,
  list_distinct(regexp_extract_all(dir, '[a-z0-9]+')) AS names FROM m),
u AS (SELECT scope, count(*) AS n, min({{'draw': ('0x' || substr(md5('42' || chr(31) || scope || chr(31) || dir), 1, 8))::BIGINT, 'dir': dir, 'want': first_type}}).want AS want FROM w GROUP BY scope HAVING count(*) >= 2),
asked AS (SELECT scope, want FROM u)"""
_GENERIC_SQL = str(list(catalog.GENERIC))


def _order_modules(spark: SparkSession, sf: str, describe: bool = False) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    noun = F.split("p_name", " ")[1]
    type_, second = F.concat(F.lit("aws_"), F.lower("p_type"), F.lit("_"), noun), F.concat(F.lit("aws_"), noun)
    types = F.when(F.col("p_size") % 2 == 0, F.array(type_)).otherwise(F.array(type_, second))
    parts = p.select("p_partkey", F.concat_ws("/", F.concat(F.lit("live/p"), "p_partkey"), F.lower(F.split("p_name", " ")[0])).alias("dir"), types.alias("resource_types"), (F.col("p_size") % 5).alias("reuse_count"))
    # a part's dir names it, so equal modules of an order are equal pairs of keys
    pairs, parts = li.select("l_orderkey", "l_partkey").distinct(), parts.distinct()
    # merged: a file's size says little of what its parts take in memory, and the driver would hold them whole to send them out
    rows = pairs.join((sweep.described(parts) if describe else parts).hint("merge"), pairs["l_partkey"] == parts["p_partkey"])
    # an order's modules lie together, so that later steps by order move little
    return rows.drop("l_partkey", "p_partkey").withColumn("l_orderkey", F.col("l_orderkey").cast("string")).withColumnRenamed("l_orderkey", "scope").repartition("scope")


@query(_SWEEP_SQL.replace("{{", "{").replace("}}", "}") + f""", r AS (SELECT a.scope, want, dir, reuse, list_filter(string_split(replace(substr(want, 5), '_', ' '), ' '), lambda x: NOT list_contains({_GENERIC_SQL}, x)) AS q,
  list_filter(type_words, lambda x: NOT list_contains({_GENERIC_SQL}, x)) AS tw, list_filter(names, lambda x: NOT list_contains({_GENERIC_SQL}, x)) AS nw FROM asked a JOIN w USING (scope)),
s AS (SELECT scope, want, dir, reuse, 2 * len(list_intersect(q, tw)) + len(list_intersect(q, nw)) AS score, len(list_intersect(q, list_concat(tw, nw))) AS covered, len(q) AS n FROM r)
SELECT scope, want, dir, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY scope ORDER BY s.score DESC, reuse DESC, dir) AS INT) AS rank FROM s WHERE score > 0 AND 2 * covered >= n QUALIFY rank <= 3""")
def ranked_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each repository, ranked against its modules, all in one job."""
    modules = sweep.written(_order_modules(spark, sf), "modules")
    asked = sweep.positives(modules).select("scope", "want", "intent")
    return sweep.rank_requests(asked, modules).select("scope", "want", "dir", "score", "rank")


@query(_SWEEP_SQL.replace("{{", "{").replace("}}", "}") + """, v AS (SELECT want, row_number() OVER (ORDER BY ('0x' || substr(md5('0' || chr(31) || want), 1, 8))::BIGINT % 64, want) - 1 AS number, count(*) OVER () AS total
  FROM (SELECT DISTINCT unnest(types) AS want FROM w JOIN u USING (scope))),
said AS (SELECT scope, list_distinct(flatten(list(list_concat(names, flatten(list_transform(type_words, lambda x: string_split(x, '_'))))))) AS words, any_value(('0x' || substr(md5('42' || chr(31) || scope), 1, 8))::BIGINT) AS start FROM w JOIN u USING (scope) GROUP BY scope),
no AS (SELECT scope, min_by(want, (number - start % total + total) % total) AS want FROM said, v WHERE NOT list_has_any(words, string_split(substr(want, 5), '_')) GROUP BY scope),
c AS (SELECT scope, 'positive' AS kind, want FROM u UNION ALL SELECT scope, 'negative', want FROM no),
r AS (SELECT c.scope, kind, c.want, dir, reuse, types, string_split(substr(c.want, 5), '_') AS words, list_concat(names, type_words) AS hay, list_filter(words, lambda x: NOT list_contains(@GENERIC, x)) AS q,
  list_filter(type_words, lambda x: NOT list_contains(@GENERIC, x)) AS tw, list_filter(names, lambda x: NOT list_contains(@GENERIC, x)) AS nw FROM c JOIN w USING (scope)),
s AS (SELECT *, 2 * len(list_intersect(q, tw)) + len(list_intersect(q, nw)) AS score, 2 * len(list_intersect(q, list_concat(tw, nw))) >= len(q) AS covered,
  CASE WHEN list_contains(types, substr(want, 5)) OR dir = substr(want, 5) THEN 2 WHEN contains(dir, substr(want, 5)) OR len(list_filter(types, lambda x: contains(x, substr(want, 5)))) > 0 THEN 1 ELSE 0 END AS tier FROM r),
took AS (SELECT 'planner' AS who, scope, kind, min_by(s, (-score, -reuse, dir)) AS b FROM s WHERE score > 0 AND covered GROUP BY scope, kind
  UNION ALL SELECT 'compose', scope, kind, min_by(s, (-tier, -reuse, dir)) FROM s WHERE tier > 0 GROUP BY scope, kind),
d AS (SELECT x.who, c.kind, b IS NOT NULL AS reused, coalesce(list_contains(b.types, c.want), false) AS strict, coalesce(list_has_any(b.hay, b.words), false) AS related FROM c CROSS JOIN (VALUES ('planner'), ('compose')) x(who) LEFT JOIN took USING (who, scope, kind)),
t AS (SELECT who, count(*) FILTER (WHERE kind = 'positive') AS positives, count(*) FILTER (WHERE kind = 'positive' AND strict) / positives AS strict, count(*) FILTER (WHERE kind = 'positive' AND (strict OR related)) / positives AS lenient,
  count(*) FILTER (WHERE kind = 'negative') AS negatives, count(*) FILTER (WHERE kind = 'negative' AND reused) / greatest(negatives, 1) AS false_reuse FROM d GROUP BY who)
SELECT who, positives, round(strict, 6) AS strict, round(lenient, 6) AS lenient, negatives, round(false_reuse, 6) AS false_reuse, lenient >= 0.85 AND false_reuse <= 0.05 AS ok FROM t""".replace("@GENERIC", _GENERIC_SQL))
def sweep_report(spark: SparkSession, sf: str) -> DataFrame:
    """Strict, lenient and false reuse of the planner and the composer, and whether they pass the thresholds."""
    modules = _order_modules(spark, sf, describe=True)
    told = sweep.report(sweep.sweep(modules))
    return told.select("who", "positives", "negatives", *[F.round(c, 6).alias(c) for c in ("strict", "lenient", "false_reuse")], "ok")


@query("SELECT conv_id, string_agg('# ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id")
def group_concat_dataset(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return dataset.ordered_concat(c, ["conv_id"], ["turn", "role"], F.concat(F.lit("# "), "role", F.lit("\n"), "text"), "\n\n")


@query("""WITH g AS (SELECT string_agg('# ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)
SELECT count(*) AS examples, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens, round(avg(length(text)), 6) AS mean_chars FROM g""")
def dataset_totals(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.totals(group_concat_dataset(spark, sf), F.col("text")).select("examples", "chars", "tokens", F.round("mean_chars", 6).alias("mean_chars"))


#: Documents in the role of files: eight to a directory, of which four are grouped, two stand alone and two are left out.
#: Signs of strings and comments are blanked, so that SQL can count braces; a closing line is added to some, an opening one to others.
_NAMES = ("main.tf", "variables.tf", "outputs.tf", "inputs.hcl", "config.yml", "live.tfvars", "terragrunt.hcl", "README.md")
_DOC_DIR = "CONCAT('src/', coalesce(source, 'none'), '/d', CAST(floor(doc_id / 8) AS INT))"
_DOC_TEXT = """CONCAT(CASE WHEN doc_id % 8 = 1 THEN CONCAT('a {', CHR(10)) ELSE '' END, translate(text, CONCAT(CHR(34), CHR(92), '#/*'), '     '), CASE WHEN doc_id % 8 = 0 THEN CONCAT(CHR(10), '}', CHR(10)) ELSE CHR(10) END)"""
_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _doc_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf, "documents").select(F.concat_ws("/", F.expr(_DOC_DIR), name).alias("file"), F.expr(_DOC_TEXT).alias("text"))


_EXAMPLES_SQL = f"""WITH d AS (SELECT {_DOC_DIR} AS dir, {list(_NAMES)}[doc_id % 8 + 1] AS name, doc_id % 8 AS k, {_DOC_TEXT} AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, dir || '/' || name AS file FROM d WHERE k < 6 AND length(trim(t, {_BLANK_SQL})) >= 15),
g AS (SELECT dir AS label, string_agg('# file: ' || file || chr(10) || rtrim(t, {_BLANK_SQL}), chr(10) || chr(10) ORDER BY [2, 1, 3, 4][k + 1]) AS t, false AS alone FROM f WHERE k < 4 GROUP BY dir
  UNION ALL SELECT file, t, true FROM f WHERE k >= 4),
short AS (SELECT label, t AS text FROM g WHERE alone AND length(t) <= 4000),
l AS (SELECT label, list_transform(string_split(t, chr(10)), lambda x, k: CASE WHEN k < len(string_split(t, chr(10))) THEN x || chr(10) ELSE x END) AS lines FROM (SELECT label, t FROM g WHERE NOT (alone AND length(t) <= 4000))),
w AS (SELECT label, lines, list_reduce(list_transform(lines, lambda x, k: [{{'first': k, 'last': k, 'chars': length(x), 'depth': length(replace(x, '}}', '')) - length(replace(x, '{{', ''))}}]),
  lambda a, x: CASE WHEN a[-1].depth = 0 AND a[-1].chars >= 4000 THEN list_concat(a, x)
    ELSE list_concat(a[1:len(a) - 1], [{{'first': a[-1].first, 'last': x[1].last, 'chars': a[-1].chars + x[1].chars, 'depth': a[-1].depth + x[1].depth}}]) END) AS windows FROM l),
u AS (SELECT label, generate_subscripts(windows, 1) AS part, lines, unnest(windows) AS v FROM w),
c AS (SELECT label, part, rtrim(array_to_string(lines[v.first:v.last], ''), {_BLANK_SQL}) AS text FROM u),
n AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY part) - 1 AS i, count(*) OVER (PARTITION BY label) AS parts FROM c WHERE text <> '')
SELECT label, text FROM short UNION ALL SELECT label || CASE WHEN parts > 1 THEN '::part' || i ELSE '' END, text FROM n"""


@query(_EXAMPLES_SQL)
def dataset_examples(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.build(_doc_files(spark, sf), max_chars=4000)


@query("SELECT page_id, CAST(length(replace(html, '}', '')) - length(replace(html, '{', '')) AS INT) AS balance FROM pages")
def brace_balance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.brace_balance(F.col("html")).alias("balance"))


#: Documents in the role of code: under a head that opens a block or, in every third, a string that runs on over lines.
_CODE = """CONCAT(CASE WHEN doc_id % 3 = 0 THEN 'a = [ "{' ELSE 'a = [ {' END, CHR(10), text)"""
#: Strings (whole, or open to the end) keep their line ends only, comments go.
_PIECE = r"""'"(?:[^"\\]|(?s:\\.))*(?:"|\\?\z)|(?:#|//)[^\n]*|[^"#/]+|/'"""
_LINES_SQL = rf"""WITH s AS (SELECT doc_id, regexp_extract_all({_CODE}, {_PIECE}) AS pieces FROM documents),
plain AS (SELECT doc_id, array_to_string(list_transform(pieces, lambda p: CASE WHEN p[1] = '"' THEN regexp_replace(p, '[^\n]', '', 'g') WHEN p[1] = '#' OR p[1:2] = '//' THEN '' ELSE p END), '') AS text FROM s),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM plain),
c AS (SELECT doc_id, line, length(translate(code, '}}])', '')) - length(translate(code, '{{[(', '')) AS change FROM l)"""


@query(_LINES_SQL + " SELECT doc_id, line, CAST(sum(change) OVER (PARTITION BY doc_id ORDER BY line) - change AS BIGINT) AS depth FROM c")
def line_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Of every line, by blocks of 256 lines."""
    texts = table(spark, sf, "documents").select("doc_id", F.expr(_CODE).alias("text"))
    return depths.line_depths(depths.lines_of(texts, "doc_id", F.col("text")), "doc_id", block=256)


@query(_LINES_SQL + " SELECT doc_id, CAST(sum(change) AS BIGINT) AS depth FROM c GROUP BY doc_id")
def text_balance(spark: SparkSession, sf: str) -> DataFrame:
    """What each text leaves open."""
    texts = table(spark, sf, "documents").select("doc_id", F.expr(_CODE).alias("text"))
    return depths.balances(depths.lines_of(texts, "doc_id", F.col("text")), "doc_id").select("doc_id", "depth")


@query("SELECT 'live/n' || s_nationkey || '/s' || s_suppkey || '/main.tf' AS file, s_suppkey % 2 = 0 AS sound FROM supplier")
def structural_check(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.regexp_extract("file", r"s(\d+)/", 1).cast("long") % 2 == 1
    return _tree(spark, sf).select("file", index.sound(F.when(odd, F.concat("text", F.lit("x = [1\n"))).otherwise(F.col("text"))).alias("sound"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END) AS file_hash FROM documents WHERE doc_id % 10 <> 0""")
def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents changed, every tenth of all went; the others keep their rows."""
    d = table(spark, sf, "documents")
    old = d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("file_hash"))
    new = d.filter("doc_id % 10 <> 0").select("doc_id", F.md5(F.concat("text", F.lit("!")).cast("binary")).alias("file_hash"))
    return index.refresh(old, new, d.filter("doc_id % 2 = 0").select("doc_id"), key="doc_id")


def _signs(texts: list[str]) -> list[list[int]]:
    """A stand-in for a model: how long a text is, its vowels a, and its blanks."""
    return [[len(t), t.count("a"), t.count(" ")] for t in texts]


_SIGNS_SQL = "length(t) AS n, length(t) - length(replace(t, 'a', '')) AS n_a, length(t) - length(replace(t, ' ', '')) AS n_blank"


@query(f"""SELECT doc_id, {_SIGNS_SQL} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each document beside the vector of its text; equal texts were encoded once."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = EncodedTexts(spark, scratch_path(spark, "vectors"), "signs")
    e.encode(d, _signs, commits=4)
    return e.lookup(d).select("doc_id", *[F.get("vector", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("n", "n_a", "n_blank"))])


@query("""WITH d AS (SELECT doc_id % 3 = 0 AS early, coalesce(text, '') AS t FROM documents)
SELECT 0 AS run, count(DISTINCT t) FILTER (WHERE early) AS encoded FROM d UNION ALL SELECT 1, count(DISTINCT t) - count(DISTINCT t) FILTER (WHERE early) FROM d UNION ALL SELECT 2, 0""")
def encoding_runs(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts are encoded when a third of the documents are there, when all are, and again."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = EncodedTexts(spark, scratch_path(spark, "vectors"), "signs")
    done = [e.encode(x, _signs, commits=4) for x in (d.filter("doc_id % 3 = 0"), d, d)]
    return spark.createDataFrame(list(enumerate(done)), "run int, encoded long")


@query("""SELECT s_suppkey, ['ec2,instance', 'security_group,security,group', 'vpc,network', 'zebra', 'db,rds'][s_suppkey % 5 + 1] AS words FROM supplier""")
def alias_expansion(spark: SparkSession, sf: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, ["ec2", "security_group", "vpc", "zebra", "db"])), (F.col("s_suppkey") % 5).cast("int"))
    names = F.array_sort(F.array_distinct(catalog.with_aliases(word)))
    order = F.array_distinct(F.concat(F.array(word), F.array_except(catalog.with_aliases(word), F.array(word))))
    return table(spark, sf, "supplier").filter(F.size(names) > 0).select("s_suppkey", F.array_join(order, ",").alias("words"))


@query("""SELECT user_id, bool_and(NOT (value < 20) OR event_type = 'view') AS ok, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) FILTER (WHERE value < 20 AND event_type <> 'view'), '') AS failed FROM events GROUP BY user_id""")
def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the role of stages: views are skipped, small values fail."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("stage"), (F.col("value") >= 20).alias("ok"), (F.col("event_type") == "view").alias("skipped"))
    return requests.verdict(e, ("user_id",)).select("user_id", "ok", F.array_join("failed", ",").alias("failed"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = streaming.tumbling(table(spark, sf, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) - 1 AS rank FROM events GROUP BY user_id, event_type""")
def rank_positions(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("id")).agg(F.count("*").alias("score"))
    return retrieval.ranks(g, ("user_id",)).select("user_id", F.col("id").alias("event_type"), F.col("rank").cast("long"))
