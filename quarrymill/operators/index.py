"""Symbols and dependency edges of code files, and the lookups over them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructType

from ..functions import hcl
from ..functions.text import basename, dirname, resolve_relative

# Block types that are symbols under their own name at the top level, and nested ones that are.
TOP_KINDS = ("resource", "module", "variable", "output", "data", "locals", "provider", "terraform", "include", "dependency", "generate", "remote_state", "inputs", "dependencies")
NESTED_KINDS = ("dynamic", "ingress", "egress", "lifecycle", "provisioner", "connection", "timeouts", "setting", "filter", "content", "root_block_device", "ebs_block_device", "network_interface")

# Patterns of references.
SOURCE = r'source\s*=\s*"([^"]+)"'
INCLUDE_PATH = r"path\s*=\s*([^\n]+)"
CONFIG_PATH = r'config_path\s*=\s*"([^"]+)"'
VAR = r"\bvar\.([A-Za-z_][\w-]*)"
REMOTE_STATE = r'module\.remote_state\.components\[\s*var\.upstream_modules\.([A-Za-z_][\w-]*)\s*\]\s*\[\s*"([^"]+)"\s*\]'
MODULE_OUTPUT = r"\bmodule\.([A-Za-z_][\w-]*)\.([A-Za-z_][\w-]*)"
DEPENDENCY_OUTPUT = r"\bdependency\.([A-Za-z_][\w-]*)\.outputs\.([A-Za-z_][\w-]*)"
TOOL_CALLS = r"\b(find_in_parent_folders|read_terragrunt_config|path_relative_to_include|path_relative_from_include|get_repo_root|get_terragrunt_dir|get_parent_terragrunt_dir)\s*\("

#: Tasks for each core that parse.
SPREAD = 4
#: Bytes of texts that are parsed together, of equal ones one (a longer text is alone), and facts that leave a task together.
FOLD_BYTES, FACT_ROWS = 2_000_000, 2_000

#: One row per file, per block and per reference; what a kind of row doesn't have is null.
FACTS = (
    "file string, fact string, file_hash string, block_id int, parent_id int, depth int, type string, labels array<string>, header string, line_start int, line_end int, char_start int, body string, "
    "parent_type string, parent_labels array<string>, edge_type string, module string, output string, raw string"
)
_BLOCK = ("file", "block_id", "parent_id", "depth", "type", "labels", "header", "line_start", "line_end", "char_start", "body", "parent_type", "parent_labels")
_EDGE = ("file", "edge_type", "module", "name", "output", "line")


#: What each reference pattern means: its edge type, and which groups name the module and the output. Last, what a text without
#: which there is none must hold.
REFERENCES = (
    ("remote_state", REMOTE_STATE, 2, "module.remote_state."),
    ("var_ref", VAR, None, "var."),
    ("output_ref", MODULE_OUTPUT, 2, "module."),
    ("output_ref", DEPENDENCY_OUTPUT, 2, "dependency."),
    ("terragrunt", TOOL_CALLS, None, "("),
)


def _facts_of(text: str) -> Iterator[dict]:
    """The rows of one text. Bodies have comments blanked; references stand in the text itself, wherever lines end."""
    yield {"fact": "file", "file_hash": hashlib.md5(text.encode()).hexdigest()}
    pieces = list(hcl.scan(text))
    clean = hcl.blank_comments(text, pieces)
    found = hcl.blocks(text, pieces)
    for b in found:
        up = found[b.parent_id] if b.parent_id is not None else None
        own = {"block_id": b.block_id, "parent_id": b.parent_id, "depth": b.depth, "type": b.type, "labels": b.labels, "header": b.header, "line_start": b.line_start, "line_end": b.line_end}
        yield own | {"fact": "block", "char_start": b.char_start, "body": clean[b.body_start : b.body_end], "parent_type": up and up.type, "parent_labels": up and up.labels}
    ends = [m.start() for m in re.finditer("\n", clean)]
    for kind, pattern, output, held in REFERENCES:
        for m in re.finditer(pattern, clean) if held in clean else ():
            if kind != "output_ref" or not m.group().startswith("module.remote_state."):
                raw = m.group() + ")" * (kind == "terragrunt")
                yield {"fact": "reference", "edge_type": kind, "module": m[1], "output": m[output] if output else None, "line_start": bisect_left(ends, m.start()) + 1, "raw": raw, "char_start": m.start()}


def _facts_of_all(files: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of (file, text, ...), file by file, each with what stands beside its text. Nothing but the path tells the facts
    of equal texts apart, so a text is parsed once."""
    texts = pc.dictionary_encode(pc.fill_null(files.column(1), ""))
    parsed, sizes = [], []
    for text in texts.dictionary:
        rows = list(_facts_of(text.as_py()))
        parsed += rows
        sizes.append(len(rows))
    beside = files.select([n for n in files.schema.names if n != "text"])
    facts = pa.RecordBatch.from_pylist(parsed, schema=pa.schema([f for f in schema if f.name not in beside.schema.names]))
    which = texts.indices.to_numpy()
    sizes = np.array(sizes, dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes[which]
    owner = np.repeat(np.arange(len(which)), n)
    place = np.arange(len(owner)) + np.repeat(begins[which] - (np.cumsum(n) - n), n)
    for k in range(0, len(owner), FACT_ROWS):
        of, at = beside.take(pa.array(owner[k : k + FACT_ROWS])), facts.take(pa.array(place[k : k + FACT_ROWS]))
        yield pa.RecordBatch.from_arrays([(of if f.name in of.schema.names else at).column(f.name).cast(f.type) for f in schema], schema=schema)


def parse(files: DataFrame, carry: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """FACTS of (file, text): the one pass over the texts that needs Python; everything else is read off these rows.
    Columns named in carry stand beside every fact of their file. Files are dealt by path first, to a number of tasks that
    adaptive execution leaves alone: a split of a few MB can hold texts that take minutes to parse. A task streams its texts,
    a few MB at a time, of which equal ones are parsed once. Without deal, files have been dealt."""
    facts = files.sparkSession.createDataFrame([], FACTS).schema
    out = StructType([*facts.fields, *(files.schema[c] for c in carry)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            share = np.cumsum(sizes) // FOLD_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if end > begin:
                    yield from _facts_of_all(batch.slice(begin, end - begin), schema)

    files = files.select("file", "text", *carry)
    if deal:
        files = files.repartition(SPREAD * files.sparkSession.sparkContext.defaultParallelism, "file")
    return files.mapInArrow(run, out)


def blocks(facts: DataFrame) -> DataFrame:
    """One row per block, with its body and what its parent is."""
    return facts.filter("fact = 'block'").select(*_BLOCK)


def parse_blocks(files: DataFrame) -> DataFrame:
    return blocks(parse(files))


@F.pandas_udf(BooleanType())
def sound(texts: pd.Series) -> pd.Series:
    """Whether texts have no structural problem."""
    return texts.map(lambda t: not hcl.problems(t or ""))


def symbol_name(prefix: str = "") -> Column:
    kind, labels = F.col(f"{prefix}type"), F.col(f"{prefix}labels")
    two = kind.isin("resource", "data") & (F.size(labels) >= 2)
    return F.when(two, F.concat_ws(".", labels[0], labels[1])).when(F.size(labels) > 0, labels[0]).otherwise(kind)


def symbols(blocks: DataFrame) -> DataFrame:
    """(file, name, kind, line_start, line_end, signature, parent): nested blocks of unlisted types are of kind block."""
    kind = F.when(F.col("depth") == 0, F.col("type")).when(F.col("type").isin(*NESTED_KINDS), F.col("type")).otherwise("block")
    parent = F.when(F.col("parent_id").isNotNull(), symbol_name("parent_"))
    return blocks.select("file", symbol_name().alias("name"), kind.alias("kind"), "line_start", "line_end", F.col("header").alias("signature"), parent.alias("parent"))


def edge_of(strict: bool = False, only: tuple[str, ...] = ()) -> Column:
    """The edge that a row of facts is, with where it stands (pos), or null; of some types only if they are named."""
    null, fact, kind, kind_of = F.lit(None).cast("string"), F.col("fact"), F.col("type"), F.col("edge_type")
    pattern = r'(?m)^\s*source\s*=\s*"([^"]+)"' if strict else SOURCE
    body, label = F.col("body"), F.coalesce(F.get("labels", F.lit(0)), F.lit(""))
    found = lambda p, group: F.nullif(F.trim(F.regexp_extract("body", p, group)), F.lit(""))

    def edge(edge_type: Column, module: Column, name: Column, raw: Column, target: Column, output: Column = null, line: Column | None = None, pos: Column | None = None) -> Column:
        line, pos = F.col("line_start") if line is None else line, F.col("char_start") if pos is None else pos
        return F.struct(edge_type.alias("edge_type"), module.alias("module"), name.alias("name"), output.alias("output"), line.cast("int").alias("line"), raw.alias("raw"), target.alias("target_file"), pos.alias("pos"))

    said, there, inputs, tool = F.regexp_extract("body", pattern, 1), F.nullif(resolve_relative(F.col("file"), F.regexp_extract("body", CONFIG_PATH, 1)), F.lit("")), F.lit("inputs.hcl"), F.lit("terragrunt")
    key = resolve_relative(F.col("file"), said)
    # what a row must be is told without a look at its body
    block = fact == "block"
    tried = (
        (("remote_state", "var_ref", "output_ref", "terragrunt"), (fact == "reference") & (kind_of.isin(*only) if only else F.lit(True)), edge(kind_of, F.col("module"), F.col("module"), F.col("raw"), null, F.col("output"))),
        (("module_source",), block & kind.isin("module", "terraform"), F.when(body.rlike(pattern), edge(F.lit("module_source"), key, symbol_name(), said, key))),
        (("terragrunt",), block & (kind == "include"), edge(tool, F.lit("include"), label, F.coalesce(found(SOURCE, 0), found(INCLUDE_PATH, 0), F.lit("include")), null)),
        (("terragrunt",), block & (kind == "dependency"), edge(tool, F.coalesce(there, F.lit("dependency")), label, F.coalesce(found(CONFIG_PATH, 0), F.lit("dependency")), there)),
        (("terragrunt",), (fact == "file") & (basename(F.col("file")) == inputs), edge(tool, inputs, inputs, inputs, null, line=F.lit(1), pos=F.lit(0))),
    )
    return F.coalesce(*(F.when(row, made) for types, row, made in tried if not only or set(types) & set(only)))


def edges(facts: DataFrame, *, strict: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """(file, edge_type, module, name, output, line, raw, target_file), one row for each of the first six.

    Types: module_source, remote_state, var_ref, output_ref, terragrunt. A module's source is the first `source = "..."`
    in its block, wherever it stands; with strict, `data_source = ...` and the like don't count. A reference names what it
    refers to as module and as name; raw is the code it was read from (of repeated rows, the first), target_file a resolved
    path. An include and a dependency without a path name themselves as module; inputs.hcl files get a row as such. A row
    of facts is one edge at most, so this is one pass. Edges of a few types are asked for by only: all else is left out of
    the expression, which is long enough for the JVM to leave it uncompiled.
    """
    e = edge_of(strict, only)
    rows = facts.select("file", e.alias("e")).filter("e is not null").select("file", "e.*")
    return rows.groupBy(*_EDGE).agg(F.min(F.struct("pos", "raw", "target_file")).alias("best")).select(*_EDGE, "best.raw", "best.target_file")


def find_symbol(table: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name or signature holds the query, in any case; the query has no wildcards."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.contains(F.lower("signature"), q)
    return table.filter(hit if kind is None else hit & (F.col("kind") == kind))


def importers(edge_table: DataFrame) -> DataFrame:
    """(module, files) of every imported module."""
    return edge_table.filter("edge_type = 'module_source'").groupBy("module").agg(F.array_sort(F.collect_set("file")).alias("files"))


def _importing(edge_table: DataFrame, names: list[str]) -> DataFrame:
    """(name, file) of the files that import any of a few names: by the exact key or, only for names that are no key, where
    the last part of a key is the name as given. One plan: the tier is a column."""
    rows = edge_table.filter("edge_type = 'module_source'").select("file", "module")
    asked = F.explode(F.array(*map(F.lit, names))).alias("name")
    rows = rows.select("file", "module", asked).withColumn("tier", F.when(F.col("module") == F.col("name"), 0).when(basename(F.col("module")) == F.col("name"), 1)).filter("tier is not null")
    best = rows.groupBy("name").agg(F.min("tier").alias("best"))
    return rows.join(F.broadcast(best), "name").filter("tier = best").select("name", "file").distinct()  # as many rows as names


def find_importers(edge_table: DataFrame, name: str) -> DataFrame:
    """(file) that import a module: by its exact key or, only if there is none, by the last part of keys, which a name with slashes never is."""
    return _importing(edge_table, [name]).select("file")


def related(edge_table: DataFrame, file: str) -> DataFrame:
    """(how, file, edge_type, module, name, output, line): every edge out of a file, and what imports the directory it is
    in, one hop; file is the other end, as far as it is one."""
    there = file.rsplit("/", 1)[0].strip("/") if "/" in file else ""
    out = edge_table.filter(F.col("file") == file).select(F.lit("imports").alias("how"), "target_file", "edge_type", "module", "name", "output", "line").withColumnRenamed("target_file", "file")
    null = F.lit(None).cast("string")
    by = _importing(edge_table, sorted({there, there.rsplit("/", 1)[-1]})).select("file").distinct()
    back = by.select(F.lit("importer").alias("how"), "file", F.lit("module_source").alias("edge_type"), F.lit(there).alias("module"), null.alias("name"), null.alias("output"), F.lit(None).cast("int").alias("line"))
    return out.unionByName(back)


def normalise_key(files: DataFrame, path: str, root: str = "") -> DataFrame:
    """(file): a path as given, relative to the root, or the first file that ends with it."""
    relative = path[len(root) :].lstrip("/") if root and path.startswith(root) else path
    tier = F.when(F.col("file") == path, 0).when(F.col("file") == relative, 1).when(F.endswith("file", F.lit(path)), 2)
    return files.select("file").withColumn("tier", tier).filter("tier is not null").orderBy("tier", "file").limit(1).select("file")


def module_dirs(symbol_table: DataFrame) -> DataFrame:
    return symbol_table.filter(F.col("file").endswith(".tf") & F.col("kind").isin("resource", "variable", "data")).select(dirname(F.col("file")).alias("dir")).distinct()


def longest_prefix(files: DataFrame, owners: DataFrame, owner_col: str = "dir") -> DataFrame:
    """(file, owner): the deepest directory of owners above each file, by an equi-join on ancestors."""
    from ..functions.text import ancestors

    up = files.select("file", F.explode(ancestors(F.col("file"))).alias("owner"))
    return up.join(owners.select(F.col(owner_col).alias("owner")).distinct(), "owner").groupBy("file").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def refresh(old: DataFrame, new: DataFrame, paths: DataFrame, key: str = "file") -> DataFrame:
    """A table with the rows of the named paths replaced by what is there now; paths without new rows vanish."""
    return old.join(paths.select(key).distinct(), key, "left_anti").unionByName(new.join(paths.select(key).distinct(), key, "left_semi"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
