"""What a generator is told about a tree: the module, its contract, precedents and examples, as tables and as one text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname
from ..sources import trees
from . import catalog, compose, index, layout, requests, search

# How much of each part a prompt holds.
CONTRACT_CHARS, SIBLING_CHARS, BLOCK_CHARS, HEAD_CHARS = 4000, 2000, 1200, 3000
PRECEDENTS, BLOCKS, TEMPLATES, SOURCES = 6, 2, 6, 4
DEFAULT_REGION = "ap-south-1"


@dataclass
class Code:
    """A tree of code and what is derived from it."""

    files: DataFrame
    blocks: DataFrame
    edges: DataFrame
    modules: DataFrame

    @classmethod
    def of(cls, files: DataFrame, facts: DataFrame | None = None) -> Code:
        """facts: those of a kept index; without, the texts are parsed once and their facts held as long as there is room."""
        facts = index.parse(files).persist() if facts is None else facts
        blocks, edges = index.blocks(facts), index.edges(facts)
        schema = layout.repo_schemas(files.select(F.lit("").alias("repo"), "file", "text")).first()  # one repository
        return cls(files, blocks, edges, catalog.build(blocks, edges, schema["prefix"] if schema else ""))

    def text(self, file: str) -> str | None:
        row = self.files.filter(F.col("file") == file).select("text").first()
        return None if row is None else row["text"]


@dataclass
class Bundle:
    resource_type: str
    decision: str
    module: dict | None = None
    contract: str = ""
    variables: list[str] = field(default_factory=list)
    precedents: list[dict] = field(default_factory=list)
    templates: list[dict] = field(default_factory=list)
    siblings: list[dict] = field(default_factory=list)
    common: str = ""
    notes: list[str] = field(default_factory=list)


def _guarded(make: Callable[[], list], notes: list[str]) -> list:
    """A search that fails costs its hits, not the request."""
    try:
        return make()
    except Exception as e:  # noqa: BLE001 - the model and reranker are callables handed in
        notes.append(f"search left out: {type(e).__name__}")
        return []


def gather(code: Code, resource_type: str, project: str, provider: str, *, query: str = "", component_dir: str = "", **options: object) -> Bundle:
    """The bundle of one request. All rows taken are few: the best module, a search's hits, two siblings."""
    b = Bundle(resource_type, "net-new")
    module = requests.find_module(code.modules, resource_type).first()
    if query:
        hits = _guarded(lambda: [r.asDict() for r in search.search_and_expand(search.build_chunks(code.files, code.blocks, code.edges), code.files, code.edges, query, **options).collect()], b.notes)
        b.precedents = [h for h in hits if h["reason"] == "retrieved"]
        b.templates = [h for h in hits if h["reason"] in ("dep:template", "dep:module_source")]
        if module is None and b.precedents:
            ranked = code.files.sparkSession.createDataFrame([(h["file"], k) for k, h in enumerate(b.precedents)], "file string, rank int")
            module = requests.nearest_module(ranked, code.modules, resource_type).first()
            if module is not None:
                b.notes.append(f"module taken from the search: {module['dir']}")
    if module is not None:
        b.decision, b.module = "reuse", module.asDict(recursive=True)
        b.contract = code.text(f"{module['dir']}/variables.tf") or ""
        b.variables = [i["name"] for i in b.module["inputs"]]
    else:
        b.notes.append(f"no module for {resource_type}")
        for h in b.templates[:BLOCKS]:
            h["text"] = (code.text(h["file"]) or "")[:HEAD_CHARS]
    for h in b.precedents[:BLOCKS]:
        lines = (code.text(h["file"]) or "").split("\n")
        h["text"] = "\n".join(lines[h["line_start"] - 1 : h["line_end"]])[:BLOCK_CHARS]
    b.siblings = [r.asDict() for r in trees.siblings(code.files, resource_type, exclude_dir=component_dir).select("file", "text").collect()]
    b.common = code.text(f"{project}/{provider}/common.hcl") or ""
    return b


def prompt(b: Bundle) -> str:
    """The bundle as one text, each part cut to its room."""
    out = [f"resource type: {b.resource_type}", f"decision: {b.decision}"]
    if b.module:
        required = [i["name"] for i in b.module["inputs"] if i["required"]]
        optional = [i["name"] for i in b.module["inputs"] if not i["required"]]
        out += [f"module: {b.module['dir']} (used by {b.module['reuse_count']})", "required inputs: " + (", ".join(required) or "unknown")]
        out += ["optional inputs: " + ", ".join(optional)] if optional else []
    if b.contract:
        out.append("== contract\n" + b.contract[:CONTRACT_CHARS])
    elif b.variables:
        out.append("variables: " + ", ".join(b.variables))
    if b.precedents:
        out.append("== closest precedents\n" + "\n".join(f"{h['symbol']} {h['file']} {h['score']}" for h in b.precedents[:PRECEDENTS]))
    out += [f"== precedent {h['file']}\n{h['text']}" for h in b.precedents[:BLOCKS] if h.get("text")]
    if b.decision == "net-new" and b.templates:
        kinds = [(k, [h for h in b.templates if h["reason"] == f"dep:{k}"][:n]) for k, n in (("template", TEMPLATES), ("module_source", SOURCES))]
        out.append("== what precedents depend on\n" + "\n".join(f"{k} {h['file']}" for k, hs in kinds for h in hs))
        out += [f"== template {h['file']}\n{h['text']}" for h in b.templates if h.get("text")]
    out += [f"== example {s['file']}\n{s['text'][:SIBLING_CHARS]}" for s in b.siblings]
    if b.common:
        out.append("== shared inputs, not to be repeated\n" + b.common[:CONTRACT_CHARS])
    if b.notes:
        out.append("notes: " + "; ".join(b.notes))
    return "\n".join(out)


def resolve_env(components: DataFrame, project: str, provider: str, wanted: str | None, hits: DataFrame | None = None, configs: DataFrame | None = None) -> tuple[str | None, str]:
    """(environment, note): the directory that a word means; of several, the one a hit lies in, else the first; else the word itself.

    configs: (project, env, config_env), the environments' own words."""
    mine = components.filter((F.col("project") == project) & (F.col("provider") == provider)).select("project", "env").distinct()
    there = sorted(r["env"] for r in mine.collect())  # a project's environments
    if not wanted or wanted in there or not there:
        return wanted, ""
    envs = mine.withColumn("config_env", F.lit("")) if configs is None else mine.join(configs, ["project", "env"], "left").withColumn("config_env", F.coalesce("config_env", F.lit("")))
    found = sorted(r["env"] for r in layout.match_env(envs.select("env", "config_env"), wanted).collect())
    if len(found) == 1:
        return found[0], f"environment {wanted} is {found[0]}"
    if found:
        picked = requests.pick_env(hits, found).first() if hits is not None else None
        return (picked["env"] if picked else found[0]), f"environment {wanted} may be any of {', '.join(found)}"
    return wanted, f"no environment {wanted} among {', '.join(there)}"


def missing(files: DataFrame, project: str, provider: str, env: str) -> dict[str, str]:
    """Texts for the files a new project or environment lacks, by path, modelled on those of the tree: an environment's
    config on one of the same project before others, shared inputs on another project's. Accounts are never taken over;
    the tree's own root file is not written."""
    wanted = files.filter(basename(F.col("file")).isin("config.yml", "common.hcl")).select("file", "text", dirname(F.col("file")).alias("dir"))
    p = F.split("dir", "/")
    rows = wanted.select("file", "text", p[0].alias("project"), p[1].alias("provider"), F.get(p, F.lit(2)).alias("env"), basename(F.col("file")).alias("name")).filter(F.col("provider") == provider)
    out: dict[str, str] = {}
    config, common = f"{project}/{provider}/{env}/config.yml", f"{project}/{provider}/common.hcl"
    have = {r["file"] for r in rows.filter(F.col("file").isin(config, common)).select("file").collect()}  # two at most
    if config not in have:
        model = rows.filter((F.col("name") == "config.yml") & F.col("env").isNotNull()).orderBy(F.col("project") != project, "file").first()
        values = files.sparkSession.range(1).select(trees.flat_yaml(F.lit(model["text"])).alias("v")).first()["v"] if model else {}
        out[config] = compose.env_config(values.get("terraform_module", "env"), env, values.get("region", DEFAULT_REGION))
    if common not in have:
        model = rows.filter((F.col("name") == "common.hcl") & (F.col("project") != project)).orderBy("file").first()
        text = model["text"] if model else "inputs = {\n}\n"
        out[common] = re.sub(r'(?m)^(\s*account_id\s*=\s*).*$', r'\1"TODO"', text)
    return out


def from_text(code: Code, text: str, read_intent: Callable[[str], dict], *, provider: str = "aws", plan_edits: Callable | None = None, generate: Callable[[str], str] | None = None) -> list[tuple[str, compose.Composed]]:
    """(path, result) of each component that a request asks for: one for each type of the tree that it names.

    read_intent turns the request into a raw intent. A change of a type the tree doesn't have goes to the type it names;
    environments are matched to directories; new components start from the one the request refers to."""
    intent = compose.normalise_intent(read_intent(text), text)
    components = trees.components(code.files)
    project, primary = intent["project"] or "", intent["resource_type"] or ""
    types = [r["component"] for r in requests.named_types(components.select("component"), text, primary or None).collect()] or [""]
    if intent["operation"] != "create" and primary:
        types = [requests.real_type(components.select("component"), text, primary).first()["component"]]
    env, note = resolve_env(components, project, provider, intent["env"])
    out = []
    for kind in types:
        mine = intent | {"resource_type": kind or None, "env": env, "specifics": dict(intent["specifics"])}
        here = components.filter((F.col("project") == project) & (F.col("env") == (env or "")) & (F.col("component") == kind)).select("file", "text").first()
        module = requests.find_module(code.modules, kind).first()
        contract = {i["name"]: i["type"] for i in module["inputs"]} if module else {}
        said = mine["reference"] or {}
        like = None
        if here is None and mine["operation"] == "create":
            none = code.files.sparkSession.createDataFrame([], "file string, rank int")
            like = requests.reference(components, none, project=said.get("project") or project, provider=provider, component=said.get("component") or kind, env=said.get("env")).first()
        done = compose.compose(mine, here["text"] if here else None, contract, reference=(code.text(like["file"]) or "") if like else "", plan_edits=plan_edits, generate=generate)
        done.notes += [note] if note else []
        path = code.files.sparkSession.range(1).select(layout.component_path(F.lit(project), F.lit(provider), F.lit(env or ""), F.lit(kind)).alias("p")).first()["p"]
        out.append((here["file"] if here else f"{path}/inputs.hcl", done))
    return out
