"""Composing a component: intent, guards, the deterministic edit leg, rendering. The model is a callable handed in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import hcl
from ..functions.text import OPERATION_HINTS

# What an intent says.
INTENT_KEYS = ("resource_type", "project", "env", "name", "region", "specifics", "reference", "notes", "operation")
OPERATIONS = ("create", "update", "add", "modify", "delete")


def operation_of(text: str) -> str:
    low = (text or "").lower()
    return next((op for op, hints in OPERATION_HINTS if any(h in low for h in hints)), "create")


def normalise_intent(raw: dict, text: str) -> dict:
    """All keys, empty ones None; the type a slug; specifics an object; the operation one of the known."""
    out = {k: raw.get(k) if raw.get(k) not in ("", [], {}) else None for k in INTENT_KEYS}
    if out["resource_type"]:
        out["resource_type"] = re.sub(r"[\s-]+", "_", str(out["resource_type"]).strip().lower())
    out["specifics"] = out["specifics"] if isinstance(out["specifics"], dict) else {}
    out["reference"] = out["reference"] if isinstance(out["reference"], dict) and any(out["reference"].values()) else None
    op = str(out["operation"] or "").strip().lower()
    out["operation"] = op if op in OPERATIONS else operation_of(text)
    return out


def parse_json(answer: str) -> dict:
    """An object out of a model's answer, with or without a code fence."""
    bare = re.sub(r"^```\w*\s*|\s*```$", "", answer.strip())
    found = json.loads(bare)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def missing_fields(intent: dict) -> list[str]:
    return [k for k in ("resource_type", "project", "env") if not intent.get(k)]


def is_ambiguous(intent: dict) -> bool:
    """A change that says neither what nor where."""
    if intent["operation"] == "create":
        return False
    return not intent.get("resource_type") and not intent.get("reference") or not (intent.get("specifics") or intent.get("name"))


@dataclass
class Composed:
    text: str
    refused: str = ""
    changed: bool = False
    notes: list[str] = field(default_factory=list)


def compose(intent: dict, base: str | None, contract: dict[str, str], *, reference: str = "", plan_edits: Callable[[str, dict], list[dict]] | None = None, generate: Callable[[str], str] | None = None) -> Composed:
    """The text of a component.

    Changes need the component to be there. Declared scalars of an update are set without a model; what is left goes to
    plan_edits, whose edits of an `add` are kept only if they add; all are verified by reading back. Without a base, the
    reference is taken, or generate is asked; an answer that is structurally broken is refused.
    """
    if is_ambiguous(intent):
        return Composed(base or "", refused="ambiguous request")
    change = intent["operation"] != "create"
    if change and base is None:
        return Composed("", refused="the component does not exist")
    start = base if base is not None else reference
    if not start:
        if generate is None:
            return Composed("", refused="nothing to start from")
        start = re.sub(r"^```\w*\n|\n?```\s*$", "", generate(json.dumps(intent, sort_keys=True)).strip()) + "\n"
    notes: list[str] = []
    edits: list[dict] = []
    left = dict(intent["specifics"])
    if intent["operation"] != "add":
        for k in [k for k in left if k in contract and contract[k] in ("string", "number", "bool")]:
            edits.append({"path": k, "op": "set", "value": hcl.coerce(left.pop(k), contract[k])})
    if left and plan_edits is not None:
        more = plan_edits(start, left)
        dropped = [e for e in more if intent["operation"] == "add" and e.get("op") != "add"]
        notes += [f"dropped {e.get('op')} of {e['path']}" for e in dropped]
        edits += [e for e in more if e not in dropped]
    elif left:
        notes.append("not applied: " + ", ".join(sorted(left)))
    text, results = hcl.apply_edits(start, edits)
    notes += [f"{r['path']}: {r['error']}" for r in results if not r["ok"]]
    notes += [f"{v['path']}: not there after the edit" for v, r in zip(hcl.verify_edits(text, edits), results, strict=True) if r["ok"] and not v["ok"]]
    if found := hcl.problems(text):
        return Composed(start, refused=found[0], notes=notes)
    return Composed(text, changed=text != (base or ""), notes=notes)


def module_call(name: str, source: str, inputs: list[dict], values: dict) -> str:
    """A module block: given values, and a placeholder for each required input without one."""
    lines = [f"  source = {json.dumps(source)}"]
    for i in inputs:
        if i["name"] in values:
            lines.append(f"  {i['name']} = {hcl.render(values[i['name']], 1)}")
        elif i["required"]:
            lines.append(f"  {i['name']} = {placeholder(i.get('type') or '')} # TODO")
    return f'module "{name}" {{\n' + "\n".join(lines) + "\n}\n"


def placeholder(declared: str) -> str:
    for start, value in (("bool", "false"), ("number", "0"), ("list", "[]"), ("set", "[]"), ("map", "{}"), ("object", "{}")):
        if declared.startswith(start):
            return value
    return '""'


def module_scaffold(resource_type: str, name: str) -> dict[str, str]:
    return {
        "main.tf": f'resource "{resource_type}" "{name}" {{\n  # TODO\n}}\n',
        "variables.tf": 'variable "name" {\n  type = string\n}\n',
        "outputs.tf": f'output "id" {{\n  value = {resource_type}.{name}.id\n}}\n',
    }


def env_config(module: str, env: str, region: str) -> str:
    """An environment's config; its account is never guessed."""
    return f"terraform_module: {module}\nenvironment: {env}\nregion: {region}\naccount_id: TODO\n"
