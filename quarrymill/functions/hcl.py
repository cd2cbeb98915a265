"""HCL: a scanner, blocks, structural problems, attribute values and byte-exact edits.

Everything rests on one scanner that cuts a text into comments, strings, heredocs, words, signs and line ends; the block
finder, the checker and the value reader are three small consumers of it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

_CLOSER = {"{": "}", "[": "]", "(": ")"}
#: What stands at a place after blanks, by number of its group; strings with escapes or interpolations begin as quotes.
_TOKEN = re.compile(
    r'[^\S\n]*(?:(\n)|([A-Za-z_][\w-]*)|("[^"\\\n$%]*")|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(#[^\n]*|//[^\n]*)|(/\*)|(")|<<-?([A-Za-z_]\w*)[ \t]*\r?\n|([^\s]))'
)
_KINDS = ("", "line", "word", "string", "number", "comment", "", "", "", "sign")


class Piece(NamedTuple):
    kind: str  # comment, string, heredoc, word, number, sign, line; open_* where the end is missing
    start: int
    end: int


def _string_end(text: str, at: int) -> int:
    """The place after the quote that closes the string opened at `at`, or -1. Interpolations may hold strings."""
    k = at + 1
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
        elif c == '"':
            return k + 1
        elif c == "\n":
            return -1
        elif c in "$%" and text.startswith("{", k + 1):
            k = _interpolation_end(text, k + 2)
            if k < 0:
                return -1
        else:
            k += 1
    return -1


def _interpolation_end(text: str, k: int) -> int:
    depth = 1
    while k < len(text):
        c = text[k]
        if c == '"':
            k = _string_end(text, k)
            if k < 0:
                return -1
            continue
        depth += (c == "{") - (c == "}")
        k += 1
        if not depth:
            return k
    return -1


def scan(text: str) -> Iterator[Piece]:
    line = text.rfind("\n") + 1
    last = line + len(text[line:].rstrip())  # blanks at the end are no piece, and a search would try each of them
    new, kinds, k = tuple.__new__, _KINDS, 0
    while k < last:
        for m in _TOKEN.finditer(text, k):
            what = m.lastindex
            start, k = m.span(what)
            if what <= 5 or what == 9:
                yield new(Piece, (kinds[what], start, k))
                if k < last:
                    continue
                return
            # what may end elsewhere than its match; the search goes on from there
            if what == 6:
                end = text.find("*/", k)
                k = len(text) if end < 0 else end + 2
                yield Piece("open_comment" if end < 0 else "comment", start, k)
            elif what == 7:
                end = _string_end(text, start)
                if end < 0:
                    line = text.find("\n", start)
                    k = len(text) if line < 0 else line
                else:
                    k = end
                yield Piece("open_string" if end < 0 else "string", start, k)
            else:
                k = m.end()
                close = re.compile(rf"^[ \t]*{m[8]}[ \t]*\r?$", re.M).search(text, k)
                k = close.end() if close else len(text)
                yield Piece("heredoc" if close else "open_heredoc", text.rfind("<<", 0, start), k)
            break


def problems(text: str) -> list[str]:
    """What is structurally wrong, in order; an empty list for a sound text."""
    out: list[str] = []
    stack: list[tuple[str, int]] = []

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    for p in scan(text):
        if p.kind.startswith("open_"):
            out.append(f"line {line(p.start)}: unterminated {p.kind[5:]}")
        elif p.kind == "sign":
            c = text[p.start]
            if c in _CLOSER:
                stack.append((c, p.start))
            elif c in "}])":
                if not stack:
                    out.append(f"line {line(p.start)}: stray {c}")
                elif _CLOSER[stack[-1][0]] != c:
                    out.append(f"line {line(p.start)}: {c} closes {stack.pop()[0]}")
                else:
                    stack.pop()
    return out + [f"line {line(at)}: unclosed {c}" for c, at in stack]


def blank_comments(text: str, pieces: Iterable[Piece] | None = None) -> str:
    """The text with comments blanked; lengths and lines stay. A text's pieces may be handed in."""
    out, last = [], 0
    for p in scan(text) if pieces is None else pieces:
        if p.kind in ("comment", "open_comment"):
            out += [text[last : p.start], re.sub(r"[^\n]", " ", text[p.start : p.end])]
            last = p.end
    return "".join(out) + text[last:]


@dataclass
class Block:
    block_id: int
    parent_id: int | None
    depth: int
    type: str
    labels: list[str]
    line_start: int
    line_end: int
    char_start: int
    body_start: int
    body_end: int

    @property
    def header(self) -> str:
        return " ".join([self.type, *(f'"{x}"' for x in self.labels)])


def blocks(text: str, pieces: Iterable[Piece] | None = None) -> list[Block]:
    """All blocks in order of their beginnings; braces of object values are no blocks. An unclosed block ends with the text.
    A text's pieces may be handed in."""
    out: list[Block] = []
    line, counted = 1, 0  # of the place up to which lines were counted
    stack: list[Block | None] = []  # None: an object, list or call
    head: list[tuple[str, int, int]] = []
    assigned = inside_value = False
    for kind, start, end in scan(text) if pieces is None else pieces:
        if kind == "line":
            if not inside_value:
                if head:
                    head = []
                assigned = False
        elif kind != "sign":
            if not inside_value and (kind == "word" or kind == "string"):
                head.append((kind, start, end))
        elif (c := text[start]) in "{[(":
            if c == "{" and not inside_value and not assigned and head and head[0][0] == "word":
                parent = stack[-1] if stack else None  # no value is open
                labels = [text[at:to].strip('"') for _, at, to in head[1:]]
                _, at, to = head[0]
                line, counted = line + text.count("\n", counted, at), at
                b = Block(len(out), parent.block_id if parent else None, parent.depth + 1 if parent else 0, text[at:to], labels, line, 0, at, end, len(text))
                out.append(b)
                stack.append(b)
                head = []
            else:
                stack.append(None)
                inside_value = True
        elif c in "}])":
            if stack:
                b = stack.pop()
                inside_value = bool(stack) and stack[-1] is None
                if b is not None:
                    line, counted = line + text.count("\n", counted, start), start
                    b.body_end, b.line_end = start, line
                    head, assigned = [], False
        elif c == "=" and not inside_value:
            assigned = True
    for b in stack:
        if b is not None:
            b.line_end = text.count("\n") + 1
    return out


# ---------------------------------------------------------------------------------------------------------------
# Values and edits


@dataclass
class Node:
    """A value with its place: kind is object, list, string, number, bool, null or raw."""

    kind: str
    start: int
    end: int
    value: object = None
    fields: dict[str, Node] = field(default_factory=dict)
    items: list[Node] = field(default_factory=list)
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)  # of whole entries, by field


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = text
        self.pieces = [p for p in scan(text) if p.kind != "comment"]
        self.signs = [text[start] if kind == "sign" else "" for kind, start, _ in self.pieces] + [""]
        self.at = 0

    def sign(self) -> str:
        return self.signs[self.at]

    def skip_lines(self) -> None:
        while self.at < len(self.pieces) and (self.pieces[self.at].kind == "line" or self.signs[self.at] == ","):
            self.at += 1

    def body(self, start: int, closing: str) -> Node:
        """Entries up to the closing sign (or the text's end); blocks within count as objects of their type."""
        node = Node("object", start, len(self.text))
        while True:
            self.skip_lines()
            if self.at >= len(self.pieces):
                return node
            if closing and self.sign() == closing:
                node.end = self.pieces[self.at].end
                self.at += 1
                return node
            key = self.pieces[self.at]
            if key.kind not in ("word", "string"):
                self.at += 1
                continue
            name = self.text[key.start : key.end].strip('"')
            self.at += 1
            while self.at < len(self.pieces) and self.pieces[self.at].kind in ("word", "string"):
                name += "." + self.text[self.pieces[self.at].start : self.pieces[self.at].end].strip('"')
                self.at += 1
            if self.sign() in ("=", ":"):
                self.at += 1
                value = self.value()
            elif self.sign() == "{":
                begin = self.pieces[self.at].start
                self.at += 1
                value = self.body(begin, "}")
            else:
                continue
            node.fields[name] = value
            node.spans[name] = (key.start, value.end)

    def value(self) -> Node:
        if self.at >= len(self.pieces):
            return Node("raw", len(self.text), len(self.text), "")
        first = self.at
        p = self.pieces[first]
        if self.sign() == "{":
            self.at += 1
            node = self.body(p.start, "}")
        elif self.sign() == "[":
            self.at += 1
            node = Node("list", p.start, len(self.text))
            while True:
                self.skip_lines()
                if self.at >= len(self.pieces):
                    break
                if self.sign() == "]":
                    node.end = self.pieces[self.at].end
                    self.at += 1
                    break
                before = self.at
                node.items.append(self.value())
                self.at += self.at == before
        else:
            raw = self.text[p.start : p.end]
            self.at += 1
            node = Node("raw", p.start, p.end, raw)
            if p.kind == "string" and "${" not in raw:
                node = Node("string", p.start, p.end, raw[1:-1])
            elif p.kind == "number":
                node = Node("number", p.start, p.end, float(raw) if re.search(r"[.eE]", raw) else int(raw))
            elif raw in ("true", "false"):
                node = Node("bool", p.start, p.end, raw == "true")
            elif raw == "null":
                node = Node("null", p.start, p.end)
        depth, end = 0, node.end
        while self.at < len(self.pieces):  # an expression goes on to the line's end, a comma or a closing sign
            c = self.signs[self.at]
            if not depth and (self.pieces[self.at].kind == "line" or c in (",", "}", "]", ")")):
                break
            if c:
                depth += (c in "([{") - (c in ")]}")
            end = self.pieces[self.at].end
            self.at += 1
        return node if end == node.end else Node("raw", node.start, end, self.text[node.start : end])


def read_tree(text: str) -> Node:
    return _Reader(text).body(0, "")


def plain(node: Node) -> object:
    if node.kind == "object":
        return {k: plain(v) for k, v in node.fields.items()}
    return [plain(x) for x in node.items] if node.kind == "list" else node.value


def as_text(node: Node) -> str:
    if node.kind == "bool":
        return "true" if node.value else "false"
    if node.kind in ("object", "list"):
        return json.dumps(plain(node), sort_keys=True)
    return "" if node.value is None else str(node.value)


def flatten(node: Node, prefix: str = "") -> dict[str, str]:
    """All values by dotted and indexed path, containers too."""
    out: dict[str, str] = {}
    for k, v in node.fields.items():
        path = f"{prefix}.{k}" if prefix else k
        out[path] = as_text(v)
        out |= flatten(v, path)
    for k, v in enumerate(node.items):
        path = f"{prefix}[{k}]"
        out[path] = as_text(v)
        out |= flatten(v, path)
    return out


def read_values(text: str) -> dict[str, str]:
    """The values of an inputs object, or of the top level where there is none."""
    tree = read_tree(text)
    return flatten(tree.fields["inputs"] if "inputs" in tree.fields else tree)


def top_scalars(text: str) -> dict[str, str]:
    return {k: as_text(v) for k, v in read_tree(text).fields.items() if v.kind in ("string", "number", "bool")}


def render(value: object, indent: int = 0) -> str:
    """A JSON-like value as HCL."""
    pad = "  " * (indent + 1)
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, dict):
        return "{\n" + "".join(f"{pad}{k} = {render(v, indent + 1)}\n" for k, v in value.items()) + "  " * indent + "}" if value else "{}"
    if isinstance(value, list):
        return "[\n" + "".join(f"{pad}{render(v, indent + 1)},\n" for v in value) + "  " * indent + "]" if any(isinstance(v, (dict, list)) for v in value) else "[" + ", ".join(render(v) for v in value) + "]"
    return json.dumps(str(value), ensure_ascii=False).replace('\\"${', '"${')


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def find(tree: Node, path: str) -> tuple[Node | None, Node | None, str | int]:
    """(node, container, last step) of a dotted and indexed path; inputs are looked into if the path is not found above."""
    steps = [int(i) if i else k for k, i in _STEP.findall(path)]

    def walk(node: Node) -> tuple[Node | None, Node | None, str | int]:
        parent: Node | None = None
        here: Node | None = node
        for s in steps:
            parent = here
            if here is None:
                return None, None, s
            here = here.fields.get(s) if isinstance(s, str) else here.items[s] if s < len(here.items) else None
        return here, parent, steps[-1]

    if not steps:
        return tree, None, ""
    got = walk(tree)
    if got[0] is None and "inputs" in tree.fields:
        inner = walk(tree.fields["inputs"])
        if inner[0] is not None or inner[1] is not None:
            return inner
    return got


def _whole_line(text: str, start: int, end: int) -> tuple[int, int]:
    """A span with its comma, and its line if nothing else stands there."""
    after = re.compile(r"[ \t]*,?[ \t]*").match(text, end).end()
    line = text.rfind("\n", 0, start) + 1
    if not text[line:start].strip() and (after >= len(text) or text[after] == "\n"):
        return line, min(after + 1, len(text))
    return start, after


def _matches(node: Node, match: dict) -> bool:
    return all(k in node.fields and as_text(node.fields[k]) == (str(v).lower() if isinstance(v, bool) else str(v)) for k, v in match.items())


def apply_edit(text: str, edit: dict, tree: Node | None = None) -> tuple[str, str]:
    """(text, error) of one edit {path, op: set | add | remove, value | index | match}; other bytes stay as they are. A text's
    tree may be handed in."""
    tree = read_tree(text) if tree is None else tree
    path, op = edit["path"], edit.get("op", "set")
    node, parent, last = find(tree, path)
    if op == "set":
        if node is not None and parent is not None:
            return text[: node.start] + render(edit.get("value"), text.count("  ", text.rfind("\n", 0, node.start) + 1, node.start) and 1) + text[node.end :], ""
        if parent is None or parent.kind != "object" or not isinstance(last, str):
            return text, f"no such path: {path}"
        line = f"{last} = {render(edit.get('value'), 1)}\n"
        if parent is tree:
            return text + ("" if not text or text.endswith("\n") else "\n") + line, ""
        close = parent.end - 1
        start = text.rfind("\n", 0, close) + 1
        at = start if not text[start:close].strip() else close
        return text[:at] + ("  " if at == start else "\n  ") + line + text[at:], ""
    if node is None:
        return text, f"no such path: {path}"
    if op == "add":
        if node.kind == "list":
            value = render(edit.get("value"))
            if not node.items:
                return text[: node.start] + f"[{value}]" + text[node.end :], ""
            tail = node.items[-1]
            if "\n" in text[node.start : node.items[0].start]:
                line = text.rfind("\n", 0, tail.start) + 1
                pad = text[line : tail.start] if not text[line : tail.start].strip() else "  "
                after = re.compile(r"[ \t]*,").match(text, tail.end)
                return text[: tail.end] + f",\n{pad}{value}" + (text[tail.end :] if after else "," + text[tail.end :]), ""
            return text[: tail.end] + f", {value}" + text[tail.end :], ""
        if node.kind == "object" and isinstance(edit.get("value"), dict):
            for n, (k, v) in enumerate(edit["value"].items()):
                text, error = apply_edit(text, {"path": f"{path}.{k}", "op": "set", "value": v}, None if n else tree)
                if error:
                    return text, error
            return text, ""
        return text, f"cannot add to a {node.kind}: {path}"
    if op == "remove":
        if node.kind == "list" and ("index" in edit or "match" in edit or "value" in edit):
            for k, x in enumerate(node.items):
                if edit.get("index") == k or ("match" in edit and _matches(x, edit["match"])) or ("value" in edit and "index" not in edit and as_text(x) == str(edit["value"])):
                    a, b = _whole_line(text, x.start, x.end)
                    if k and k == len(node.items) - 1 and a == x.start:
                        a = node.items[k - 1].end
                        b = x.end
                    return text[:a] + text[b:], ""
            return text, f"no such element: {path}"
        start = node.start
        if parent is not None and isinstance(last, str) and last in parent.spans:
            start = parent.spans[last][0]
        a, b = _whole_line(text, start, node.end)
        return text[:a] + text[b:], ""
    return text, f"unknown operation: {op}"


def apply_edits(text: str, edits: list[dict]) -> tuple[str, list[dict]]:
    """Edits in turn; an edit that fails is recorded and leaves the text as it was."""
    results = []
    for e in edits:
        text, error = apply_edit(text, e)
        results.append({"path": e["path"], "op": e.get("op", "set"), "ok": not error, "error": error})
    return text, results


def verify_edits(text: str, edits: list[dict], tree: Node | None = None) -> list[dict]:
    """Whether a text shows what each edit asked for, by reading it back. A text's tree may be handed in."""
    tree = read_tree(text) if tree is None else tree
    out = []
    for e in edits:
        node, _, _ = find(tree, e["path"])
        op = e.get("op", "set")
        if op == "set":
            ok = node is not None and plain(node) == e.get("value")
        elif op == "add":
            ok = node is not None and (e.get("value") in plain(node) if node.kind == "list" else node.kind == "object" and e.get("value").items() <= plain(node).items())
        elif "match" in e:
            ok = node is None or not any(_matches(x, e["match"]) for x in node.items)
        elif "value" in e:
            ok = node is None or all(as_text(x) != str(e["value"]) for x in node.items)
        else:
            ok = node is None or "index" in e
        out.append({"path": e["path"], "op": op, "ok": bool(ok)})
    return out


def coerce(value: object, kind: str) -> object:
    """A value as its declared type asks, of which the beginning counts: bool, number or string. A bool is true, 1 or yes
    and else false; a number without a fraction is whole; what is no number, and values of other types, stay."""
    said = (kind or "").lower()
    if said.startswith("bool"):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes")
    if (said.startswith("number") or said in ("int", "integer", "float")) and not isinstance(value, bool):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return value
        return int(number) if number.is_integer() else number
    if said.startswith("string") and not isinstance(value, str):
        return str(value)
    return value


_VISIBLE = re.compile(r'\\.|"(?:\\.|[^"\\])*"?|/\*|//|[#{}]', re.S)
_IN_COMMENT = re.compile(r'\\.|"(?:\\.|[^"\\])*"?|\*/', re.S)


def depth_change(line: str) -> int:
    """How many braces a line opens, less those it closes. Each line stands for itself: a comment hides braces up to its end
    or the line's; quoted parts and characters after a backslash count wherever they stand, as the measure has it."""
    n, at, hidden, to_the_end = 0, 0, False, False
    while m := (_IN_COMMENT if hidden else _VISIBLE).search(line, at):
        token, at = m[0], m.end()
        if token[0] in '"\\':
            n += token.count("{") - token.count("}")
        elif hidden:
            hidden = to_the_end
        elif token in "{}":
            n += 1 if token == "{" else -1
        else:
            hidden, to_the_end = True, token != "/*"
    return n


class Cutter:
    """Lines in, chunks out. A chunk ends after the first line that leaves no brace open once max_chars are there, so the
    limit is soft; blanks at a chunk's end go. Kept are the lines of the chunk that is open, nothing else."""

    def __init__(self, max_chars: int) -> None:
        self.max_chars = max_chars
        self.lines: list[str] = []
        self.chars = self.depth = 0

    def add(self, line: str) -> str:
        """The chunk that the line completes, if it does."""
        self.lines.append(line)
        self.chars += len(line)
        self.depth += depth_change(line)
        return self.rest() if not self.depth and self.chars >= self.max_chars else ""

    def rest(self) -> str:
        out = "".join(self.lines).rstrip()
        self.lines, self.chars, self.depth = [], 0, 0
        return out


def smart_chunks(text: str, max_chars: int) -> list[str]:
    """A text that is short enough as it is, else its chunks."""
    if len(text) <= max_chars:
        return [text]
    cutter = Cutter(max_chars)
    return [x for x in [*map(cutter.add, text.splitlines(keepends=True)), cutter.rest()] if x]
