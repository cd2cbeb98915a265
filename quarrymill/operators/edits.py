"""Edits of many files as a table: each file's edits in order, a result for each, and the new texts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import hcl
from .index import SPREAD

#: What an edit may say: value and match are JSON, index a place in a list, kind the declared type a value is coerced to.
EDITS = "file string, seq long, path string, op string, value string, index int, match string, kind string"
#: Bytes of a batch that are Python objects at a time.
CHUNK_BYTES = 1_000_000
RESULTS = "file string, seq long, path string, op string, how string, verified boolean, error string, text string"


def _edit(row: dict) -> dict:
    out = {"path": row["path"], "op": row["op"] or "set"}
    if row["value"] is not None:
        out["value"] = json.loads(row["value"])
        if row["kind"] is not None:
            out["value"] = hcl.coerce(out["value"], row["kind"])
    if row["index"] is not None:
        out["index"] = row["index"]
    if row["match"] is not None:
        out["match"] = json.loads(row["match"])
    return out


def _apply(text: str | None, tree: hcl.Node | None, row: dict) -> tuple[str | None, hcl.Node | None, str, bool, str]:
    """(text, tree, how, verified, error): how is replaced, injected, added, removed, unchanged or skipped. The tree is the
    text's, read if it is not there yet, so that each text is read once."""
    if text is None:
        return None, None, "skipped", False, "no such file"
    try:
        edit = _edit(row)
    except ValueError:
        return text, tree, "skipped", False, "value or match is no JSON"
    if not edit["path"]:
        return text, tree, "skipped", False, "no path"
    tree = hcl.read_tree(text) if tree is None else tree
    there = hcl.find(tree, edit["path"])[0] is not None
    after, error = hcl.apply_edit(text, edit, tree)
    if error:
        return text, tree, "skipped", False, error
    same = after == text
    tree = tree if same else hcl.read_tree(after)
    verified = hcl.verify_edits(after, [edit], tree)[0]["ok"]
    if same:
        return text, tree, "unchanged", verified, ""
    return after, tree, {"add": "added", "remove": "removed"}.get(edit["op"], "replaced" if there else "injected"), verified, ""


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, of which a few MB at a time are Python objects."""
    step = max(1, batch.num_rows * CHUNK_BYTES // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, step):
        yield from batch.slice(k, step).to_pylist()


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """RESULTS: a row for each edit, read back right after it was made, and for each edited file a row without seq that has
    its text after all of them.

    Texts and edits are one table, dealt by file and sorted by seq, a text before its edits; a task streams it and holds one
    text and its tree. Only files with edits are dealt, to four tasks a core at least, as editing costs far more than its bytes
    suggest. An edit sees what those before it did; one that fails leaves the text as it was.

    Edge cases: edits of a file that isn't there are skipped, with no text row; a null text is an empty one; edits of equal
    seq go by path and op, a null seq first; of a file that stands twice each text ends the one before, and the last one
    takes the edits; other columns are ignored.
    """
    e = edits.select("file", F.lit(1).alias("what"), *[x.split()[0] for x in EDITS.split(", ")[1:]], F.lit(None).cast("string").alias("text"))
    texts = files.join(edits.select("file").distinct(), "file", "left_semi").select("file", F.lit(0).alias("what"), F.coalesce("text", F.lit("")).alias("text"))
    spark = files.sparkSession
    tasks = max(SPREAD * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = e.unionByName(texts, allowMissingColumns=True).repartition(tasks, "file").sortWithinPartitions("file", "what", "seq", "path", "op", "text")
    schema = to_arrow_schema(spark.createDataFrame([], RESULTS).schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, text, tree, out, size = None, None, None, [], 0

        def ended() -> list[dict]:
            return [] if text is None else [{"file": file, "text": text}]

        for batch in batches:
            for row in _rows(batch):
                if row["file"] != file or row["what"] == 0:
                    done = ended()
                    out, size = out + done, size + sum(len(x["text"]) for x in done)
                    file, text, tree = row["file"], row["text"] if row["what"] == 0 else None, None
                if row["what"]:
                    text, tree, how, verified, error = _apply(text, tree, row)
                    out.append({"file": file, "seq": row["seq"], "path": row["path"], "op": row["op"] or "set", "how": how, "verified": verified, "error": error})
                if size > 4_000_000 or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        out += ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(fold, RESULTS)
