"""Training-set assembly: the files of a directory as one example, chunks, totals, decision quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import hcl
from ..functions.text import basename, dirname, extension

# What the builder collects and leaves out.
VALID_EXTENSIONS = (".tf", ".tfvars", ".hcl", ".yml", ".yaml")
SKIP_FILES = ("terragrunt.hcl", ".terraform.lock.hcl", ".gitignore", "README.md")
SKIP_DIRS = (".git", ".terraform", "node_modules", "__pycache__", ".terragrunt-cache", ".DS_Store", "venv", ".venv")
MIN_CHARS = 15
#: Fixed value: files that make one example with the others of their directory, in the order they stand there.
GROUPED = ("variables.tf", "main.tf", "outputs.tf", "versions.tf", "providers.tf", "locals.tf", "data.tf", "iam.tf", "inputs.hcl")
MAX_CHARS = 400_000
#: What str.strip takes for blanks.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], text: Column, separator: str, alias: str = "text") -> DataFrame:
    """The texts of each group joined in the order given; a group's texts are one row. Examples of files are `build`'s."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["__text"]), separator).alias(alias))


def totals(df: DataFrame, text: Column) -> DataFrame:
    """Examples, characters, about how many tokens, and the mean length."""
    return df.agg(F.count("*").alias("examples"), F.sum(F.length(text)).alias("chars"), F.expr("coalesce(sum(length(text)), 0) div 4").alias("tokens"), F.avg(F.length(text)).alias("mean_chars"))


def collectable(path: Column, text: Column) -> Column:
    """Whether a file is taken: by its extension, its name, the directories above it, and how much there is in it."""
    parts = F.split(path, "/")
    return (
        extension(path).isin(*VALID_EXTENSIONS)
        & ~basename(path).isin(*SKIP_FILES)
        & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS)))
        & (F.length(F.btrim(text, F.lit(BLANKS))) >= MIN_CHARS)
    )


class _Example:
    """The example that is being written: its chunks as they are completed, named by parts only if there are several."""

    def __init__(self, label: str, max_chars: int, headed: bool) -> None:
        self.label, self.headed = label, headed
        self.cutter = hcl.Cutter(max_chars)
        self.open_line = ""
        self.first: str | None = None
        self.n = 0

    def _named(self, chunk: str, label: str) -> tuple[str, str]:
        return label, f"# file: {label}\n{chunk}" if self.headed else chunk

    def _chunk(self, chunk: str) -> Iterator[tuple[str, str]]:
        if not chunk:
            return
        if self.n == 0:
            self.first = chunk  # its name depends on whether another follows
        else:
            if self.n == 1:
                yield self._named(self.first, f"{self.label}::part0")
                self.first = None
            yield self._named(chunk, f"{self.label}::part{self.n}")
        self.n += 1

    def add(self, text: str) -> Iterator[tuple[str, str]]:
        """More text, which goes on in the line that is open."""
        lines = (self.open_line + text).splitlines(keepends=True)
        self.open_line = lines.pop() if lines else ""
        for line in lines:
            yield from self._chunk(self.cutter.add(line))

    def close(self) -> Iterator[tuple[str, str]]:
        yield from self._chunk(self.cutter.add(self.open_line))
        yield from self._chunk(self.cutter.rest())
        if self.n == 1:
            yield self._named(self.first, self.label)


def build(files: DataFrame, *, by: tuple[str, ...] = (), max_chars: int = MAX_CHARS, grouped: bool = True, out_chars: int = 4_000_000) -> DataFrame:
    """(by..., label, text): training examples of files (by..., file, text), by naming the repository, say.

    The groupable files of a directory are one example, each under a `# file:` head, in their fixed order; every other file,
    and every file at the root, is its own. What passes max_chars is cut where no brace is open, into `<label>::part<n>`.
    Without grouping each file is an example under its head. Directories are dealt by hash, sorted and streamed: a task
    holds a file and the chunk that is open, never a directory.

    Edge cases: null texts and texts of under 15 characters are left out; a null `by` is a value of its own; a file that
    stands twice in a directory is there twice; other columns are ignored; no rows give none.
    """
    name, dir_ = basename(F.col("file")), dirname(F.col("file"))
    together = name.isin(*GROUPED) & (dir_ != "") if grouped else F.lit(False)
    order = F.array_position(F.array(*map(F.lit, GROUPED)), name)
    rows = files.filter(collectable(F.col("file"), F.col("text")) & F.col("text").isNotNull()).select(*by, "file", "text", together.alias("together"), F.when(together, dir_).otherwise(F.col("file")).alias("label"), F.when(together, order).otherwise(0).alias("place"))
    keys = [*by, "label", "together"]
    schema = rows.select(*by, "label", "text").schema
    out_schema = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple]:
            key, example = None, None
            for batch in batches:
                columns = [batch.column(k) for k in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    *own, file, text, whole, label, _ = (c[i].as_py() for c in columns)
                    more = whole and key == (own, label)
                    if not more and example:
                        yield from ((*key[0], *x) for x in example.close())
                        example = None
                    key = (own, label)
                    if not whole and len(text) <= max_chars:
                        yield (*own, label, text if grouped else f"# file: {label}\n{text}")
                        continue
                    example = example or _Example(label, max_chars, not grouped)
                    said = f"# file: {file}\n{text.rstrip()}" if whole else text
                    yield from ((*own, *x) for x in example.add("\n\n" * more + said))
            if example:
                yield from ((*key[0], *x) for x in example.close())

        done, size = [], 0
        for row in examples():
            done.append(row)
            size += len(row[-1])
            if size > out_chars:
                yield batch_of(done)
                done, size = [], 0
        if done:
            yield batch_of(done)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(out_schema)], schema=out_schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "place", "file").mapInArrow(fold, schema)


def decision_quality(df: DataFrame, predicted: Column, truth: Column, lenient: Column) -> DataFrame:
    """Strict and lenient precision over decided rows, and the rate of false reuse."""
    reuse = predicted == 1
    return df.agg(
        F.count("*").alias("n"),
        F.avg((predicted == truth).cast("double")).alias("strict"),
        F.avg(((predicted == truth) | lenient).cast("double")).alias("lenient"),
        (F.count_if(reuse & (truth == 0)) / F.count("*")).alias("false_reuse"),
    )
