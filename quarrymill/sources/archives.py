"""Archives of code: one row per member file."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hcl
from ..functions.text import has_secret, repo_id

# Which members are files of interest.
EXTENSIONS = (".tf", ".hcl", ".tfvars")
SKIP_PARTS = (".terraform", ".git", ".terragrunt-cache", "node_modules")
MAX_BYTES = 1_000_000

FILE_SCHEMA = "repo_id long, path string, ext string, size long, sha1 string, text string, parse_ok boolean, has_secret boolean"


def archive_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the members to keep; a broken archive gives what could be read before it broke."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            for m in tar:
                ext = "." + m.name.rsplit(".", 1)[-1].lower() if "." in m.name.rsplit("/", 1)[-1] else ""
                if not m.isfile() or ext not in EXTENSIONS or m.size > MAX_BYTES or set(m.name.split("/")) & set(SKIP_PARTS):
                    continue
                content = tar.extractfile(m).read()
                if b"\0" not in content:
                    yield m.name, content
    except (tarfile.TarError, EOFError, OSError):
        return


def read_archives(spark: SparkSession, folder: str, *, limit: int | None = None) -> DataFrame:
    """Files of all archives <repo id>*.tar.gz in a folder. The archive is the unit of work; the secret test is native."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder)
    if limit is not None:
        archives = archives.orderBy("path").limit(limit)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, data in zip(batch["repo_id"], batch["content"], strict=True):
                rows = []
                for path, content in archive_members(data):
                    text = content.decode("utf-8", "replace")
                    rows.append((i, path, "." + path.rsplit(".", 1)[-1].lower(), len(content), hashlib.sha1(content).hexdigest(), text, not hcl.problems(text)))
                yield pd.DataFrame(rows, columns=["repo_id", "path", "ext", "size", "sha1", "text", "parse_ok"])

    members = archives.select(repo_id(F.col("path")).alias("repo_id"), "content").mapInPandas(explode, FILE_SCHEMA.rsplit(",", 1)[0])
    return members.withColumn("has_secret", has_secret(F.col("text")))


def write_files(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").partitionBy("ext").parquet(path)
