"""An index that is kept: the facts of all files as a table in buckets, of which only those with changes are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index

BUCKETS = 64
#: Characters of texts and bodies in one task that writes, which sorts its rows by bucket.
SHARE_CHARS = 4_000_000


class KeptIndex:
    """The facts (see index.parse) of a tree in a folder, partitioned by a hash of the path.

    A refresh compares content hashes, which is Spark's own work; Python starts only for files that are new or changed, and
    not at all where there are none. Touched buckets are replaced by dynamic partition overwrite, each holding a row of its
    own so that an empty one is replaced as well. A run that dies while buckets are moved in place leaves each of them as
    it was, as it is to be, or missing; the next refresh finds by the hashes what it has to parse. One refresh at a time.
    A bucket is written by as many tasks as its texts ask for, so that none sorts more than a few million characters.

    Edge cases: null texts are empty ones; a path that stands twice has the facts of both texts, and is parsed again when
    either changes; a bucket count is the folder's, so that another one needs another folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self) -> DataFrame:
        schema = f"{index.FACTS}, bucket int"
        if not self._there():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int").alias("bucket")

    def facts(self) -> DataFrame:
        return self._table().filter("fact <> 'bucket'").drop("bucket")

    def files(self) -> DataFrame:
        """(file, file_hash)"""
        return self._table().filter("fact = 'file'").select("file", "file_hash")

    def refresh(self, files: DataFrame, paths: DataFrame | None = None) -> dict[str, int]:
        """Bring the index to a tree (file, text), or only the named paths (file) of it to what files has of them; paths that
        files doesn't have vanish. How many files were parsed and are gone."""
        text = F.coalesce("text", F.lit(""))
        if not self._there():
            return self._build(files if paths is None else files.join(paths.select("file").distinct(), "file", "left_semi"), F.length(text))
        now = files.select("file", F.md5(text.cast("binary")).alias("file_hash"), F.length(text).alias("chars"))
        before = self._table().filter("fact = 'file'").select("file", "file_hash", F.lit(0).alias("chars"))
        if paths is not None:
            named = paths.select("file").distinct()
            now, before = now.join(named, "file", "left_semi"), before.join(named, "file", "left_semi")
        sides = now.withColumn("side", F.lit(1)).unionByName(before.withColumn("side", F.lit(0)))
        hashes = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("file_hash"))))
        compared = sides.groupBy("file").agg(hashes(1).alias("now"), hashes(0).alias("before"), F.sum("chars").alias("chars")).filter("now <> before")
        changed = compared.select("file", (F.size("now") > 0).alias("here"), self._bucket())
        counts = F.count_if("here").alias("parsed"), F.count_if(~F.col("here")).alias("gone"), F.sum("chars").alias("chars")
        touched = compared.withColumns({"here": F.size("now") > 0, "bucket": self._bucket()}).groupBy("bucket").agg(*counts).collect()  # one row a bucket
        if not touched:
            return {"parsed": 0, "gone": 0}
        numbers = sorted(r["bucket"] for r in touched)
        rest = self._table().filter(F.col("bucket").isin(numbers) & (F.col("fact") != "bucket")).join(changed, "file", "left_anti")
        new = index.parse(files.join(changed.filter("here"), "file", "left_semi")).withColumn("bucket", self._bucket())
        out = rest.unionByName(new)
        sizes = [r["chars"] for r in touched]
        stays = rest.groupBy("bucket").agg(F.sum(F.coalesce(F.length("body"), F.lit(0)) + 100).alias("chars"))  # in a touched bucket it is written again
        sizes += [r["chars"] for r in stays.collect()]  # one row a bucket
        self._write(out, numbers, sizes)
        return {"parsed": sum(r["parsed"] for r in touched), "gone": sum(r["gone"] for r in touched)}

    def _build(self, files: DataFrame, chars: F.Column) -> dict[str, int]:
        """A first refresh: with nothing to compare with, texts are neither hashed nor joined before they are parsed."""
        files = files.filter("file is not null")
        paths = files.select("file", chars.alias("chars")).groupBy("file").agg(F.sum("chars").alias("chars"))
        touched = paths.groupBy(self._bucket()).agg(F.count("*").alias("parsed"), F.sum("chars").alias("chars")).collect()  # one row a bucket
        if touched:
            numbers, sizes = sorted(r["bucket"] for r in touched), [r["chars"] for r in touched]
            if sum(sizes) <= SHARE_CHARS:
                self._write(index.parse(files).withColumn("bucket", self._bucket()), numbers, sizes)
            else:  # a task parses what it writes, so that only texts are shuffled; no bucket is empty, so none needs a row of its own
                tasks = index.SPREAD * self.spark.sparkContext.defaultParallelism
                dealt = self._dealt(files, self._bucket(), numbers, max(-(-max(sizes) // SHARE_CHARS), -(-tasks // len(numbers))))
                self._save(index.parse(dealt, (), False).withColumn("bucket", self._bucket()))
        return {"parsed": sum(r["parsed"] for r in touched), "gone": 0}

    def _dealt(self, rows: DataFrame, bucket: F.Column, numbers: list[int], shares: int) -> DataFrame:
        """Rows with a task for each share of each bucket; hashed, several would meet in one task."""
        nth = F.array_position(F.array(*map(F.lit, numbers)), bucket) - 1
        share = F.coalesce(F.pmod(F.xxhash64(F.lit("share"), "file"), F.lit(shares)), F.lit(0))
        return rows.repartitionById(len(numbers) * shares, (nth * shares + share).cast("int"))

    def _save(self, rows: DataFrame) -> None:
        out = rows.select(*self._table().columns)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _write(self, rows: DataFrame, numbers: list[int], sizes: list[int]) -> None:
        """Replace some buckets by rows, given how many characters they hold."""
        marks = self.spark.createDataFrame([("bucket", n) for n in numbers], "fact string, bucket int")
        out = rows.unionByName(marks, allowMissingColumns=True)
        if sum(sizes) <= SHARE_CHARS:
            out = out.repartition("bucket")
        else:
            out = self._dealt(out, F.col("bucket"), numbers, -(-max(sizes) // SHARE_CHARS))
        self._save(out)
