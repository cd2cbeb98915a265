from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter

from quarrymill.operators import index
from quarrymill.streaming import events


def test_stream_and_table_windows_agree(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * k), k % 3, "a" if k % 2 else "b", float(k)) for k in range(40)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    table.write.parquet(str(tmp_path / "in"))
    stream = events.stream_events(spark, str(tmp_path / "in"), table.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    q = events.tumbling(stream, late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.tumbling(table).collect()))
    assert events.sessions(table, "6 hours").count() >= 3


def test_refresh_by_micro_batch(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "file string, v int")
    base.write.parquet(str(tmp_path / "t0"))
    spark.createDataFrame([("a", 2)], "file string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, v int").parquet(str(tmp_path / "in"))

    def apply(batch, n):
        index.refresh(spark.read.parquet(str(tmp_path / f"t{n}")), batch, batch.select("file")).write.parquet(str(tmp_path / f"t{n + 1}"))

    events.refresh_stream(stream, apply, str(tmp_path / "cp")).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t1")).collect()} == {("a", 2), ("b", 1)}


def test_changes_of_edges_add_up_to_the_table(spark, tmp_path):
    """Files change, go, come back, arrive late and twice; what was added less what was retracted are the newest files' edges."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(4)

    def text(k):
        return None if r.random() < 0.15 else "".join(r.choice(['module "m%d" {\n  source = "../n%d"\n}\n', "x = var.v%d + var.w%d\n", "y = module.m%d.o%d\n", "# %d %d\n"]) % (r.randint(0, 2), k % 3) for _ in range(r.randint(0, 4)))

    schema = "file string, version long, text string, clash string"
    batches = [[(f"d/f{r.randint(0, 7)}.tf", v, text(v), "x") for v in r.sample(range(100), 6)] for _ in range(4)] + [[("d/inputs.hcl", 1, "", "x"), ("d/none.tf", None, "a = var.z", "x")], [("d/inputs.hcl", 2, None, "x")]]
    batches[2].append(batches[0][0])
    table = None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = events.edge_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        seen = [row for b in batches[: n + 1] for row in b]
        newest = {}
        for f, v, t, _ in seen:
            mark = (-1 if v is None else v, hashlib.md5(t.encode()).hexdigest() if t is not None else "")
            if f not in newest or mark > newest[f][0]:
                newest[f] = (mark, t)
        table = spark.createDataFrame([(f, t) for f, (_, t) in newest.items() if t is not None] or [("", "")], "file string, text string")
        want = Counter(tuple(x) for x in index.edges(index.parse(table)).select("file", *events._EDGE).collect())
        got = Counter()
        for x in spark.read.parquet(str(tmp_path / "out")).select("file", *events._EDGE, "change").collect():
            got[tuple(x)[:-1]] += 1 if x["change"] == "added" else -1
        assert {k: v for k, v in got.items() if v} == dict(want)
