"""Depths of lines against a scan of each text from its start."""

from __future__ import annotations

import random

from quarrymill.operators import depths


def scanned(text: str) -> tuple[list[int], int, bool]:
    out, depth, inside = [], 0, False
    for line in text.split("\n"):
        out.append(depth)
        signs = iter(range(len(line)))
        for k in signs:
            c = line[k]
            if inside:
                if c == "\\":
                    next(signs, None)
                inside = c != '"'
            elif c == "#" or line.startswith("//", k):
                break
            elif c == '"':
                inside = True
            else:
                depth += (c in "{[(") - (c in "}])")
    return out, depth, inside


def texts() -> list[tuple]:
    r = random.Random(3)
    odd = ["", "\n", '"', "\\", '"\\', '"\\\n"{', 'a = "{"\nb {', '# "\n{', '// {\n}', '"a\\"{\n}" {\n', "/", "/{/}/", '"#{\n#"{\n(', "\n" * 50, '"' + "\\a" * 20_000 + '"{\n{', '"' + "x" * 200_000 + "\n}"]
    made = ["".join(r.choice('"\\#/{}[]()ab \n\n') for _ in range(r.randint(1, 300))) for _ in range(120)]
    return [(k, t) for k, t in enumerate(odd + made)] + [(None, 'a {\n"'), (999, None)]


def test_depths_agree_with_a_scan(spark):
    rows = texts()
    lines = depths.lines_of(spark.createDataFrame(rows, "file long, text string"), "file", depths.F.col("text")).cache()
    want = {(k, n + 1): d for k, t in rows if t is not None for n, d in enumerate(scanned(t)[0])}
    for block in (1, 3, 7, 4096):
        got = depths.line_depths(lines, block=block).collect()
        assert len(got) == len(want) and {(r["file"], r["line"]): r["depth"] for r in got} == want
        ends = {r["file"]: (r["depth"], r["open_string"]) for r in depths.balances(lines, block=block).collect()}
        assert ends == {k: scanned(t)[1:] for k, t in rows if t is not None}
    lines.unpersist()


def test_nothing_python_and_blocks_spread_a_text(spark):
    long = spark.range(1, 20_001, numPartitions=8).selectExpr("'a' AS file", "id AS line", "CASE WHEN id % 5 = 0 THEN '}' WHEN id % 5 < 3 THEN 'x = { # {' ELSE 'y = \"' END AS code")
    df = depths.line_depths(long, block=512)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = long.orderBy("line").collect()
    assert [r["depth"] for r in df.orderBy("line").collect()] == scanned("\n".join(r["code"] for r in rows))[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "file string, line long, code string")
    assert depths.line_depths(none).count() == 0 and depths.balances(none).count() == 0
    assert depths.line_depths(spark.createDataFrame([("a", 5, None), ("a", 9, "{"), ("a", 12, "x")], none.schema)).orderBy("line").collect()[-1]["depth"] == 1
