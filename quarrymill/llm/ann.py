"""Approximate nearest neighbours by learned partitions.

A bounded sample (``sample`` vectors, 16,384) is joined to its nearest neighbours into a graph; the graph is cut into
equal parts that keep neighbours together (balanced label propagation under a size cap, from balanced centres); a small
network learns to tell a vector's part from the vector. Every row of the table is then indexed by the network: each goes
to its likeliest part. How many parts a query visits is calibrated: the network is fitted without a quarter of the
sample, and the fewest probable parts are taken that hold ``target`` of that quarter's nearest neighbours in the sample
(which lie further off than those in the table, so the table's are found more often). A query is routed to so many of
its most probable parts, and until they hold enough rows, and reranked there by exact cosine in double precision. So
clustered vectors are searched in few parts, vectors without structure in many, and the share of the table that a query
visits falls as parts become more.

Parts are searched some together, and large ones and the queries sent to them are cut into blocks by counts taken
beforehand, so a part that holds a third of all rows is many tasks; equal vectors of a block are scored once. Edge cases: vectors that are null, zero, of another length
than most, or hold null or non-finite components take no part; null ids neither; ties go to the smaller id; a query
with fewer candidates than k gets all of them; tables of fewer than 64 vectors are one part, without a network; rows that repeat a vec_id count as that many candidates, but for the
query's own id; an id of several rows asks once, with the smallest of its vectors (compared component by component);
tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 16_384
NEIGHBOURS = 10
ROWS_PER_PART = 100
FEWEST_PARTS = 8
PART_SAMPLE = 24
TARGET = 0.94
HELD = 4
BLOCK_ROWS = 32_768
BLOCK_QUERIES = 32_768
#: Parts are searched in bins of a number of rows, which give one list of neighbours together.
LEAST_BIN, BINS = 4096, 64
_CANDIDATES = 32
K = 5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """(vector, k) its nearest others by cosine, among the sample."""
    u = unit(x)
    k = min(k, len(u) - 1)
    out = np.zeros((len(u), k), np.int64)
    for at in range(0, len(u), 256):
        s = u[at : at + 256] @ u.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each vector: first by centres with a size cap, then moved to where most neighbours are while that has room."""
    n = len(x)
    cap = int(np.ceil(n / parts * slack))
    u = unit(x)
    centres = u[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        s = u @ centres.T
        ranked = np.argsort(-s, axis=1, kind="stable")[:, :_CANDIDATES].tolist()
        label = np.full(n, -1)
        room = np.full(parts, cap)
        for v in np.argsort(-s.max(1), kind="stable"):
            best = next((p for p in ranked[v] if room[p] > 0), -1)
            if best < 0:
                best = int(np.argmax(np.where(room > 0, s[v], -2)))
            label[v] = best
            room[best] -= 1
        centres = unit(np.array([u[label == p].mean(0) if (label == p).any() else u[rng.integers(n)] for p in range(parts)]) + 1e-12)
    back: list[list[int]] = [[] for _ in range(n)]
    for v, row in enumerate(graph.tolist()):
        for w in row:
            back[w].append(v)
    near = [np.array(row + b, np.int64) for row, b in zip(graph.tolist(), back, strict=True)]
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(label[near[v]], minlength=parts)
            best = int(np.argmax(np.where(size < cap, votes, -1)))
            if votes[best] > votes[label[v]]:
                size[label[v]] -= 1
                size[best] += 1
                label[v] = best
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, steps: int = 600, rate: float = 0.01) -> Router:
        """Learn, for each vector, the shares of its part and its neighbours' parts."""
        u = unit(x)
        goal = np.zeros((len(u), parts))
        np.add.at(goal, (np.arange(len(u)), label), 1.0)
        for j in range(graph.shape[1]):
            np.add.at(goal, (np.arange(len(u)), label[graph[:, j]]), 1.0 / graph.shape[1])
        goal /= goal.sum(1, keepdims=True)
        net = [rng.normal(0, 1, (u.shape[1], hidden)) * np.sqrt(2 / u.shape[1]) * 2, np.zeros(hidden), rng.normal(0, 1, (hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        m, v = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net]
        for t in range(1, steps + 1):
            rows = rng.choice(len(u), min(512, len(u)), replace=False)
            h = np.maximum(u[rows] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - goal[rows]) / len(rows)
            dh = (d @ net[2].T) * (h > 0)
            for k, g in enumerate((u[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net[k] -= rate * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return cls(*net)


def valid(vector: F.Column) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, cosine) of each query's k nearest rows of a block, equal ones by id. Equal rows are scored once,
    and the products of a shortlist are taken anew in one fixed order, so that equal pairs have equal scores."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = np.ascontiguousarray(rows[order]), row_ids[order]
    _, first, same = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(same, kind="stable")  # of each distinct row, by id
    begin = np.searchsorted(same[members], np.arange(len(first) + 1))
    member_ids = row_ids[members]
    lowest, highest = member_ids[begin[:-1]], member_ids[begin[1:] - 1]
    distinct = rows[first]
    norm_r, norm_q = np.sqrt((distinct * distinct).sum(1)), np.sqrt((queries * queries).sum(1))
    scaled = (distinct / norm_r[:, None]).T
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    want = min(k, len(first))
    for at in range(0, len(queries), 256):
        q_ids = query_ids[at : at + 256]
        s = (queries[at : at + 256] / norm_q[at : at + 256, None]) @ scaled
        s[(q_ids[:, None] == lowest) & (lowest == highest)] = -np.inf  # rows of the query's own id only
        least = np.partition(s, len(first) - want, axis=1)[:, len(first) - want]
        q, d = np.nonzero(s >= least[:, None] - 1e-9)
        exact = (distinct[d] * queries[at + q]).sum(1) / (norm_r[d] * norm_q[at + q])
        one = (begin[d + 1] - begin[d] == 1) & (lowest[d] != q_ids[q])
        found.append((q_ids[q[one]], lowest[d[one]], exact[one]))
        more = np.flatnonzero(begin[d + 1] - begin[d] > 1)
        for i, j, e in zip(q[more].tolist(), d[more].tolist(), exact[more].tolist(), strict=True):
            ids = member_ids[begin[j] : begin[j + 1]]
            own = np.searchsorted(ids, q_ids[i]), np.searchsorted(ids, q_ids[i], "right")
            ids = np.concatenate((ids[: min(own[0], k)], ids[own[1] : own[1] + k]))[:k]
            found.append((np.full(len(ids), q_ids[i]), ids, np.full(len(ids), e)))
    return best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query by score, then id."""
    by = np.lexsort((row, -score, query))
    query, row, score = query[by], row[by], score[by]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    keep = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query)))) < k
    return query[keep], row[keep], score[keep]


def bins_of(held: np.ndarray, most: int) -> np.ndarray:
    """A bin for each part: parts in order, as many in one bin as have `most` rows together."""
    out, at, rows = np.zeros(len(held), np.int64), 0, 0
    for p, n in enumerate(held.tolist()):
        if rows and rows + n > most:
            at, rows = at + 1, 0
        out[p] = at
        rows += n
    return out


def part_count(total: int, fitted: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """Parts of about rows_per_part rows, FEWEST_PARTS at least, as far as the sample has PART_SAMPLE vectors for each."""
    return int(min(max(FEWEST_PARTS, total // rows_per_part), max(1, fitted // PART_SAMPLE)))


def fit(x: np.ndarray, total: int, *, k: int = K, target: float = TARGET, rows_per_part: int = ROWS_PER_PART, seed: int = 11) -> tuple[Router | None, int, int]:
    """(router, parts, parts to visit) from a sample in random order."""
    held = len(x) // HELD
    parts = part_count(total, len(x) - held, rows_per_part)
    if parts < 2:
        return None, 1, 1
    rng = np.random.default_rng(seed)
    mine = x[held:]
    graph = neighbour_graph(mine)
    router = Router.fit(mine, graph, balanced_parts(mine, graph, parts, rng), parts, rng)
    order = np.argsort(-router.logits(x), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], 1)
    u, found = unit(x), []
    for at in range(0, held, 256):
        s = u[at : min(at + 256, held)] @ u.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        near = np.argpartition(-s, min(k, len(u) - 1) - 1, axis=1)[:, :k]
        found.append(place[np.arange(at, at + len(s))[:, None], order[near, 0]].ravel())
    found = np.sort(np.concatenate(found))
    return router, parts, int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = K,
    sample: int = SAMPLE,
    target: float = TARGET,
    rows_per_part: int = ROWS_PER_PART,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by `every`.

    target: the share of the sample's own nearest neighbours that the visited parts have to hold.
    """
    spark = vectors.sparkSession
    mine = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vec"))
    mine = mine.filter(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    result = "query_id long, rank int, vec_id long, score double"
    sizes = mine.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dim, total = sizes[0]
    mine = mine.filter(F.size("vec") == dim)
    share = min(1.0, sample / total)
    draw = F.xxhash64("vec_id", F.lit(seed))
    taken = mine.filter(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(draw, "vec_id", "vec").limit(2 * sample).toPandas()  # about sample rows
    router, parts, least = fit(np.array(taken["vec"].tolist(), np.float64).reshape(-1, dim), total, k=k, target=target, rows_per_part=rows_per_part, seed=seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            part = router.logits(x).argmax(1) if router and len(x) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "vec_id", "vec"])

    index = materialise(mine.mapInArrow(assign, "part int, vec_id long, vec array<double>"), "index")
    held = np.zeros(parts, np.int64)
    for p, n in index.groupBy("part").count().collect():  # one row per part
        held[p] = n

    bin_of = bins_of(held, min(BLOCK_ROWS, max(LEAST_BIN, total // BINS)))
    bins = int(bin_of.max()) + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            order = np.argsort(-router.logits(x), axis=1, kind="stable") if router and len(x) else np.zeros((len(x), 1), np.int64)
            row, to, lists = [], [], []
            for i, o in enumerate(order):
                visited = np.sort(o[: max(least, int(np.searchsorted(np.cumsum(held[o]), k + 1)) + 1)])
                cut = np.flatnonzero(np.append(True, np.diff(bin_of[visited]) > 0))
                row += [i] * len(cut)
                to += bin_of[visited[cut]].tolist()
                lists += [v.tolist() for v in np.split(visited, cut[1:])]
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "bin", "parts"])

    asked = index.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")).groupBy("query_id").agg(F.min("q").alias("q"))
    visits = materialise(asked.mapInArrow(route, "query_id long, q array<double>, bin int, parts array<int>"), "visits")
    cuts = np.maximum(1, -(-np.bincount(bin_of, held, bins).astype(np.int64) // BLOCK_ROWS))
    groups = np.ones(bins, np.int64)
    for b, n in visits.groupBy("bin").count().collect():  # one row per bin
        groups[b] = -(-n // BLOCK_QUERIES)
    # sample / PART_SAMPLE rows at most
    plan = F.broadcast(spark.createDataFrame([(p, int(b), int(cuts[b]), int(groups[b])) for p, b in enumerate(bin_of)], "part int, bin int, cuts int, groups int"))
    right = index.join(plan, "part").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    left = visits.join(plan.drop("part").distinct(), "bin").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(r):
            r = r.sort_values("part", kind="stable")
            vec, row_ids, part = np.stack(r["vec"].to_numpy()), r["vec_id"].to_numpy(), r["part"].to_numpy()
            asked, query_ids = np.stack(q["q"].to_numpy()), q["query_id"].to_numpy()
            visit = np.concatenate(q["parts"].to_numpy())
            who = np.repeat(np.arange(len(q)), [len(x) for x in q["parts"]])
            who, visit = who[np.argsort(visit, kind="stable")], np.sort(visit)
            for p in np.unique(part).tolist():
                mine = who[np.searchsorted(visit, p) : np.searchsorted(visit, p, "right")]
                rows = slice(np.searchsorted(part, p), np.searchsorted(part, p, "right"))
                if len(mine):
                    found.append(top_k(asked[mine], query_ids[mine], vec[rows], row_ids[rows], k))
        query, row, score = best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        return pd.DataFrame({"query_id": query, "vec_id": row, "score": score})

    cell = ["bin", "cut", "group"]
    found = left.select(*cell, "query_id", "q", "parts").groupBy(cell).cogroup(right.select(*cell, "part", "vec_id", "vec").groupBy(cell)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
