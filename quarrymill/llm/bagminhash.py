"""Near-duplicates by BagMinHash: signatures of multisets of word shingles, banding, and exact verification.

A shingle that occurs w times has weight w. Its weights are discretised: unit steps gathered in the dyadic intervals
[0,1), [1,2), [2,4), [4,8)...; each interval of each shingle has a Poisson process of its own, seeded by the shingle,
whose rate is the interval's length and whose points carry a signature place. Where w lies inside an interval, a point
descends by halves to the unit step it belongs to and counts only below w. The first point of each place is the
signature; two signatures agree in a place with the weighted Jaccard similarity as probability. Points are drawn in
ascending order and only as far as the last place to fill needs, for all documents of a slice at once.

Whole job: exact copies are folded first; representatives that share a band are candidates. In each bucket everything is
checked against a member drawn by hash, another in each bucket, links are folded into components, and so again; then
members of different components that still share a bucket are compared inside the tasks, by signature and then on their
multisets, large buckets block by block, and only links leave them. So no bucket's pairs are all made, and no link between different texts is lost
but by banding (at similarity 0.8 with 32 bands of 4: one in 2e7) and by the signature's margin of 4.5 deviations, under
which pairs that reach the last comparison are not verified: 20 in a million of those at similarity 0.8 exactly, fewer above. The sum
of both is the margin's, for pairs that no star round linked. Candidates are verified on whole multisets.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters; a shingle is five words, or all words of
a shorter text. Edge cases: texts without words (null is empty) are copies of equal texts only; null ids get rows and
can carry a class, whose id is the smallest non-null one; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, slices, spare, tidy

SHINGLE = 5
BANDS, ROWS = 32, 4
THRESHOLD = 0.8
STAR_ROUNDS = 2
#: What is compared in one task at a time: members of a bucket, and bytes of their multisets.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000
GROUP_BYTES = 8_000_000
SIGN_CHARS = 500_000

_U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, _U)
        step = base
        while len(have) < n:
            have = np.concatenate((have, have * _U(step)))
            step = step * step & ((1 << 64) - 1)
        _powers[base] = have
    return have[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs).translate(_LOWER) + b"\n", np.uint8)
    inside = _IS_WORD[data].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(data * _power(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    sizes = np.array([len(b) + 1 for b in blobs], np.int64)
    count = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
    return mix(h + (ends - starts).astype(_U)), count


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) of each distinct shingle of each text, by text and hash."""
    words, count = word_hashes(texts)
    begin = np.cumsum(count) - count
    number = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + begin[owner]
    h = np.zeros(len(owner), _U)
    padded = np.concatenate((words, np.zeros(size, _U)))
    for k in range(size):
        there = first + k
        h = h * _U(0xD6E8FEB86659FD93) + np.where(there < (begin + count)[owner], padded[there], _U(0))
    h = mix(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, places: int) -> np.ndarray:
    """(text, place) the 64-bit name of the first point of each place; texts without elements keep zeros."""
    levels = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64))
    item = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    rate = np.where(level == 0, 1.0, 2.0 ** np.maximum(level - 1, 0))
    lower = np.where(level == 0, 0.0, rate)
    text, key = owner[item], mix(element[item] + (level + 1).astype(_U) * _U(0xA0761D6478BD642F))
    inner = weight[item] < lower + rate  # w lies inside the interval
    total = np.bincount(owner, weights=weight, minlength=n_texts)
    limit = np.divide(places * (np.log(places) + 2.5), total, out=np.zeros(n_texts), where=total > 0)
    best, name = np.full(n_texts * places, np.inf), np.zeros(n_texts * places, _U)
    point = np.zeros(len(item), _U)
    hashed = mix(key)
    x = -np.log((hashed >> _U(11)) * 2.0**-53 + 2.0**-54) / rate
    active = np.arange(len(item))
    while len(active):
        go = active[x[active] <= limit[text[active]]]
        while len(go):
            h = hashed[go]
            counts = np.ones(len(go), bool)
            part = np.flatnonzero(inner[go])
            if len(part):  # down by halves to a unit step: its number is read off the leading bits
                steps = np.floor((mix(h[part] ^ _U(0x8EBC6AF09C88C6E3)) >> _U(11)) * 2.0**-53 * rate[go[part]])
                counts[part] = lower[go[part]] + steps < weight[item[go[part]]]
            hit = go[counts]
            hh = h[counts]
            slot = text[hit] * places + ((mix(hh ^ _U(0x589965CC75374CC3)) >> _U(32)) * _U(places) >> _U(32)).astype(np.int64)
            np.minimum.at(best, slot, x[hit])
            won = best[slot] == x[hit]
            name[slot[won]] = hh[won]
            point[go] += _U(1)
            hashed[go] = mix(key[go] + point[go] * _U(0x9E3779B97F4A7C15))
            x[go] -= np.log((hashed[go] >> _U(11)) * 2.0**-53 + 2.0**-54) / rate[go]
            go = go[x[go] <= limit[text[go]]]
        filled = np.where(np.isinf(best.reshape(n_texts, places)).any(1), np.inf, best.reshape(n_texts, places).max(1))
        open_ = (filled > limit) & (total > 0)
        limit[open_] *= 2
        active = active[open_[text[active]]]
    return name.reshape(n_texts, places)


def band_keys(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(text, band) keys; the band's number is part of its key."""
    grouped = names.reshape(len(names), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0xE7037ED1A0B428DB), grouped.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ grouped[:, :, k]) + _U(k)
    return h


def short_signatures(names: np.ndarray, bands: int, rows: int) -> list[bytes]:
    """Of each text, the leading 16 bits of its names, then its 64-bit band keys."""
    return [a.tobytes() + b.tobytes() for a, b in zip((names >> _U(48)).astype(np.uint16), band_keys(names, bands, rows), strict=True)]


def occurrence_sets(texts: list[str], size: int = SHINGLE) -> list[bytes]:
    """Each text's multiset as ascending distinct 64-bit names of (shingle, occurrence), for exact comparison."""
    owner, h, times = shingles(texts, size)
    item = np.repeat(np.arange(len(h)), times)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)
    names = mix(h[item] + nth.astype(_U) * _U(0x2545F4914F6CDD1D))
    cuts = np.searchsorted(owner[item], np.arange(len(texts) + 1))
    return [np.unique(names[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if not len(x) or not len(y):
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) < 0.5 * len(large):
        return len(small) / len(large) * 0.999  # an upper bound, below any threshold in use
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common / (len(x) + len(y) - common)


def _text_key(column: str = "text") -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are as similar as threshold."""
    a = sets.withColumnsRenamed({"node": "a", "grams": "grams_a"})
    b = sets.withColumnsRenamed({"node": "b", "grams": "grams_b"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(x.as_buffer(), y.as_buffer()) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def _key_filter(needed: DataFrame) -> np.ndarray:
    """Packed bits, one for each of a number of key hashes: whether a needed key has it. Some 64 bits a key, and eight
    megabytes at most whatever the number of keys; with so many that all bits are set, it lets everything through."""
    bits = 1 << min(26, max(15, (needed.count() * 64).bit_length()))
    bit = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1  # the functions count from 1
    maps = needed.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for n, found in maps.collect():
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bytes(found), np.uint8)
    return out


def _open_buckets(crowded: DataFrame, label: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(bucket, band, n, bytes, size, node, component) of the buckets that hold more than one component."""
    if label is None:
        return crowded.withColumn("component", F.col("node"))
    placed = scratch(crowded.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return scratch(placed.join(mixed, "bucket"), "open")


def _bucket_links(members: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components in a bucket. Pairs whose signatures agree in as many places as pairs at
    the threshold do, but for 4.5 standard deviations, are verified on their multisets at once, likeliest first, until a
    member has a link to a component; only links leave the task. A pair is looked at in the first band it shares only.
    Small buckets are dealt many to a group, of bounded bytes; large ones are cut into blocks, each pair of blocks a group."""
    places = bands * rows
    least = threshold * places - 4.5 * (places * threshold * (1 - threshold)) ** 0.5
    row_bytes = F.col("size") * 8 + 2 * places + 8 * bands
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil((F.col("bytes") + F.col("n") * (2 * places + 8 * bands)) / BLOCK_BYTES))
    small = cuts <= 1
    total = members.filter(small).agg(F.sum(row_bytes)).first()[0] or 0
    groups = max(1, int(total // GROUP_BYTES))
    block = F.pmod(F.xxhash64("node"), cuts)
    other = F.explode(F.when(small, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), cuts.cast("long") - 1)))
    cells = members.withColumn("block", F.when(small, F.lit(-1)).otherwise(block).cast("long")).withColumn("other", other)
    cells = cells.select(F.when(F.col("block") < 0, F.pmod("bucket", F.lit(groups))).otherwise(F.col("bucket")).alias("group"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "bucket", "band", "node", "component", "short", "grams")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["bucket", "node"], kind="stable")
        bucket, band, node = (cell[c].to_numpy() for c in ("bucket", "band", "node"))
        component, block_ = cell["component"].to_numpy(), cell["block"].to_numpy()
        short = np.frombuffer(b"".join(cell["short"]), np.uint8).reshape(len(cell), 2 * places + 8 * bands)
        names, keys = np.ascontiguousarray(short[:, : 2 * places]).view(np.uint16), np.ascontiguousarray(short[:, 2 * places :]).view(_U)
        grams = cell["grams"].tolist()
        across = len(cell) > 0 and cell["lo"].iloc[0] != cell["hi"].iloc[0]
        a_out, b_out = [], []
        cuts_ = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(cell))
        for lo, hi in zip(cuts_[:-1], cuts_[1:], strict=True):
            for i in range(lo, hi - 1):
                rest = np.arange(i + 1, hi)
                rest = rest[(component[rest] != component[i]) & ((block_[rest] != block_[i]) | (not across))]
                if not len(rest):
                    continue
                same = names[rest] == names[i]
                enough = same.sum(1) >= least
                if enough.any():
                    rest, same = rest[enough], same[enough]
                    first = (keys[rest] == keys[i]).argmax(1)
                    mine = np.flatnonzero(first == band[i])
                    linked: set[int] = set()
                    for r in rest[mine[np.argsort(-same[mine].sum(1), kind="stable")]].tolist():
                        if component[r] not in linked and jaccard(grams[i], grams[r]) >= threshold:
                            linked.add(component[r])
                            a_out.append(node[i])
                            b_out.append(node[r])
        del cell, names, keys, short, grams
        tidy()
        return pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return cells.groupBy("group", "lo", "hi").applyInPandas(compare, "a long, b long")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node in links (a, b), the component named by its smallest node.

    Each round joins every node to its smallest neighbour and contracts the links, which at least halves the nodes
    that still have any; rounds are written out, and nothing is collected.
    """
    scratch = scratch or Scratch()
    label = None
    edges = scratch(links.select("a", "b").filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).withColumnRenamed("a", "node"), "up")
        label = up.withColumnRenamed("up", "component") if label is None else label.join(up.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = scratch(label, "label")
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = scratch(edges.join(x, "a").join(y, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def text_classes(mine: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, kept) of every distinct text of (doc_id, text, key): its class and the key of the class's smallest id."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")
    scratch = Scratch()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            at = 0
            for ids, texts in slices(iter([batch]), SIGN_CHARS):
                owner, h, times = shingles(texts, shingle)
                size = np.bincount(owner, weights=times, minlength=len(texts)).astype(np.int64)
                keyed = band_keys(signatures(owner, h, times, len(texts), bands * rows), bands, rows).view(np.int64)
                full = np.zeros(len(texts), np.int64)
                full[owner] = bands
                offsets = np.concatenate(([0], np.cumsum(full))).astype(np.int32)
                values = pa.array(keyed[full > 0].reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), keys.slice(at, len(ids)), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "key", "size", "bands"])
                at += len(ids)

    signed = mine.mapInArrow(sign, "doc_id long, key binary, size long, bands array<long>")
    folded = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = scratch(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")

    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    crowd = members.groupBy("bucket").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes")).filter("n > 1")
    crowded = scratch(members.join(crowd, "bucket"), "crowded")

    # the multisets and short signatures of nodes that share a bucket, one text for each
    needed = scratch(crowded.select("node").distinct().join(nodes.select("node", "key", "rep"), "node"), "needed")
    wanted = _key_filter(needed)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(3).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            at = 0
            for ids, texts in slices(iter([batch]), SIGN_CHARS):
                names = signatures(*shingles(texts, shingle), len(texts), bands * rows)
                short = short_signatures(names, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2).slice(at, len(ids)), pa.array(occurrence_sets(texts, shingle), pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "key", "grams", "short"])
                at += len(ids)

    spotted = mine.withColumn("bit", F.pmod(F.xxhash64("key"), F.lit(len(wanted) * 8)).cast("int")).mapInArrow(gather, "doc_id long, key binary, grams binary, short binary")
    n = needed.select("node", F.col("key").alias("k"), "rep")
    one = spotted.join(n, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "grams", "short")
    sets = scratch(one.dropDuplicates(["node"]), "sets")
    grams = sets.select("node", "grams")

    links = tested = label = None
    for turn in range(STAR_ROUNDS):
        open_ = _open_buckets(crowded, label, scratch)
        centre = open_.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket", F.lit(turn))).alias("centre"), F.min_by("component", F.xxhash64("node", "bucket", F.lit(turn))).alias("theirs"))
        pairs = open_.join(centre, "bucket").filter("component <> theirs").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        pairs = scratch(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _verified(pairs, grams, threshold)
        links = scratch(found if links is None else links.unionByName(found), "links")
        label = components(links, scratch)

    # what is left: members of different components in one bucket, compared inside the tasks, block by block
    open_ = _open_buckets(crowded, label, scratch).join(sets, "node")
    more = scratch(_bucket_links(open_, bands, rows, threshold).distinct(), "more")
    if not more.isEmpty():
        label = components(links.unionByName(more), scratch)

    classes = nodes.select("node", "key", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = classes.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "key")).alias("best"))
    return scratch.keep(classes.join(best, "component").select("key", F.col("best.rep").alias("class_id"), F.col("best.key").alias("kept")), "classes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the smallest doc_id of its class. Options as for text_classes."""
    mine = id_text(docs, id_col, text_col).withColumn("key", _text_key())
    return mine.select("doc_id", "key").join(text_classes(mine, **options), "key").select("doc_id", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row of each class, with all columns: the row of its smallest id (of its least key, if several texts of the
    class have that id; of rows alike in both, any)."""
    mine = id_text(docs, id_col, text_col).withColumn("key", _text_key())
    own, key, ident = spare(docs, "own", "key", "id")
    kept = text_classes(mine, **options).filter("key = kept").select(F.col("key").alias(key), F.col("class_id").alias(ident))
    here = docs.withColumn(own, _text_key(text_col))
    match = (here[own] == kept[key]) & here[id_col].cast("long").eqNullSafe(kept[ident])
    return here.join(kept, match, "left_semi").dropDuplicates([own]).drop(own)
