"""Removal of byte strings that already occur in a document of smaller id, by blockwise suffix sorting.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller id. Strings
are judged on the input. The corpus is never sorted as one text:

1. Entries. Documents are dealt to groups of some megabytes by hash. Of every window of 50 bytes, the least-hashed
   24-byte string within is its anchor; equal windows have equal anchors, so only windows whose anchor occurs in two
   documents matter (exact: nothing is lost). A run of windows with one anchor is an entry: the anchor's hash, the hash
   of all bytes the run covers, and the smallest id that has them. Entries are dealt to partitions by anchor, as packed
   arrays, one for each group and different bytes; a partition replies which bytes a smaller id holds elsewhere, and
   which have to be sorted, as other bytes have the same anchor.
2. Suffix buckets. The bytes to sort are sent once for each distinct string, by its smallest id. A partition sorts
   one bucket of suffixes at a time: suffixes go by their first bytes; ties are resolved by ranks of a difference-cover
   sample, computed beforehand for the bucket, as for any two suffixes there is a small shift that puts both on the sample.
   Neighbours in order that share 50 bytes are equal windows; the smallest document of each run keeps its own.
3. Each group's ranges are gathered and cut out.

Equal texts are folded in their group, equal surroundings of an anchor (by 64-bit hash, beside 32 bits of the anchor's
and its partition) in all groups, so what a hot passage sends grows with the number of groups, not of copies, and is
sorted once. Long texts are worked on in overlapping pieces. Edge cases: a null text is empty; a null id counts as
larger than all others (as equal to the largest possible id, should that occur); rows that share an id never remove each
other's bytes; texts under 50 bytes stay; extra columns are ignored; tables without rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

LENGTH = 50
GRAM = 24
PART_BYTES = 12_000_000
GROUP_BYTES = 4_000_000
BUCKET_WINDOWS = 1_000_000
SLICE_BYTES = 1_000_000
_PLACE_BITS = 23
_LAST = (1 << 63) - 1
_U = np.uint64

# ---------------------------------------------------------------------------------------------------------------
# Suffix sorting with a difference cover

#: A perfect difference cover - every difference modulo 13 is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
_IN_COVER = np.full(PERIOD, -1)
_IN_COVER[list(COVER)] = np.arange(len(COVER))
#: The least shift that puts positions of two residues both on the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
_PAD = 6 * PERIOD


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each position on, as numbers in the order of the bytes."""
    data = np.frombuffer(text + bytes(_PAD + 8), np.uint8)
    out = np.zeros(len(data) - 7, _U)
    for k in range(8):
        out |= data[k : len(data) - 7 + k].astype(_U) << _U(56 - 8 * k)
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks, from 0, by the first key, then the next; equal keys get equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks, by their first 52 bytes, of the suffixes at cover positions below n + 13: row k * 4 + j is position 13k + COVER[j]."""
    blocks = n // PERIOD + 2
    at = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).reshape(-1)
    at = np.minimum(at, len(words) - 9)
    rank = _dense(words[at], words[at + 5])  # thirteen bytes
    for step in (1, 2):
        later = np.concatenate((rank[step * len(COVER) :] + 1, np.zeros(step * len(COVER), np.int64)))
        rank = _dense(rank * (len(rank) + 2) + later)
    return rank


def sort_suffixes(words: np.ndarray, ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """positions in the order of at least their first 52 bytes."""
    order = np.lexsort((words[positions + 5], words[positions]))
    pos = positions[order]
    a, b = words[pos], words[pos + 5]
    new = np.ones(len(pos), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)
    live = np.flatnonzero(size[group] > 1)  # places in pos whose tie is not resolved
    rng = np.random.default_rng(0)
    while len(live):  # quicksort of all ties at once: a pivot each, three parts
        g = group[live]
        first = np.ones(len(live), bool)
        first[1:] = g[1:] != g[:-1]
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(live)))
        pick = begin + (rng.random(len(begin)) * count).astype(np.int64)
        which = np.cumsum(first) - 1
        mine, pivot = pos[live], pos[live[pick]][which]
        d = SHIFT[pivot % PERIOD, mine % PERIOD]
        side = np.sign(ranks[_row(mine + d)] - ranks[_row(pivot + d)])
        by = np.argsort(which * 3 + side + 1, kind="stable")
        pos[live] = mine[by]
        side = side[by]
        start = np.ones(len(live), bool)
        start[1:] = (which[1:] != which[:-1]) | (side[1:] != side[:-1])
        part = np.cumsum(start) - 1
        group[live] = live[np.flatnonzero(start)][part]
        live = live[(side != 0) & (np.bincount(part)[part] > 1)]
    return pos


def _row(at: np.ndarray) -> np.ndarray:
    return at // PERIOD * len(COVER) + _IN_COVER[at % PERIOD]


def suffix_array(text: bytes) -> np.ndarray:
    """All suffixes of a short text in the order of their first 52 bytes, one bucket of leading bytes at a time."""
    words = _words(text)
    ranks = cover_ranks(words, len(text))
    lead = np.frombuffer(text, np.uint8)
    by_lead = np.argsort(lead, kind="stable")
    cuts = np.searchsorted(lead[by_lead], np.arange(257))
    return np.concatenate([sort_suffixes(words, ranks, by_lead[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a] or [np.zeros(0, np.int64)])


def repeated(text: bytes, positions: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether its first `length` (at most 52) bytes also stand at a position of a smaller owner."""
    words = _words(text)
    by = np.argsort(positions, kind="stable")
    order = sort_suffixes(words, cover_ranks(words, len(text)), positions)
    own = owner[by][np.searchsorted(positions[by], order)]
    same = np.ones(len(order), bool)
    for o in [*range(0, length - 7, 8), length - 8]:
        w = words[order + o]
        same[1:] &= w[1:] == w[:-1]
    same[0] = False
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(own, starts)[np.cumsum(~same) - 1]
    out = np.zeros(len(order), bool)
    out[by[np.searchsorted(positions[by], order)]] = own > least
    return out


# ---------------------------------------------------------------------------------------------------------------
# Anchors


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base, np.ones(1, _U))
    while len(have) < n:
        have = np.concatenate((have, have * _U(pow(base, len(have), 1 << 64))))
    _powers[base] = have
    return have[:n]


def anchors(blobs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, name, context) of each run of a text's windows that share an anchor: the anchor's
    hash, and the hash of all bytes that the run's windows cover."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    if not (sizes >= length).any():
        empty, none = np.zeros(0, np.int64), np.zeros(0, _U)
        return empty, empty, empty, none, none
    data = np.frombuffer(b"".join(blobs) + bytes(length + 8), np.uint8)
    m = _mix(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)) + _U(0x9E3779B97F4A7C15))
    grams = n + length - gram
    h = m[:grams].copy()
    for k in range(8, gram, 8):
        h *= _U(0xC2B2AE3D27D4EB4F)
        h += m[k : k + grams]
    h = _mix(h)
    # the least of each window: hashes with places in their low bits, so that ties go to the leftmost
    if grams >> _PLACE_BITS:
        raise ValueError("too many bytes at once")
    bits = _U(_PLACE_BITS)
    best = h >> bits << bits | np.arange(grams, dtype=_U)
    span, wide = 1, length - gram + 1
    while span < wide:
        step = min(span, wide - span)
        best = np.minimum(best[step:], best[:-step])
        span += step
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), sizes)
    ok = np.flatnonzero(np.arange(n) + length <= np.repeat(begin + sizes, sizes))
    where, text = best[ok], owner[ok]  # equal hashes with places: the same anchor
    new = np.ones(len(ok), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(new)
    text, first = text[runs].astype(np.int64), ok[runs]
    windows = np.diff(np.append(runs, len(ok)))
    place = (where[runs] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data[:n]] * _power(_BASE, n), out=sums[1:])
    covered = (sums[first + windows + length - 1] - sums[first]) * _power(pow(_BASE, -1, 1 << 64), n)[first]
    return text, first - begin[text], windows, _mix(h[place] ^ _U(0x5851F42D4C957F2D)), _mix(covered + windows.astype(_U))


# ---------------------------------------------------------------------------------------------------------------
# Groups of documents, partitions of anchors


class Group:
    """The documents of one group, in the order of ids, and the entries of their runs: runs of equal anchor and equal
    covered bytes are one entry, held by the smallest id among them. The same rows always give the same entries."""

    def __init__(self, table: pa.Table, length: int) -> None:
        ids, none, tags = (table.column(c).to_numpy() for c in ("doc_id", "none", "tag"))
        order = np.lexsort((tags, none, ids))
        texts = table.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        self.ids, self.none, self.length = ids[order], none[order], length
        self.blobs: list[bytes] = [texts[k] for k in order.tolist()]
        first: dict[bytes, int] = {}
        self.same = np.array([first.setdefault(b, r) for r, b in enumerate(self.blobs)], np.int64)  # the first row of this text

    def slices(self) -> Iterator[list[tuple[int, int, bytes]]]:
        """(row, offset, bytes) of distinct texts, some SLICE_BYTES at a time; longer texts in pieces that share length - 1 bytes."""
        out, n = [], 0
        for r in np.flatnonzero(self.same == np.arange(len(self.same))).tolist():
            blob = self.blobs[r]
            for at in range(0, max(1, len(blob) - self.length + 1), SLICE_BYTES):
                out.append((r, at, blob[at : at + SLICE_BYTES + self.length - 1]))
                n += len(out[-1][2])
                if n >= SLICE_BYTES:
                    yield out
                    out, n = [], 0
        if out:
            yield out

    def enter(self, parts: int) -> None:
        """Find the runs (row, start, windows, entry) and the entries (part, key, context, holder)."""
        found = []
        for pieces in self.slices():
            text, start, windows, name, context = anchors([b for _, _, b in pieces], self.length)
            found.append((np.array([r for r, _, _ in pieces])[text], start + np.array([o for _, o, _ in pieces])[text], windows, name, context))
        row, start, windows, name, context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        name, context = name.astype(_U), context.astype(_U)
        part, bits = name % _U(parts), _U(parts.bit_length())
        order = np.argsort(part << (_U(64) - bits) | _mix(name ^ context * _U(0x9E3779B97F4A7C15)) >> bits, kind="stable")
        name, context, part = name[order], context[order], part[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (context[1:] != context[:-1])
        lead = np.flatnonzero(new)
        self.row, self.start, self.windows = row[order], start[order], windows[order]
        self.entry, self.lead = np.cumsum(new) - 1, lead
        self.key, self.context = (name[lead] // _U(parts) & _U(0xFFFFFFFF)).astype(np.uint32), context[lead]
        self.holder = self.ids[self.row[lead]]  # rows ascend within an entry, so the first has the smallest id
        self.cuts = np.searchsorted(part[lead], np.arange(parts + 1).astype(_U))


def _packed(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def _schema(ints: str, binaries: str) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in ints.split()] + [(c, pa.binary()) for c in binaries.split()])


_ENTRIES = _schema("p g", "keys contexts ids")
_REPLIES = _schema("g p", "at flags")
_CONTEXTS = _schema("p g", "text sizes keys ids counts rows starts")
_MARKS = _schema("g", "rows starts ends")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _joined(arrays: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(arrays), kind)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return _joined(table.column(name).to_pylist(), kind)


def replies(p: int, table: pa.Table) -> pa.Table:
    """What each group has to do with its entries: 1 - another group holds the same bytes under a smaller id, so they go
    everywhere; 2 - other bytes have the same anchor, so they have to be sorted; no reply - nothing."""
    keys, contexts, ids = _column(table, "keys", "u4"), _column(table, "contexts", "u8"), _column(table, "ids", "i8")
    count = np.array([len(x) // 4 for x in table.column("keys").to_pylist()], np.int64)
    by = np.argsort(keys, kind="stable")
    alike = np.zeros(len(keys), bool)
    equal = keys[by][1:] == keys[by][:-1]
    alike[1:] = equal
    alike[:-1] |= equal
    by = by[alike]
    by = by[np.lexsort((ids[by], contexts[by], keys[by]))]
    k, c, i = keys[by], contexts[by], ids[by]
    out: dict[str, list] = {n: [] for n in _REPLIES.names}
    if len(by):
        new_key = np.append(True, k[1:] != k[:-1])
        new_context = new_key | np.append(True, c[1:] != c[:-1])
        of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new_context) - 1
        least = i[new_context][of_context]
        starts = np.flatnonzero(new_key)
        two_ids = np.minimum.reduceat(i, starts) < np.maximum.reduceat(i, starts)
        several = (np.add.reduceat(new_context.astype(np.int64), starts) > 1) & two_ids
        flag = np.where(i > least, 1, np.where(several[of_key], 2, 0)).astype(np.uint8)
        said = flag > 0
        at, flag = by[said], flag[said]
        order = np.argsort(at, kind="stable")
        at, flag = at[order], flag[order]
        ends = np.cumsum(count)
        src = np.searchsorted(ends, at, side="right")
        local = (at - (ends - count)[src]).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else [], len(src)).astype(np.int64)
        groups = table.column("g").to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for n, v in zip(_REPLIES.names, (int(groups[src[a]]), p, local[a:b].tobytes(), flag[a:b].tobytes()), strict=True):
                out[n].append(v)
    return _packed(out, _REPLIES)


def surroundings(g: int, group: Group, said: pa.Table, parts: int) -> pa.Table:
    """What is known to go, and the bytes of the entries that have to be sorted, for their partitions."""
    flags = np.zeros(len(group.lead), np.uint8)
    for p, at, flag in zip(*(said.column(c).to_pylist() for c in ("p", "at", "flags")), strict=True):
        flags[group.cuts[p] + np.frombuffer(at, np.uint32).astype(np.int64)] = np.frombuffer(flag, np.uint8)
    mine, holder = group.ids[group.row], group.holder[group.entry]
    goes = (flags[group.entry] == 1) | (mine > holder)
    out: dict[str, list] = {n: [] for n in _CONTEXTS.names}

    def put(*values: object) -> None:
        for n, v in zip(_CONTEXTS.names, values, strict=True):
            out[n].append(v)

    if goes.any():
        row, a, b = merged_by_row(group.row[goes], group.start[goes], group.start[goes] + group.windows[goes] + group.length - 1)
        put(g % parts, g, b"", b"", b"", b"", b.astype(np.uint32).tobytes(), row.astype(np.uint32).tobytes(), a.astype(np.uint32).tobytes())
    ask = np.flatnonzero(flags == 2)
    which = np.searchsorted(group.cuts, ask, side="right") - 1
    runs = np.append(group.lead, len(group.row))
    for p in np.unique(which).tolist():
        entries = ask[which == p]
        texts, counts, rows, starts = [], [], [], []
        for e in entries.tolist():
            lo, hi = runs[e], runs[e + 1]
            kept = lo + np.flatnonzero(~goes[lo:hi])
            r, s = int(group.row[lo]), int(group.start[lo])
            texts.append(group.blobs[r][s : s + int(group.windows[lo]) + group.length - 1])
            counts.append(len(kept))
            rows.append(group.row[kept])
            starts.append(group.start[kept])
        u4 = [np.array([len(t) for t in texts], np.uint32), group.key[entries], np.array(counts, np.uint32), np.concatenate(rows).astype(np.uint32), np.concatenate(starts).astype(np.uint32)]
        sizes, keys, counts_, rows_, starts_ = (x.tobytes() for x in u4)
        put(p, g, pa.compress(b"".join(texts), codec="zstd", asbytes=True), sizes, keys, group.holder[entries].tobytes(), counts_, rows_, starts_)
    return _packed(out, _CONTEXTS)


def sorted_marks(table: pa.Table, length: int) -> pa.Table:
    """The ranges that go, by group: those known already, and those that sorting a partition's bytes finds."""
    known = pc.equal(pc.binary_length(table.column("sizes")), 0)
    there = table.filter(known)
    out = {"g": there.column("g").to_pylist(), "rows": there.column("rows").to_pylist(), "starts": there.column("starts").to_pylist(), "ends": there.column("counts").to_pylist()}
    table = table.filter(pc.invert(known))
    if table.num_rows:
        context, a, b = _covered(table, length)
        group = np.repeat(table.column("g").to_numpy(), [len(x) // 4 for x in table.column("sizes").to_pylist()])
        count, rows, starts = (_column(table, c, "u4").astype(np.int64) for c in ("counts", "rows", "starts"))
        times = count[context]
        rep = np.repeat(np.arange(len(context)), times)
        at = (np.cumsum(count) - count)[context][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
        g, row, a, b = group[context][rep], rows[at], starts[at] + a[rep], starts[at] + b[rep]
        by = np.argsort(g, kind="stable")
        g, row, a, b = g[by], row[by], a[by], b[by]
        cuts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else [], len(g)).astype(np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            r, s, e = merged_by_row(row[x:y], a[x:y], b[x:y])
            for n, v in zip(_MARKS.names, (int(g[x]), *(z.astype(np.uint32).tobytes() for z in (r, s, e))), strict=True):
                out[n].append(v)
    return _packed(out, _MARKS)


def _covered(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the ranges that go of one partition's contexts, a bucket of anchors at a time."""
    sizes, keys, ids = _column(table, "sizes", "u4").astype(np.int64), _column(table, "keys", "u4"), _column(table, "ids", "i8")
    n_text = [int(np.frombuffer(x, "u4").sum(dtype=np.int64)) for x in table.column("sizes").to_pylist()]
    text = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(table.column("text").to_pylist(), n_text, strict=True))
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    total = np.cumsum((sizes - length + 1)[order])
    out = [(np.zeros(0, np.int64),) * 3]
    at = 0
    while at < len(order):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + BUCKET_WINDOWS, side="right"))
        end = max(end, at + 1)
        while end < len(order) and keys[order[end]] == keys[order[end - 1]]:
            end += 1
        mine = order[at:end]
        at = end
        block = b"".join(text[begin[m] : begin[m] + sizes[m]] for m in mine)
        n = sizes[mine] - length + 1
        offset = np.cumsum(sizes[mine]) - sizes[mine]
        which = np.repeat(np.arange(len(mine)), n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        goes = repeated(block, offset[which] + j, ids[mine][which], length)
        which, j = which[goes], j[goes]
        if not len(which):
            continue
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (j[1:] != j[:-1] + 1)
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(which)) - 1
        out.append((mine[which[lead]], j[lead], j[last] + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged_by_row(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges (row, start, end), by row and start."""
    if not len(row):
        return row, a, b
    by = np.lexsort((a, row))
    row, a, b = row[by], a[by], b[by]
    shift = row * (int(b.max()) + 1)  # rows lie apart on one line
    reach = np.maximum.accumulate(b + shift)
    new = np.append(True, (a + shift)[1:] > reach[:-1])
    new[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    return row[at], a[at], (reach - shift)[np.append(at[1:], len(row)) - 1]


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(group: Group, marks: pa.Table) -> pa.Table:
    """One row per document of a group."""
    row, a, b = merged_by_row(*(_column(marks, c, "u4").astype(np.int64) for c in _MARKS.names[1:]))
    cuts = np.searchsorted(row, np.arange(len(group.blobs) + 1))
    rows = []
    for r, (blob, first) in enumerate(zip(group.blobs, group.same.tolist(), strict=True)):
        if group.ids[r] > group.ids[first] and len(blob) >= group.length:  # a later copy
            kept, removed, spans = b"", len(blob), 1
        else:  # rows of one id and text share their ranges
            x, y = a[cuts[first] : cuts[first + 1]].tolist(), b[cuts[first] : cuts[first + 1]].tolist()
            kept = b"".join(blob[i:j] for i, j in zip([0, *y], [*x, len(blob)], strict=True))
            removed, spans = len(blob) - len(kept), len(x)
        rows.append((None if group.none[r] else int(group.ids[r]), len(blob), removed, spans, hashlib.sha256(kept).hexdigest()))
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.table({n: pa.array(c, pa.string() if n == names[-1] else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: its bytes, how many go in how many maximal runs, and the hash of what is left.

    length: 32 to 52 bytes.
    """
    if not 32 <= length <= 52:
        raise ValueError("length must be from 32 to 52")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    ident = docs[id_col].cast("long")
    mine = docs.select(F.coalesce(ident, F.lit(_LAST)).alias("doc_id"), ident.isNull().alias("none"), F.xxhash64(text).alias("tag"), text.alias("text"))
    total = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, groups = max(8, -(-total // PART_BYTES)), max(8, -(-total // GROUP_BYTES))
    placed = mine.withColumn("g", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(groups)))

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        g, group = key[0].as_py(), Group(table, length)
        group.enter(parts)
        out: dict[str, list] = {n: [] for n in _ENTRIES.names}
        for p in np.flatnonzero(np.diff(group.cuts)).tolist():
            x = slice(group.cuts[p], group.cuts[p + 1])
            for n, v in zip(_ENTRIES.names, (p, g, group.key[x].tobytes(), group.context[x].tobytes(), group.holder[x].tobytes()), strict=True):
                out[n].append(v)
        return _freed(_packed(out, _ENTRIES))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return _freed(replies(key[0].as_py(), table))

    def surround(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        group = Group(table, length)
        group.enter(parts)
        return _freed(surroundings(key[0].as_py(), group, said, parts))

    def sort_part(table: pa.Table) -> pa.Table:
        return _freed(sorted_marks(table, length))

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        return cut(Group(table, length), marks)

    entries = placed.groupBy("g").applyInArrow(deal, _ddl(_ENTRIES))
    said = entries.groupBy("p").applyInArrow(ask, _ddl(_REPLIES))
    contexts = placed.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(surround, _ddl(_CONTEXTS))
    marks = contexts.groupBy("p").applyInArrow(sort_part, _ddl(_MARKS))
    return placed.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(finish, _OUT)


def _freed(table: pa.Table) -> pa.Table:
    tidy()
    return table
