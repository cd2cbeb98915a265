"""Bounded-space online packing of token sequences.

Each input partition keeps a fixed number of open windows. A document's tokens are cut into whole windows, which close
at once, and a rest that goes to the open window it fits best; where none fits and all places are taken, the fullest
window is emitted. What is still open at a partition's end is merged over groups of partitions, largest piece first.
Tokens never leave the task that made them: only piece descriptions (some fifty bytes each) are written and merged.

Edge cases: a null text is empty and yields one piece, the end id; every row is packed, repeated ids and texts
included; extra columns are ignored; tables without rows give none.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, slices

WINDOW = 2048
OPEN_WINDOWS = 256
END_ID = 1
#: Partitions whose leftovers are merged together.
MERGE_FAN_IN = 64
#: Texts are encoded in slices of this many characters.
ENCODE_CHARS = 2_000_000
#: Words whose ids a Python worker keeps from slice to slice, some 50 bytes each.
KNOWN_WORDS = 400_000
_UNUSUAL_SPACE = re.compile(r"\s\s")
#: A full stop or comma after one of these letters is always a piece of its own.
_CLOSED = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}][.,]$"
_JOINED, _BATCH = 64, 16_384


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + lengths[k] - 1 of all k, in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Ids of a byte-level BPE file for a slice of texts, each distinct word encoded once.

    The pre-tokeniser always begins a new piece at a single space between other characters, so texts without two
    white-space characters in a row are encoded word by word; others go to the tokenizer whole. Distinct words are joined
    by spaces and encoded together: the ids whose bytes begin with a space are where words begin.
    """

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # the byte 32 in such files
        self.closers = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"}  # a byte is one id
        self.most = KNOWN_WORDS
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text's."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), _JOINED):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + _JOINED], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(len(ids[-1]))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words with a space before each, and the number of each word's; words don't end in white space."""
        ids = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), _BATCH):
            joined = [" " + " ".join(words[k : k + _JOINED]) for k in range(at, min(at + _BATCH, len(words)), _JOINED)]
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(ids)
        first = np.flatnonzero(self.begins[flat])
        if len(first) != len(words):
            raise ValueError("this tokenizer doesn't begin a piece at each space")
        return flat, np.diff(np.append(first, len(flat)))

    def _stems(self, stems: pa.LargeStringArray) -> np.ndarray:
        """The places of distinct words in the tables, to which new ones are added."""
        if len(self.known) > self.most:
            self._forget()
        at = pc.index_in(stems, value_set=self.known)
        new = stems.filter(at.is_null())
        words = new.to_pylist()
        alone = np.array([not w or w[-1].isspace() for w in words], bool)
        for these, encode in ((~alone, lambda w: self._words(w)), (alone, lambda w: self._each([" " + x for x in w]))):
            if these.any():
                new_ids, sizes = encode([w for w, t in zip(words, these.tolist(), strict=True) if t])
                self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
                self.ids, self.sizes = np.concatenate((self.ids, new_ids)), np.concatenate((self.sizes, sizes))
                self.known = pa.concat_arrays([self.known, new.filter(pa.array(these))])
        place = np.empty(len(new), np.int64)
        base = len(self.known) - len(new)
        place[~alone], place[alone] = base + np.arange((~alone).sum()), base + (~alone).sum() + np.arange(alone.sum())
        out = at.fill_null(0).to_numpy().astype(np.int64)
        out[at.is_null().to_numpy(zero_copy_only=False)] = place
        return out

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        each, flat = np.diff(split.offsets.to_numpy()), split.flatten()
        first = np.cumsum(each) - each  # a text's first word stands without a space
        later = np.ones(len(flat), bool)
        later[first] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        heads = flat.take(pa.array(first)).dictionary_encode()
        words = coded.dictionary
        closed = pc.match_substring_regex(words, _CLOSED)
        stems = pc.if_else(closed, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        stem = self._stems(stems.dictionary)[stems.indices.to_numpy()]
        mark = np.array([self.closers["."], self.closers[","]])[pc.ends_with(words, ",").to_numpy(zero_copy_only=False).astype(np.int64)]
        closed = closed.to_numpy(zero_copy_only=False)
        # the slice's own table: words with their closing marks, then first words
        sizes = self.sizes[stem]
        ids = np.insert(self.ids[_gather(self.starts[stem], sizes)], np.cumsum(sizes)[closed], mark[closed])
        head_ids, head_sizes = self._each(heads.dictionary.to_pylist())
        ids, sizes = np.concatenate((ids, head_ids)), np.concatenate((sizes + closed, head_sizes))
        starts = np.cumsum(sizes) - sizes
        which = np.empty(len(flat), np.int64)
        which[first], which[later] = len(words) + heads.indices.to_numpy(), coded.indices.to_numpy()
        lengths = sizes[which]
        per_text = np.add.reduceat(lengths, first) if len(first) else np.zeros(0, np.int64)
        return ids[_gather(starts[which], lengths)], per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin, with the end of the last."""
        whole = np.array([_UNUSUAL_SPACE.search(t) is not None for t in texts], bool)
        a, n_a = self._each([t for t, w in zip(texts, whole.tolist(), strict=True) if w])
        b, n_b = self._by_word([t for t, w in zip(texts, whole.tolist(), strict=True) if not w])
        sizes, starts = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        sizes[whole], sizes[~whole] = n_a, n_b
        starts[whole], starts[~whole] = np.cumsum(n_a) - n_a, len(a) + np.cumsum(n_b) - n_b
        ids = b if not len(a) else a if not len(b) else np.concatenate((a, b))[_gather(starts, sizes)]
        return ids, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


class OpenWindows:
    """Best fit over a bounded number of windows."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit, self.next = size, limit, 0
        self.free: list[tuple[int, int]] = []  # (room, window), ascending

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece shorter than a window."""
        k = bisect.bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, window = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                self.free.pop(0)
            room, window = self.size, self.new()
        if room > length:
            bisect.insort(self.free, (room - length, window))
        return window, self.size - room


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: where its ids begin in the document and in which sequence they lie."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    names = [x.split()[0] for x in _PIECE.split(", ")] + ["part", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(path)
        part = TaskContext.get().partitionId()
        windows = OpenWindows(window, open_windows)
        held: dict[int, list[tuple]] = {}  # pieces of windows that are open
        done: list[tuple] = []

        def batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = [np.array(c, np.int64) for c in zip(*[r[1:] for r in rows], strict=True)] or [np.zeros(0, np.int64)] * 6
            ids = pa.array([r[0] for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols), pa.array(np.full(len(rows), part, np.int64)), pa.array(np.full(len(rows), is_open))], names=names)

        for ids, texts in slices(batches, ENCODE_CHARS, 1 << 20):
            tokens, cuts = words.encode(texts)
            data = memoryview(np.insert(tokens, cuts[1:], end_id).astype("<u4", copy=False)).cast("B")
            at = 0
            for i, n in zip(ids, (np.diff(cuts) + 1).tolist(), strict=True):
                for a in range(0, n, window):
                    length = min(window, n - a)
                    crc = zlib.crc32(data[4 * (at + a) : 4 * (at + a + length)])
                    w, offset = (windows.new(), 0) if length == window else windows.place(length)
                    row = (i, a, length, crc, n, (part << 32) + w, offset)
                    if length == window:
                        done.append(row)
                    else:
                        held.setdefault(w, []).append(row)
                at += n
            still = {w for _, w in windows.free}
            for w in [w for w in held if w not in still]:
                done += held.pop(w)
            if done:
                yield batch(done, False)
                done = []
        if held:
            yield batch([r for rows in held.values() for r in rows], True)

    pieces = materialise(id_text(docs, id_col, text_col).mapInArrow(run, f"{_PIECE}, part long, open boolean"), "pieces")
    columns = [c for c in names[:-2]]

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        windows = OpenWindows(window, len(group))
        placed = [windows.place(int(n)) for n in group["length"]]
        group["sequence_id"] = [(1 << 62) + (int(key[0]) << 32) + w for w, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group[columns]

    left = pieces.filter("open").withColumn("merge", F.expr(f"part div {MERGE_FAN_IN}"))
    return pieces.filter("not open").select(columns).unionByName(left.groupBy("merge").applyInPandas(merge, _PIECE))
