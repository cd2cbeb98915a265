"""Toxicity: noisy-channel restoration of disguised words, then a linear score of the restored text.

Three steps. (1) A character trigram model is counted over all documents (one pass, 27^3 counts whatever the corpus).
(2) Disguised words - signs and digits for letters, letters spelled out with spaces or signs between them, stretched
letters - become lattices of what each character may stand for; Viterbi search under the character model restores them,
a batch of lattices at a time. Every word with a sign next to a letter or to another sign, or three equal letters in a row takes this
way, whatever its length and other characters, numbers included; letters beyond a-z pass as themselves, under the model
as their base letter. Left alone are words in which no character stands for another: plain ones, and a lone sign. (3) A logistic model over words and word beginnings, of the plain and the restored words,
scores the text. It is fitted on the driver from a bounded sample of labelled rows (``max_train``, 8,000 documents), of
which only those beginnings and words are kept that labels tell apart.

Scoring is a map over rows. Edge cases: null and empty texts get the score of no words; documents without a label are
scored like others; null labels and null ids teach nothing; with labels of one kind only, or none, the score is the
labelled share of toxic rows (0 without any); repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_slices, held_out_remainder, id_text, slices, tidy

MAX_TRAIN = 8000
N_CHARS = 27  # a-z from 1; 0 is everything else
_STRIP = ".,;:!?\"'()[]{}<>%*&$#|-_=+~`^/\\@"
_CACHE_WORDS = 150_000

#: What signs may stand for, in the order of likelihood.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e"}

_SIGN = "".join(map(re.escape, SIGNS))
_LETTER = r"[^\W\d_]"
_DISGUISED = re.compile(rf"{_LETTER}[{_SIGN}]|[{_SIGN}]{_LETTER}|({_LETTER})\1\1|[{_SIGN}]{{2}}")
_ONE = rf"(?:[^\W_]|[{_SIGN}])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_ONE}(?:[.\-_*]| {{1,2}})){{3,}}{_ONE}(?![^\W_])")
_STRETCHED = re.compile(r"(.)\1{3,}")
_PART = re.compile(rf"{_ONE}+")
_PIECE, _STEP = 64, 32

def _base_letters() -> dict[int, str]:
    out = dict(zip(map(ord, "ßæøœłđ"), "saoold", strict=True))
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        x = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= x <= "z":
            out[c] = x
    return out


#: Letters beyond a-z: the letter that the character model takes them for. Others count as a boundary.
_BASE = _base_letters()
_CHAR = np.zeros(1 << 16, np.int16)  # of each UTF-16 unit
for _c in range(26):
    _CHAR[[65 + _c, 97 + _c]] = _c + 1
for _c, _x in _BASE.items():
    _CHAR[_c] = ord(_x) - 96


#: UTF-16 units that may stand beside others in a word: letters, digits (surrogates as well) and signs.
_JOINS = np.array([chr(c).isalnum() or 0xD800 <= c < 0xE000 or chr(c) in SIGNS for c in range(1 << 16)])


# ---------------------------------------------------------------------------------------------------------------
# The character model


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of three characters in a row, texts joined by a boundary."""
    c = _CHAR[np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-16-le", "surrogatepass"), "<u2")].astype(np.int32)
    return np.bincount(c[:-2] * (N_CHARS * N_CHARS) + c[1:-1] * N_CHARS + c[2:], minlength=N_CHARS**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of c after a and b, from all rows; the counts of each partition are summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CHARS**3, np.int64)
        for _, texts in slices(batches, 500_000):
            total += trigram_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(N_CHARS**3)
    for gram, n in docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # 27^3 rows at most
        counts[gram] = n
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    c3 = counts.reshape(N_CHARS, N_CHARS, N_CHARS)
    c2, c1 = c3.sum(0), c3.sum((0, 1)) + 1
    p1 = c1 / c1.sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)).astype(np.float32)


# ---------------------------------------------------------------------------------------------------------------
# Restoration


def _lattice(word: str) -> tuple[list[tuple[tuple[int, float], ...]], list[float]]:
    """For each character: what it may stand for (letter, log-probability), and the log-probability of dropping it."""
    options, drop = [], []
    for k, ch in enumerate(word):
        if "a" <= ch <= "z":
            options.append(((ord(ch) - 96, -0.01),))
        elif ch in SIGNS:
            options.append(tuple((ord(x) - 96, -0.2 - 0.7 * j) for j, x in enumerate(SIGNS[ch])))
        elif ch.isalpha():
            options.append(((ord(_BASE[ord(ch)]) - 96 if ord(ch) in _BASE else 0, -0.01),))
        else:
            options.append(((0, -2.5),))
        if not (ch in SIGNS or ch.isalpha()):
            drop.append(-0.1)
        elif k and word[k - 1] == ch:
            run = len(re.match(re.escape(ch) + "*", word[k:]).group()) + len(word[:k]) - len(word[:k].rstrip(ch))
            drop.append(-0.3 if run > 2 else -6.0)
        else:
            drop.append(-1e9)
    return options, drop


def restore(model: np.ndarray, words: list[str]) -> list[str]:
    """The likeliest plain form of each word, a blank where its lattice holds a boundary, letters beyond a-z as they are.

    Viterbi search over the last two characters kept; only those that the lattice allows are states, a handful at most.
    """
    if not words:
        return []
    logp, square, out = model.ravel().tolist(), N_CHARS * N_CHARS, []
    for word in words:
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for ch, options, d in zip(word, *_lattice(word), strict=True):
            itself = ch > "z" and ch not in SIGNS and ch.isalpha()
            # the tie goes to the kept character, then to the smaller letter
            after = {} if d < -1e8 else {k: (s + d, back) for k, (s, back) in states.items()}
            kept: dict[int, tuple[float, tuple | None]] = {}
            for k, (s, back) in sorted(states.items()) if len(states) > 1 else states.items():
                for c, p in options:
                    to, score = k * N_CHARS + c, s + p
                    score += logp[to]
                    to %= square
                    if to not in kept or score > kept[to][0]:
                        kept[to] = (score, (ch if itself else chr(96 + c) if c else " ", back))
            for to, best in kept.items():
                if to not in after or best[0] >= after[to][0]:
                    after[to] = best
            states = after
        back = states[max(sorted(states), key=lambda k: states[k][0] + logp[k * N_CHARS])][1]
        letters = []
        while back is not None:
            letters.append(back[0])
            back = back[1]
        out.append("".join(reversed(letters)).strip())
    return out


def _pieces(run: str) -> list[str]:
    """A run as it is, or overlapping pieces of a longer one. Four and more equal characters are three: none but the dropped ones differ."""
    run = _STRETCHED.sub(r"\1\1\1", run)
    return [run[a : a + _PIECE] for a in range(0, max(1, len(run) - _PIECE + _STEP), _STEP)]


def _forms(word: str) -> tuple[str, ...]:
    """What a word may hide: itself, without the signs around it, and its parts between other characters."""
    if not _DISGUISED.search(word):
        return ()
    bare = word.strip(".,;:?\"'")
    forms = {bare, bare.strip(_STRIP), *(_PART.findall(bare))}
    return tuple(sorted({x for f in forms if _DISGUISED.search(f) for x in _pieces(f) if _DISGUISED.search(x)}))


def _spelled(lower: str) -> list[str]:
    """The spelled-out runs of a lower-cased text."""
    return [x for m in _SPELLED.finditer(lower) if sum(map(str.isalpha, m.group())) >= 2 for x in _pieces(m.group())]


def _may_spell(texts: list[str]) -> list[bool]:
    """Whether a text has two characters in a row, each alone between separators, as the inner ones of a spelled-out run
    are, or letters beyond the first plane: without, nothing is spelled out."""
    blobs = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) // 2 + 1 for b in blobs])
    units = np.frombuffer(b"\n\0".join(blobs) + b"\n\0" * 5, "<u2")
    apart = ~_JOINS[units]
    alone = np.zeros(len(units), bool)
    alone[1:-1] = apart[:-2] & apart[2:] & ~apart[1:-1]
    n = len(units) - 3
    at = np.flatnonzero((alone[:n] & (alone[2 : n + 2] | alone[3 : n + 3])) | (units[:n] & 0xF800 == 0xD800))
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, at, side="right")] = True
    return out.tolist()


def disguised(lower: str, words: set[str]) -> list[str]:
    """Words and spelled-out runs of a lower-cased text that may hide others. Longer ones are cut into overlapping pieces."""
    return [x for w in words for x in _forms(w)] + _spelled(lower)


# ---------------------------------------------------------------------------------------------------------------
# The linear score


def word_features(w: str) -> tuple[int, ...]:
    """Hashes of a word without signs around it and of its beginnings of four to six letters."""
    if not w:
        return ()
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in [w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k)])


@dataclass
class Model:
    characters: np.ndarray
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    #: Words seen, those of them that have features or may hide others, and what beginnings and lattices gave.
    seen: set[str] = field(default_factory=set)
    plain: dict[str, tuple[int, ...]] = field(default_factory=dict)
    forms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    begins: dict[str, tuple[int, ...]] = field(default_factory=dict)
    hidden: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _kept(self, word: str, keep: dict[int, float] | None) -> tuple[int, ...]:
        """word_features of a word that have a weight; those of beginnings are looked up by the longest."""
        w = word.strip(_STRIP)
        if keep is None:
            return word_features(w)
        first = w[:7]  # tells a word of six letters from a longer one
        begins = self.begins.get(first)
        if begins is None:
            begins = self.begins[first] = tuple(x for x in word_features(first)[1:] if x in keep)
        x = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        return (x, *begins) if x in keep and w else begins

    def features(self, texts: list[str], *, all_kinds: bool = False) -> list[set[int]]:
        """Feature hashes of each text; only those that have a weight, unless all_kinds."""
        keep = None if all_kinds else self.weights
        if max(len(self.seen), len(self.begins), len(self.hidden)) > _CACHE_WORDS:
            self.forget()
        sets, runs, disguises = [], [], _DISGUISED.search
        lowered = [t.lower() for t in texts]
        for lower, spells in zip(lowered, _may_spell(lowered), strict=True):
            ws = set(lower.split())
            for w in ws - self.seen:
                if f := self._kept(w, keep):
                    self.plain[w] = f
                if disguises(w) and (f := _forms(w)):
                    self.forms[w] = f
            self.seen |= ws
            sets.append([self.plain[w] for w in ws & self.plain.keys()])
            runs.append([x for w in ws & self.forms.keys() for x in self.forms[w]] + (_spelled(lower) if spells else []))
        new = sorted({r for rs in runs for r in rs if r not in self.hidden})
        for r, back in zip(new, restore(self.characters, new), strict=True):
            self.hidden[r] = tuple(x for w in {back.replace(" ", ""), *back.split()} for x in self._kept(w, keep))
        return [{x for f in fs for x in f} | {x for r in rs for x in self.hidden[r]} for fs, rs in zip(sets, runs, strict=True)]

    def forget(self) -> None:
        """Empty the word caches."""
        for cache in (self.seen, self.plain, self.forms, self.begins, self.hidden):
            cache.clear()

    def scores(self, texts: list[str]) -> list[float]:
        raw = [self.bias + sum(self.weights[x] for x in sorted(f)) for f in self.features(texts)]
        return (1 / (1 + np.exp(-np.clip(raw, -30, 30)))).tolist()


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, *, least_rows: int = 3, least_z: float = 3.0, steps: int = 200, penalty: float = 0.5) -> tuple[float, dict[int, float]]:
    """Bias and weights of the features that labels tell apart (a two-sample z of least_z), by gradient ascent."""
    n, n1 = len(rows), int(labels.sum())
    share = n1 / n if n else 0.0
    if not n1 or n1 == n:
        return float(np.log((share + 1e-4) / (1 - share + 1e-4))), {}
    ids, at = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    seen, hit = np.bincount(at, minlength=len(ids)), np.bincount(at, weights=labels[row], minlength=len(ids))
    p = seen / n
    z = (hit - n1 * p) / np.sqrt(np.maximum(n1 * (n - n1) / n * p * (1 - p), 1e-9))
    chosen = (seen >= least_rows) & (np.abs(z) > least_z)
    new = np.cumsum(chosen) - 1
    use = chosen[at]
    at, row = np.concatenate((new[at[use]], np.full(n, chosen.sum()))), np.concatenate((row[use], np.arange(n)))
    w, g2 = np.zeros(chosen.sum() + 1), np.full(chosen.sum() + 1, 1e-3)
    for _ in range(steps):
        s = np.bincount(row, w[at], n)
        g = np.bincount(at, (labels - 1 / (1 + np.exp(-s)))[row], len(w))
        g[:-1] -= penalty * w[:-1]
        g2 += g * g
        w += 0.5 * g / np.sqrt(g2)
    return float(w[-1]), dict(zip(ids[chosen].tolist(), w[:-1].tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_train: int = MAX_TRAIN, seed: int = 7) -> Model:
    """docs: (doc_id, text). Labels of rows that the hold-out rule sets aside are never read."""
    model = Model(character_model(docs))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(held_out_remainder() != 0)
    n = known.count()
    if not n:
        return Model(model.characters, bias=float(np.log(1e-4)))
    share = min(1.0, max_train / n)
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.features([t or "" for t in batch.column(0).to_pylist()], all_kinds=True)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([np.array(sorted(f), np.uint32).tobytes() for f in found], pa.binary())], names=["label", "features"])
        model.forget()
        tidy()

    # about max_train rows of two numbers, so it can be broadcast
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "label").mapInArrow(run, "label int, features binary").toPandas()
    model.bias, model.weights = fit_weights([np.frombuffer(x, np.uint32) for x in rows["features"]], rows["label"].to_numpy(float))
    return Model(model.characters, model.bias, model.weights)


_OUT = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: whether its label was set aside, its score and the prediction."""
    mine = id_text(docs, id_col, text_col)
    model = fit(mine, labels, max_train=max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            s = model.scores(texts)
            cols = [pa.array(ids, pa.int64()), pa.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])
        model.forget()

    return mine.mapInArrow(run, _OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns and in all their rows; null and empty texts are
    scored as texts without words, null ids are kept or dropped like others, other columns are not read."""
    model = fit(id_text(docs, id_col, text_col), labels, max_train=max_train)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, at):
            yield batch.filter(pa.array([x < 0.5 for x in model.scores([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))
        model.forget()
        tidy()

    return docs.mapInArrow(run, docs.schema)
