"""Personal data: four pattern kinds, and a linear-chain conditional random field over word shapes for the rest.

The field is trained on the driver from a small labelled table (``LABELLED``, or a caller's own) by gradient
ascent on the exact log-likelihood, and decoded on the executors by Viterbi over whole batches of sentences in
numpy. It is a map over rows: no shuffle, and the model is a few kilobytes whatever the corpus.

Edge cases: a null text is an empty one; texts without spans get zero counts, the hash of the empty string and an
empty span list; rows repeat as given; tables without rows give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_slices, id_text, slices

#: Kinds in output order. The last four come from the random field.
BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("name", "address", "identifier", "secret")
KINDS = BASE_KINDS + MODEL_KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the whole run before it, as no run holds an @."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and not _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the four pattern kinds, by start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            s = m.group()
            if m.end() - m.start() >= 12:
                d = s.replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


# ---------------------------------------------------------------------------------------------------------------
# Word shapes

#: Words that carry meaning beyond their shape, by group.
TITLES = "mr mrs ms miss dr prof herr frau monsieur madame senor senora sr sra"
STREETS = "street st avenue ave road rd lane ln drive boulevard blvd court square strasse platz rue calle plaza"
NAME_CUES = "name named signed sincerely regards contact patient customer employee author"
ID_CUES = "ssn passport iban nif dni nin insurance licence license identifier account"
FIRST_NAMES = "john mary james anna peter maria robert linda michael sarah david laura thomas julia paul emma hans klaus pierre marie jean carlos ana luis"
FILLERS = "number no id is was the of security social and at in lives born"
SECRET_CUES = "token secret password passwd pwd key apikey auth bearer credential credentials"
LEXICON = [x.split() for x in (TITLES, STREETS, NAME_CUES, ID_CUES, FIRST_NAMES, FILLERS, SECRET_CUES)]

#: A run of at least so many ASCII letters and digits that holds both is one token.
LONG_RUN = 16

#: Byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 other sign; bytes of non-ASCII letters count as lower.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1
_LOWER_8 = np.uint64(0x2020202020202020)
_MASK_8 = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
_SIGNS = np.zeros(256, np.int64)
for _k, _c in enumerate(".,:-/#()'"):
    _SIGNS[ord(_c)] = _k + 1

#: Shapes: 0 edge, 1 lower, 2 Capitalised, 3 CAPS, 4 other letters, 5-9 digits by length (1, 2, 3, 4, 5+), 10-19 signs,
#: 20 long runs of hexadecimal digits, 21 other long runs of letters and digits.
N_SHAPES = 22
N_OBS = N_SHAPES * (len(LEXICON) + 1)


def _word_key(w: str) -> int:
    return int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little")


_LEX = sorted((_word_key(w), len(w), k + 1) for k, ws in enumerate(LEXICON) for w in ws)
_LEX_KEY = np.array([x[0] for x in _LEX], np.uint64)
_LEX_LENGTH, _LEX_ID = np.array([x[1] for x in _LEX]), np.array([x[2] for x in _LEX])


def _long_runs(data: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters and digits that are one token."""
    plain = ((group == 1) & (data < 128)) | (group == 3)
    turn = np.flatnonzero(np.diff(plain.view(np.int8), prepend=0, append=0))
    a, b = turn[::2], turn[1::2]
    a, b = a[b - a >= LONG_RUN], b[b - a >= LONG_RUN]
    if not len(a):
        return a, b
    digits = np.concatenate(([0], np.cumsum(group == 3, dtype=np.int64)))
    n = digits[b] - digits[a]
    mixed = (n > 0) & (n < b - a)
    return a[mixed], b[mixed]


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes, observation ids and sequence numbers of the tokens of a UTF-8 buffer.

    Tokens are runs of letters, runs of digits, long runs of both, and single signs. A sequence ends at a line end or at a full stop
    that does not follow a title or an initial.
    """
    cls = _CLASS[data]
    group = cls.copy()
    group[group == 2] = 1
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(group[1:], group[:-1], out=edge[1:])
    edge |= group == 4
    runs, run_ends = _long_runs(data, group)
    if len(runs):  # their inner edges go
        inside = np.zeros(len(data) + 1, np.int8)
        inside[runs + 1] += 1
        inside[run_ends] -= 1
        edge &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        edge[run_ends[run_ends < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    keep = group[starts] > 0
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends, starts, starts
    kind, length = group[starts], ends - starts
    upper = np.concatenate(([0], np.cumsum(cls == 2, dtype=np.int64)))
    ups = upper[ends] - upper[starts]
    shape = np.zeros(len(starts), np.int64)
    letters = kind == 1
    first_up = cls[starts] == 2
    shape[letters] = np.where(ups[letters] == 0, 1, np.where(first_up[letters] & (ups[letters] == 1), 2, np.where(ups[letters] == length[letters], 3, 4)))
    digits = kind == 3
    shape[digits] = 4 + np.minimum(length[digits], 5)
    signs = kind == 4
    shape[signs] = 10 + _SIGNS[data[starts[signs]]]
    if len(runs):
        hexadecimal = np.concatenate(([0], np.cumsum(_HEX[data], dtype=np.int64)))
        long_ = np.searchsorted(starts, runs)
        shape[long_] = np.where(hexadecimal[run_ends] - hexadecimal[runs] == run_ends - runs, 20, 21)
    lex = np.zeros(len(starts), np.int64)
    words = np.flatnonzero(letters & (length <= 10))
    if len(words):  # the first eight bytes, lower-cased, and the length tell lexicon words apart
        eight = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
        key = (eight[starts[words]] | _LOWER_8) & _MASK_8[np.minimum(length[words], 8)]
        at = np.minimum(np.searchsorted(_LEX_KEY, key), len(_LEX_KEY) - 1)
        lex[words] = np.where((_LEX_KEY[at] == key) & (_LEX_LENGTH[at] == length[words]), _LEX_ID[at], 0)
    stop = np.zeros(len(starts), bool)
    stop[:-1] = (shape[:-1] == 11) & (starts[1:] > ends[:-1])
    stop[1:] &= ~((lex[:-1] == 1) | (lex[:-1] == 2) | ((shape[:-1] <= 3) & (length[:-1] == 1)))
    lines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int64)))[starts]
    new = np.zeros(len(starts), np.int64)
    new[1:] = stop[:-1] | (lines[1:] != lines[:-1])
    return starts, ends, shape + N_SHAPES * lex, np.cumsum(new)


# ---------------------------------------------------------------------------------------------------------------
# The field: labels 0 = O, 1 + 2k = begin of kind k, 2 + 2k = inside it

N_LABELS = 1 + 2 * len(MODEL_KINDS)
_OFFSETS = (0, -1, 1, -2, 2)

#: The small labelled table: spans stand in brackets that begin with their kind.
LABELLED = """
Please contact [name Mr. John Smith] before noon.
We met [name Dr. Anna Keller] at the office.
Yesterday [name Mrs. Linda Brown] called again.
Signed, [name Robert Miller]
Name: [name Sarah Jones]
The patient, [name Mr. Thomas Gray], was seen.
Regards, [name Laura White]
We saw [name Mr. Henry Ford].
I know [name Dr. Susan Clark]. She is here.
It was sent by [name Ms. Grace Hill].
[name Herr Klaus Weber] wohnt hier.
[name Madame Marie Dubois] est ici.
[name Senor Carlos Lopez] vive aqui.
Customer [name Emma Stone] asked for it.
Author: [name Peter Hall]
He lives at [address 12 Oak Street] in town.
She moved to [address 221 Baker Street].
Send it to [address 7 Hill Road], please.
Our office is at [address 1600 Park Avenue] now.
They met at [address 45 Rose Lane] again.
The shop, [address 9 King Square], is closed.
SSN [identifier 123-45-6789] is on file.
His SSN: [identifier 987-65-4321].
Social security number [identifier 219-09-9999] was given.
Passport number [identifier 533380006] expired.
Passport no. [identifier 12345678] is valid.
Insurance number: [identifier 44556677]
Account number [identifier 00123456] is closed.
The street was empty and the road was long.
In the name of the law, no one is above it.
The Old House Was Sold In May.
There were 12 of them at 7 in the morning.
Call 555-1234 or write.
Version 2.0 of the License is here.
This work is licensed under the General Public License, version 3.
Licensed under the Apache License, Version 2.0.
All rights reserved.
It is 3.14 or so, and 2020-01-05 was a day.
An account of the Great War.
Der Mann und die Frau gingen nach Hause.
La calle es larga y la plaza es grande.
Le nom de la rue est long.
Erth thonan Ined ble.
Thea onth, erest Heyon Reand.
Of The And In To.
John and Mary went home.
The number of people was 1234567 in 1999.
token = 12345678 and id 5.
Street View is a tool.
He was born in 1980 in Paris.
The license is granted to any person.
Contact us for more.
The Drive to Win.
Court is in session.
The passport is blue.
See section 4 of the Act.
Paul was here.
At 10 Downing he stood.
Author unknown.
Und Der Die Das Ist.
Les Maisons Sont Belles.
Table 5 Figure 7 Row 123456789.
Item 123-45-6789 of the list.
The St%%% thing### is$$$ an%%% id&&& of$$$ a***.
$$$ ntin.### St%%% heanea account$$$ number%%%
He is in *** the street &&& name ### no %%% passport
An account | of | the | road | name | is | here.
Its id = number = "12ab34cd56ef" here
token = "[secret 3f786850e387550fdab836ed7e6dc881de23001b]" here
the token: [secret 89E6C98D92887913CADF06B2ADB97F26CDE4849B], and so on
api_key = '[secret aB3dE6gH9jK2mN5pQ8sT]'
secret = [secret 2e7d2c03a9507ae265ecf5b5356885a5]
PASSWORD="[secret Xy7Zw9Qv4Rt6Ku8Lm2]"
Authorization: Bearer [secret eyJhbGciOiJIUzI1NiIsInR5cCI6]
It said token = "[secret 0b1f9d2c8e7a6f5d4c3b2a190817263544536271]" the.
my key is [secret 4c9a82b1d7e6f5031827364554637281]
auth: [secret q1w2e3r4t5y6u7i8o9p0]
The commit 9fceb02d0ae598e95dc970b74767f19372d61af8 was merged.
Its sha1 is da39a3ee5e6b4b0d3255bfef95601890afd80709 as shown.
File d41d8cd98f00b204e9800998ecf8427e was removed.
The token was lost, and the key is on the table.
A secret is no secret, said the password.
The build 20240115abcdef0123 ran.
"""

_BRACKET = re.compile(r"\[(\w+) ([^\]]*)\]")


def parse_labelled(table: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines of plain text with (start, end, kind index) spans."""
    out = []
    for line in table.strip().splitlines():
        plain, spans, last = "", [], 0
        for m in _BRACKET.finditer(line):
            plain += line[last : m.start()]
            spans.append((len(plain), len(plain) + len(m.group(2)), MODEL_KINDS.index(m.group(1))))
            plain += m.group(2)
            last = m.end()
        out.append((plain + line[last:], spans))
    return out


def _padded(obs: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observations as a (sequence, position) matrix with edges of 0 at both sides by 2, and the lengths."""
    count = np.bincount(seq)
    begin = np.cumsum(count) - count
    out = np.zeros((len(count), count.max() + 4), np.int64)
    out[seq, np.arange(len(seq)) - begin[seq] + 2] = obs
    return out, count


def _emissions(weights: np.ndarray, padded: np.ndarray) -> np.ndarray:
    n = padded.shape[1] - 4
    return sum(weights[k][padded[:, 2 + o : 2 + o + n]] for k, o in enumerate(_OFFSETS))


def train(table: str = LABELLED, steps: int = 300, rate: float = 0.5, penalty: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights (offset, observation, label) and transitions (label, label), by full-batch gradient ascent (Adagrad)."""
    rows = parse_labelled(table)
    all_obs, all_seq, all_gold = [], [], []
    for k, (text, spans) in enumerate(rows):
        s, e, obs, _ = tokens(np.frombuffer(text.encode(), np.uint8))
        gold = np.zeros(len(s), np.int64)
        for a, b, kind in spans:
            inside = (s >= a) & (e <= b)
            gold[inside] = 2 + 2 * kind
            gold[np.flatnonzero(inside)[0]] = 1 + 2 * kind
        all_obs.append(obs)
        all_seq.append(np.full(len(s), k))
        all_gold.append(gold)
    padded, count = _padded(np.concatenate(all_obs), np.concatenate(all_seq))
    n_seq, n = len(count), padded.shape[1] - 4
    gold = np.zeros((n_seq, n), np.int64)
    for k, g in enumerate(all_gold):
        gold[k, : len(g)] = g
    live = np.arange(n)[None, :] < count[:, None]
    forbidden = np.zeros((N_LABELS, N_LABELS))  # an inside label follows only its own begin or inside
    for k in range(len(MODEL_KINDS)):
        for p in range(N_LABELS):
            if p not in (1 + 2 * k, 2 + 2 * k):
                forbidden[p, 2 + 2 * k] = -1e4
    w = np.zeros((len(_OFFSETS), N_OBS, N_LABELS))
    t = np.zeros((N_LABELS, N_LABELS))
    gw, gt = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    onehot = np.eye(N_LABELS)
    for _ in range(steps):
        em = _emissions(w, padded)
        tr = t + forbidden
        alpha, beta = np.zeros((n_seq, n, N_LABELS)), np.zeros((n_seq, n, N_LABELS))
        alpha[:, 0] = em[:, 0]
        alpha[:, 0, 2::2] = -1e4
        for i in range(1, n):
            x = alpha[:, i - 1, :, None] + tr
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1)) + em[:, i]
            alpha[:, i] = np.where(live[:, i, None], new, alpha[:, i - 1])
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        for i in range(n - 2, -1, -1):
            x = tr + (em[:, i + 1] + beta[:, i + 1])[:, None, :]
            top = x.max(2)
            new = top + np.log(np.exp(x - top[..., None]).sum(2))
            beta[:, i] = np.where(live[:, i + 1, None], new, 0)
        marginal = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        diff = (onehot[gold] - marginal) * live[..., None]
        dw = np.zeros_like(w)
        for k, o in enumerate(_OFFSETS):
            np.add.at(dw[k], padded[:, 2 + o : 2 + o + n], diff)
        pair = np.zeros_like(t)
        for i in range(1, n):
            x = alpha[:, i - 1, :, None] + tr + (em[:, i] + beta[:, i])[:, None, :] - z[:, None, None]
            pair -= (np.exp(x) * live[:, i, None, None]).sum(0)
            np.add.at(pair, (gold[:, i - 1][live[:, i]], gold[:, i][live[:, i]]), 1)
        dw -= penalty * n_seq * w
        pair -= penalty * n_seq * t
        gw += dw**2
        gt += pair**2
        w += rate * dw / np.sqrt(gw)
        t += rate * pair / np.sqrt(gt)
    return w.astype(np.float32), (t + forbidden).astype(np.float32)


def viterbi(model: tuple[np.ndarray, np.ndarray], obs: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The likeliest label of each token; all sequences of one length class step together."""
    w, tr = model
    labels = np.zeros(len(obs), np.int64)
    if not len(obs):
        return labels
    # Where no token can gain by leaving O, even with the best of transitions on both sides, all-O is the best path.
    slack = 2 * max(0.0, float(tr.max() - tr[0, 0]))
    near = _around(obs, seq)
    gain = np.full(len(obs), slack, np.float32)
    for k, x in enumerate(near):
        gain += (w[k][:, 1:].max(1) - w[k][:, 0])[x]
    maybe = np.flatnonzero(gain >= 0)  # a sum of bests bounds the best sum, which is taken next
    score = sum(w[k][x[maybe]] for k, x in enumerate(near))
    into = np.maximum(tr.max(0)[1:], tr[0, 0]) - tr[0, 0] + max(0.0, float(tr[:, 0].max() - tr[0, 0]))
    maybe = maybe[(score[:, 1:] - score[:, :1] + into).max(1) >= 0]
    open_ = (np.bincount(seq[maybe], minlength=int(seq[-1]) + 1) > 0)[seq]
    if not open_.any():
        return labels
    labels[open_] = _decode(w, tr, [x[open_] for x in near], np.unique(seq[open_], return_inverse=True)[1])
    return labels


def _around(obs: np.ndarray, seq: np.ndarray) -> list[np.ndarray]:
    """The observations at each offset, 0 beyond the sequence's ends."""
    out = []
    for o in _OFFSETS:
        x = np.zeros(len(obs), obs.dtype)
        a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, len(obs) - o), slice(o, None))
        x[a] = np.where(seq[a] == seq[b], obs[b], 0)
        out.append(x)
    return out


def _decode(w: np.ndarray, tr: np.ndarray, near: list[np.ndarray], seq: np.ndarray) -> np.ndarray:
    labels = np.zeros(len(seq), np.int64)
    count = np.bincount(seq)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    score = sum(w[k][x] for k, x in enumerate(near))
    back = np.zeros((len(seq), N_LABELS), np.uint8)
    at, size = begin[order], count[order]
    cur = score[at].copy()
    cur[:, 2::2] = -1e4
    final = np.zeros((len(order), N_LABELS), np.float32)
    n_live = len(order)
    for i in range(1, int(size[0]) + 1):
        now = int(np.searchsorted(-size, -i, side="left"))  # sequences longer than i come first
        final[now:n_live] = cur[now:n_live]
        if not now:
            break
        n_live = now
        best = cur[:now, 0, None] + tr[0]
        arg = np.zeros((now, N_LABELS), np.uint8)
        for p in range(1, N_LABELS):
            x = cur[:now, p, None] + tr[p]
            better = x > best
            arg[better] = p
            np.maximum(best, x, out=best)
        back[at[:now] + i] = arg
        cur = best + score[at[:now] + i]
    path = final.argmax(1)
    last = at + size - 1
    live = np.arange(len(order))
    step = 0
    while len(live):
        labels[last[live] - step] = path[live]
        live = live[size[live] > step + 1]
        path[live] = back[last[live] - step, path[live]]
        step += 1
    return labels


def model_spans(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind index among KINDS, end) in code points of the field's spans, for each text."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs), np.uint8)
    starts, ends, obs, seq = tokens(data)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(obs):
        return out
    labels = viterbi(model, obs, seq)
    heads = np.flatnonzero(labels % 2 == 1)
    if not len(heads):
        return out
    sizes = np.array([len(b) for b in blobs], np.int64)
    offset = np.cumsum(sizes + 1) - sizes - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))  # code points before each byte
    for h in heads:
        kind = (labels[h] - 1) // 2
        t = h
        while t + 1 < len(labels) and labels[t + 1] == labels[h] + 1 and seq[t + 1] == seq[h]:
            t += 1
        row = int(np.searchsorted(offset, starts[h], side="right")) - 1
        a, b = (int(points[x] - points[offset[row]]) for x in (starts[h], ends[t]))
        if plausible(int(kind), texts[row][a:b]):
            out[row].append((a, len(BASE_KINDS) + int(kind), b))
    return out


def plausible(kind: int, span: str) -> bool:
    """The check after decoding: names have a capital, addresses begin with a digit and have three words, identifiers
    have six digits, secrets are a long run of letters and digits."""
    digits = len(_DIGITS.findall(span))
    if kind == 0:
        return any(c.isupper() for c in span)
    if kind == 1:
        return span[0].isdigit() and span.count(" ") >= 2
    return digits >= 6 if kind == 2 else digits > 0 and len(span) >= LONG_RUN


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def all_spans(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text. A span of the field that overlaps a base span gives way to it."""
    for text, extra in zip(texts, model_spans(model, texts), strict=True):
        base = base_spans(text)
        if extra and base:
            starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
            before = [bisect_left(starts, b) for _, _, b in extra]  # base spans that begin before a span's end
            extra = [x for x, n in zip(extra, before, strict=True) if not n or reach[n - 1] <= x[0]]
        yield base, sorted(base + extra)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long, n_spans long"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: str = LABELLED) -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base span list, all spans, and how many of them
    come from the field and in all."""
    model = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            rows = []
            for i, (base, spans) in zip(ids, all_spans(model, texts), strict=True):
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            yield _batch(rows, [x.split()[0] for x in _OUT.split(", ")], "lllllddll")

    return id_text(docs, id_col, text_col).mapInArrow(run, _OUT)


def _batch(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "l" else pa.string()) for c, k in zip(cols, kinds, strict=True)], names=names)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: str = LABELLED) -> DataFrame:
    """The documents with every span replaced by <KIND>; overlapping spans become one. Other columns stay, n_chars is counted anew.

    Null texts stay null. Rows are changed in place, so repeated ids are no matter.
    """
    model = train(labelled)
    names, at = docs.columns, docs.columns.index(text_col)
    n_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, at):
            texts = batch.column(at).to_pylist()
            clean = []
            for t, (_, spans) in zip(texts, all_spans(model, [t or "" for t in texts]), strict=True):
                if not spans or t is None:
                    clean.append(t)
                    continue
                parts, last = [], 0
                for a, k, b in spans:
                    if a >= last:
                        parts += [t[last:a], f"<{KINDS[k].upper()}>"]
                    last = max(last, b)
                clean.append("".join(parts) + t[last:])
            cols = list(batch.columns)
            cols[at] = pa.array(clean, pa.string())
            if n_at is not None:
                cols[n_at] = pa.array([None if t is None else len(t) for t in clean], pa.int64()).cast(cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
