"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens (runs of other characters than white space) from features of word shape: the shape with runs collapsed,
run lengths, the shapes of the neighbours, and digit checks. It is trained on a small labelled table, by gradient ascent on
the exact likelihood (forward-backward in numpy). A token without a digit and without "@" is always O; the best path through
such a token is fixed there, so Viterbi runs exactly on the stretches between, many at a time in numpy batches by length.

Base spans stay as they are; a span that the field adds overlaps none of them. All places are code points, ends exclusive.

Defined cases: a null or empty text has no spans (its digest is that of the empty string); rows with the same id count each
for themselves; very long texts are handled in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import common as C

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in forms that match the same in linear time. Emails are found from each "@" outwards.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            out.append((start, last := m.end()))
            end = last
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -------------------------------------------------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_N = len(TAGS)
#: Tokens and their labels; # stands for a random digit, @@ for a random word. Labels: e, i, c, p (email, ip, card, phone), - for none.
TABLE = (
    ("@@ @@ (###) ###-#### @@", "- - p p -"),
    ("@@ ###-###-#### @@ @@", "- p - -"),
    ("@@ 1-###-###-#### @@", "- p -"),
    ("@@ ###.###.#### , @@", "- p - -"),
    ("@@ tel: (###) ###-####.", "- - p p"),
    ("@@ +# (###) ###-#### @@", "- p p p -"),
    ("@@ +## ## #### #### @@", "- p p p p -"),
    ("@@ +## ### ####### @@", "- p p p -"),
    ("@@ a.@@##@localhost @@", "- e -"),
    ("@@ @@.##@mail#.example.com @@", "- e -"),
    ("@@ <@@@@@.example.org> @@", "- e -"),
    ("@@ @@@intranet @@ @@", "- e - -"),
    ("@@ ##.##.##.### @@", "- i -"),
    ("@@ ###.##.##.##:#### @@", "- i -"),
    ("@@ fe80::##:#ab# @@", "- i -"),
    ("@@ 2001:db8::#a#:## @@", "- i -"),
    ("@@ #### #### #### #### @@", "- c c c c -"),
    ("@@ ####-####-####-#### @@", "- c -"),
    ("@@ 4############### @@ @@", "- c - -"),
    ("@@ #### @@ @@", "- - - -"),
    ("@@ in #### @@", "- - - -"),
    ("@@ ############ @@", "- - -"),
    ("@@ ########### @@ @@", "- - - -"),
    ("@@ #,### @@ ##% @@", "- - - - -"),
    ("@@ version #.# @@", "- - - -"),
    ("@@ License, Version #.#. @@", "- - - - -"),
    ("@@ ####-##-## @@ ##:## @@", "- - - - -"),
    ("@@ ##/##/#### @@", "- - -"),
    ("@@ $##.## @@", "- - -"),
    ("@@ (####) @@", "- - -"),
    ("@@ [##] @@", "- - -"),
    ("@@ a##b#c#d##e#f#a##b#c#d# @@", "- - -"),
    ("@@ token = \"#a#b##c#d#e##f#a#b#c\" @@", "- - - - -"),
    ("@@ password=#a#b##c#d# @@", "- - -"),
    ("@@ AKIA#XYZ##ABCD#EF @@", "- - -"),
    ("@@ ### ### @@", "- - - -"),
    ("@@ ## @@ ## @@", "- - - - -"),
    ("@@ https://a.b/####/## @@", "- - -"),
    ("@@ @@ @ @@", "- - - -"),
    ("@@ @@@ @@", "- - -"),
    ("@@ ###### @@", "- - -"),
    ("@@ #####-#### @@", "- - -"),
    ("@@ ISBN ###-#-##-######-# @@", "- - - -"),
    ("@@ #.#.#.#.# @@", "- - -"),
    ("@@ no. #### / ## @@", "- - - - - -"),
)


def _shape(token: str) -> str:
    """Character classes, runs collapsed with their lengths up to 4."""
    out, last, run = [], "", 0
    for ch in token + "\0":
        c = "d" if "0" <= ch <= "9" else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if c != last:
            if last:
                out.append(last + (str(min(run, 5)) if last == "d" else ""))
            last, run = c, 0
        run += 1
    return "".join(out)


def _features(tokens: list[str], i: int) -> list[str]:
    t = tokens[i]
    core = t.strip(".,;:!?\"'<>[]")
    digits = _NOT_DIGIT.sub("", core)
    n = len(digits)
    before, after = (tokens[i - 1] if i else ""), (tokens[i + 1] if i + 1 < len(tokens) else "")
    short = lambda s: _shape(s.strip(".,;:"))[:12] if any(c.isdigit() or c in "@+(" for c in s) else "w"
    shape = _shape(core)
    out = ["b", f"s={shape}", f"c={re.sub('[0-9]', '', shape)[:16]}", f"n={min(n, 20)}", f"pair={short(before)}|{short(core)}", f"next={short(core)}|{short(after)}"]
    if "@" in core:
        out.append("at" + ("y" if 0 < core.find("@") < len(core) - 1 else "n"))
    if 12 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if core.startswith("+"):
        out.append("plus")
    if "::" in core:
        out.append("colons")
    return out


def labelled_table(copies: int = 6, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The table with its digits and words filled in, ``copies`` times."""
    rng = np.random.default_rng(seed)
    letter = {"e": 0, "i": 1, "c": 2, "p": 3}
    parts = ("an", "er", "tion", "le", "che", "os", "un", "ment", "re", "ou")
    out = []
    for _ in range(copies):
        for text, marks in TABLE:
            text = re.sub("@@(?=.)|@@$", lambda _: "".join(rng.choice(parts, 2)), text)
            tokens, tags, last = re.sub("#", lambda _: str(rng.integers(10)), text).split(), [], "-"
            for m in marks.split():
                tags.append(0 if m == "-" else 1 + 2 * letter[m] + (m == last))
                last = m
            tags += [0] * (len(tokens) - len(tags))
            out.append((tokens, tags[: len(tokens)]))
    return out


class Field:
    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit, step

    def scores(self, tokens: list[str], i: int) -> np.ndarray:
        get = self.index.get
        return self.emit[[j for f in _features(tokens, i) if (j := get(f)) is not None]].sum(axis=0)

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each run of token scores, which is O before and after."""
        out: list = [None] * len(runs)
        by: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(runs):
            by[len(x)].append(k)
        for n, ks in by.items():
            x = np.stack([runs[k] for k in ks])
            v, back = x[:, 0] + self.step[0], []
            for t in range(1, n):
                s = v[:, :, None] + self.step[None]
                back.append(s.argmax(axis=1))
                v = s.max(axis=1) + x[:, t]
            at = (v + self.step[:, 0]).argmax(axis=1)
            path = [at]
            for b in reversed(back):
                path.append(at := b[np.arange(len(ks)), at])
            for k, p in zip(ks, np.stack(path[::-1], axis=1), strict=True):
                out[k] = p
        return out


def _forbidden() -> np.ndarray:
    bad = np.zeros((_N, _N), bool)
    for a in range(_N):
        for k in range(len(KINDS)):
            bad[a, 2 + 2 * k] = a not in (1 + 2 * k, 2 + 2 * k)
    return bad


@lru_cache(maxsize=2)
def train(copies: int = 6, seed: int = 5, steps: int = 150, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Adam on the mean log-likelihood; the table's size is fixed, and so is the cost."""
    rows = labelled_table(copies, seed)
    index: dict[str, int] = {}
    feats = [[[index.setdefault(f, len(index)) for f in _features(tokens, i)] for i in range(len(tokens))] for tokens, _ in rows]
    longest = max(len(t) for t, _ in rows)
    m = len(rows)
    mask, gold = np.zeros((m, longest), bool), np.zeros((m, longest), np.int64)
    pos, fid = [], []
    for r, (tokens, tags) in enumerate(rows):
        mask[r, : len(tokens)], gold[r, : len(tokens)] = True, tags
        for i in range(len(tokens)):
            pos += [r * longest + i] * len(feats[r][i])
            fid += feats[r][i]
    pos, fid = np.asarray(pos), np.asarray(fid)
    bad = _forbidden()
    emit, step = np.zeros((len(index), _N)), np.zeros((_N, _N))
    state = [np.zeros_like(x) for x in (emit, emit, step, step)]
    one = np.eye(_N)
    gold_emit, gold_step = np.zeros_like(emit), np.zeros_like(step)
    np.add.at(gold_emit, fid, one[gold.ravel()[pos]])
    for r, (_, tags) in enumerate(rows):
        for a, b in zip([0, *tags], [*tags, 0], strict=True):
            gold_step[a, b] += 1

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    length = mask.sum(axis=1)
    for k in range(1, steps + 1):
        move = np.where(bad, -1e4, step)
        x = np.zeros((m * longest, _N))
        np.add.at(x, pos, emit[fid])
        x = x.reshape(m, longest, _N)
        # beyond a row's end everything stays O at no cost, so one sweep serves all lengths
        x[~mask] = -1e4
        x[~mask, 0] = 0
        alpha, beta = np.zeros_like(x), np.zeros_like(x)
        alpha[:, 0] = x[:, 0] + move[0]
        moves = [None] + [np.where(mask[:, t, None, None] | (length == t)[:, None, None], move[None], 0.0) for t in range(1, longest)]
        for t in range(1, longest):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + moves[t], 1) + x[:, t]
        beta[:, -1] = np.where((length == longest)[:, None], move[:, 0], 0.0)
        for t in range(longest - 2, -1, -1):
            beta[:, t] = lse(moves[t + 1] + (x[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, 0] + beta[:, 0], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        want_emit, want_step = np.zeros_like(emit), np.zeros_like(step)
        np.add.at(want_emit, fid, node.reshape(-1, _N)[pos])
        want_step[0] += node[:, 0].sum(axis=0)
        for t in range(1, longest):
            edge = np.exp(alpha[:, t - 1, :, None] + moves[t] + (x[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            want_step += edge[mask[:, t] | (length == t)].sum(axis=0)
        want_step[:, 0] += node[length == longest, -1].sum(axis=0)
        for w, g, m1, m2 in ((emit, (gold_emit - want_emit) / m - decay * emit, state[0], state[1]), (step, (gold_step - want_step) / m - decay * step, state[2], state[3])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Field(index, emit, np.where(bad, -1e9, step))


def added_spans(field: Field, texts: dict[int, str], found: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """Row: (start, kind, end) that the field finds among the stretches of tokens (first, last exclusive) of each row's words."""
    runs, where = [], []
    for row, stretches in found.items():
        for tokens, spans, a, b in stretches:
            runs.append(np.stack([field.scores(tokens, i) for i in range(a, b)]))
            where.append((row, tokens, spans, a))
    out: dict[int, list] = defaultdict(list)
    for (row, _, spans, a), path in zip(where, field.decode(runs), strict=True):
        open_kind, start, end = -1, 0, 0
        for i, tag in enumerate([*path.tolist(), 0]):
            if open_kind >= 0 and not (tag and tag % 2 == 0):
                out[row].append((start, open_kind, end))
                open_kind = -1
            if tag:
                if tag % 2:
                    open_kind, start = (tag - 1) // 2, spans[a + i][0]
                end = spans[a + i][1]
    return {row: [s for s in map(lambda s, t=texts[row]: _trim(t, s), x) if s] for row, x in out.items()}


#: Digits that a span of a kind holds; others are dropped, as in the base patterns.
_DIGITS = {2: (12, 19), 3: (9, 15)}


def _trim(text: str, span: tuple[int, int, int]) -> tuple[int, int, int] | None:
    a, kind, b = span
    while a < b and text[a] in ".,;:!?\"'<>[]|":
        a += 1
    while b > a and text[b - 1] in ".,;:!?\"'<>[]|":
        b -= 1
    n = sum("0" <= c <= "9" for c in text[a:b])
    low, high = _DIGITS.get(kind, (0, 1 << 60))
    return (a, kind, b) if a < b and low <= n <= high and (kind != 2 or luhn(_NOT_DIGIT.sub("", text[a:b]))) else None


def find(docs: DataFrame, **training: float) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(**training))

    def text(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = shared.value
        off, raw = C.offsets_of(batch.column(1))
        rows = len(off) - 1
        hot = ((raw >= 48) & (raw <= 57)) | (raw == 64)
        hots = np.concatenate([[0], np.cumsum(hot)])
        has = np.flatnonzero(hots[off[1:]] > hots[off[:-1]])
        texts = {int(r): batch.column(1)[int(r)].as_py() for r in has}
        base = {r: base_spans(t) for r, t in texts.items()}
        start, end, row = C.words(off, raw)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        mine = np.flatnonzero(hots[end] > hots[start])
        found: dict[int, list] = defaultdict(list)
        if len(mine):
            cuts = np.flatnonzero((np.diff(mine) > 1) | (np.diff(row[mine]) > 0)) + 1
            bounds = np.bincount(row, minlength=rows).cumsum()
            for run in np.split(mine, cuts):
                r = int(row[run[0]])
                low, high = (int(bounds[r - 1]) if r else 0), int(bounds[r])
                a, b = max(low, int(run[0]) - 1), min(high, int(run[-1]) + 2)
                spans = [(int(points[start[i]] - points[off[r]]), int(points[end[i]] - points[off[r]])) for i in range(a, b)]
                if _covered(spans[int(run[0]) - a : int(run[-1]) + 1 - a], base[r]):
                    continue
                found[r].append(([texts[r][x:y] for x, y in spans], spans, int(run[0]) - a, int(run[-1]) + 1 - a))
        more = added_spans(field, texts, found)
        counts, digest, joined = np.zeros((4, rows), np.int64), [hashlib.sha256(b"").hexdigest()] * rows, [""] * rows
        for r, own in base.items():
            for _, k, _ in own:
                counts[k, r] += 1
            digest[r] = hashlib.sha256(text(own).encode()).hexdigest()
            joined[r] = text(sorted([*own, *(s for s in more.get(r, ()) if not any(s[0] < b and a < s[2] for a, _, b in own))]))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest), pa.array(joined)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return C.map_text(docs, step, SCHEMA)


def _covered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> bool:
    """Whether every token lies in base spans, but for marks: nothing could be added then."""
    return all(any(p <= a + 2 and b - 2 <= q for p, _, q in base) for a, b in spans)
