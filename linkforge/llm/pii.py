"""Personal data (operator 10): base patterns plus a linear-chain conditional random field over word shapes.

The base patterns find emails, IP addresses, card and phone numbers exactly. The field labels every word of
every line from the shapes and key words of five words around it; it is trained here from the small labelled
table below and decoded by Viterbi over all lines of a batch at once. Its runs of one label become further spans
when they pass the kind's own check and overlap no base span: phone numbers without a plus sign, spelt-out email
addresses, card numbers with other marks, and secrets (keys, tokens), which no base pattern knows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words
from linkforge.runtime import ship

KINDS = ("email", "ip", "card", "phone", "secret")
#: The field's labels: none, and the kinds that it can add.
LABELS = ("", "email", "card", "phone", "secret")

# The base patterns; an email's is cut at its at sign. The look-behind changes no match; it keeps long digit runs linear.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# The labelled table. A line has slots for the values of a kind (E email, C card, P phone, S secret) and for
# values that are none, of the forms below: # digit, h hexadecimal, X capital or digit, x letter or digit, w word, T domain ending.
LINES = """
call {P} before noon
her office number is {P} today
Tel: {P} oder schreiben
tel. {P} le matin
llame al {P} por la tarde
phone {P} at the desk
reach us at {P} or later
fax {P} and mail
mobile {P} thanks
und rufen sie {P} an
{P}
w w w {P} w w
w w, {P}. W w
the w of {P} and w
write to {E} soon
mail {E} for details
contact {E} bitte
email: {E} merci
send it to {E} please
escriba a {E} hoy
{E} wrote
{E} w that
w w {E} w w w
ask {E} about it
pay with {C} now
card number {C} expires
Karte {C} endet
carte {C} valable
w w {C} w w
token = "{S}"
token = "{S}" w w
w w token = "{S}" w w
token: {S}
my token is {S} and
api key {S} was leaked
the api_key = {S} in w
secret: "{S}" w
secret = '{S}'
password = "{S}" w
key = {S}
access key {S}
w secret key {S} w
bearer {S}
host {i} answered
from {i} to the server
adresse {i} du poste
we met at noon and left at six
version 3.0 of the license dated 2004
in 1998 there were 1200 people and 35 cars
chapter 12 page 345 line 6
the year 2019 was dry
pages 210-215 of volume 4
total 1,234.50 for 12 items
on 12-05-2017 at 14:30 hours
the meeting at the dot on the map
look at w ## and w ##
look at the w and the w
they met at w in w
he was at w w and wrote
w at w and w at w
the w at w dot
at ## dot points were drawn
put a dot at the end
build 20190412 passed 415 tests
order ####### shipped in 3 boxes
order number ########## shipped
invoice ######### of w
ssn ###-##-####
his ssn is ###-##-#### w
see figure 2.3.1 and table 4.5
he was born 03.04.1956 in the north
born ####-##-## in w
apache license version 2.0 is used
item 44-1023 in row 17
isbn ###-#-##-######-#
isbn ##########
part ####-#### of w
commit hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh merged
the commit hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh of w
sha hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh of the file
md5 hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh matches
file xxxxxxxxxxxxxxxxxxxxxxxx.w is here
id hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh of w
the token of the w
a secret w was kept
the key to the w is w
the and of in to was for with that
der die und das ist nicht mit von
le la les des et que pour dans
el los de que y en para con
w w w, w w. W w w
w w ## w ### w
w ####, w w ####
room 101 floor 5 building 7
score 3-2 after 90 minutes
was it here or there, then
Straße 17 in 50667 Ort
rue 24 et code 75011
from 1914 to 1918 and on
call me at ## or at ##
the phone rang ## times
w wwwwwwwwwwwwwwwwwwwwwwww w
""".strip().split("\n")
FORMS = {
    "P": ("(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "0## #### ####", "0## ########", "(0##) ####-####", "(0##) ###-#####", "0# ## ## ## ##", "### ## ## ##", "(###) ### ####", "0####/######", "1-###-###-####"),
    "E": ("w at w dot T", "w [at] w [dot] T", "w (at) w (dot) T", "w.w at w dot T", "w AT w DOT T", "w[at]w.T", "w [at] w.T", "w(at)w.T", "w## at w dot T", "w at w dot w dot T", "w_w [at] w [dot] T"),
    "C": ("####.####.####.####", "####/####/####/####", "####_####_####_####", "####.######.#####", "####:####:####:####"),
    "S": ("h" * 40, "h" * 32, "h" * 64, "AKIA" + "X" * 16, "sk_live_" + "x" * 24, "ghp_" + "x" * 36, "x" * 40, "x" * 24, "xxxxxxxxxx-xxxxxxxxxx-xxxxxxxxxx"),
    "i": ("##.##.##.##", "1##.1##.##.#", "1##.1##.1##.1##"),
}
_OF_SLOT = {"E": 1, "C": 2, "P": 3, "S": 4, "i": 0}
#: Times that each line is filled in anew.
FILLS = 5

#: Words with a feature of their own, without surrounding marks and digits.
KEYS = (
    "at", "dot", "tel", "phone", "call", "fax", "mobile", "number", "email", "mail", "card", "carte", "karte", "token", "key", "apikey", "secret", "password", "bearer", "access",
    "com", "org", "net", "de", "fr", "es", "edu", "io", "commit", "sha", "ssn", "isbn", "order", "invoice", "id",
)
ENDINGS = ("com", "org", "net", "de", "fr", "es", "edu", "io")
_LONGEST = 12

#: Value counts of a word's shape features: digits, letters, dots, hyphens, round bracket, at sign, other marks, length.
DIGITS = np.asarray([0, 1, 2, 3, 4, 5, 6, 6, 6, 7, 8, 9, 10, 10, 10, 10, 11] + [12] * 4 + [13])
SHAPE = (14, 3, 4, 3, 2, 2, 2, 4)
#: Codes: shapes, then key words, which all have the shape of a short word of letters.
SHAPES = int(np.prod(SHAPE))
PLACES = (-2, -1, 0, 1, 2)


class Words:
    """Word bounds and shape codes of a text given as code points."""

    def __init__(self, points: np.ndarray):
        table, special = _char_classes()
        kind = table[np.minimum(points, 128)]
        solid = np.concatenate([[0], (kind != 0).astype(np.int8), [0]])
        edge = np.diff(solid)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        newline = points == 10
        self.line = np.cumsum(newline)[self.start] if len(self.start) else self.start
        if not len(self.start):
            self.code = np.empty(0, np.int64)
            return
        bounds = np.stack([self.start, self.end], axis=1).reshape(-1)
        if bounds[-1] == len(points):
            bounds = bounds[:-1]

        def count(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask, bounds, dtype=np.int32)[::2]

        digits, letters = count(kind == 1), count(kind == 2)
        size = self.end - self.start
        code = DIGITS[np.minimum(digits, 21)]
        for value, top in (
            (np.where(letters == 0, 0, np.where(letters == size, 2, 1)), 3),
            (np.minimum(count(kind == 3), 3), 4),
            (np.minimum(count(kind == 4), 2), 3),
            ((count(kind == 5) > 0) * 1, 2),
            ((count(kind == 6) > 0) * 1, 2),
            ((count(kind == 7) > 0) * 1, 2),
            (np.searchsorted([8, 16, 32], size, side="right"), 4),
        ):
            code = code * top + value
        self.code = code.astype(np.int64)
        # keys: short words, looked up by their letters packed to an integer
        short = np.flatnonzero((letters >= 2) & (letters <= 8) & (size <= _LONGEST) & (digits == 0))
        if len(short):
            packed = np.zeros(len(short), np.int64)
            for step in range(int(size[short].max())):
                at = self.start[short] + step
                inside = at < self.end[short]
                c = np.where(inside, points[np.minimum(at, len(points) - 1)], 0)
                c = np.where((c >= 65) & (c <= 90), c + 32, c)
                # letters beyond ASCII count as one more letter, so that the word is no key
                letter = (c >= 97) & (c <= 122) | (c > 127)
                packed = np.where(letter, packed * 32 + np.where(c > 127, 31, c - 96), packed)
            place = np.minimum(np.searchsorted(special[0], packed), len(special[0]) - 1)
            hit = special[0][place] == packed
            self.code[short[hit]] = SHAPES + special[1][place[hit]]


@lru_cache(maxsize=1)
def _char_classes() -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """0 blank, 1 digit, 2 letter (all beyond ASCII too), 3 dot, 4 hyphen, 5 round bracket, 6 at sign, 7 other."""
    table = np.full(129, 7, np.int8)
    for c in range(128):
        ch = chr(c)
        table[c] = 0 if c == 32 or 9 <= c <= 13 else 1 if ch.isdigit() else 2 if ch.isalpha() else {".": 3, "-": 4, "(": 5, ")": 5, "@": 6}.get(ch, 7)
    table[128] = 2
    packed = []
    for word in KEYS:
        value = 0
        for ch in word:
            value = value * 32 + ord(ch) - 96
        packed.append(value)
    order = np.argsort(packed)
    return table, (np.asarray(packed, np.int64)[order], np.asarray(order, np.int64))


def _parts(code: np.ndarray) -> np.ndarray:
    """Feature values of codes, most significant first; the last is the key word, 0 for none."""
    key = np.maximum(code - SHAPES + 1, 0)
    plain = int(np.ravel_multi_index((0, 2, 0, 0, 0, 0, 0, 0), SHAPE))
    return np.stack([*np.unravel_index(np.where(key > 0, plain, code), SHAPE), key], axis=-1)


class Field:
    """Weights: per place (two words before to two after) and feature value a score for each label, and
    transition scores. ``table`` holds the summed scores of every code."""

    def __init__(self):
        self.features = [np.zeros((len(PLACES), top, len(LABELS))) for top in (*SHAPE, len(KEYS) + 1)]
        self.transition = np.zeros((len(LABELS), len(LABELS)))
        self.first = np.zeros(len(LABELS))

    def tabled(self) -> np.ndarray:
        parts = _parts(np.arange(SHAPES + len(KEYS)))
        return sum(f[:, parts[:, i], :] for i, f in enumerate(self.features))


def filled(form: str, rng: random.Random) -> str:
    """A form with its placeholders filled in; runs of w are one word unless longer than a word."""
    letters, names = "abcdefghijklmnopqrstuvwxyz", ("th", "er", "on", "an", "ing", "re", "st", "lo", "mi", "ka", "de", "un", "el", "or")
    word = lambda m: "".join(rng.choice(names) for _ in range(max(rng.randint(1, 4), len(m.group()) // 2)))
    form = re.sub(r"(?<![A-Za-z0-9])[wW](?![A-Za-z0-9])|(?<![A-Za-z0-9])w(?=##)|(?<![A-Za-z0-9])w{20,}|(?<=[_\]).])w(?![A-Za-z0-9])|(?<![A-Za-z0-9])w(?=_w)", word, form)
    form = re.sub(r"(?<![A-Za-z0-9])T(?![A-Za-z0-9])", lambda m: rng.choice(ENDINGS), form)
    form = re.sub(r"h{8,}|(?<=-)h{4}(?=-)", lambda m: "".join(rng.choice("0123456789abcdef") for _ in m.group()), form)
    form = re.sub(r"X{8,}", lambda m: "".join(rng.choice(letters.upper() + "234567") for _ in m.group()), form)
    form = re.sub(r"x{8,}", lambda m: "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in m.group()), form)
    return re.sub("#", lambda m: rng.choice("0123456789"), form)


def labelled(lines: list[str], forms: dict[str, tuple[str, ...]], fills: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with their slots filled in, and (start, label, end) of the values."""
    rng, out = random.Random(seed), []
    for line in lines:
        for _ in range(fills):
            text, spans = "", []
            for i, piece in enumerate(re.split(r"\{(\w)\}", line)):
                if i % 2:
                    value = filled(rng.choice(forms[piece]), rng)
                    if _OF_SLOT[piece]:
                        spans.append((len(text), _OF_SLOT[piece], len(text) + len(value)))
                    text += value
                else:
                    text += filled(piece, rng)
            out.append((text, spans))
    return out


def _examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and lengths of the labelled table, padded."""
    rows = []
    for text, spans in labelled(LINES, FORMS, FILLS, 11):
        w = Words(np.asarray([ord(c) for c in text], np.uint32))
        rows.append((w.code, [next((k for a, k, b in spans if s < b and e > a), 0) for s, e in zip(w.start.tolist(), w.end.tolist())]))
    most = max(len(x) for _, x in rows)
    codes, labels = np.zeros((len(rows), most), np.int64), np.full((len(rows), most), -1)
    for i, (c, x) in enumerate(rows):
        codes[i, : len(c)], labels[i, : len(x)] = c, x
    return codes, labels, np.asarray([len(x) for _, x in rows])


def train(steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Gradient ascent (Adam) on the exact log likelihood of the labelled table, by forward and backward sums."""
    codes, labels, sizes = _examples()
    n, most = codes.shape
    parts, field, k = _parts(codes), Field(), len(LABELS)
    at = np.arange(most)
    inside = at[None] < sizes[:, None]
    gold = np.eye(k)[np.maximum(labels, 0)] * inside[..., None]
    weights = [*field.features, field.transition, field.first]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        """x at the word ``by`` places on, zero beyond the line."""
        out = np.zeros_like(x)
        if by == 0:
            out[:] = x
        elif by > 0:
            out[:, :-by] = x[:, by:]
        else:
            out[:, -by:] = x[:, :by]
        return out

    for step in range(1, steps + 1):
        score = np.zeros((n, most, k))
        for i, f in enumerate(field.features):
            for j, by in enumerate(PLACES):
                score += shifted(f[j, parts[..., i]] * inside[..., None], by)
        score *= inside[..., None]
        forward, backward = np.zeros((n, most, k)), np.zeros((n, most, k))
        forward[:, 0] = score[:, 0] + field.first
        for t in range(1, most):
            forward[:, t] = np.where(inside[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + field.transition, axis=1) + score[:, t], forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(most - 2, -1, -1):
            backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(field.transition + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0)
        own = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        delta = gold - own
        grads = []
        for i, f in enumerate(field.features):
            g = np.zeros_like(f)
            for j, by in enumerate(PLACES):
                np.add.at(g[j], parts[..., i][inside], shifted(delta, -by)[inside])
            grads.append(g)
        both = np.exp(forward[:, :-1, :, None] + field.transition + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        pair = gold[:, :-1, :, None] * gold[:, 1:, None, :] - both * inside[:, 1:, None, None]
        grads += [pair.sum(axis=(0, 1)), delta[:, 0].sum(axis=0)]
        for w, g, m in zip(weights, grads, moments):
            g = g / n - decay * w
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            w += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return field


def viterbi(field_table: np.ndarray, transition: np.ndarray, first: np.ndarray, code: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The best label of every word; words of one line follow each other. All lines advance together."""
    total = len(code)
    if not total:
        return np.empty(0, np.int64)
    middle = len(field_table) // 2
    score = field_table[middle][code]
    for by in range(1, middle + 1):
        near = line[by:] == line[:-by]
        score[by:][near] += field_table[middle - by][code[:-by][near]]
        score[:-by][near] += field_table[middle + by][code[by:][near]]
    linked = line[1:] == line[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~linked]))
    sizes = np.diff(np.concatenate([head, [total]]))
    order = np.argsort(-sizes, kind="stable")
    head, sizes = head[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # lines at least that long
    back = np.zeros((total, score.shape[1]), np.int8)
    best = score[head] + first
    final = np.zeros(len(head), np.int64)
    for t in range(1, int(sizes[0]) + 1):
        going = int(active[t]) if t < sizes[0] else 0
        final[going : int(active[t - 1])] = best[going:].argmax(axis=1)
        if not going:
            break
        paths = best[:going, :, None] + transition
        at = head[:going] + t
        back[at] = paths.argmax(axis=1)
        best = paths.max(axis=1) + score[at]
    labels = np.zeros(total, np.int64)
    current = final.copy()
    for t in range(int(sizes[0]) - 1, -1, -1):
        going = int(active[t])
        at = head[:going] + t
        labels[at] = current[:going]
        current[:going] = back[at, current[:going]]
    return labels


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted by start, then kind."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:  # the local part is the run of its characters before the at sign, save what the last match took
        low = at
        while low > end and _LOCAL.match(text, low - 1):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((low, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p) < 256 or not p.strip("0") or int(p.lstrip("0")[:4]) < 256 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        at = text.find("+")
        while at >= 0:
            m = PHONE.search(text, at)
            if not m:
                break
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
            at = m.end()
    return sorted(found)


# What a spelt-out address and a secret look like as a whole.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]?(?:@|at|AT)[\])]? ?[A-Za-z0-9-]+(?:(?:\.| [\[(]?(?:dot|DOT)[\])]? |[\[(](?:dot|DOT)[\])])[A-Za-z0-9-]+)+")
_SECRET = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")


def _plausible(kind: str, text: str) -> bool:
    """The kind's own check of a span that the field proposes."""
    if kind == "email":
        return len(text) <= 320 and _SPELT.fullmatch(text) is not None
    if kind == "secret":
        return _SECRET.fullmatch(text) is not None
    digits = _digits(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\(?[0-9][0-9 ()./-]*[0-9]", text) is not None and re.search(r"[ ()./-]", text) is not None


#: Marks around a word that are no part of a span.
_LEAD, _TAIL = "\"'<[{,;:*$%&#!=", "\"'>]},;:*$%&#!.?="


class Finder:
    """Finds all spans of batches of texts."""

    def __init__(self, field: Field):
        self.table, self.transition, self.first = field.tabled(), field.transition, field.first

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """Per text: base spans and all spans, as (start, kind, end)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        w = Words(points)
        label = viterbi(self.table, self.transition, self.first, w.code, w.line)
        out = [(base := base_spans(t), list(base)) for t in texts]
        hit = np.flatnonzero(label)
        if not len(hit):
            return out
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (label[hit[1:]] != label[hit[:-1]]) | (w.line[hit[1:]] != w.line[hit[:-1]])
        first, last = hit[new], hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]
        row = np.searchsorted(starts, w.start[first], side="right") - 1
        for i, a, b, k in zip(row.tolist(), w.start[first].tolist(), w.end[last].tolist(), label[first].tolist()):
            a, b = a - int(starts[i]), b - int(starts[i])
            text, (base, every), kind = texts[i], out[i], LABELS[k]
            while a < b and text[a] in _LEAD:
                a += 1
            while b > a and text[b - 1] in _TAIL:
                b -= 1
            if kind == "secret":  # a name that stands before the value in one word
                a += max(text[a:b].rfind(x) for x in "=:") + 1
                while a < b and text[a] in _LEAD:
                    a += 1
            clear = all(e <= a or s >= b or (kind == "secret" and a <= s and e <= b) for s, _, e in base)
            if a < b and clear and _plausible(kind, text[a:b]):
                every.append((a, KINDS.index(kind), b))
        return [(base, sorted(every)) for base, every in out]


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained once per process; training is deterministic and takes about a second."""
    return train()


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanner(field: Field):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            for part in words.slices(batch):
                found = finder.spans([t or "" for t in part.column("text").to_pylist()])
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(e) for _, e in found], pa.string()), pa.array([len(e) for _, e in found], pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans"],
                )

    return scan


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans and n_spans for every row.

    Counts and ``base`` are of the base patterns, leftmost and non-overlapping per kind: matches that fail
    (an IP part over 255, a card without 12 to 19 digits or a wrong check digit, a phone without 9 to 15
    digits) are dropped. ``spans`` holds these and the field's, n_spans counts them. Both list kind:start:end by
    start, then kind (email, ip, card, phone, and secret of the field), in code points with exclusive ends. Null and empty texts have no spans. Rows
    are scanned one by one, so repeated rows and null ids change nothing; other columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    return docs.mapInArrow(_scanner(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")
