"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The random field labels the words of every sentence (O, or begin or
inside of a kind) by their collapsed shapes, their counts of digits and letters, and cue words around
them. It is trained on a small labelled table by gradient ascent on the likelihood, and decoded by
Viterbi over numpy batches of sentences. Sentences in which no word's best other label can outweigh O,
whatever the transitions, have O throughout as their proven best path and need no decoding. Its spans
are added where they overlap no base span; those of a kind with a checksum or range must pass it too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{at}-{kind}" for kind in KINDS for at in "BI"))
MAX_ROWS = 2_000  # labelled rows that are learnt from: the first by row_id
ROUNDS, RATE, DECAY, MIN_COUNT = 120, 0.12, 1e-3, 3
CHARS = 1_000_000  # texts are worked on in runs of so many characters; a longer text by itself
ROWS = 128  # rows that are redacted at once

# --- base spans: each pattern starts at the start of a run, so it never rescans one ---
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their @ signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, found: str) -> bool:
    """What a kind asks of a match beyond its pattern."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= sum("0" <= c <= "9" for c in found) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as in BASE and then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, needs in (("ip", _IP, "."), ("card", _CARD, ""), ("phone", _PHONE, "+")):
        if needs in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# --- words and their features, for many texts at once ---
_rng = np.random.default_rng(8)
_CLASS = np.full(256, 2, np.uint8)  # 2: lower case and anything beyond ASCII
for _c in range(128):
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 0 if _c in (9, 10, 11, 12, 13, 32) else 4 + _c % 60
_SHAPE = _rng.integers(1, 2**62, (64, 12)).astype(np.uint64)
_WORD = _rng.integers(1, 2**62, (256, 16)).astype(np.uint64)
for _c in range(128):
    if _CLASS[_c] > 3:
        _WORD[_c] = 0  # only letters and digits spell a cue word
    elif _CLASS[_c] == 1:
        _WORD[_c] = _WORD[_c + 32]
_DIGIT_STEPS, _LETTER_STEPS = np.array([1, 2, 3, 5, 8, 12, 16, 20]), np.array([1, 2, 5, 12, 24])
COLUMNS = tuple((what, shift) for what, shifts in (("shape", (0, -1, 1)), ("word", (0, -1, -2, 1)), ("bucket", (0, -1, 1))) for shift in shifts)


@dataclass
class Words:
    """Words of one or more texts: byte ranges, sentence numbers, and hashes of what describes them."""

    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    bucket: np.ndarray


def words_of(data: bytes) -> Words:
    """Words are runs between white space; a sentence ends at a line end or after a word that ends in one of .!?"""
    buf = np.frombuffer(data, np.uint8)
    kinds = _CLASS[buf]
    full = kinds > 0
    first = full.copy()
    first[1:] &= ~full[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    kept = np.flatnonzero(full)
    c, opens = kinds[kept], first[kept]
    at = np.flatnonzero(opens)
    sizes = np.diff(np.append(at, len(kept)))
    end = start + sizes
    place = (np.arange(len(kept), dtype=np.int32) - np.repeat(at, sizes).astype(np.int32)).clip(max=15)
    word = np.add.reduceat(_WORD[buf[kept], place], at)
    turn = opens.copy()
    turn[1:] |= c[1:] != c[:-1]
    runs = np.flatnonzero(turn)
    run_at = np.searchsorted(runs, at)
    run_sizes = np.diff(np.append(run_at, len(runs)))
    run_place = (np.arange(len(runs)) - np.repeat(run_at, run_sizes)).clip(max=11)
    shape = np.add.reduceat(_SHAPE[c[runs], run_place], run_at)
    digits = np.add.reduceat((c == 3).view(np.uint8), at, dtype=np.int64)
    letters = np.add.reduceat(((c == 1) | (c == 2)).view(np.uint8), at, dtype=np.int64)
    bucket = np.searchsorted(_DIGIT_STEPS, digits, side="right") * 6 + np.searchsorted(_LETTER_STEPS, letters, side="right")
    lines = np.cumsum(buf == 10, dtype=np.int32)[start]
    breaks = np.ones(len(start), bool)
    breaks[1:] = (lines[1:] != lines[:-1]) | np.isin(buf[end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    return Words(start, end, np.cumsum(breaks) - 1, shape, word, bucket)


def _shifted(x: np.ndarray, sentence: np.ndarray, by: int) -> np.ndarray:
    """x of the word ``by`` places on in the same sentence, else 1 (the feature of a missing word)."""
    out = np.ones(len(x), np.int64)
    if by < 0:
        out[-by:] = np.where(sentence[-by:] == sentence[:by], x[:by], 1)
    elif by > 0:
        out[:-by] = np.where(sentence[:-by] == sentence[by:], x[by:], 1)
    return out


@dataclass
class Field:
    """The random field: known shapes and words, weights by column, and transitions between labels."""

    keys: dict[str, np.ndarray]
    weights: list[np.ndarray]  # by column: feature x label; feature 0 is any unknown one, 1 a missing word
    bias: np.ndarray
    moves: np.ndarray  # label x next label
    opening: np.ndarray

    def features(self, w: Words) -> list[np.ndarray]:
        own = {"bucket": w.bucket + 2}
        for what in ("shape", "word"):
            keys, x = self.keys[what], getattr(w, what)
            at = np.searchsorted(keys, x).clip(max=max(0, len(keys) - 1))
            own[what] = np.where(keys[at] == x, at + 2, 0) if len(keys) else np.zeros(len(x), np.int64)
        return [_shifted(own[what], w.sentence, shift) if shift else own[what] for what, shift in COLUMNS]

    def emissions(self, w: Words) -> np.ndarray:
        out = np.repeat(self.bias[None], len(w.start), 0)
        for weights, i in zip(self.weights, self.features(w), strict=True):
            out += weights[i]
        return out

    def decode(self, w: Words) -> np.ndarray:
        """The best label of every word, sentence by sentence."""
        labels = np.zeros(len(w.start), np.int8)
        if not len(labels):
            return labels
        e = self.emissions(w)
        least = min(self.moves[0, 0], self.opening[0])
        pull = 2 * max(0.0, float(self.moves.max()) - float(least), float(self.opening.max()) - float(least))
        doubtful = np.unique(w.sentence[e[:, 1:].max(1) - e[:, 0] + pull >= 0])
        first = np.searchsorted(w.sentence, doubtful)
        size = np.searchsorted(w.sentence, doubtful, side="right") - first
        octave = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for o in np.unique(octave):  # sentences padded to at most twice their length
            here = np.flatnonzero(octave == o)
            step = max(1, 200_000 >> o)
            for k in range(0, len(here), step):
                part = here[k : k + step]
                n, length = first[part], size[part]
                t = np.arange(length.max())
                inside = t[None] < length[:, None]
                rows = np.where(inside, n[:, None] + t[None], 0)
                best = viterbi(e[rows], length, self.moves, self.opening)
                labels[rows[inside]] = best[inside]
        return labels


def viterbi(e: np.ndarray, length: np.ndarray, moves: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Best label paths of sequences padded to one length; e is sequence x place x label."""
    n, most, k = e.shape
    back = np.zeros((most, n, k), np.int8)
    score = e[:, 0] + opening
    for t in range(1, most):
        step = score[:, :, None] + moves
        came = step.argmax(1)
        new = np.take_along_axis(step, came[:, None], 1)[:, 0] + e[:, t]
        live = (t < length)[:, None]
        back[t] = np.where(live, came, np.arange(k))
        score = np.where(live, new, score)
    out = np.zeros((n, most), np.int8)
    out[:, -1] = score.argmax(1)
    for t in range(most - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """Train on (text, [(kind, start, end)]) rows; a text is split into sentences as in decoding."""
    data, marks, base = [], [], 0
    for text, spans in rows:
        raw = text.encode()
        data.append(raw)
        marks += [(kind, base + len(text[:a].encode()), base + len(text[:b].encode())) for kind, a, b in spans]
        base += len(raw) + 1
    w = words_of(b"\n".join(data))
    n, k = len(w.start), len(LABELS)
    keys = {}
    for what in ("shape", "word"):
        x, times = np.unique(getattr(w, what), return_counts=True)
        keys[what] = x[times >= MIN_COUNT]
    sizes = {"bucket": 2 + 54, "shape": 2 + len(keys["shape"]), "word": 2 + len(keys["word"])}
    field = Field(keys, [np.zeros((sizes[what], k)) for what, _ in COLUMNS], np.zeros(k), np.zeros((k, k)), np.zeros(k))
    if not n:
        return field
    gold = np.zeros(n, np.int64)
    for kind, a, b in marks:
        own = np.flatnonzero((w.end > a) & (w.start < b))
        gold[own] = LABELS.index(f"I-{kind}")
        gold[own[:1]] = LABELS.index(f"B-{kind}")
    columns = field.features(w)
    first = np.flatnonzero(np.append(True, w.sentence[1:] != w.sentence[:-1]))
    length = np.diff(np.append(first, n))
    t = np.arange(length.max())
    inside = t[None] < length[:, None]
    at = np.where(inside, first[:, None] + t[None], 0)
    s = len(first)
    params = [*field.weights, field.bias, field.moves, field.opening]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    true_moves, true_opening = np.zeros((k, k)), np.bincount(gold[first], minlength=k).astype(float)
    same = np.flatnonzero(w.sentence[1:] == w.sentence[:-1])
    np.add.at(true_moves, (gold[same], gold[same + 1]), 1)
    for round_ in range(1, ROUNDS + 1):
        e = field.emissions(w)[at]
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + field.opening
        for i in range(1, len(t)):
            live = inside[:, i, None]
            ahead[:, i] = np.where(live, _log_sum(ahead[:, i - 1, :, None] + field.moves, 1) + e[:, i], ahead[:, i - 1])
        total = _log_sum(ahead[:, -1], 1)
        for i in range(len(t) - 2, -1, -1):
            live = inside[:, i + 1, None]
            behind[:, i] = np.where(live, _log_sum(field.moves[None] + (e[:, i + 1] + behind[:, i + 1])[:, None], 2), behind[:, i + 1])
        odds = np.exp(ahead + behind - total[:, None, None])
        each = np.zeros((n, k))
        each[at[inside]] = odds[inside]
        pull = -each
        pull[np.arange(n), gold] += 1
        pairs = np.zeros((k, k))
        for i in range(1, len(t)):
            live = inside[:, i]
            pairs += np.exp(ahead[live, i - 1, :, None] + field.moves + (e[live, i] + behind[live, i])[:, None] - total[live, None, None]).sum(0)
        grads = []
        for weights, column in zip(field.weights, columns, strict=True):
            g = np.zeros_like(weights)
            np.add.at(g, column, pull)
            grads.append(g)
        grads += [pull.sum(0), true_moves - pairs, true_opening - odds[:, 0].sum(0)]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g / s - DECAY * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += RATE * (a / (1 - 0.9**round_)) / (np.sqrt(b / (1 - 0.99**round_)) + 1e-8)
    return field


# --- the small labelled table: sentences with slots, filled by a fixed rule ---
_SENTENCES = (
    "write to {email} for more", "the contact is {email} , please", "schreib an {email} bitte", "le contact est {email} ici", "escribe a {email} ahora", "mail: {email}",
    "call {phone} after noon", "my phone is {phone} at home", "ruf {phone} an", "mon numéro est {phone} merci", "mi teléfono es {phone} de día", "tel. {phone}", "phone: {phone}",
    "the server at {ip} is down", "von {ip} aus", "depuis {ip} hier", "desde {ip} hoy", "ip {ip}",
    "card {card} was charged", "die karte {card} ist neu", "la carte {card} est perdue", "la tarjeta {card} es nueva", "{card}",
    'token = "{secret}" in the file', "api_key = '{secret}'", 'secret: "{secret}"', "password={secret_join}", 'the token = "{secret}" is old', 'token = "{secret}"', "key: {secret}",
    "{w} {w} {email} {w}", "{w} {w} {phone} {w}", "{w} {w} {ip} {w}", "{w} {w} {card} {w}", '{w} {w} token = "{secret}" {w}', "{w} {phone} {w} {email} {w}", '{w} token = "{secret}" {card} {w}', "{w} {ip} {phone} {w}",
    "{w} {w} {w} {w} {w}", "{w} {w} {n} {w}", "the {w} of {w} is {n} {w}", "in {y} {w} {w} and {w}", "{w} {w} version {v} {w}", "commit {hex} {w} {w}", "{w} = {n} {w}", '{w} said " {w} {w} "', "{w} | {w} | {n} | {w}", "{w} {date} {w} at {clock}", "see https://{w}.org/{w} {w}",
    "token {w} {w} key {w}", "call {w} phone {w} mail {w}", "{n} {n} {n} {n}", "{date} {date} {w}", "{w} ( {n} ) {w}", "${n} {w} {n}% {w}", "the key = {w} {w}", 'a token = "{w}" {w}', "{w} {big} {w}", "{w} {w} {big} {n}",
)


def labelled_rows(times: int = 8, seed: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: each sentence ``times`` times with other fillings, as (text, spans)."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(["an", "er", "on", "th", "ti", "eau", "de", "lo", "ch", "ß", "é", "ción", "st", "the"], rng.integers(1, 5)))
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))

    def fill(slot: str) -> tuple[str, str]:
        if slot == "email":
            return f"{word()}.{number(2)}@{word()}{number(1)}.example.com" if rng.random() < 0.7 else f"{word()}_{word()}@{word()}.org", "email"
        if slot == "phone":
            a, b, c = number(3), number(3), number(4)
            return str(rng.choice([f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}"])), "phone"
        if slot == "ip":
            return ".".join(map(str, rng.integers(0, 256, 4))), "ip"
        if slot == "card":
            d = number(16)
            return (d if rng.random() < 0.6 else " ".join(d[i : i + 4] for i in range(0, 16, 4))), "card"
        if slot.startswith("secret"):
            n = int(rng.integers(24, 48))
            return ("".join(rng.choice(list("0123456789abcdef"), 40)) if rng.random() < 0.6 else "sk_" + "".join(rng.choice(alphabet, n))), "secret"
        if slot == "w":
            x = word()
            x = x.capitalize() if rng.random() < 0.2 else x.upper() if rng.random() < 0.1 else x
            return x + str(rng.choice(["", "", "", "", ",", "###", "$$$", "!!", "***", "%%%", "&&&", "."])), ""
        if slot == "n":
            return number(int(rng.integers(1, 7))) + str(rng.choice(["", "", ",", "."])), ""
        if slot == "big":
            return number(int(rng.integers(8, 14))), ""
        if slot == "y":
            return str(rng.integers(1500, 2050)), ""
        if slot == "v":
            return ".".join(map(str, rng.integers(0, 30, rng.integers(2, 4)))), ""
        if slot == "hex":
            return "".join(rng.choice(list("0123456789abcdef"), rng.integers(7, 40))), ""
        if slot == "date":
            return f"{rng.integers(1900, 2050)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", ""
        return f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", ""

    out = []
    for _ in range(times):
        for sentence in _SENTENCES:
            text, spans, tail = "", [], str(rng.choice(["", "", "###", "$$$", ",", "!!"]))
            for i, part in enumerate(re.split(r"\{(\w+)\}", sentence)):
                if i % 2 == 0:
                    text += part
                    continue
                filled, kind = fill(part)
                if kind:
                    spans.append((kind, len(text), len(text) + len(filled)))
                text += filled + (tail if kind and '"' not in sentence else "")
            out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: row_id, text, spans (kind, start, end)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(labelled_rows())], "row_id long, text string, spans array<struct<kind:string,start:int,end:int>>")


@lru_cache(maxsize=1)
def _built_in() -> Field:
    return fit(labelled_rows())


def train(labelled: DataFrame | None = None) -> Field:
    """A field from a table like :func:`labelled_table` (MAX_ROWS rows at most, rows with a null text left out)."""
    if labelled is None:
        return _built_in()
    rows = labelled.filter("text IS NOT NULL").orderBy("row_id", "text").limit(MAX_ROWS).collect()
    return fit([(r["text"], [tuple(s) for s in r["spans"] or ()]) for r in rows])


def _trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    if kind == "secret":  # what stands before a value belongs to its name
        a += text[a:b].rstrip("=\"' ").rfind("=") + 1
    while a < b and not (text[a].isalnum() or kind == "phone" and text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def _accepts(kind: str, found: str) -> bool:
    """What a span of the random field must have beyond its label."""
    if kind == "email":
        return "@" in found
    if kind == "ip":
        return _IP.fullmatch(found) is not None and valid("ip", found)
    if kind == "secret":
        return len(found) >= 16
    return valid(kind, found)


def added_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in characters that the random field finds in each text."""
    raw = [t.encode() for t in texts]
    joined = b"\n".join(raw)
    w = words_of(joined)
    labels = field.decode(w)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(labels)
    if not len(hits):
        return out
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, w.start[hits], side="right")
    kind = (labels[hits] - 1) // 2
    starts = np.ones(len(hits), bool)  # inside labels carry on a span of their kind, else they begin one
    starts[1:] = (labels[hits[1:]] % 2 == 1) | (np.diff(hits) != 1) | (np.diff(kind) != 0) | (np.diff(w.sentence[hits]) != 0)
    at = np.flatnonzero(starts)
    # characters before each byte: all bytes but those that carry on a character
    before = np.append(0, np.cumsum(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80, dtype=np.int32))
    begins = before[ends - [len(r) + 1 for r in raw]]
    for a, b in zip(at, np.append(at[1:], len(hits)), strict=True):
        i, k = int(doc[a]), KINDS[kind[a]]
        x, y = (int(before[byte] - begins[i]) for byte in (w.start[hits[a]], w.end[hits[b - 1]]))
        x, y = _trimmed(k, texts[i], x, y)
        if _accepts(k, texts[i][x:y]):
            out[i].append((k, x, y))
    return out


def spans_of(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text; the added ones overlap no base span and none another."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = []
    at = 0
    while at < len(texts):  # runs of texts up to CHARS together
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHARS:
            size += len(texts[end])
            end += 1
        added += added_spans(texts[at:end], field)
        at = end
    out = []
    for own, more in zip(base, added, strict=True):
        new = [s for s, over in zip(more, overlapping(more, own), strict=True) if not over] if own else more
        out.append((own, sorted([*own, *new], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def overlapping(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each span overlaps one of the others: of those that begin before its end, the furthest end decides."""
    by_start = sorted((a, b) for _, a, b in others)
    begins, furthest = [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))
    before = [bisect_left(begins, b) for _, _, b in spans]
    return [k > 0 and furthest[k - 1] > a for (_, a, _), k in zip(spans, before, strict=True)]


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty: no spans and the hash of the empty string. Repeated rows give repeated
    results; other columns are not read. Offsets are code points, ends exclusive. No shuffle; a task
    holds one Arrow batch, and the model, of fixed size, is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE]
            hashes = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([spelled(all_) for _, all_ in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted_batches(batches: Iterator[pa.RecordBatch], at: int, field: Field) -> Iterator[pa.RecordBatch]:
    """The batches with column ``at`` redacted, ROWS rows at a time, so that a batch's texts are not all held a second and third time."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            texts = batch.column(at).to_pylist()
            found = spans_of([t or "" for t in texts], field)
            new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """``documents`` with all spans in ``text`` replaced, and n_chars (where there is such a column) counted anew.

    Null texts stay null. All other columns stay as they are, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or train())
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return redacted_batches(batches, at, shared.value)

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        kept = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", kept)
    return out
