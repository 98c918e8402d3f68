"""Secrets in text: fixed patterns, and credential values that are costly to guess.

The cost of a value is the smallest sum over its segmentations into known words, dates, repeats, sequences, keyboard walks and
brute-force spans, in powers of ten of guesses, found by dynamic programming. A whole value in a credential
context whose cost reaches LEAST_COST is a secret of kind "guess", unless it lies in a span of a fixed pattern; one that such a
span only cuts into is added as a whole. All steps take time in proportion to a value's length.
"""

from __future__ import annotations

import functools
import hashlib
import math
from bisect import bisect_right
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import map_rows

#: Powers of ten of guesses.
LEAST_COST = 10.0
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|login"""
    r"""|(?:api|access|private|signing|encryption|client|auth)?[_-]?(?:key|secret|token))[A-Za-z0-9_-]{0,24}["']?"""
    r"""\x20*(?:=>|:=|[:=])\x20*(?:bearer\x20+|basic\x20+)?["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
_BEARER = re.compile(r"\bbearer\x20+([A-Za-z0-9._~+/=-]{6,})", re.I | re.A)

# Words that guessers try first, in rough order.
WORDS = (
    "password", "admin", "welcome", "letmein", "login", "secret", "master", "dragon", "monkey", "sunshine", "princess",
    "football", "baseball", "shadow", "superman", "batman", "trustno", "iloveyou", "hello", "freedom", "whatever", "access",
    "default", "changeme", "change", "please", "guest", "root", "user", "test", "testing", "example", "sample", "demo", "temp",
    "dummy", "placeholder", "your", "here", "none", "null", "undefined", "true", "false", "value", "string", "token", "apikey",
    "key", "pass", "word", "hunter", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "march", "april",
    "june", "july", "august", "october", "december", "company", "server", "database", "mysql", "postgres", "oracle", "redis",
    "spark", "hadoop", "python", "java", "love", "money", "house", "green", "black", "white", "orange", "yellow", "purple",
    "tiger", "eagle", "horse", "correct", "battery", "staple", "cheese", "coffee", "pepper", "ginger", "cookie", "flower",
    "internet", "computer", "google", "amazon", "github", "linux", "windows", "apple", "mobile", "system", "manager", "service",
    "public", "private", "the", "and", "for", "you", "with", "this", "that", "new", "old", "one", "two", "abc", "qwerty",
)
# Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
LEET = str.maketrans("04315$@7!8", "oaeisSatib".lower())

_RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_BEGINS = frozenset(w[:3] for w in WORDS)
_DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
)
_YEAR = re.compile(r"(?:19|20)\d\d")
_RUN = re.compile(r"(.)\1{2,}", re.S)
_AGAIN = re.compile(r"(.{2,12}?)\1+", re.S)


def _neighbours() -> dict[str, set[str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
    return {
        a: {b for b, (x2, y2) in at.items() if a != b and abs(x - x2) <= 1 and abs(y - y2) <= 1}
        for a, (x, y) in at.items()
    }


_NEXT = _neighbours()


@functools.lru_cache(maxsize=4096)
def _size(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def _matches(value: str, known: frozenset[str]) -> list[tuple[int, int, float]]:
    """(start, end, cost) of everything cheaper than brute force."""
    low, out, n = value.lower(), [], len(value)
    plain = low.translate(LEET)
    for i in range(n - 2):
        if low[i : i + 3] not in _BEGINS and plain[i : i + 3] not in _BEGINS:
            continue
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := _RANK.get(plain[i:j])) is not None:
                extra = 0.7
            if rank is not None:
                out.append((i, j, rank + extra + (0.0 if value[i:j].islower() or not value[i:j].isalpha() else 0.5)))
    if low in known:
        out.append((0, n, 4.5))
    for m in re.finditer(r"[^\W\d_]{4,}", low):
        if m.group() in known:
            out.append((*m.span(), 4.5))
    out += [(*m.span(), math.log10(366 * 120)) for m in _DATE.finditer(value)]
    out += [(*m.span(), math.log10(120)) for m in _YEAR.finditer(value)]
    out += [(*m.span(), _size(m.group(1)) + math.log10(m.end() - m.start())) for m in _RUN.finditer(value)]
    for m in _AGAIN.finditer(value):
        unit = m.group(1)
        out.append((*m.span(), sum(map(_size, unit)) + math.log10((m.end() - m.start()) // len(unit))))
    keys = [SHIFTED.get(c, c) for c in low]
    out += _lines(low, 3, 1.3, lambda a, b: abs(ord(b) - ord(a)) == 1, same=True)
    out += _lines(keys, 4, 1.7, lambda a, b: b in _NEXT.get(a, ()), same=False)
    return out


def _lines(keys, least: int, base: float, follows, same: bool) -> list[tuple[int, int, float]]:
    """From each place of a run of keys that follow one another to the run's end, with the cost of its turns.

    A run with the `same` step ends where the step changes; its last key may begin the next one.
    """
    out, n, i = [], len(keys), 0
    steps = [ord(b) - ord(a) for a, b in zip(keys, keys[1:], strict=False)]
    while i < n - 1:
        j = i
        while j < n - 1 and follows(keys[j], keys[j + 1]) and not (same and j > i and steps[j] != steps[i]):
            j += 1
        turns = 0
        for k in range(j - 1, i - 1, -1):  # the run from key k to key j
            turns += k + 1 < j and steps[k] * steps[k + 1] < 0
            if j + 1 - k >= least:
                out.append((k, j + 1, base + math.log10(j + 1 - k) + 0.6 * turns))
        i = max(j, i + 1)
    return out


def guess_cost(value: str, known: frozenset[str] = frozenset()) -> float:
    """log10 of the guesses of the cheapest segmentation of value. `known` has lower-case words of its surroundings."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _matches(value, known):
        by_end.setdefault(j, []).append((i, cost))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + _size(value[j - 1])
        for i, cost in by_end.get(j, ()):
            best[j] = min(best[j], best[i] + cost + (0.3 if i else 0.0))
    return best[-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def guess_spans(text: str, base: list[tuple[str, int, int]], least: float = LEAST_COST) -> list[tuple[str, int, int]]:
    """("guess", start, end) of costly whole values in a credential context, but for those that lie in a base span."""
    found = []
    if ":" in text or "=" in text:
        found += [m.span(1) for m in _CONTEXT.finditer(text)]
    if "earer" in text or "EARER" in text:
        found += [m.span(1) for m in _BEARER.finditer(text)]
    values = found + [(a, b) for _, a, b in base]
    firsts = sorted((x, y) for _, x, y in base)
    reach = list(accumulate((y for _, y in firsts), max))
    # A value's last signs may belong to the sentence around it.
    found = {(a, b - len(text[a:b]) + len(text[a:b].rstrip(".)]}:!?"))) for a, b in found}
    found = sorted((a, b) for a, b in found if not ((k := bisect_right(firsts, (a, math.inf))) and reach[k - 1] >= b))
    if not found:
        return []
    # Words that stand outside all values: a value that is repeated is no better known for that.
    outside, at = [], 0
    for a, b in sorted(values):
        outside.append(text[at : max(at, a)])
        at = max(at, b)
    known = frozenset(re.findall(r"[^\W\d_]{4,}", " ".join([*outside, text[at:]]).lower()))
    out, upto = [], -1
    for a, b in found:
        if a >= upto and b - a >= 6 and guess_cost(text[a:b], known) >= least:
            out.append(("guess", a, b))
            upto = b
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_secrets(documents: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """One row for each row of documents: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    spans has all spans as kind:start:end in code points, end exclusive, by start and then kind, joined by commas. A null
    text counts as empty, and a text of any length is read whole; without spans, spans is empty and base_sha256 is that of the empty string. Repeated rows get equal results;
    an empty table gives no rows. Only doc_id and text are read.
    """

    def make():
        def step(rows):
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")}
            for text in rows["text"]:
                base = base_spans(text or "")
                more = guess_spans(text or "", base, least)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base + more))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(base + more))
            return {"doc_id": rows["doc_id"], **out}

        return step

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(
        texts,
        ["doc_id", "text"],
        make,
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string",
    )
