"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases the text, maps homoglyphs, and digits and signs that touch letters, to the letters they
stand for, and turns other signs to blanks, so every term is searched as " term" (the start of a word)
or " term " (a whole word). Terms and weights are learned from labelled training documents. A
word's weight is that of its heaviest term; words inside an exception phrase don't count. A document's
hits, as they stand and normalised by its length, give its score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import crf
from weblens.llm.common import held_out, map_rows, training_texts

#: Labelled documents of each class that the lexicon is learned from at most, chosen by a hash of their ids.
TRAINING_DOCUMENTS = 4000
#: A term is a whole word, or the start of a word of so many letters.
STEMS = range(4, 9)
#: A term needs so many toxic documents, and such a log ratio of its rates in toxic and clean documents.
LEAST_DOCUMENTS, LEAST_WEIGHT = 4, 3.0

# Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ƒ": "f", "ł": "l", "ø": "o",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
#: Phrases in which a term is harmless; more are learned from clean documents.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pathetic fallacy", "sore loser")


class _Fold(dict):
    """Translation table that is filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif c in SUBSTITUTES:
            out = c
        elif c.isalpha():
            out = unicodedata.normalize("NFKC", c).lower()
            out = HOMOGLYPHS.get(out, out)
            out = out if out.isalpha() else c
        elif unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        else:
            out = " "
        self[code] = out
        return out


_FOLD = _Fold()


_SIGNS = "".join(map(re.escape, SUBSTITUTES))
_ALONE = re.compile(rf"(?<![^\s])[{_SIGNS}]+(?![^\s])")
_LETTERS = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """Words of folded letters with one blank before, between and after them. A number that stands alone is the word "#"."""
    plain = _ALONE.sub("#", text.lower().translate(_FOLD)).translate(_LETTERS)
    return f" {' '.join(plain.split())} "


@dataclass
class Lexicon:
    """weights: folded term -> weight; a term that ends in a blank is a whole word."""

    weights: dict[str, float]
    exceptions: list[str]
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, automaton, folded: str) -> dict[int, float]:
        """Start of each word with a hit -> weight of its heaviest term."""
        weights: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in automaton.iter(folded) if len(automaton) else ():
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif weight > weights.get(start, 0.0):
                weights[start] = weight
        if not spared:
            return weights
        # Phrases come by their ends. The furthest end of those that start at or before a word tells whether one holds it.
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return {i: w for i, w in weights.items() if not ((k := bisect_right(starts, i)) and reach[k - 1] > i)}

    def figures(self, automaton, text: str) -> list[float]:
        folded = fold(text)
        found = self.hits(automaton, folded)
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        total, words = sum(found.values()), folded.count(" ") - 1
        return [1.0, max(found.values()), math.log1p(total), total / math.sqrt(words)]


def _terms(text: str) -> set[str]:
    out = set()
    for word in set(fold(text).split()) - {"#"}:
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in STEMS if k <= len(word))
    return out


def learn(sample: list[tuple[str, int]]) -> Lexicon:
    """A lexicon and its calibration from (text, toxic) pairs. Copies of a text count once. Without toxic pairs nothing is toxic."""
    toxic, clean = (list(dict.fromkeys(t for t, y in sample if bool(y) == kind)) for kind in (True, False))
    seen, other = Counter(), Counter()
    for text in toxic:
        seen.update(_terms(text))
    for text in clean:
        other.update(_terms(text) & seen.keys())
    weights = {}
    for term, n in seen.items():
        w = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((other[term] + 0.5) / (len(clean) + 1))
        if n >= LEAST_DOCUMENTS and w >= LEAST_WEIGHT:
            weights[term] = w
    # Of a start and its continuations, the longest that still has nearly all its documents stays: "idiot" as a
    # whole word, but an inflected stem as the start that its forms share.
    covered = set()
    for term in weights:
        for k in range(min(STEMS), len(term) - 1):
            if seen[term] >= 0.9 * seen[start := term[: k + 1]] and start != term:
                covered.add(start)
    kept: dict[str, float] = {}
    for term in sorted(weights.keys() - covered, key=lambda t: (len(t), t)):
        shorter = [kept[term[: k + 1]] for k in STEMS if k + 1 < len(term) and term[: k + 1] in kept]
        if not shorter or weights[term] > max(shorter) + 1.0:
            kept[term] = weights[term]
    lexicon = Lexicon(kept, [*EXCEPTIONS])
    lexicon.exceptions += _learned_exceptions(lexicon, toxic, clean)
    machine = lexicon.automaton()
    rows = np.array([lexicon.figures(machine, t) for t in toxic + clean]).reshape(-1, 4)
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    if len(toxic) and len(clean):
        # The classes are sampled apart, and weigh equally: scores don't depend on the share drawn of each.
        lexicon.calibration = crf.logistic(rows, labels, l2=0.1)
    else:
        lexicon.calibration = np.array([0.0, 0.0, 0.0, 0.0, -3.0])
    return lexicon


def _learned_exceptions(lexicon: Lexicon, toxic: list[str], clean: list[str], least: int = 3) -> list[str]:
    """Two-word phrases around a hit that clean documents have repeatedly and toxic ones never."""
    machine = lexicon.automaton()

    def phrases(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for text in texts:
            folded = fold(text)
            found = lexicon.hits(machine, folded)
            near = set()
            for i in found:
                word = folded[i + 1 : folded.index(" ", i + 1)]
                before, after = folded[:i].rsplit(" ", 1)[-1], folded[i + len(word) + 2 :].split(" ", 1)[0]
                near |= {f"{before} {word}"} if before else set()
                near |= {f"{word} {after}"} if after else set()
            out.update(near)
        return out

    never = phrases(toxic)
    return sorted(p for p, n in phrases(clean).items() if n >= least and p not in never)


def train_lexicon(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS) -> Lexicon:
    both = [training_texts(documents, labels.where(F.col("toxic") == y), "toxic", limit) for y in (1, 0)]
    return learn(both[0] + both[1])


def score_toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted, n_hits, spans.

    spans has the hits as "word:weight" in text order. A null or empty text has no hit and gets the
    score of clean texts; a very long text is read whole, in time in proportion to its length. Repeated rows get equal scores. An empty table gives no rows. Only doc_id and text are read.
    """

    def make():
        machine = lexicon.automaton()

        def step(rows):
            figures, n, spans = [], [], []
            for text in rows["text"]:
                folded = fold(text or "")
                found = lexicon.hits(machine, folded)
                total = sum(found.values())
                figures.append(
                    [1.0, max(found.values()), math.log1p(total), total / math.sqrt(folded.count(" ") - 1)]
                    if found
                    else [0.0] * 4
                )
                n.append(len(found))
                spans.append(",".join(f"{folded[i + 1 : folded.index(' ', i + 1)]}:{w:.2f}" for i, w in sorted(found.items())))
            score = crf.sigmoid(np.column_stack([np.array(figures), np.ones(len(n))]) @ lexicon.calibration)
            return {"doc_id": rows["doc_id"], "score": score, "n_hits": n, "spans": spans}

        return step

    scored = map_rows(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        ["doc_id", "text"],
        make,
        "doc_id long, score double, n_hits long, spans string",
    )
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_hits",
        "spans",
    )
