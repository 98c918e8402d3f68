"""Language of each word, and of each document, from a linear-chain conditional random field.

A word's features are its prefixes and suffixes and its letter n-grams, hashed into one weight table, and its entry in
a lexicon of words that several training documents have; transitions between the languages of neighbouring words are learned with them. Words
of code-switched text get their own marginals by forward-backward, and a document's language is the
one with the largest sum of marginals over its words, weighted by letters.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.llm import crf
from weblens.llm.common import held_out, map_rows, text_or_empty

#: Documents of each language that the model learns from at most, chosen by a hash of their ids.
TRAINING_DOCUMENTS = 200
BITS = 17
#: Words in a training sequence.
SEQUENCE = 6
#: Letters of a word at most; a longer run, as in scripts without blanks, is taken in pieces of so many.
WIDTH = 24
#: Word types whose scores a task keeps at most; then it starts again.
KEPT_TYPES = 400_000
UNKNOWN = "und"

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Lower-cased words: runs that start with a letter, longer ones in pieces of WIDTH."""
    found = _WORDS.findall(text.lower())
    if max(map(len, found), default=0) <= WIDTH:
        return found
    return [w[at : at + WIDTH] for w in found for at in range(0, len(w), WIDTH)]


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids of all words one after the other, number of features of each word). Ids of the lexicon follow the hashed ones."""
    letters = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    sizes = np.minimum(np.array([len(w) for w in words]), WIDTH)
    tails = np.array([w[-4:][::-1] for w in words], dtype="U4").view(np.uint32).reshape(len(words), 4).astype(np.uint64)
    columns, masks = [], []

    def add(values: np.ndarray, kind: int, mask: np.ndarray) -> None:
        mixed = (values + np.uint64(kind * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
        columns.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        masks.append(mask)

    running = np.zeros(len(words), dtype=np.uint64)
    for k in range(4):  # prefixes of 1 to 4 letters
        running = running * np.uint64(1_000_003) + letters[:, k]
        add(running, 1 + k, sizes > k)
    running = np.zeros(len(words), dtype=np.uint64)
    for k in range(4):
        running = running * np.uint64(1_000_003) + tails[:, k]
        add(running, 11 + k, sizes > k)
    longest = int(sizes.max()) if len(words) else 0
    for i in range(longest):  # bigrams and trigrams anywhere
        here = letters[:, i]
        if i + 1 < longest:
            two = here * _MIX[0] + letters[:, i + 1] * _MIX[1]
            add(two, 21, sizes > i + 1)
            if i + 2 < longest:
                add(two + letters[:, i + 2] * _MIX[2], 22, sizes > i + 2)
    entry = np.fromiter(map(lexicon.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    columns.append(entry + (1 << BITS))
    masks.append(entry >= 0)
    table, mask = np.stack(columns, axis=1), np.stack(masks, axis=1)
    return table[mask], mask.sum(axis=1)


@dataclass
class LanguageModel:
    languages: list[str]
    chain: crf.Chain
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), dtype=np.float32)
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            out[lo : lo + 20_000] = crf.emissions(self.chain.weights, *word_features(part, self.lexicon))
        return out


class Tagger:
    """Scores of word types, kept between batches of one task."""

    def __init__(self, model: LanguageModel):
        self.model, self.known, self.table = model, {}, np.empty((0, len(model.languages)), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words) - self.known.keys())
        if new:
            if len(self.known) + len(new) > KEPT_TYPES and self.known:
                self.known, self.table = {}, self.table[:0]
                new = list(set(words))
            new.sort()
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def word_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(marginals of each word, words of each text, the words)."""
        words, lengths = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = words_of(text)
            lengths[i] = len(found)
            words += found
        if not words:
            return np.zeros((0, len(self.model.languages)), dtype=np.float32), lengths, words
        full = lengths > 0
        found, _, _ = crf.marginals(self.table_of(words), lengths[full], self.model.chain)
        return found, lengths, words

    def table_of(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.table[ids]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """(language, its share, words in any other language) of each text."""
        found, lengths, words = self.word_marginals(texts)
        weights = np.fromiter(map(len, words), dtype=np.float32, count=len(words))[:, None]
        ends = np.cumsum(lengths)
        total = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found * weights, axis=0, dtype=np.float64)])
        sums = total[ends] - total[ends - lengths]
        best = sums.argmax(axis=1) if found.shape[1] else np.zeros(len(texts), dtype=int)
        labels = found.argmax(axis=1) if len(found) else np.zeros(0, dtype=int)
        other = np.concatenate([[0], np.cumsum(labels != np.repeat(best, lengths))])
        switched = other[ends] - other[ends - lengths]
        all_of = sums.sum(axis=1)
        names, scores = [], []
        for i in range(len(texts)):
            known = lengths[i] > 0 and all_of[i] > 0
            names.append(self.model.languages[best[i]] if known else UNKNOWN)
            scores.append(float(min(1.0, sums[i, best[i]] / all_of[i])) if known else 0.0)
        return names, scores, switched.tolist()


def fit(sample: list[tuple[str, str]], rounds: int = 25) -> LanguageModel:
    """Learn from (text, language) pairs; each word takes its document's language."""
    languages = sorted({y for _, y in sample})
    place = {y: k for k, y in enumerate(languages)}
    texts = [(w, place[y]) for t, y in sample if (w := words_of(t))]
    width = max(1, len(languages))
    if not texts:
        zero = np.zeros((width, width))
        return LanguageModel(languages or [UNKNOWN], crf.Chain(np.zeros((1 << BITS, width)), zero, zero[0], zero[0]))
    words = [w for ws, _ in texts for w in ws]
    kinds, types = np.unique(np.array(words, dtype=object), return_inverse=True)
    seen = Counter(w for ws, _ in texts for w in set(ws))
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}
    features, counts = word_features(list(kinds), lexicon)
    # Short training sequences: over whole documents the transitions alone would explain the labels.
    lengths = np.array([min(SEQUENCE, len(ws) - at) for ws, _ in texts for at in range(0, len(ws), SEQUENCE)])
    labels = np.repeat(np.array([y for _, y in texts]), [len(ws) for ws, _ in texts])
    chain = crf.train(features, counts, types, labels, lengths, (1 << BITS) + len(lexicon), width, l2=1.0, rounds=rounds)
    # Documents of one language never switch, so the learned moves are bounded to leave room for switches.
    chain.transitions = np.clip(chain.transitions, -4.0, 4.0)
    parts = (x.astype(np.float32) for x in (chain.weights, chain.transitions, chain.begin, chain.end))
    return LanguageModel(languages, crf.Chain(*parts), lexicon)


def train_language(documents: DataFrame, limit: int = TRAINING_DOCUMENTS) -> LanguageModel:
    """Learn from at most `limit` documents of each language outside the held-out fold, so that rare languages are learned too."""
    known = documents.select(F.col("doc_id").alias("k"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    known = known.where(F.col("k").isNotNull() & F.col("lang").isNotNull() & ~held_out("k"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    ids = {(r["k"], r["lang"]) for r in known.withColumn("place", place).where(F.col("place") <= limit).select("k", "lang").collect()}
    rows = documents.select(F.col("doc_id").alias("k"), text_or_empty().alias("t"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("k").isin([k for k, _ in ids])).collect() if ids else []
    return fit([(r["t"], r["lang"]) for r in sorted((r for r in rows if (r["k"], r["lang"]) in ids), key=lambda r: (r["k"], r["lang"], r["t"]))])


def detect_language(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score, n_switched.

    A null text, and one without a letter, gets "und" and score 0. n_switched counts the words in another
    language than the document's, a run of more than WIDTH letters by its pieces. Texts of any length are read whole. Repeated rows get equal
    results; an empty table gives no rows. Only doc_id and text are read.
    """

    def make():
        tagger = Tagger(model)

        def step(rows):
            names, scores, switched = tagger.predict([t or "" for t in rows["text"]])
            return {"doc_id": rows["doc_id"], "lang_pred": names, "score": scores, "n_switched": switched}

        return step

    found = map_rows(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        ["doc_id", "text"],
        make,
        "doc_id long, lang_pred string, score double, n_switched long",
    )
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switched")
