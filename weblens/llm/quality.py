"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are binned surface figures of its own and of
the lines before and after it; forward-backward gives each line's marginal, and the marginals
weighted by line length give the document's quality, calibrated on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import crf
from weblens.llm.common import held_out, map_rows, text_test, training_texts

#: Labelled documents that the model learns from at most, chosen by a hash of their ids.
TRAINING_DOCUMENTS = 3000
BINS = 8
#: Lines and characters whose words and figures are held at a time, and lines whose labels are.
LINES, CHARS, GROUP_LINES = 1 << 13, 500_000, 1 << 16

#: Byte classes: 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 other sign, 7 first byte of a
#: non-ASCII character, 0 its other bytes.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0x80:0xC0] = 0
_CLASS[0xC0:] = 7


def line_blocks(texts: list[str]) -> Iterator[list[str]]:
    """The lines of all texts in their order, in blocks that LINES and CHARS bound unless one line alone is longer. An empty text is one empty line."""
    held, chars = [], 0
    for text in texts:
        for line in text.split("\n"):
            if held and (len(held) >= LINES or chars + len(line) > CHARS):
                yield held
                held, chars = [], 0
            held.append(line)
            chars += len(line) + 1
    if held:
        yield held


def block_figures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(figures of each line, characters of each line)."""
    data = np.frombuffer("\n".join(lines).encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    begins = np.concatenate([[0], ends[:-1] + 1])
    kinds = _CLASS[data]

    def count(k: int) -> np.ndarray:
        if len(lines) == 1:  # it may be very long
            return np.array([np.count_nonzero(kinds == k)], dtype=float)
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        return (total[ends] - total[begins]).astype(float)

    lower, upper, digit, blank, mark, sign, wide = (count(k) for k in range(1, 8))
    chars = np.maximum(1.0, lower + upper + digit + blank + mark + sign + wide)
    words = [line.split() for line in lines]
    n = np.array([len(w) for w in words], dtype=float)
    some = np.maximum(1.0, n)
    again = np.array([sum(map(str.__eq__, w, w[1:])) for w in words], dtype=float)
    distinct = np.array([len(set(w)) for w in words], dtype=float)
    ends_well = np.array([line.rstrip()[-1:] in ".!?\"'" for line in lines], dtype=float)
    figures = np.column_stack(
        [
            np.log1p(chars),
            (lower + wide) / chars,
            upper / chars,
            digit / chars,
            blank / chars,
            mark / chars,
            sign / chars,
            (lower + upper + wide) / some,
            again / some,
            1.0 - distinct / some,
            distinct / some * np.log1p(n),
            ends_well,
        ]
    )
    return figures, chars


def line_counts(texts: list[str]) -> np.ndarray:
    return np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)


def _bins(figures: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each figure, (lines, figures)."""
    return np.stack([np.searchsorted(edges[j], figures[:, j], side="right") for j in range(figures.shape[1])], axis=1).astype(np.uint8)


def _around(own: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of the lines themselves, of the previous lines and of the next ones."""
    yield own
    for step, none in ((1, np.cumsum(lengths) - lengths), (-1, np.cumsum(lengths) - 1)):
        other = np.roll(own, step, axis=0)
        other[none] = BINS  # no such line
        yield other


def _features(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Feature ids of each line, (lines, 3 * figures)."""
    k, width = own.shape[1], BINS + 1
    return np.concatenate([bins + np.arange(i * k, i * k + k) * width for i, bins in enumerate(_around(own, lengths))], axis=1)


def _line_scores(own: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed weights of each line's features, one feature of all lines at a time: no line's features are ever held together."""
    k = own.shape[1]
    tables = weights.reshape(3, k, BINS + 1, weights.shape[1])
    scores = np.zeros((len(own), weights.shape[1]))
    for table, bins in zip(tables, _around(own, lengths), strict=True):
        for j in range(k):
            scores += table[j][bins[:, j]]
    return scores


@dataclass
class QualityModel:
    edges: np.ndarray
    chain: crf.Chain
    slope: float
    offset: float

    def line_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, characters of each line, lines of each text)."""
        own, chars = [], []
        for lines in line_blocks(texts):
            figures, n = block_figures(lines)
            own.append(_bins(figures, self.edges))
            chars.append(n)
        lengths = line_counts(texts)
        scores = _line_scores(np.concatenate(own), lengths, self.chain.weights)
        good, _, _ = crf.marginals(scores, lengths, self.chain)
        return good[:, 1], np.concatenate(chars), lengths

    def raw(self, texts: list[str]) -> np.ndarray:
        """Log odds of each text, from groups of texts that GROUP_LINES bounds unless one text alone has more lines."""
        out, start, held = [], 0, 0
        for i, n in enumerate(line_counts(texts).tolist()):
            if i > start and held + n > GROUP_LINES:
                out.append(self._raw(texts[start:i]))
                start, held = i, 0
            held += n
        return np.concatenate([*out, self._raw(texts[start:])])

    def _raw(self, texts: list[str]) -> np.ndarray:
        good, chars, lengths = self.line_marginals(texts)
        at = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(good * chars, at) / np.add.reduceat(chars, at)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return crf.sigmoid(self.slope * self.raw(texts) + self.offset)


def fit(sample: list[tuple[str, int]]) -> QualityModel:
    """Learn from (text, quality) pairs; each line takes its document's label. No pairs: everything scores 0.5."""
    if not sample:
        sample = [("", 0), ("", 1)]
    texts, labels = [t for t, _ in sample], np.array([int(y) for _, y in sample])
    figures, lengths = np.concatenate([block_figures(lines)[0] for lines in line_blocks(texts)]), line_counts(texts)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(figures, cuts, axis=0).T.copy()
    ids = _features(_bins(figures, edges), lengths)
    chain = crf.train(
        ids.ravel(),
        np.full(len(ids), ids.shape[1]),
        np.arange(len(ids)),
        np.repeat(labels, lengths),
        lengths,
        3 * figures.shape[1] * (BINS + 1),
        2,
    )
    model = QualityModel(edges, chain, 1.0, 0.0)
    slope, offset = crf.logistic(model.raw(texts)[:, None], labels, l2=1.0)
    return QualityModel(edges, chain, float(slope), float(offset))


def train_quality(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS) -> QualityModel:
    return fit(training_texts(documents, labels, "quality", limit))


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted.

    A null text counts as empty, and an empty text is one empty line with its own score. Repeated rows
    get equal scores. An empty table gives no rows. Only doc_id and text are read.
    """

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "score": model.scores([t or "" for t in rows["text"]])}

    scored = map_rows(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        ["doc_id", "text"],
        make,
        "doc_id long, score double",
    )
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of documents whose quality score is `least` or more, with all their columns."""
    return documents.where(text_test(lambda: lambda texts: (model.scores(texts) >= least).tolist()))
