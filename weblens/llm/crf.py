"""Linear-chain conditional random fields over batches of sequences, in numpy.

Positions of all sequences lie in one flat array. They are laid out time-major with the longest
sequences first, so that one step of the recursions is one dense operation over a slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Learned parameters: feature weights (V, L), transitions (L, L), and end scores (L)."""

    weights: np.ndarray
    transitions: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, starts, active): where each flat position goes, and each step's first place and width."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
    starts = np.concatenate([[0], np.cumsum(active)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return starts[step] + rank[owner], starts, active


def marginals(
    scores: np.ndarray, lengths: np.ndarray, chain: Chain, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Forward-backward: P(label at position), expected transition counts if asked for, and sum of log Z."""
    kind = scores.dtype
    place, starts, active = layout(lengths)
    top = scores.max(axis=1, keepdims=True)
    a = np.empty_like(scores)
    a[place] = np.exp(scores - top)
    move, begin, end = (np.exp(x).astype(kind) for x in (chain.transitions, chain.begin, chain.end))
    back = np.ascontiguousarray(move.T)
    alpha = np.empty_like(a)
    log_z, steps = float(top.sum()) if pairs else 0.0, len(active)
    for t in range(steps):
        lo, n = starts[t], active[t]
        now = a[lo : lo + n] * (begin if t == 0 else alpha[starts[t - 1] : starts[t - 1] + n] @ move)
        norm = now.sum(axis=1, keepdims=True)
        alpha[lo : lo + n] = now / norm
        if pairs:
            log_z += float(np.log(norm).sum())
    beta = np.empty_like(a)
    moved = np.zeros_like(chain.transitions) if pairs else None
    for t in range(steps - 1, -1, -1):
        lo, n = starts[t], active[t]
        m = active[t + 1] if t + 1 < steps else 0
        beta[lo + m : lo + n] = end
        if pairs and n > m:
            log_z += float(np.log(alpha[lo + m : lo + n] @ end).sum())
        if m:
            g = a[starts[t + 1] : starts[t + 1] + m] * beta[starts[t + 1] : starts[t + 1] + m]
            b = g @ back
            if pairs:
                prior = alpha[lo : lo + m]
                moved += ((prior / (prior * b).sum(axis=1, keepdims=True)).T @ g) * move
            beta[lo : lo + m] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    return both[place], moved, log_z


def emissions(weights: np.ndarray, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Summed weights of each type's features; features holds the ids of all types one after the other."""
    out = np.zeros((len(counts), weights.shape[1]))
    full = counts > 0
    if full.any():
        at = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(weights[features], at, axis=0)
    return out


def train(
    features: np.ndarray,
    counts: np.ndarray,
    types: np.ndarray,
    labels: np.ndarray,
    lengths: np.ndarray,
    n_features: int,
    n_labels: int,
    l2: float = 1.0,
    rounds: int = 40,
) -> Chain:
    """Maximum likelihood with an L2 penalty. Each position has a type; types share feature lists."""
    size = n_features * n_labels
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(labels), dtype=bool)
    inner[first] = False
    gold = np.eye(n_labels)[labels]
    gold_moves = np.zeros((n_labels, n_labels))
    np.add.at(gold_moves, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    gold_begin, gold_end = gold[first].sum(axis=0), gold[last].sum(axis=0)

    def unpack(x: np.ndarray) -> Chain:
        rest = x[size:]
        return Chain(
            x[:size].reshape(n_features, n_labels),
            rest[: n_labels**2].reshape(n_labels, n_labels),
            rest[n_labels**2 : n_labels**2 + n_labels],
            rest[n_labels**2 + n_labels :],
        )

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        chain = unpack(x)
        scores = emissions(chain.weights, features, counts)[types]
        probability, moved, log_z = marginals(scores, lengths, chain, pairs=True)
        value = log_z - float((scores * gold).sum() + (gold_moves * chain.transitions).sum())
        value -= float(gold_begin @ chain.begin + gold_end @ chain.end)
        off = probability - gold
        by_type = np.stack([np.bincount(types, off[:, k], len(counts)) for k in range(n_labels)], axis=1)
        spread = np.repeat(by_type, counts, axis=0)
        slope = np.stack([np.bincount(features, spread[:, k], n_features) for k in range(n_labels)], axis=1)
        parts = [slope.ravel(), (moved - gold_moves).ravel(), off[first].sum(axis=0), off[last].sum(axis=0)]
        return value + 0.5 * l2 * float(x @ x), np.concatenate(parts) + l2 * x

    return unpack(minimize(loss, np.zeros(size + n_labels**2 + 2 * n_labels), rounds))


def minimize(loss, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y, rho in reversed(past):
            kept.append(rho * (s @ q))
            q -= kept[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(slope).sum() / 10)
        for (s, y, rho), k in zip(past, reversed(kept), strict=True):
            q += (k - rho * (y @ q)) * s
        step, drop = 1.0, slope @ q
        if drop <= 0:
            break
        for _ in range(25):
            tried, its_slope = loss(x - step * q)
            if tried <= value - 1e-4 * step * drop:
                break
            step /= 2
        else:
            break
        s, y = -step * q, its_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1.0 / (s @ y))][-memory:]
        done = abs(value - tried) < 1e-6 * max(1.0, abs(value))
        x, value, slope = x + s, tried, its_slope
        if done:
            break
    return x


def logistic(inputs: np.ndarray, labels: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression; the last one is the intercept, which has no penalty."""
    rows = np.column_stack([inputs, np.ones(len(inputs))])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows @ w
        held = np.append(w[:-1], 0.0)
        value = float(np.logaddexp(0, z).sum() - labels @ z + 0.5 * l2 * held @ held)
        return value, rows.T @ (sigmoid(z) - labels) + l2 * held

    return minimize(loss, np.zeros(rows.shape[1]), rounds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
