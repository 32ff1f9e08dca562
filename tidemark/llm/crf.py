"""A linear-chain conditional random field with two labels: 0 boilerplate, 1 content."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Scores of content over boilerplate by feature, of label pairs (from, to), and of first labels."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]
    starts: tuple[float, float]


def viterbi(chain: Chain, content: list[float]) -> list[int]:
    """The best labels of a sequence whose elements score content[t] for label 1 and 0 for label 0. Ties: label 1."""
    (m00, m01), (m10, m11) = chain.moves
    a, b = chain.starts[0], chain.starts[1] + content[0] if content else 0.0
    back = []
    for e in content[1:]:
        stay0, from1 = a + m00, b + m10
        from0, stay1 = a + m01, b + m11
        back.append((int(from1 >= stay0), int(stay1 >= from0)))
        a, b = max(stay0, from1), max(from0, stay1) + e
    labels = [int(b >= a)] if content else []
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, moves: np.ndarray, starts: np.ndarray):
    """Mean log-likelihood of label sequences and its gradient; x is (sequence, step, feature), all start at step 0."""
    n, steps, _ = x.shape
    emit = np.stack([np.zeros((n, steps)), x @ w], axis=2)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = starts + emit[:, 0]
    for t in range(1, steps):
        new = _log_sum(alpha[:, t - 1, :, None] + moves, 1) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        new = _log_sum(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    z = _log_sum(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    gold = np.stack([1 - y, y], axis=2) * mask[..., None]
    gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    score = (gold * emit).sum() + (gold_pair * moves).sum() + (gold[:, 0] * starts).sum() - z.sum()
    grad_w = ((gold - node)[..., 1, None] * x).sum((0, 1))
    return score / n, grad_w / n, (gold_pair - pair).sum((0, 1)) / n, (gold[:, 0] - node[:, 0]).sum(0) / n


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], features: int, rounds: int = 120, step: float = 0.15, ridge: float = 1e-3, length: int = 32) -> Chain:
    """Maximum likelihood by gradient ascent with adaptive steps; long sequences are cut into runs of length."""
    runs = [(x[i : i + length], y[i : i + length]) for x, y in sequences for i in range(0, len(y), length)]
    n = len(runs)
    x, y, mask = np.zeros((n, length, features)), np.zeros((n, length)), np.zeros((n, length), dtype=bool)
    for i, (a, b) in enumerate(runs):
        x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, True
    parts = [np.zeros(features), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for k in range(1, rounds + 1):
        grads = gradient(x, y, mask, *parts)[1:]
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            g = g - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    w, moves, starts = parts
    return Chain(tuple(w.tolist()), tuple(map(tuple, moves.tolist())), tuple(starts.tolist()))


def labelled_lines(texts: list[tuple[np.ndarray, np.ndarray, bool]], least: float, rounds: int = 1) -> list[np.ndarray]:
    """Labels of the lines of texts (features, sizes, good) of which only the whole is known to be good or not.

    Hard expectation maximisation. Lines alone are told apart first, each with its text's label; a field fitted on that
    labels them anew, in turns. Few are enough: each turn makes switches rarer. The share of a text's size in lines labelled content must
    agree with what is known: at least `least` where the text is good, less where it isn't; else the whole text's
    label holds for all its lines.
    """
    whole = [np.full(len(size), float(good)) for _, size, good in texts]

    def checked(k: int, y: np.ndarray) -> np.ndarray:
        size = texts[k][1]
        return y if (y @ size >= least * size.sum()) == texts[k][2] else whole[k]

    features = texts[0][0].shape[1]
    alone = fit([(x, y) for (x, *_), y in zip(texts, whole, strict=True)], features, rounds=400, length=1)
    bias = alone.starts[1] - alone.starts[0]
    labels = [checked(k, (x @ np.array(alone.weights) + bias >= 0).astype(float)) for k, (x, *_) in enumerate(texts)]
    for _ in range(rounds):
        chain = fit([(x, y) for (x, *_), y in zip(texts, labels, strict=True)], features)
        labels = [checked(k, np.array(viterbi(chain, (x @ np.array(chain.weights)).tolist()), float)) for k, (x, *_) in enumerate(texts)]
    return labels
