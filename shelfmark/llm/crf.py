"""A linear-chain conditional random field over sparse binary features, two or more labels.

Sequences are decoded and trained in groups of one length, all steps at once, so that
the work per position is a few array operations. Features of a position are numbers
below ``n_features``; the score of a label sequence is the sum of the weights of its
positions' features and of its transitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, from row to column
    starts: np.ndarray  # labels


def by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """Numbers of the sequences, a group for each length above zero."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    return np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []


def emissions(field: Field, features: np.ndarray) -> np.ndarray:
    """Scores of the labels at each position; ``features`` is positions x slots."""
    return field.weights[features].sum(axis=1)


def viterbi(
    field: Field, features: np.ndarray, lengths: np.ndarray, kind: np.ndarray | None = None
) -> np.ndarray:
    """The best label of each position of the sequences laid end to end.

    Of equally good sequences the one with lower labels, from the last position on. With
    ``kind``, positions have the features of that row.
    """
    score = emissions(field, features)
    score = score if kind is None else score[kind]
    offset = np.cumsum(lengths) - lengths
    out = np.zeros(len(score), np.int64)
    for group in by_length(lengths):
        n = int(lengths[group[0]])
        at = offset[group]
        best = score[at] + field.starts
        back = np.zeros((n, len(group), len(field.starts)), np.int8)
        for t in range(1, n):
            ways = best[:, :, None] + field.moves
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[at + t]
        label = best.argmax(axis=1)
        for t in range(n - 1, -1, -1):
            out[at + t] = label
            label = back[t][np.arange(len(group)), label]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def gradient(
    field: Field, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray,
    kind: np.ndarray | None = None,
) -> tuple[float, Field]:
    """Log likelihood of the labels, and its gradient, by forward and backward sums.

    With ``kind``, positions have the features of that row.
    """
    k = len(field.starts)
    score = emissions(field, features)
    score = score if kind is None else score[kind]
    marginal = np.zeros((len(score), k))
    moves, starts, total = np.zeros((k, k)), np.zeros(k), 0.0
    offset = np.cumsum(lengths) - lengths
    for group in by_length(lengths):
        n, at = int(lengths[group[0]]), offset[group]
        ahead = np.zeros((n, len(group), k))
        ahead[0] = score[at] + field.starts
        for t in range(1, n):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + field.moves, 1) + score[at + t]
        norm = _log_sum(ahead[-1], 1)
        after = np.zeros((len(group), k))
        for t in range(n - 1, -1, -1):
            marginal[at + t] = np.exp(ahead[t] + after - norm[:, None])
            if t:
                reach = score[at + t] + after
                both = ahead[t - 1][:, :, None] + field.moves + reach[:, None, :]
                moves -= np.exp(both - norm[:, None, None]).sum(axis=0)
                np.add.at(moves, (labels[at + t - 1], labels[at + t]), 1)
                total += field.moves[labels[at + t - 1], labels[at + t]].sum()
                after = _log_sum(field.moves + reach[:, None, :], 2)
        starts += np.bincount(labels[at], minlength=k) - marginal[at].sum(axis=0)
        total += field.starts[labels[at]].sum() - norm.sum()
    total += score[np.arange(len(labels)), labels].sum()
    error = -marginal
    error[np.arange(len(labels)), labels] += 1
    weights = np.zeros_like(field.weights)
    if kind is not None:
        error = np.stack([np.bincount(kind, error[:, i], len(features)) for i in range(k)], axis=1)
    for slot in range(features.shape[1]):
        np.add.at(weights, features[:, slot], error)
    return float(total), Field(weights, moves, starts)


def train(
    features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int,
    n_labels: int = 2, rounds: int = 60, rate: float = 0.2, decay: float = 1e-3,
    unused: int | None = None, kind: np.ndarray | None = None,
) -> Field:
    """Weights by gradient ascent with per-weight steps (Adam), on the mean likelihood.

    A feature ``unused`` fills places and has no weight.
    """
    field = Field(np.zeros((n_features, n_labels)), np.zeros((n_labels,) * 2), np.zeros(n_labels))
    if not len(features):
        return field
    parts = ("weights", "moves", "starts")
    mean = {p: np.zeros_like(getattr(field, p)) for p in parts}
    square = {p: np.zeros_like(getattr(field, p)) for p in parts}
    for turn in range(1, rounds + 1):
        _, slope = gradient(field, features, labels, lengths, kind)
        if unused is not None:
            slope.weights[unused] = 0
        for p in parts:
            value = getattr(field, p)
            g = getattr(slope, p) / len(labels) - decay * value
            mean[p] = 0.9 * mean[p] + 0.1 * g
            square[p] = 0.99 * square[p] + 0.01 * g * g
            step = mean[p] / (1 - 0.9**turn) / (np.sqrt(square[p] / (1 - 0.99**turn)) + 1e-8)
            value += rate * step
    return field
