"""A linear-chain conditional random field with two states, in numpy.

State 1 is "good". A line scores weights x features for state 1 and zero for
state 0; a 2 x 2 table scores neighbouring states, and two numbers the first
state. Chains are computed side by side, padded to the longest of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    weights: np.ndarray  # per feature
    steps: np.ndarray  # 2 x 2: from, to
    start: np.ndarray  # per first state


def _messages(model: Model, scores: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log messages and log normalisers of padded chains (chains x places)."""
    n, width = scores.shape
    emit = np.zeros((n, width, 2))
    emit[:, :, 1] = scores
    forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    forward[:, 0] = model.start + emit[:, 0]
    for t in range(1, width):
        f = forward[:, t - 1]
        new = np.stack([np.logaddexp(f[:, 0] + model.steps[0, s], f[:, 1] + model.steps[1, s]) for s in (0, 1)], 1)
        # beyond its end a chain keeps its last message
        forward[:, t] = np.where(live[:, t, None], new + emit[:, t], f)
    for t in range(width - 2, -1, -1):
        b = backward[:, t + 1] + emit[:, t + 1]
        new = np.stack([np.logaddexp(model.steps[s, 0] + b[:, 0], model.steps[s, 1] + b[:, 1]) for s in (0, 1)], 1)
        backward[:, t] = np.where(live[:, t + 1, None], new, 0.0)
    return forward, backward, np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])


def _padded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    live = np.arange(sizes.max()) < sizes[:, None]
    out = np.zeros(live.shape)
    out[live] = values
    return out, live


def _groups(sizes: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of about one length, and their lines: padding at most doubles the work."""
    first = np.concatenate(([0], np.cumsum(sizes)))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        limit = max(2 * int(sizes[order[at]]), 4)
        upto = at + int(np.searchsorted(sizes[order[at : at + most]], limit, "right"))
        group = order[at:upto]
        yield group, np.concatenate([np.arange(first[g], first[g + 1]) for g in group])
        at = upto


def marginals(model: Model, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The probability that each line is good; ``sizes`` are the lines of each chain."""
    return marginals_of_scores(model, features @ model.weights, sizes)


def marginals_of_scores(model: Model, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same from each line's score for state 1."""
    out = np.empty(len(scores))
    for group, lines in _groups(sizes):
        table, live = _padded(scores[lines], sizes[group])
        forward, backward, total = _messages(model, table, live)
        out[lines] = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[live]
    return np.clip(out, 0.0, 1.0)


def train(
    features: np.ndarray, sizes: np.ndarray, good: np.ndarray, rounds: int = 150, ridge: float = 1e-3, rate: float = 0.1
) -> Model:
    """Maximum conditional likelihood of the lines' states (Adam over all chains).

    ``good`` is the state of each line. Every chain counts alike, whatever its
    length.
    """
    n, dims = len(sizes), features.shape[1]
    groups = []
    for group, lines in _groups(sizes, n):
        own = sizes[group]
        truth, live = _padded(good[lines], own)
        groups.append((features[lines], own, truth.astype(np.int64), live, np.repeat(1.0 / own, own)))
    params = np.zeros(dims + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        model = Model(params[:dims], params[dims : dims + 4].reshape(2, 2), params[dims + 4 :])
        gradient = sum(_gradient(model, *group) for group in groups) / n - ridge * params
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(params[:dims], params[dims : dims + 4].reshape(2, 2), params[dims + 4 :])


def _gradient(
    model: Model, features: np.ndarray, sizes: np.ndarray, truth: np.ndarray, live: np.ndarray, weight: np.ndarray
) -> np.ndarray:
    """Observed minus expected counts of a group of chains, each chain weighted by one over its length."""
    table, _ = _padded(features @ model.weights, sizes)
    forward, backward, total = _messages(model, table, live)
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    steps = np.zeros((2, 2))
    if live.shape[1] > 1:
        pair = live[:, 1:] & live[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                after = backward[:, 1:, b] + (table[:, 1:] if b else 0.0)
                belief = np.exp(forward[:, :-1, a] + model.steps[a, b] + after - total[:, None])
                seen = (truth[:, :-1] == a) & (truth[:, 1:] == b)
                steps[a, b] = (((seen - belief) * pair).sum(1) / sizes).sum()
    start = (truth[:, 0] - one[:, 0]).sum()
    return np.concatenate((features.T @ ((truth[live] - one[live]) * weight), steps.ravel(), [-start, start]))
