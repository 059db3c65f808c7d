"""A log-bilinear word model over a small vocabulary, in numpy.

The two words before a word predict a vector; its product with a word's vector,
plus a bias, scores that word. Training is noise-contrastive: true words are
told from words drawn from the unigram distribution, without normalising.
Scoring normalises: one product of all contexts with all words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Weights:
    """``context``: vectors of preceding words, ``mix``: a matrix per position, ``target`` and ``bias`` of words."""

    context: np.ndarray
    mix: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.mix, self.target, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return Weights(*out)


def initial(unigram: np.ndarray, dims: int, seed: int = 1) -> Weights:
    """Small random vectors and the unigram distribution as bias."""
    rng, n = np.random.default_rng(seed), len(unigram)
    return Weights(
        rng.normal(0, 0.1, (n, dims)),
        np.stack([np.eye(dims), np.eye(dims)]),
        rng.normal(0, 0.1, (n, dims)),
        np.log(unigram),
    )


def predicted(w: Weights, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The vector that two preceding words predict; ``second`` stands next to the word."""
    return w.context[first] @ w.mix[0] + w.context[second] @ w.mix[1]


def contrast(
    w: Weights,
    state: np.ndarray,
    grams: np.ndarray,
    unigram: np.ndarray,
    rng: np.random.Generator,
    noise: int = 5,
    rate: float = 0.1,
    weight: np.ndarray | None = None,
) -> None:
    """One noise-contrastive step (Adagrad) on word triples; ``w`` and ``state`` change in place.

    ``weight``: what each triple stands for, 1 on average; 1 for all if missing.
    """
    n, words = len(grams), len(unigram)
    first, second, true = grams.T
    drawn = rng.choice(words, (n, noise), p=unigram)
    asked = np.concatenate((true[:, None], drawn), 1)
    guess = predicted(w, first, second)
    vectors = w.target[asked]
    score = np.einsum("nd,nkd->nk", guess, vectors) + w.bias[asked] - np.log(noise * unigram[asked])
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    error = -p
    error[:, 0] += 1
    error /= n
    if weight is not None:
        error *= weight[:, None]
    to_guess = np.einsum("nk,nkd->nd", error, vectors)
    flat = asked.ravel()
    target = np.zeros_like(w.target)
    np.add.at(target, flat, (error[:, :, None] * guess[:, None, :]).reshape(len(flat), -1))
    bias = np.bincount(flat, error.ravel(), words)
    mix = np.stack([w.context[first].T @ to_guess, w.context[second].T @ to_guess])
    context = np.zeros_like(w.context)
    np.add.at(context, first, to_guess @ w.mix[0].T)
    np.add.at(context, second, to_guess @ w.mix[1].T)
    gradient = np.concatenate([g.ravel() for g in (context, mix, target, bias)])
    state += gradient**2
    step = rate * gradient / (np.sqrt(state) + 1e-8)
    at = 0
    for part in w.parts():
        part += step[at : at + part.size].reshape(part.shape)
        at += part.size


def log_table(w: Weights) -> np.ndarray:
    """Normalised natural log-probabilities: row first * words + second, column word."""
    words = len(w.bias)
    out = np.empty((words * words, words), np.float32)
    every = np.arange(words)
    for first in range(words):
        scores = predicted(w, np.full(words, first), every) @ w.target.T + w.bias
        scores -= scores.max(1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(1, keepdims=True))
        out[first * words : (first + 1) * words] = scores
    return out
