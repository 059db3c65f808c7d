"""A grouping genetic algorithm for packing items into bins of one size.

Chromosomes are sets of bins. Crossover injects whole well-filled bins of one
parent into the other, takes out the bins that hold one of their items, and
best-fits what was displaced. A search ends when the bins are as few as the
total length allows, or when several generations brought nothing.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

Bins = list[list[int]]


@dataclass(frozen=True)
class Search:
    """``patience``: generations without a better packing after which a search ends."""

    population: int = 4
    generations: int = 8
    patience: int = 3
    inject_share: float = 0.25


class Block:
    """Items of one block: their lengths and the capacity of a bin."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.least = -(-sum(lengths) // capacity)

    def load(self, group: Iterable[int]) -> int:
        return sum(map(self.lengths.__getitem__, group))

    def best_fit(self, bins: Bins, items: Iterable[int]) -> Bins:
        """Put items one by one where they leave the least room; ``bins`` is changed."""
        free = sorted((self.capacity - self.load(b), i) for i, b in enumerate(bins))
        for item in items:
            size = self.lengths[item]
            at = bisect_left(free, (size, -1))
            if at < len(free):
                room, i = free.pop(at)
                bins[i].append(item)
            else:
                room, i = self.capacity, len(bins)
                bins.append([item])
            if room > size:
                insort(free, (room - size, i))
        return bins

    def decreasing(self, items: Iterable[int]) -> list[int]:
        return sorted(items, key=lambda i: (-self.lengths[i], i))

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then fuller ones; larger is better."""
        return -len(bins), sum((self.load(b) / self.capacity) ** 2 for b in bins)

    def first(self) -> Bins:
        return self.best_fit([], self.decreasing(range(len(self.lengths))))

    def shaken(self, rng: random.Random) -> Bins:
        """Best fit in an order that is only nearly decreasing."""
        order = sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i] * rng.uniform(0.85, 1.0))
        return self.best_fit([], order)

    def cross(self, mother: Bins, father: Bins, rng: random.Random, share: float) -> Bins:
        fullest = sorted(father, key=self.load, reverse=True)
        upto = max(1, int(len(fullest) * 2 * share))
        injected = [list(b) for b in rng.sample(fullest[:upto], max(1, upto // 2))]
        new = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in mother:
            if new.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in new]
        return self.best_fit(injected + kept, self.decreasing(displaced))

    def mutated(self, bins: Bins, rng: random.Random) -> Bins:
        """Dissolve the emptiest bins and a few others."""
        order = sorted(range(len(bins)), key=lambda i: self.load(bins[i]))
        gone = set(order[:2]) | set(rng.sample(range(len(bins)), min(len(bins), 2 + len(bins) // 50)))
        left = [list(b) for i, b in enumerate(bins) if i not in gone]
        return self.best_fit(left, self.decreasing(i for g in gone for i in bins[g]))

    def evolve(self, population: list[Bins], search: Search, seed: int) -> list[Bins]:
        """The population after some generations, best first."""
        rng = random.Random(seed)
        if not self.lengths:
            return [[]]
        if not population:
            population = [self.first()]
        ranked = sorted(population, key=self.fitness, reverse=True)
        if len(ranked[0]) <= self.least:
            return ranked
        while len(ranked) < search.population:
            ranked.append(self.shaken(rng))
        ranked.sort(key=self.fitness, reverse=True)
        idle = 0
        for _ in range(search.generations):
            if len(ranked[0]) <= self.least or idle == search.patience:
                break
            before = self.fitness(ranked[0])
            young = []
            for mother in ranked[: search.population // 2]:
                father = rng.choice([p for p in ranked if p is not mother] or [mother])
                young.append(self.mutated(self.cross(mother, father, rng, search.inject_share), rng))
            ranked = sorted(ranked + young, key=self.fitness, reverse=True)[: search.population]
            idle = idle + 1 if self.fitness(ranked[0]) == before else 0
        return ranked


def to_numbers(bins: Bins, n: int) -> list[int]:
    """The bin of each item."""
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def to_bins(numbers: Sequence[int]) -> Bins:
    out: Bins = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return [b for b in out if b]
