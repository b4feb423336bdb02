"""FTRL-proximal logistic regression over hashed features, for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash

from graphloom.llm.common import mix64

#: Hash values of words kept by a worker; the memory is emptied when it is full.
REMEMBERED = 1 << 17


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int, skip: int) -> list[np.ndarray]:
    """Hashes of the word n-grams of 1..n words and of the skip-grams: two words with 1..skip words between them."""
    out, run = [h], h
    for k in range(1, n):
        run = mix64(run[:-1]) + h[k:] * np.uint64(2 * k + 1)
        out.append(run)
    for gap in range(2, skip + 2):
        out.append(mix64(h[:-gap] ^ np.uint64(gap)) ^ h[gap:] if len(h) > gap else h[:0])
    return out


class Ftrl:
    """Weights learnt one row at a time: w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).

    alpha / (beta + sqrt(n)) is a coordinate's own rate; l1 keeps weights of rare or useless coordinates at 0.
    """

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 10.0, l2: float = 0.5):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray | float, label: int) -> None:
        """One step for a row with the distinct coordinates ``at`` and their values."""
        w = self.weights(at)
        g = (sigmoid(float((w * x).sum())) - label) * x * np.ones(len(at))
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
