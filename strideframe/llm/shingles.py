"""Hashes of words and of word windows, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finalizer: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (split at ASCII white space) of all texts in order, and the number of words of each text."""
    lists = [t.encode("utf-8", "replace").split() for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for x in lists for w in x]
    return (pd.util.hash_array(flat, categorize=True) if len(flat) else np.empty(0, np.uint64)), counts


def windows(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start of every k-word window inside one text; a shorter text with words has one window of all of them."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    n = len(h)
    z = np.zeros(max(0, n - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            z = mix(z + h[i : i + len(z)] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
        at = np.flatnonzero(np.arange(len(z)) + k <= ends[doc[: len(z)]])
        small = np.flatnonzero((counts > 0) & (counts < k))
        if not len(small):
            return z[at], doc[at], at
        short = np.zeros(len(small), np.uint64)
        for i in range(k - 1):
            has = counts[small] > i
            part = h[np.minimum(ends[small] - counts[small] + i, n - 1)]
            short = np.where(has, mix(short + part + np.uint64(0xD1B54A32D192ED03 * (i + 1) % 2**64)), short)
    starts = (ends - counts)[small]
    docs = np.concatenate([doc[at], small])
    order = np.argsort(docs, kind="stable")
    return np.concatenate([z[at], short])[order], docs[order], np.concatenate([at, starts])[order]
