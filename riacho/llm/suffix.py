"""Suffix arrays of integer sequences in which 0 separates texts."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; each 0 is a separator of its own, so that no comparison passes one. Prefix doubling."""
    n = len(symbols)
    seps = symbols == 0
    rank = np.where(seps, np.cumsum(seps) - 1, symbols.astype(np.int64) + int(seps.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        fresh = np.concatenate([[False], key[1:] != key[:-1]])
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(fresh)
        if n == 0 or int(dense[order[-1]]) == n - 1:
            return order
        ahead = np.concatenate([dense[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        rank = dense * (n + 1) + np.where(seps, 0, ahead)
        order = np.argsort(rank, kind="stable")
        step *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of ``order`` how many symbols it shares with the one before, up to ``depth`` and before any 0."""
    n = len(order)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for at in range(depth):
        a, b = order[live] + at, order[live - 1] + at
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(symbols[a] == symbols[b]) & (symbols[a] != 0)]
        if not len(live):
            break
        out[live] = at + 1
    return out
