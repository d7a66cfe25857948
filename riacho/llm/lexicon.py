"""Minimal acyclic transducer: a shared-suffix automaton over words whose path sums give word numbers, and so ids.

Built from sorted words (incremental minimisation), laid out as flat arrays that can be memory-mapped, and run over all
pieces of a batch at once.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np

ARRAYS = ("symbols", "base", "check", "target", "count", "final", "offsets", "ids")

#: Places for a state's edges that are tried at once.
WINDOW = 2048


class _Node:
    __slots__ = ("edges", "final", "number", "size")

    def __init__(self) -> None:
        self.edges: dict[str, _Node] = {}
        self.final = False
        self.number = -1
        self.size = 0

    def signature(self) -> tuple:
        return self.final, tuple((c, id(n)) for c, n in self.edges.items())


def _minimal(words: Sequence[str]) -> _Node:
    """Root of the minimal automaton of ``words``, which are distinct and sorted by code point."""
    root, register, path, previous = _Node(), {}, [], ""

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, c, child = path.pop()
            parent.edges[c] = register.setdefault(child.signature(), child)

    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        node = path[-1][2] if path else root
        for c in word[common:]:
            child = _Node()
            node.edges[c] = child
            path.append((node, c, child))
            node = child
        node.final = True
        previous = word
    close(0)
    return root


def _states(root: _Node) -> list[_Node]:
    """All states, each after those it leads to; numbers them and counts the words each accepts."""
    out: list[_Node] = []
    stack = [(root, iter(root.edges.values()))]
    seen = {id(root)}
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            node.number, node.size = len(out), node.final + sum(n.size for n in node.edges.values())
            out.append(node)
        elif id(child) not in seen:
            seen.add(id(child))
            stack.append((child, iter(child.edges.values())))
    return out


def compile_lexicon(ids_of: dict[str, Sequence[int]]) -> dict[str, np.ndarray]:
    """Flat arrays of the transducer; non-empty words only. The start state is the last one."""
    words = sorted(w for w in ids_of if w)
    states = _states(_minimal(words))
    alphabet = sorted({c for w in words for c in w})
    symbols = np.zeros(max(map(ord, alphabet), default=0) + 1, np.int32)
    for i, c in enumerate(alphabet, 1):
        symbols[ord(c)] = i
    width = len(alphabet) + 1
    # Slots below ``width`` stay empty, so that every state can use any later one; a state's edges lie at base + symbol.
    size = 4 * width + 4 * sum(len(s.edges) for s in states) + 2 * WINDOW
    check, target, count = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    base = np.zeros(max(1, len(states)), np.int32)
    free = top = width
    for s in sorted(states, key=lambda s: -len(s.edges)):
        codes = np.array([symbols[ord(c)] for c in s.edges], np.int64)
        if not len(codes):
            continue
        while check[free] != -1:
            free += 1
        b = free - int(codes[0])
        while True:
            if b + width + WINDOW > len(check):
                check = np.concatenate([check, np.full(size, -1, np.int32)])
                target, count = (np.concatenate([x, np.zeros(size, np.int32)]) for x in (target, count))
            fits = np.ones(WINDOW, bool)
            for c in codes:
                fits &= check[b + c : b + c + WINDOW] == -1
            if fits.any():
                b += int(fits.argmax())
                break
            b += WINDOW
        base[s.number], before = b, int(s.final)
        top = max(top, b + int(codes[-1]) + 1)
        for to, code in zip(s.edges.values(), codes, strict=True):
            check[b + code], target[b + code], count[b + code] = s.number, to.number, before
            before += to.size
    check, target, count = (x[: top + width] for x in (check, target, count))  # a look-up may reach so far beyond the last edge
    final = np.array([s.final for s in states] or [False], bool)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(ids_of[w]) for w in words], out=offsets[1:])
    ids = np.fromiter((i for w in words for i in ids_of[w]), np.int32)
    return dict(zip(ARRAYS, (symbols, base, check, target, count, final, offsets, ids), strict=True))


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the number of arrays' headers and data, each array aligned so that it can be mapped."""
    out = io.BytesIO()
    for name in ARRAYS:
        a = arrays[name]
        head = np.zeros(8, np.int64)
        head[0], head[1] = np.dtype(a.dtype).num, len(a)
        out.write(head.tobytes())
        out.write(a.tobytes())
        out.write(b"\0" * (-out.tell() % 64))
    return out.getvalue()


def map_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped: workers of one machine share its pages."""
    kinds = {np.dtype(k).num: np.dtype(k) for k in (bool, np.int32, np.int64)}
    raw, at, out = np.memmap(path, np.uint8, "r"), 0, {}
    for name in ARRAYS:
        head = raw[at : at + 64].view(np.int64)
        kind, n = kinds[int(head[0])], int(head[1])
        at += 64
        out[name] = raw[at : at + n * kind.itemsize].view(kind)
        at += n * kind.itemsize
        at += -at % 64
    return out


def look_up(lex: dict[str, np.ndarray], cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word number of each piece ``cp[start : start + length]``, or -1; all pieces take a step at once."""
    number = np.full(len(start), -1, np.int64)
    if len(lex["offsets"]) == 1:
        return number
    symbols, base, check, target, count, final = (lex[k] for k in ARRAYS[:6])
    known = cp < len(symbols)
    code = np.where(known, symbols[np.where(known, cp, 0)], 0)
    live = np.arange(len(start))
    state = np.full(len(start), len(base) - 1, np.int32)
    total = np.zeros(len(start), np.int32)
    pos, left = start.copy(), length.copy()
    while len(live):
        c = code[pos]
        slot = base[state] + c
        ok = (c > 0) & (check[slot] == state)
        if not ok.all():
            live, slot, total, pos, left = live[ok], slot[ok], total[ok], pos[ok], left[ok]
        total = total + count[slot]
        state = target[slot]
        left = left - 1
        pos = pos + 1
        done = left == 0
        if done.any():
            ended = done & final[state]
            number[live[ended]] = total[ended]
            more = ~done
            live, state, total, pos, left = live[more], state[more], total[more], pos[more], left[more]
    return number
