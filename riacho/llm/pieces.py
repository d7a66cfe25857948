"""Pre-splitting of byte-level BPE tokenizers, vectorised over whole Arrow batches.

The pieces are those of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: Stands between the texts of a batch; no code point.
SENTINEL = sys.maxunicode + 1


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, and of the sentinel."""
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(SENTINEL) if not 0xD800 <= i < 0xE000)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            run = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            out[run] = kind
    out[SENTINEL] = END
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by the sentinel; index of the first code point of each text)."""
    parts, starts, at = [], np.zeros(len(texts) + 1, np.int64), 0
    end = np.array([SENTINEL], np.uint32)
    for i, t in enumerate(texts):
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += (cp, end)
        at += len(cp) + 1
        starts[i + 1] = at
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), starts


def split_points(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every piece of ``cp``; sentinels are no pieces."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == END
    # The last blank before something else goes with it if it is a plain space, else stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    first[last] = True
    first[last[cp[last] == 0x20] + 1] = False
    _contractions(cp, kind, first)
    start = np.flatnonzero(first)
    length = np.diff(start, append=n)
    keep = kind[start] != END
    return start[keep], length[keep]


def _contractions(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
    n = len(cp)
    at = np.flatnonzero((cp == 0x27) & first)
    at = at[(at + 1 < n)]
    one, two = cp[at + 1], cp[np.minimum(at + 2, n - 1)]
    is_one = np.isin(one, [ord(c) for c in "stmd"])
    is_two = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, size in ((at[is_one], 2), (at[is_two & ~is_one], 3)):
        first[found + 1] = False
        after = found + size
        after = after[after < n]
        first[after[kind[after] == LETTER]] = True


#: Places where no piece can cross: before a single space between two visible characters.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PIECES = regex.compile(PATTERN)


def chunks(text: str) -> list[str]:
    """``text`` cut at places that no piece crosses; few of the results are distinct."""
    return _CUT.split(text)


def split_text(text: str) -> list[str]:
    return _PIECES.findall(text)


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that each holds about ``chars`` characters, or one text; with their texts."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin, total = 0, 0
        for i, t in enumerate(texts):
            total += len(t or "") + 1
            if total >= chars or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, total = i + 1, 0
