"""Texts as flat numpy arrays, in blocks of whole texts.

Operators that look at every character work on one flat array per block of
texts instead of one Python call per character or word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 20


def blocks(texts: Sequence[str | None], limit: int = BLOCK) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row numbers, texts) whose lengths add up to about ``limit``; every text is whole."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        rows.append(i)
        parts.append(text)
        held += len(text)
        if held >= limit:
            yield np.asarray(rows), parts
            rows, parts, held = [], [], 0
    if rows:
        yield np.asarray(rows), parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the parts, each part followed by a 0, and each part's start."""
    flat = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    return flat, np.cumsum(lengths) - lengths


_TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 if it isn't a letter."""
    if "letters" not in _TABLES:
        out = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _TABLES["letters"] = out
    return _TABLES["letters"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; every run must have an element."""
    return np.add.reduceat(values, starts)
