"""64-bit hashes of the words of many texts at once.

A word is a run of bytes other than blank and U+0009 to U+000D; A-Z count as
a-z. With prefix sums of byte values times powers of an odd number modulo
2**64, the hash of every word is one subtraction and one multiplication.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.textarrays import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers and inverse powers, at least ``n`` of them."""
    if "value" not in _CACHE:
        value = mix(np.arange(1, 257, dtype=np.uint64))
        value[65:91] = value[97:123]
        _CACHE["value"] = value
    have = len(_CACHE.get("power", ()))
    if have < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _CACHE[name] = np.multiply.accumulate(p)
    return _CACHE["value"], _CACHE["power"], _CACHE["inverse"]


def word_hashes(texts: list[str], tail: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts in order, and the number of words of each text.

    With ``tail``, also the hashes of the words' last ``tail`` bytes.
    """
    if not texts:
        none = np.zeros(0, dtype=np.uint64)
        return (none, np.zeros(0, dtype=np.int64), none)[: 3 if tail else 2]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    flat = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = (flat != 32) & ((flat < 9) | (flat > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    value, power, inverse = _tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(value[flat] * power[: len(flat)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin])
    stops = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(begin, np.concatenate([[0], stops])))
    if tail:
        late = np.maximum(begin, end - tail)
        return hashes, counts, mix((total[end] - total[late]) * inverse[late] + np.uint64(tail))
    return hashes, counts
