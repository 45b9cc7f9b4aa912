"""Words of many texts at once, as numbers: hashes of words and of runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from tideline.llm.common import kept

#: Bytes of text, about, that are handled at once.
BATCH_CHARS = 400_000
#: Fixed value: words are parted by blanks and the ASCII controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P, _Q1, _Q2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(h: np.ndarray, k: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    powers = kept("powers", dict)
    have = powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * BATCH_CHARS:  # those of a very long text aren't kept
            powers[base] = have
    return have[0][:n], have[1][:n]


def runs(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all k numbers in a row."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _power((_Q1, _Q2)[which], len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1], 0xFF51AFD7ED558CCD if which == 0 else 0x9FB21C651E98DF25)


def hashed(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words begin (one place more than texts)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(data) + b"\n"
    a = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    word = (a != 32) & ((a < 9) | (a > 13))
    step = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power(_P, len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:-1], dtype=np.uint64, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(d) + 1 for d in data])
    return h, np.searchsorted(starts, bounds)




def grouped(rows: Iterable[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Rows in groups of about BATCH_CHARS characters of text, or of one row."""
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += len(r[text_at])
        if size > BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group
