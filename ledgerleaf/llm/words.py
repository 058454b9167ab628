"""Word hashes and shingle sets of whole texts, vectorised with numpy inside Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from ledgerleaf.llm.common import forgets

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words are runs of other bytes than ASCII white space; UTF-8 keeps this the same as on code points.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LIMIT = 300_000
_cache: dict[bytes, int] = {}
forgets.append(_cache.clear)
_digest = xxhash.xxh3_64_intdigest


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a bounded cache of words saves most of the hashing."""
    if len(_cache) > _LIMIT:
        _cache.clear()
    get = _cache.get
    out = [get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _cache[words[i]] = _digest(words[i])
    return np.array(out, np.uint64)


_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the one hash of all; of none, nothing."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    w = min(width, len(h))
    n = len(h) - w + 1
    total = np.full(n, w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(w):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(mixed(total))
