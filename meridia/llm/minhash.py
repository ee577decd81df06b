"""MinHash bands over a text's tokens and padded q-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from meridia.llm.namekit import fold


@lru_cache(32)
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20240).integers(1, 1 << 62, size=n, dtype=np.int64).astype(np.uint64)


def shingles(text: str, q: int) -> list[str]:
    """The tokens and their padded q-grams, in one romanisation."""
    out = set()
    for w in text.split():
        f = f"^{fold(w)}$"
        out.add(f)
        out.update(f[i : i + q] for i in range(len(f) - q + 1))
    return sorted(out)


@lru_cache(1 << 16)
def band_keys(text: str, q: int, rows: int, bands: int) -> tuple[int, ...]:
    """One signed 64-bit key for each band of so many rows; () for a text without tokens.

    Two texts of Jaccard similarity s share no key with probability (1 - s**rows)**bands.
    """
    grams = shingles(text, q)
    if not grams:
        return ()
    h = np.array([xxhash.xxh64_intdigest(s) for s in grams], dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (h[None, :] ^ _seeds(rows * bands)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    low = (x ^ (x >> np.uint64(32))).min(axis=1).reshape(bands, rows)
    return tuple(xxhash.xxh64_intdigest(i.to_bytes(2, "big") + r.tobytes()) - (1 << 63) for i, r in enumerate(low))
