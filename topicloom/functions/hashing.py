"""Counter-based uniforms: a draw depends on seed, document, place, sweep and purpose only, so samples
are the same on any partitioning and after any retry."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, doc: np.ndarray, n: int, sweep: int, purpose: int = 0) -> np.ndarray:
    """[len(doc), n] numbers in (0, 1)."""
    base = mix(np.array([(seed * 1_000_003 + sweep * 101 + purpose) % 2**64], np.uint64))
    of_doc = mix(doc.astype(np.int64).view(np.uint64) ^ base)
    at = mix(of_doc[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return ((at >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def normals(seed: int, doc: np.ndarray, n: int, sweep: int, purpose: int = 0) -> np.ndarray:
    """[len(doc), n] standard normal numbers (Box and Muller)."""
    u = uniforms(seed, doc, 2 * n, sweep, purpose)
    return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])
