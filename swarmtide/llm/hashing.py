"""Hashes of spans of a buffer, all at once.

``strings`` suits spans of any length: a sum of mixed blocks of eight bytes, each mixed with its place. ``spans`` are polynomials modulo 2**64
over prefix sums, for overlapping spans; they are only to be used below 512 bytes, from where on such polynomials collide by construction.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20)
BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = tuple(int(x) | 5 for x in _rng.integers(1 << 60, 1 << 63, 2, dtype=np.uint64))
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def power(which: int, n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n at least."""
    if len(_powers[which][0]) < n:
        for k, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[which][k] = np.cumprod(steps)
    return [x[:n] for x in _powers[which]]


def prefix(raw: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[which][raw] * power(which, len(raw))[0], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int, size: int) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * power(which, size)[1][start])


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans may not be empty."""
    blocks = (end - start + 7) // 8
    of = np.repeat(np.arange(len(start)), blocks)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(len(of)) - first[of]
    at = start[of] + 8 * nth
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8")[:, 0].copy() if len(of) else np.zeros(0, np.uint64)
    over = np.maximum(at + 8 - end[of], 0).astype(np.uint64) * _U(8)
    eight &= _U(0xFFFFFFFFFFFFFFFF) >> over
    each = mixed(mixed(eight + _U(0x9E3779B97F4A7C15)) + (nth + 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    whole = np.add.reduceat(each, first) if len(of) else each
    return mixed(whole + (end - start).astype(np.uint64) * _U(0xA0761D6478BD642F))


def runs(h: np.ndarray, head: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Hash of each run of ``size`` (1 to ``most``) hashes that begins at ``head``."""
    out = size.astype(np.uint64)
    for k in range(most):
        here = np.minimum(head + k, len(h) - 1)
        out += np.where(k < size, mixed(h[here] + _U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), _U(0)) if len(h) else _U(0)
    return mixed(out)
