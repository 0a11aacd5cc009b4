"""Words as the near-duplicate and decontamination operators see them."""

from __future__ import annotations

import string

import numpy as np
import xxhash

_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def spaced(text: str) -> bytes:
    """Lower-cased UTF-8 with white space for ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_SPACED)


def words_of(text: str) -> list[bytes]:
    """Lower-cased UTF-8 words between white space and ASCII punctuation."""
    return spaced(text).split()


U = np.uint64
#: An odd multiplier of 64-bit arithmetic, any will do.
ODD = U(0xA24BAED4963EE407)
#: Words of more bytes are named one at a time.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, by multiply and xor-shift."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd base and of its inverse, mod 2**64, 0 to n-1 at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = max(n, 1 << 16, 2 * len(_POWERS.get(base, ([], []))[0]) if n < 1 << 23 else 0)
        _POWERS[base] = tuple(np.multiply.accumulate(np.r_[U(1), np.full(n - 1, b, U)]) for b in (base, pow(base, -1, 2**64)))
    return _POWERS[base]


def prefix_sums(names: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of names times powers, and the inverse powers."""
    up, down = powers(base, len(names) + 1)
    return np.r_[U(0), np.cumsum(names * up[: len(names)], dtype=U)], down


def digest(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the names lo..hi-1, the same wherever they stand."""
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U))


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit digests of words: eight bytes at a time go through a finaliser, so no pattern of letters cancels out."""
    size = ends - starts
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))  # the eight bytes from every place on
    h = mix(size.astype(U) * ODD + U(seed))
    mine = np.flatnonzero(size <= LONG)
    at = 0
    while len(mine):
        left = size[mine] - at
        chunk = eights[starts[mine] + at] & _KEEP[np.minimum(left, 8)]
        h[mine] = mix((h[mine] ^ chunk) * ODD)
        at += 8
        mine = mine[left > 8]
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def word_names(blobs: list[bytes], seeds: tuple[int, ...] = (1,)) -> tuple[np.ndarray, ...]:
    """64-bit names of all words between ASCII white space, for each seed, and each blob's number of words."""
    data = np.frombuffer(b" ".join(blobs) + b" " * 9, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    ends_of = np.cumsum([len(b) + 1 for b in blobs])
    counts = np.diff(np.searchsorted(starts, np.r_[0, ends_of])) if blobs else np.empty(0, np.int64)
    return *(_names(data, starts, ends, seed) for seed in seeds), counts


def stretch_names(names: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit names of the ``length`` symbols from each place ``at`` on: pairs of pairs are named, and those put together."""
    out, span, off, level = mix(np.full(len(at), length, U) + U(seed)), 1, 0, names
    while span <= length:
        if length & span:
            out = mix((out ^ level[at + off]) * ODD)
            off += span
        span *= 2
        if span <= length:
            half = span // 2
            level = mix(level * ODD + mix(np.r_[level[half:], np.zeros(min(half, len(level)), U)] + U(span)))
    return out
