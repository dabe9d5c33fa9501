"""Rabin-Karp fingerprints of word runs: prefix polynomials over bytes, joined word by word.

The fingerprint of a run is that of its words joined by one blank. Three polynomials modulo primes below 2^31 give
the fingerprint of 62 bits and a check of 31 bits that is independent of it.
"""

from __future__ import annotations

import functools

import numpy as np

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 1018364587)
_BLOCK = 1 << 16
_BLANK = 33                     # a byte counts one more than its value, so that a leading zero byte counts


@functools.lru_cache(maxsize=None)
def _powers(k: int, size: int, inverse: bool) -> np.ndarray:
    p, b = PRIMES[k], BASES[k]
    b = pow(b, -1, p) if inverse else b
    out = np.ones(size, np.int64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done:done + more] = out[:more] * pow(b, done, p) % p
        done += more
    return out


def _size(n: int) -> int:
    return 1 << max(int(n), _BLOCK).bit_length()


def word_hashes(vocab: np.ndarray, cuts: np.ndarray, use: int = len(PRIMES)) -> list[np.ndarray]:
    """For the first ``use`` polynomials the value of every word ``vocab[cuts[i]:cuts[i + 1]]``, from prefix sums of blocks."""
    n = len(cuts) - 1
    out = [np.zeros(n, np.int64) for _ in PRIMES[:use]]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + _BLOCK, side="right")) - 1)
        raw = vocab[cuts[i]:cuts[j]].astype(np.int64) + 1
        lo, hi = cuts[i:j] - cuts[i], cuts[i + 1:j + 1] - cuts[i]
        for k, p in enumerate(PRIMES[:use]):
            down, up = _powers(k, _size(len(raw)), True), _powers(k, _size(len(raw)), False)
            prefix = np.r_[0, np.cumsum(raw * down[:len(raw)] % p)]
            out[k][i:j] = (prefix[hi] - prefix[lo]) % p * up[np.maximum(hi - 1, 0)] % p
        i = j
    return out


def append(head: list[np.ndarray], word: list[np.ndarray], size: np.ndarray) -> list[np.ndarray]:
    """Values of runs ``head`` followed by a blank and a word of ``size`` bytes."""
    top = _size(size.max(initial=0) + 2)
    return [(h * _powers(k, top, False)[size + 1] % p + _BLANK * _powers(k, top, False)[size] + w) % p
            for k, (p, h, w) in enumerate(zip(PRIMES, head, word))]


def packed(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and check."""
    return values[0] << 31 | values[1], values[2]


def fingerprint(words: list[bytes]) -> tuple[int, int]:
    """The same for one run, by Horner's rule."""
    got = []
    for p, b in zip(PRIMES, BASES):
        h = 0
        for byte in b" ".join(words):
            h = (h * b + byte + 1) % p
        got.append(h)
    return got[0] << 31 | got[1], got[2]
