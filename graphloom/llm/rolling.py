"""Rolling hashes and winnowing over code points, vectorised."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 bits of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
        _POWERS[base] = have
    return have[:n]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k symbols; empty if there are fewer."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(0x51ED27)) * _powers(_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1))


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every window of that width."""
    n, out = 1, values
    while n * 2 <= width:
        out = of(out[:-n], out[n:])
        n *= 2
    return of(out[: len(out) - (width - n)], out[width - n :]) if n < width else out


def winnow(symbols: np.ndarray, owner: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes chosen by winnowing each owner's symbols.

    symbols holds the texts of a batch end to end, owner the number of the text of
    each symbol. Of every window of k-grams within one text the least hash is
    chosen, with all its ties, so two texts that share a run of window + k - 1
    symbols choose the same k-gram at the same place in it.
    """
    grams = gram_hashes(symbols, k)
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(grams, window)
    starts = len(least)
    whole = owner[:starts] == owner[window + k - 2 : window + k - 2 + starts]
    least = np.where(whole, least, np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    at = np.flatnonzero((most == grams) & (grams != 0))
    return at, grams[at]
