"""64-bit hashes of substrings, many at a time, and strings of words on top of them."""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes over random byte values; powers are kept and grow to the longest text seen."""

    def __init__(self, seed: int = 1):
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, 2 * len(self.power))
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)), dtype=np.uint64)
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, INVERSE)), dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """data: bytes as uint8. One more value than bytes."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefixes[ends] - prefixes[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def word_line(text: str | None, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the text joined by single spaces, as bytes, and where each word starts and ends."""
    data = (text or "").encode()
    line = np.frombuffer(b" ".join((data.lower() if lower else data).split()), np.uint8)
    if not len(line):
        return line, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(line == 32)
    return line, np.append(0, gaps + 1), np.append(gaps, len(line))


def word_windows(text: str | None, n: int, roller: Roller, lower: bool, whole: bool) -> tuple[np.ndarray, int]:
    """Hash of each n consecutive words, and the number of words. whole: fewer words than n, but not none, are one window."""
    line, starts, ends = word_line(text, lower)
    if len(starts) < n:
        if not whole or not len(starts):
            return np.zeros(0, np.uint64), len(starts)
        return roller.spans(roller.prefixes(line), starts[:1], ends[-1:]), len(starts)
    return roller.spans(roller.prefixes(line), starts[: len(starts) - n + 1], ends[n - 1 :]), len(starts)
