"""Words of many texts at once: their bounds and hashes as arrays over the bytes, without a loop over words."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np

BYTES_AT_ONCE = 1 << 20  # texts are worked on together up to so many bytes; a longer text alone
SPACES = b" \t\n\x0b\x0c\r"
PUNCTUATION = string.punctuation.encode()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(values: dict[int, int] | None = None, default: int | None = None) -> np.ndarray:
    """64-bit values of the 256 bytes: pseudo-random ones, but for ``values``."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) if default is None else np.full(256, default, np.uint64)
    for byte, value in (values or {}).items():
        out[byte] = value
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to be worked on together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BYTES_AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text begins."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum(lengths) - lengths


def bounds(between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``between`` words; the last byte is."""
    change = np.flatnonzero(between[1:] != between[:-1]) + 1
    if len(between) and not between[0]:
        change = np.concatenate([np.zeros(1, np.int64), change])
    return change[::2], change[1::2]


class Hasher:
    """Hashes of stretches of a sequence of 64-bit values, equal for equal stretches wherever they are."""

    def __init__(self) -> None:
        self._powers = self._inverses = np.ones(1, np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(values) > len(self._powers):
            n = max(len(values), 2 * BYTES_AT_ONCE)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._inverses[starts])
