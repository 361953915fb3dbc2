"""Hashed n-gram indicators of texts: their words, and the shapes of their tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

from plumbrow.llm import tokens

BITS = 20
DIMENSIONS = 1 << BITS
_REPEATED = np.uint64(0x51ED270B51ED270B)

_SPACE = np.zeros(256, bool)
_SPACE[list(tokens.SPACES)] = True
# Letters A-Z count as a-z and punctuation counts nothing, so a word is itself before a comma too.
_WORD = tokens.table({c: 0 for c in tokens.SPACES + tokens.PUNCTUATION})
_WORD[65:91] = _WORD[97:123]
# One sign for capitals, one for other letters (bytes of other alphabets are letters), one for digits.
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[65:91], _SIGN[97:123], _SIGN[128:], _SIGN[48:58], _SIGN[list(tokens.SPACES)] = 65, 97, 97, 48, 0
_RUNS_COUNT_ONCE = np.isin(_SIGN, [0, 48, 65, 97])
_SIGN_VALUE = tokens.table()


class Found(NamedTuple):
    """Features of some texts in a row, distinct and sorted within each text."""

    features: np.ndarray
    starts: np.ndarray  # of each text's features
    tokens: np.ndarray  # how many words each text has


class Indicators:
    """Feature numbers of UTF-8 texts.

    A token is what stands between white space. Features are words, pairs of words, and the shapes of
    tokens in runs of 1 to 3, and feature 0, which every text has. A shape has one sign for a run of
    capitals, of other letters or of digits and up to two for a run of another character; a token that repeats the
    one before has a shape of its own. ``wanted`` marks the features to keep.
    """

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self._wanted, self._hash = wanted, tokens.Hasher()

    def __call__(self, texts: Sequence[bytes]) -> Iterator[Found]:
        """All texts in their order, some at a time."""
        for first, end in tokens.chunks(texts):
            yield self._features(texts[first:end])

    def _features(self, texts: Sequence[bytes]) -> Found:
        data, text_starts = tokens.joined(texts)
        starts, ends = tokens.bounds(_SPACE[data])
        sign = _SIGN[data]
        kept = sign != 0
        kept[1:] &= sign[1:] != sign[:-1]
        again = ~_RUNS_COUNT_ONCE[data]
        again[1:] &= sign[1:] == sign[:-1]
        again[2:] &= sign[2:] != sign[:-2]
        again[:1] = False
        kept |= again
        place = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
        word = self._hash(_WORD[data], starts, ends)
        shape = self._hash(_SIGN_VALUE[sign[kept]], place[starts], place[ends])
        n = len(texts)
        number = np.searchsorted(text_starts, starts, "right") - 1
        text = number << BITS
        two, three = text[1:] == text[:-1], text[2:] == text[:-2]
        repeated = (word[1:] == word[:-1]) & (shape[1:] == shape[:-1]) & two
        shape[1:][repeated] = _REPEATED
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        shapes = tokens.mixed(shape[:-1] * a + shape[1:])
        found = [np.arange(n, dtype=np.int64) << BITS]
        for h, t in (
            (word, text),
            (shape, text),
            (tokens.mixed(word[:-1] * b + word[1:])[two], text[:-1][two]),
            (shapes[two], text[:-1][two]),
            (tokens.mixed(shapes[:-1] * a + shape[2:])[three], text[:-2][three]),
        ):
            feature = (h >> np.uint64(64 - BITS)).astype(np.int64)
            if self._wanted is not None:
                mask = self._wanted[feature]
                feature, t = feature[mask], t[mask]
            found.append(t | feature)
        keys = np.unique(np.concatenate(found))
        at = np.searchsorted(keys, np.arange(n, dtype=np.int64) << BITS)
        return Found(keys & (DIMENSIONS - 1), at, np.bincount(number, minlength=n))

    def lists(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The features of each text."""
        return [x for found in self(texts) for x in np.split(found.features, found.starts[1:])]
