"""The number stream of Python's seeded generator, by places, so that many tasks can share one stream.

Draws are below 2 ** 32, so each try takes one word of 32 bits.
"""

from __future__ import annotations

import random

import numpy as np

#: Words that are passed over or made in one go.
_STEP = 1 << 22


def stream(seed: int, start: int = 0) -> np.random.MT19937:
    """The generator of ``random.Random(seed)`` after its first ``start`` words of 32 bits."""
    *key, place = random.Random(seed).getstate()[1]
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": place}}
    while start > 0:
        out.random_raw(min(start, _STEP), output=False)
        start -= _STEP
    return out


def resumed(key: bytes, place: int) -> np.random.MT19937:
    """A generator in the state of one that was stopped."""
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, np.uint32), "pos": place}}
    return out


def _bound(n: int) -> tuple[np.uint64, np.uint64]:
    """What good words are below, and how far a draw's bits are shifted: it is the word's top bits, if below ``n``."""
    shift = 32 - n.bit_length()
    return np.uint64(n << shift), np.uint64(shift)


def accepted(words: np.ndarray, n: int) -> np.ndarray:
    """The draws below ``n`` among tries of one word each."""
    bound, shift = _bound(n)
    return (words[words < bound] >> shift).astype(np.uint32)


def good(words: np.ndarray, n: int) -> int:
    """The number of the draws that :func:`accepted` gives."""
    return int(np.count_nonzero(words < _bound(n)[0]))


class Falling:
    """Draws below n, n - 1, ..., 2 in turn, as a seeded shuffle takes them; can be stopped and taken up again.

    ``top`` is the bound of the next draw and ``used`` the number of words before it.
    """

    def __init__(self, seed: int, top: int, used: int = 0):
        self.top, self.used = top, used
        self._words = stream(seed, used)

    def draws(self, most: int) -> np.ndarray:
        """The next ``most`` draws, fewer at the end of the stream."""
        out, left = [], min(most, self.top - 1)
        while left > 0:
            bits = self.top.bit_length()
            # All bounds down to this one are of as many bits, so each try reads its word alike.
            run = min(left, self.top - (1 << bits - 1) + 1, 1 << 16)
            tries = (self._words.random_raw(run) >> np.uint64(32 - bits)).astype(np.int64)
            # A try below the least bound of the run is good and one at its top bound or above is not;
            # only those between depend on how many were good before them.
            good, bound, between = tries < self.top, self.top, np.flatnonzero((tries >= self.top - run) & (tries < self.top))
            before, last = np.cumsum(good), 0
            for k in between.tolist():
                if tries[k] >= bound - (int(before[k]) - 1 - last):
                    good[k] = False
                    last += 1
            self.used += run
            got = tries[good]
            out.append(got)
            self.top -= len(got)
            left -= len(got)
        return np.concatenate(out) if out else np.empty(0, np.int64)
