"""Words and rolling word hashes of many documents at once, as flat arrays.

A word is a maximal run of characters other than blank and 0x09-0x0D.  These six
characters are single bytes in UTF-8 and exactly what ``bytes.split()`` splits
on, so words are taken from the encoded text.  ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

# Words remembered with their hash in one Python task before the memory is cleared.
REMEMBERED = 1 << 19
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def split(text: bytes | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    return (text.lower() if lower else text).split()


@dataclass
class Words:
    """Hashes of all words of a list of documents; document i owns [starts[i], starts[i+1])."""

    hashes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], lower: bool = False) -> Words:
        return cls.from_lists([split(t, lower) for t in texts])

    @classmethod
    def from_lists(cls, lists: list[list[bytes]]) -> Words:
        starts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=starts[1:])
        hashes = np.empty(starts[-1], np.uint64)
        get = _known.__getitem__
        for i, words in enumerate(lists):
            hashes[starts[i] : starts[i + 1]] = np.fromiter(map(get, words), np.uint64, len(words))
        return cls(hashes, starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from every position, and whether they lie in one document.

        Both arrays are as long as the word array (or shorter by up to ``size - 1``).
        """
        total = len(self.hashes)
        if total < size:
            return np.empty(0, np.uint64), np.empty(0, bool)
        ends = np.repeat(self.starts[1:], self.counts)[: total - size + 1]
        return mixed(rolling(self.hashes, size)), np.arange(total - size + 1) + size <= ends


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values, by doubling."""
    total = len(hashes) - size + 1
    done, length, result = hashes, 1, None
    left = size
    while True:
        if left & 1:
            # append the block of ``length`` values that follows what is hashed so far
            have = 0 if result is None else size_done
            part = done[have : have + total]
            result = part if result is None else result * np.uint64(pow(BASE, length, _MASK + 1)) + part
            size_done = have + length
        left >>= 1
        if not left:
            return result
        done = done[:-length] * np.uint64(pow(BASE, length, _MASK + 1)) + done[length:]
        length *= 2


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that any bits of the result may be used."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
