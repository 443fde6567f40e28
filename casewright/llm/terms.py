"""Terms of whole texts: maximal runs of ASCII letters, digits and all signs beyond ASCII, with A-Z as a-z."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .words import bytes_of, hash_spans

_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Terms(NamedTuple):
    """Hashes of the terms of a slice of texts; ``first`` has each text's first term and the end."""

    hash: np.ndarray
    first: np.ndarray


def terms_of(texts: pa.Array) -> Terms:
    """Split texts and hash their terms; a null text has none."""
    data, offsets = bytes_of(texts)
    if len(data) == 0:
        return Terms(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    solid = _SOLID[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads] = solid[heads]
    last[tails] = solid[tails]
    start = np.flatnonzero(begin)
    return Terms(hash_spans(data, start, np.flatnonzero(last) + 1), np.searchsorted(start, offsets))


class Vocabulary:
    """Numbers of known term hashes; a table of 65,536 bits turns most unknown terms away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.hashes & np.uint64(0xFFFF)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known terms in ``hashes``, and their numbers."""
        places = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFF)])
        if not len(self.hashes) or not len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = hashes[places]
        numbers = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = self.hashes[numbers] == wanted
        return places[known], numbers[known]
