"""Words, 64-bit word hashes and shingle sets of whole texts, on Arrow batches inside tasks.

A word is a maximal run of bytes outside space and TAB..CR; A-Z count as a-z. Hashes are computed
over all bytes of a slice at once: with S the running sum of byte values times powers of an odd
number, a word's hash is a difference of two sums times an inverse power (all modulo 2^64).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 19
SHINGLE = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of unsigned 64-bit values (splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_VALUE = _EXACT[_LOWER]
_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
#: Powers for slices of the usual size; those for a longer text are not kept.
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Word hashes of a slice of texts; ``first`` has each text's first word and the end, ``offsets`` the same for bytes."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    release()


def _kept() -> tuple[int, dict[str, tuple[int, object]]]:
    """Stage of this task (-1 in the driver), and what this worker process keeps with its stage."""
    context = TaskContext.get()
    module = sys.modules.setdefault("_llm_kept", ModuleType("_llm_kept"))
    return -1 if context is None else context.stageId(), module.__dict__.setdefault("kept", {})


def keep(name: str, make: Callable[[], object]) -> object:
    """``make()``, kept by this worker process for later tasks of the same stage."""
    stage, kept = _kept()
    if name not in kept or kept[name][0] != stage:
        kept[name] = stage, make()
    return kept[name][1]


def release() -> None:
    """Give memory back to the system that is free or kept for other stages, as Python workers live on."""
    stage, kept = _kept()
    for name in [name for name, (own, _) in kept.items() if own != stage]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and their offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array) -> Words:
    """Split texts and hash their words, with A-Z as a-z."""
    data, offsets = bytes_of(texts)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none, data, offsets)
    solid = ~_SPACE[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads] = solid[heads]
    last[tails] = solid[tails]
    start, stop = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(hash_spans(data, start, stop), np.searchsorted(start, offsets), start, stop, data, offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of parts of the data, in order and apart, with A-Z as a-z if ``lower``."""
    if len(data) <= SLICE_BYTES or len(start) <= 1:
        return _hash_spans(data, start, stop, lower)
    # A hash does not depend on the place, so long data are hashed in runs of words.
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + SLICE_BYTES, "right")))
        base = start[i]
        out[i:j] = _hash_spans(data[base: stop[j - 1]], start[i:j] - base, stop[i:j] - base, lower)
        i = j
    return out


def _hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    n = len(data)
    size = max(SLICE_BYTES, 1 << max(n - 1, 0).bit_length())
    powers = _POWER.get(size) or (_powers(_FACTOR, size), _powers(_INVERSE, size))
    if size == SLICE_BYTES:
        _POWER[size] = powers
    up, down = powers
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_VALUE if lower else _EXACT)[data] * up[:n], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles_of(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of ``width`` words in order; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            for place, word in zip(_PLACES, words, strict=False):
                total = total + place * word
        return mix(np.array([total], np.uint64))
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total += _PLACES[k] * words[k: n - width + 1 + k]
    return mix(total)


def order_within(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Order by group and value; ``own`` numbers the groups from 0 and is in order. Equal values of a group may come in any order."""
    order = np.argsort(values)
    groups = own[order]
    # Short numbers are sorted by counting.
    return order[np.argsort(groups.astype(np.uint16) if len(own) and own[-1] < 1 << 16 else groups, kind="stable")]


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark longs."""
    return np.asarray(values, np.uint64).view(np.int64)
