"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every benchmark item has a fingerprint: the signs of its shingles' summed hash bits. A window of as
many words as an item slides over each document (a document of fewer words is one window); windows
of which too few shingles occur in any item cannot reach the threshold and get no fingerprint. Fingerprints are cut into blocks, and each
block is looked up with all values within one bit, so no item within ``RADIUS`` is missed. Those
items are compared by the weighted Jaccard similarity of their shingles (min over max of counts).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sized
from .words import SHINGLE, mix, shingles_of, slices, words_of

#: Bits of a fingerprint and of a block; with one wrong bit allowed a block, all within RADIUS are found.
BITS = 256
BLOCK = 8
RADIUS = 2 * (BITS // BLOCK) - 1
#: Words of benchmark text in one block of items; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
_FILTER = 24
_NEAR = np.array([[bin(a ^ b).count("1") <= 1 for b in range(256)] for a in range(256)])


class Item(NamedTuple):
    item_id: int
    shingles: np.ndarray
    counts: np.ndarray
    total: int
    print: np.ndarray


class Items(NamedTuple):
    """A block of items by their number of words, with the shingles of all of them."""

    by_length: dict[int, tuple[list[Item], np.ndarray]]
    vocabulary: np.ndarray
    filter: np.ndarray
    short: dict[int, dict[int, list[int]]]


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the hash bits (+1 or -1) of shingles, from 0: one row more than shingles."""
    words = np.stack([mix(shingles + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), -1), axis=1)
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(2 * bits.astype(np.int32) - 1, axis=0, out=out[1:])
    return out


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def make_items(ids: list[int], texts: list[str], width: int) -> Items:
    words = words_of(pa.array(texts, pa.string()))
    by_length: dict[int, list[Item]] = {}
    short: dict[int, dict[int, list[int]]] = {}
    every = [np.zeros(0, np.uint64)]
    for i, item_id in enumerate(ids):
        own = words.hash[words.first[i]: words.first[i + 1]]
        if 0 < len(own) < width:
            short.setdefault(len(own), {}).setdefault(int(shingles_of(own, width)[0]), []).append(item_id)
        elif len(own):
            found = shingles_of(own, width)
            distinct, counts = np.unique(found, return_counts=True)
            item = Item(item_id, distinct, counts, len(found), fingerprint(bit_sums(found)[-1]))
            by_length.setdefault(len(own), []).append(item)
            every.append(distinct)
    vocabulary = np.unique(np.concatenate(every))
    sieve = np.zeros(1 << _FILTER, bool)
    sieve[(vocabulary >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
    return Items({n: (items, np.stack([x.print for x in items])) for n, items in by_length.items()}, vocabulary, sieve, short)


def weighted_similarity(window: np.ndarray, item: Item) -> float:
    """Sum of least over sum of greatest shingle counts."""
    at = np.minimum(np.searchsorted(item.shingles, window), len(item.shingles) - 1)
    hit = item.shingles[at] == window
    common = np.minimum(np.bincount(at[hit], minlength=len(item.shingles)), item.counts).sum()
    return float(common / (len(window) + item.total - common))


def close_items(prints: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which items each window's fingerprint finds: a block within one bit, then all within RADIUS."""
    found = np.zeros((len(prints), len(items)), bool)
    for block in range(BITS // BLOCK):
        found |= _NEAR[prints[:, block][:, None], items[:, block][None, :]]
    window, item = np.nonzero(found)
    apart = np.bitwise_count(prints[window] ^ items[item]).sum(axis=1)
    found[window[apart > RADIUS], item[apart > RADIUS]] = False
    return found


def search(shingles: np.ndarray, hits: np.ndarray, n_words: int, items: Items, percent: int, width: int) -> dict[int, tuple[float, int, int]]:
    """item -> (similarity, first word, words) of the best window of a text, earliest first."""
    best: dict[int, tuple[float, int, int]] = {}
    total = np.concatenate([[0], np.cumsum(hits)])
    for length, (group, prints) in items.by_length.items():
        # A document of fewer words than the items is one window.
        span = min(length, n_words)
        size, full = span - width + 1, length - width + 1
        if size <= 0 or 100 * size < percent * full or not group:
            continue
        # Of the shingles of a window and an item of this length, these must be common.
        need = -(-percent * (size + full) // (100 + percent))
        starts = np.flatnonzero(total[size:] - total[:-size] >= need)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for i in range(0, len(part), 5000):
                some = part[i: i + 5000]
                if not len(some):
                    continue
                low, high = some[0], some[-1] + size
                sums = bit_sums(shingles[low:high])
                found = close_items(fingerprint(sums[some - low + size] - sums[some - low]), prints)
                for w, k in zip(*np.nonzero(found), strict=True):
                    start = int(some[w])
                    value = weighted_similarity(shingles[start: start + size], group[k])
                    if 100 * value >= percent - 1e-9 and value > best.get(group[k].item_id, (0.0,))[0]:
                        best[group[k].item_id] = (value, start, span)
    return best


def contaminated(part: pa.RecordBatch, items: Items, percent: int, width: int) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) for the texts of a slice."""
    words = words_of(part.column("text"))
    out = []
    row_of = np.repeat(np.arange(part.num_rows), np.diff(words.first))
    for length, known in items.short.items():
        if len(words.hash) < length:
            continue
        at = np.arange(len(words.hash) - length + 1)
        at = at[at + length <= words.first[row_of[at] + 1]]
        runs = np.array([shingles_of(words.hash[a: a + length], width)[0] for a in at.tolist()], np.uint64)
        for a in at[np.isin(runs, np.array(list(known), np.uint64))].tolist():
            for item in known[int(shingles_of(words.hash[a: a + length], width)[0])]:
                out.append((int(row_of[a]), item, 1.0, int(a - words.first[row_of[a]]), length))
    if len(words.hash) < width or not len(items.vocabulary):
        return out
    shingles = shingles_of(words.hash, width)
    maybe = np.flatnonzero(items.filter[(shingles >> np.uint64(64 - _FILTER)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.vocabulary, shingles[maybe]), len(items.vocabulary) - 1)
    maybe = maybe[items.vocabulary[at] == shingles[maybe]]
    maybe = maybe[maybe + width <= words.first[row_of[maybe] + 1]]
    for row in np.unique(row_of[maybe]).tolist():
        a, b = int(words.first[row]), int(words.first[row + 1])
        own = maybe[(maybe >= a) & (maybe < b)] - a
        hits = np.zeros(b - a - width + 1, np.int64)
        hits[own] = 1
        for item, found in search(shingles[a: b - width + 1], hits, b - a, items, percent, width).items():
            out.append((row, item, *found))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the benchmark in blocks of bounded size, read one partition at a time."""
    ids, texts, words = [], [], 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if row.i is None or not row.t:
            continue
        ids.append(row.i)
        texts.append(row.t)
        words += row.t.count(" ") + 1
        if words >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", percent: int = 75,
    width: int = SHINGLE,
) -> DataFrame:
    """Passages of benchmark items in documents: key, item, similarity, first_word, n_words, tk.

    One row for each document and item with the best window (the earliest of equal ones); a document
    of fewer words than an item is one window. Items of fewer than ``width`` words must occur exactly. A-Z count as a-z. Null and blank texts hold
    nothing, items without an id or words are left out, and a repeated item id counts as one item
    with the best of its windows. ``tk`` is a hash of the text that tells rows with equal or null
    keys apart; equal rows give equal rows. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = pa.schema([("key", pa.int64()), ("tk", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    names = "key long, tk long, item long, similarity double, first_word long, n_words long"
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    base = base.where("text IS NOT NULL").select("key", F.xxhash64("text").alias("tk"), "text")
    with Scratch(spark, "leaks") as scratch:
        found = []
        for block in item_blocks(benchmark, item, text):
            shared = spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                items = make_items(*shared.value, width)
                for batch in batches:
                    for part in slices(batch, "text"):
                        rows = contaminated(part, items, percent, width)
                        if rows:
                            row, *rest = zip(*rows, strict=True)
                            row = pa.array(row)
                            yield pa.record_batch([part.column("key").take(row), part.column("tk").take(row), *(
                                pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:], strict=True)
                            )], schema=schema)

            found.append(scratch.stage(base.mapInArrow(run, names), "found"))
        if not found:
            return spark.createDataFrame([], names).withColumnsRenamed({"key": key, "item": item})
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        best = every.groupBy("key", "tk", "item").agg(F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("best"))
        return scratch.result(best.select(F.col("key").alias(key), F.col("item").alias(item), "best.*", "tk"))


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak."""
    dirty = found.select(F.col(key).alias("__key"), F.col("tk").alias("__tk")).distinct()
    own = docs.withColumn("__own", F.xxhash64(F.col(text).cast("string")))
    match = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__tk"))
    return own.join(sized(dirty), match, "left_anti").select(*docs.columns)
