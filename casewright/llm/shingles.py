"""Shingle sets of texts as Spark tables: their ids, sizes and parity bitmaps, and exact checks of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, Scratch, sized
from .words import SHINGLE, mix, shingles_of, signed, slices, words_of

#: Bits of the parity bitmap of a set.
BITS = 1024
#: Cells of the table of shingle frequencies, and the least count that a task reports for a cell.
CELLS = 1 << 22
HOT = 8


def text_key(text: str | Column = "text") -> Column:
    """64-bit key of a text."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def parities(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of longs for each set: ``BITS`` bits, one for each cell that an odd number of members fall in.

    Two sets differ in at least as many members as their bitmaps differ in bits.
    """
    cell = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (members & np.uint64(BITS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(sizes) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sizes), BITS // 64)


def sets_of(part: pa.RecordBatch, column: str = "text", width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, members of all sets in order, offsets) of a slice."""
    words = words_of(part.column(column))
    rows, counts = part.num_rows, np.diff(words.first)
    row = np.repeat(np.arange(rows), counts)
    found, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words.hash) >= width:
        found = shingles_of(words.hash, width)
        own = row[: len(found)]
        whole = np.arange(len(found)) + width <= words.first[own + 1]
        found, own = found[whole], own[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        single = [shingles_of(words.hash[words.first[i]: words.first[i + 1]], width) for i in short]
        found, own = np.concatenate([found, *single]), np.concatenate([own, short])
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    found, own = found[fresh], own[fresh]
    return counts, found, np.searchsorted(own, np.arange(rows + 1))


def set_ids(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit id of each set, its size included; 0 only for empty sets."""
    sizes, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.uint64)
    filled = sizes > 0
    if filled.any():
        total = np.add.reduceat(mix(members ^ np.uint64(0xA5A5A5A55A5A5A5A)), offsets[:-1][filled])
        out[filled] = mix(total + sizes[filled].astype(np.uint64)) | np.uint64(1)
    return out


def each_set(batch: pa.RecordBatch, column: str = "text", width: int = SHINGLE) -> Iterator[tuple[int, np.uint64, np.ndarray]]:
    """(words, node, sorted members) of each text of a batch."""
    for part in slices(batch, column):
        counts, members, offsets = sets_of(part, column, width)
        nodes = set_ids(members, offsets)
        for i in range(part.num_rows):
            yield counts[i], nodes[i], members[offsets[i]: offsets[i + 1]]


def describe(
    texts: DataFrame, keys: Sequence[str], width: int = SHINGLE, least: int = 1, hot: int = HOT,
) -> DataFrame:
    """``keys`` (longs) of each text with n_words, n_shingles, node and bits.

    ``node`` is the id of the shingle set, so equal sets are one node; 0 is the empty set, which
    texts of fewer than ``least`` words also get. Rows with a ``cell`` have no text: they count the
    shingles of a task's texts in a cell, for cells with at least ``hot``.
    """
    fields = [(k, pa.int64()) for k in keys]
    schema = pa.schema([
        *fields, ("n_words", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bits", pa.list_(pa.int64())),
        ("cell", pa.int64()), ("freq", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, members, offsets = sets_of(part, width=width)
                sizes = np.diff(offsets)
                if least > 1:
                    members = members[np.repeat(counts >= least, sizes)]
                    sizes = np.where(counts >= least, sizes, 0)
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                np.add.at(cells, cells_of(members), 1)
                n, flat = part.num_rows, parities(members, sizes)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.record_batch([
                    *(part.column(k) for k in keys), pa.array(counts), pa.array(sizes), pa.array(signed(set_ids(members, offsets))), bits,
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                ], schema=schema)
        at = np.flatnonzero(cells >= hot)
        if len(at):
            none = [pa.nulls(len(at), f.type) for f in schema][:-2]
            yield pa.record_batch([*none, pa.array(at), pa.array(cells[at].astype(np.int64))], schema=schema)

    out = ", ".join([*(f"{k} long" for k in keys), "n_words long, n_shingles long, node long, bits array<bigint>, cell long, freq long"])
    return texts.select(*keys, "text").mapInArrow(run, out)


def cells_of(members: np.ndarray) -> np.ndarray:
    """Cell of the table of frequencies for each member."""
    return (members >> np.uint64(42)).astype(np.int64)


def frequent_cells(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent cells in order with their counts; at most ``CELLS`` of them."""
    rows = described.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("freq").alias("freq")).toArrow()
    cell, freq = rows.column("cell").to_numpy(), rows.column("freq").to_numpy()
    order = np.argsort(cell)
    return cell[order].astype(np.int64), freq[order].astype(np.int64)


def frequency_table(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Estimated number of texts for each cell; 0 for rare ones."""
    table = np.zeros(CELLS, np.uint32)
    table[cells] = np.minimum(counts, np.iinfo(np.uint32).max)
    return table


def frequency(members: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Estimated number of texts with each member."""
    return table[cells_of(members)].astype(np.int64)


def nodes_of(described: DataFrame) -> DataFrame:
    """A row for each non-empty node: node, n, bits and the key of one of its texts."""
    return described.where("cell IS NULL AND node <> 0").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.min("tk").alias("tk")
    )


def members_of(texts: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, members) of the texts whose key is in ``wanted`` (tk), one row a node."""
    wanted = sized(wanted.select("tk").distinct())
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sets, size = [], [], 0
            for _, name, members in each_set(batch, width=width):
                node = int(name.view(np.int64))
                if node and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(members.tobytes())
                    size += len(sets[-1])
                    if size > 16 << 20:
                        yield pa.record_batch([pa.array(nodes), pa.array(sets, pa.binary())], schema=schema)
                        nodes, sets, size = [], [], 0
            if nodes:
                yield pa.record_batch([pa.array(nodes), pa.array(sets, pa.binary())], schema=schema)

    found = texts.select("tk", "text").join(wanted, "tk", "left_semi").select("text").mapInArrow(run, "node long, members binary")
    return found.dropDuplicates(["node"])


def similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map of pairs with their members (a, b, x, y) to those with 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Check:
    """Exact check of pairs (a, b) of nodes: 100 * common >= percent * union of their sets."""

    def __init__(self, scratch: Scratch, texts: DataFrame, nodes: DataFrame, percent: int, width: int = SHINGLE):
        self.scratch, self.texts, self.nodes, self.percent, self.width = scratch, texts, nodes, percent, width

    def near(self, left: str, right: str) -> Column:
        """Whether sizes and bitmaps of two sides, whose columns have these prefixes, allow a link."""
        n, m = F.col(f"{left}n"), F.col(f"{right}n")
        x, y = F.col(f"{left}bits"), F.col(f"{right}bits")
        apart = F.lit(0)
        for k in range(BITS // 64):
            apart = apart + F.bit_count(x[k].bitwiseXOR(y[k]))
        sizes = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return sizes & (apart * (100 + self.percent) <= (n + m) * (100 - self.percent))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs that may link."""
        left, right = (
            self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab"
        )
        return pairs.join(left, "a").join(right, "b").where(self.near("a_", "b_")).select("a", "b")

    def linked(self, likely: DataFrame) -> DataFrame:
        """The pairs that do, staged; ``likely`` is a staged table."""
        sets = members_of(self.texts, self.nodes.join(ends(likely), "node", "left_semi"), self.width)
        return compared(self.scratch, likely, sets, self.percent)


#: Members of the sets that a task compares at once.
GROUP = 1 << 20
#: Shares in which the sets of many nodes are sent, and members of sets up to which one is enough.
SHARES = 4
SHARE_MEMBERS = 1 << 25


def dealt(scratch: Scratch, likely: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, a, b) of the pairs, and the staged table it reads; pairs that share nodes mostly share a bucket.

    A pair goes where the pair of its greater node with the least one does; so of pairs among near copies, each
    set has to go to one bucket, and never to more than it has pairs. The pairs of a node with very many are spread.
    """
    low = likely.groupBy("b").agg(F.min("a").alias("home"))
    sizes = wanted.select(F.col("node").alias("b"), "n")
    homed, (total,) = scratch.observed(likely.join(low, "b").join(sizes, "b"), "homed", F.sum("n"))
    buckets = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 2 * (total or 0) // GROUP)
    heavy = homed.groupBy("home").agg(F.ceil(F.sum("n") / GROUP).alias("parts")).where("parts > 1")
    # Fewer rows than buckets.
    placed = homed.join(F.broadcast(heavy), "home", "left")
    share = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), "parts")).otherwise(0)
    return placed.select(F.pmod(F.xxhash64("home", share), F.lit(buckets)).cast("int").alias("bucket"), "a", "b"), homed


def verified(
    scratch: Scratch, texts: DataFrame, wanted: DataFrame, likely: DataFrame, percent: int,
    sets: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """The pairs of ``likely``, a staged table, that link, staged; ``sets`` gives nodes, members and offsets of all parts of texts.

    ``wanted`` (node, tk, n) names each node of the pairs, a text that holds it and the size of its set. Texts are asked
    for these sets alone, and a set goes once to each bucket with pairs of it. The buckets of one share after the other
    are filled, as sets take more disk than reading texts again takes time.
    """
    wanted = scratch.stage(wanted, "wanted")
    pairs, homed = dealt(scratch, likely, wanted)
    sent = pairs.select(F.col("a").alias("node"), "bucket").union(pairs.select(F.col("b").alias("node"), "bucket")).distinct()
    sent, (n, size) = scratch.observed(sent.join(wanted, "node").select("tk", "node", "bucket", "n"), "sent", F.count("*"), F.sum("n"))
    scratch.drop(wanted)
    shares = min(SHARES, 1 + (size or 0) // SHARE_MEMBERS)
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                # Copies of a text give the same sets.
                fresh = []
                for key in part.column("tk").to_pylist():
                    fresh.append(key not in seen)
                    seen.add(key)
                part = part.filter(pa.array(fresh, pa.bool_()))
                want = part.column("nodes").flatten().to_numpy().view(np.uint64)
                bucket = part.column("buckets").flatten().to_numpy()
                if not len(want):
                    continue
                node, members, offsets = sets(part)
                if not len(node):
                    continue
                order = np.argsort(node)
                spot = order[np.minimum(np.searchsorted(node, want, sorter=order), len(node) - 1)]
                held = node[spot] == want
                spot, bucket = spot[held], bucket[held]
                sizes = offsets[spot + 1] - offsets[spot]
                for own in _runs(sizes):
                    flat = members[_spans(offsets[spot[own]], sizes[own])]
                    ends_ = np.concatenate([[0], np.cumsum(sizes[own] * 8)]).astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), len(ends_) - 1, [None, pa.py_buffer(ends_), pa.py_buffer(flat)])
                    yield pa.record_batch([
                        pa.array(bucket[own]), pa.array(signed(node[spot[own]])), pa.nulls(len(blobs), pa.int64()), blobs], schema=schema)

    links = []
    for share in range(shares):
        own = F.pmod("bucket", F.lit(shares)) == share
        asked = sent.where(own).groupBy("tk").agg(F.collect_list(F.struct("node", "bucket")).alias("sent"))
        asked = asked.select("tk", F.col("sent.node").alias("nodes"), F.col("sent.bucket").alias("buckets"))
        held = texts.select("tk", "text").join(F.broadcast(asked) if n <= shares * BROADCAST_ROWS else asked, "tk")
        found = held.mapInArrow(run, "bucket int, a long, b long, members binary")
        rows = found.unionByName(pairs.where(own).withColumn("members", F.lit(None).cast("binary")))
        links.append(scratch.stage(rows.groupBy("bucket").applyInArrow(linking(percent), "a long, b long"), "links"))
    scratch.drop(homed, sent)
    if shares == 1:
        return links[0]
    every = scratch.stage(reduce(DataFrame.union, links), "links")
    scratch.drop(*links)
    return every


def _runs(sizes: np.ndarray, most: int = GROUP) -> Iterator[slice]:
    """Slices of consecutive items whose sizes sum to about ``most``."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all items of spans, one span after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def linking(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Map of a bucket's sets (a, members) and pairs (a, b) to the pairs with 100 * common >= percent * union."""

    def run(table: pa.Table) -> pa.Table:
        pairs = table.select(["a", "b"]).filter(table.column("b").is_valid())
        sets = table.select(["a", "members"]).filter(table.column("b").is_null())
        node, first = np.unique(sets.column("a").to_numpy(), return_index=True)
        sets = sets.take(pa.array(first))
        blobs = pa.concat_arrays([*sets.column("members").cast(pa.large_binary()).chunks, pa.array([], pa.large_binary())])
        offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset: blobs.offset + len(blobs) + 1] // 8
        flat = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[: 8 * offsets[-1]].view(np.uint64)
        names, member = np.unique(flat, return_inverse=True)
        size = np.diff(offsets)
        both = [pairs.column(c).to_numpy() for c in "ab"]
        # A node whose text does not hold it has no set.
        here = np.isin(both[0], node) & np.isin(both[1], node)
        pairs = pairs.filter(pa.array(here))
        a, b = (np.searchsorted(node, x[here]) for x in both)
        keep = np.zeros(len(a), bool)
        for own in _runs(size[a] + size[b], 4 * GROUP):
            x, y = a[own], b[own]
            both = np.concatenate([x, y])
            number = np.repeat(np.tile(np.arange(len(x)), 2), size[both])
            key = np.sort(number * len(names) + member[_spans(offsets[both], size[both])])
            common = np.bincount(key[1:][key[1:] == key[:-1]] // max(1, len(names)), minlength=len(x))
            keep[own] = 100 * common >= percent * (size[x] + size[y] - common)
        return pairs.filter(pa.array(keep))

    return run


def compared(scratch: Scratch, likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, staged, by the sets (node, members) of their nodes."""
    # Both joins read one shuffle of the sets.
    sets = sets.repartition("node")
    return scratch.stage(
        likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
        .mapInArrow(similar(percent), "a long, b long"), "links")


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct nodes of pairs."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
