"""From signatures to linked classes: shared signatures, star and cross candidates, components.

Nodes are 64-bit ids of classes of equal items, so copies never meet here. Signatures are grouped
inside each task before they are shuffled, so a signature that a third of all nodes share sends one
row a task. Candidates are first the pairs of each signature's least node with its others; where
a signature still joins different components, the pairs of one node chosen by hash with its others
are next, for a few rounds while the other pairs are many, and then its other pairs. No link is lost,
and a group of near copies costs a few verified pairs a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .shingles import Check
from .words import mix, release, signed

#: Signatures a task gathers before it groups them and sends them on.
GATHER = 1_000_000
#: Nodes of a signature that a task sends on as they are; of more, only the least meets other tasks'.
PLAIN = 8
#: Rows of signatures in order that a task compares at once.
CHUNK = 1 << 19
#: Rounds in which one node of each open signature meets the others, before all meet.
PIVOTS = 4
#: Pairs of different components for each row of open signatures up to which all are tried at once.
FEW_PAIRS = 16
SIGNATURES = "sig long, node long"
#: Bits of a signature that mark local rows, and a node that stands for local rows in the signature's partition.
LOCAL, HEAD = np.uint64(1), np.uint64(2)
_ARROW = pa.schema([("sig", pa.int64()), ("node", pa.int64())])
_MET = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


class Gatherer:
    """Collects (signature, node) arrays in a task and gives them out as rows of ``SIGNATURES``.

    Where more than ``PLAIN`` nodes share a signature here, the least goes on to be compared with
    other tasks, and all of them also go out as local rows, dealt by signature and node, so that
    they spread. The lowest bit of a signature marks local rows, the next one such least nodes.
    Of several ``shares`` of all signatures, one is kept.
    """

    def __init__(self, share: int = 0, shares: int = 1) -> None:
        self.share, self.shares = np.uint64(share), np.uint64(shares)
        self.forget()

    def forget(self) -> None:
        self.sigs: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.n = 0

    def add(self, sigs: np.ndarray, node: np.uint64) -> None:
        """Add the signatures of a node that are of this share."""
        sigs = sigs[self._own(sigs)]
        if len(sigs):
            self.sigs.append(sigs)
            self.nodes.append(np.full(len(sigs), node, np.uint64))
            self.n += len(sigs)

    def extend(self, sigs: np.ndarray, nodes: np.ndarray) -> None:
        """Add a row of signatures for each node, those of this share."""
        own = self._own(sigs)
        if own.any():
            self.sigs.append(sigs[own])
            self.nodes.append(np.repeat(nodes, own.sum(axis=1)))
            self.n += len(self.sigs[-1])

    def _own(self, sigs: np.ndarray) -> np.ndarray:
        return (sigs >> np.uint64(32)) % self.shares == self.share

    def full(self) -> bool:
        return self.n >= GATHER

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        sig = np.concatenate(self.sigs) & ~(LOCAL | HEAD)
        node = signed(np.concatenate(self.nodes))
        self.forget()
        order = np.argsort(sig, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0]))
        size = np.diff(np.append(start, len(sig)))
        large = np.repeat(size > PLAIN, size)
        if large.any():
            s, v = sig[order[large]], node[order[large]]
            head = np.flatnonzero(np.concatenate([[True], np.diff(s) != 0]))
            yield from _batches(s[head] | HEAD, np.minimum.reduceat(v, head))
            yield from _batches(s | LOCAL, v)
        # In the order of nodes, so that a node's rows lie together and pack well.
        plain = np.sort(order[~large])
        yield from _batches(sig[plain], node[plain])


def _batches(sig: np.ndarray, node: np.ndarray, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(sig), size):
        yield pa.record_batch([pa.array(signed(sig[i: i + size])), pa.array(node[i: i + size])], schema=_ARROW)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of rows in the order of signatures, in runs of about ``CHUNK`` rows that end between two signatures."""
    sigs, nodes, n, open_ = [], [], 0, None
    for batch in batches:
        sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
        local = (sig & int(LOCAL)).astype(bool)
        if local.any():
            yield from _met(sig[local] ^ int(LOCAL), node[local], None)
            sig, node = sig[~local], node[~local]
        sigs.append(sig)
        nodes.append(node)
        n += len(sig)
        if n < CHUNK:
            continue
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        base = sig & ~int(HEAD)
        if open_ is not None:
            more = base == open_
            yield from _met(base[more], node[more], None)
            sig, node, base = sig[~more], node[~more], base[~more]
            open_ = None if len(sig) else open_
        last = int(np.searchsorted(base, base[-1])) if len(base) else 0
        if last == 0 and len(base) >= CHUNK:
            # One signature fills the run: its rows go on as they are, and so do those that follow.
            open_ = int(base[-1])
            yield from _met(base, node, None)
            last = len(base)
        elif last:
            yield from _met_within(sig[:last], node[:last])
        sigs, nodes, n = [sig[last:].copy()], [node[last:].copy()], len(sig) - last
    if n:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        if open_ is not None:
            more = (sig & ~int(HEAD)) == open_
            yield from _met(sig[more] & ~int(HEAD), node[more], None)
            sig, node = sig[~more], node[~more]
        yield from _met_within(sig, node)
    release()


def _met_within(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Meetings of all rows of some signatures."""
    if not len(sig):
        return
    # The nodes here are not all that have a headed signature; its other nodes are in local rows.
    marked = (sig & int(HEAD)).astype(bool)
    sig = sig & ~int(HEAD)
    headed = np.unique(sig[marked])
    # Signatures that one node has are left out before the pairs of sorting keys are made.
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    meet = np.repeat(np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start), np.diff(np.append(start, len(sig))))
    sig, node = sig[meet], node[meet]
    if not len(sig):
        return
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[fresh], node[fresh]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    whole = ~np.isin(sig[start], headed)
    two = start[whole & (size == 2)]
    pairs = np.unique(np.stack([node[two], node[two + 1]], axis=1), axis=0) if len(two) else np.zeros((0, 2), np.int64)
    yield from _met(None, pairs[:, 0], pairs[:, 1])
    # Of signatures with the same nodes, one is enough; headed ones differ in their local rows.
    many, keep = whole & (size > 2), ~whole
    if many.any() or keep.any():
        name = np.add.reduceat(mix(node.view(np.uint64)), start)[many]
        _, first = np.unique(name, return_index=True)
        keep[np.flatnonzero(many)[first]] = True
        keep = np.repeat(keep, size)
        yield from _met(sig[keep], node[keep], None)


def _met(sig: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        s = slice(i, i + 100_000)
        n = len(a[s])
        yield pa.record_batch([
            pa.nulls(n, pa.int64()) if sig is None else pa.array(sig[s]), pa.array(a[s]), pa.nulls(n, pa.int64()) if b is None else pa.array(b[s]),
        ], schema=_MET)


def meetings(signatures: DataFrame) -> DataFrame:
    """Signatures that several nodes have: a pair (a, b) of two, or rows (sig, a) of more."""
    local = F.col("sig").bitwiseAND(F.lit(int(LOCAL))) != 0
    place = F.when(local, F.xxhash64("sig", "node")).otherwise(F.col("sig").bitwiseAND(F.lit(~int(HEAD))))
    return signatures.repartition(place).sortWithinPartitions("sig").mapInArrow(_meetings, "sig long, a long, b long")


def star_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs a < b: those that share a signature alone, and of others the least node with each."""
    many = met.where("sig IS NOT NULL").select("sig", F.col("a").alias("node"))
    low = many.groupBy("sig").agg(F.min("node").alias("a"))
    stars = many.join(low, "sig").where("a < node").select("a", F.col("node").alias("b"))
    return met.where("sig IS NULL").select("a", "b").union(stars).distinct()


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, label) of the signatures whose nodes lie in different components."""
    placed = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    wide = placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return placed.join(wide, "sig", "left_semi").select("sig", "node", "label")


def open_pairs(rest: DataFrame) -> tuple[int, float]:
    """Number of open rows, and of the pairs of nodes of different components that share a signature."""
    parts = rest.groupBy("sig", "label").agg(F.count("*").cast("double").alias("n"))
    wide = parts.groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    n, pairs = wide.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2)).first()
    return int(n or 0), pairs or 0.0


def pivot_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs a < b of one node of each open signature and those of other components."""
    drawn = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("node"), F.col("label").alias("label"))
    pivots = rest.groupBy("sig").agg(F.min(drawn).alias("pivot"))
    met = rest.join(pivots, "sig").where("pivot.label <> label")
    return met.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()


def cross_pairs(rest: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Distinct pairs a < b that share an open signature, lie in different components and may be similar."""
    rest = rest.join(nodes, "node")
    side = [c for c in nodes.columns if c != "node"]
    left = rest.select("sig", F.col("node").alias("a"), F.col("label").alias("la"), *(F.col(c).alias(f"a_{c}") for c in side))
    right = rest.select("sig", F.col("node").alias("b"), F.col("label").alias("lb"), *(F.col(c).alias(f"b_{c}") for c in side))
    found = left.join(right, (left.sig == right.sig) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near("a_", "b_"))
    return found.select("a", "b").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; the label is the component's least node.

    Alternates large and small stars (Kiveris et al. 2014) until the edges are stars themselves.
    """
    facts = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges, seen = scratch.observed(edges.select("a", "b").where("a <> b").distinct(), "edges", *facts)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        before = edges
        edges, state = scratch.observed(small.where("a <> b").distinct(), "stars", *facts)
        scratch.drop(before)
        if state == seen:
            break
        seen = state
    labels = scratch.stage(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    ), "labels")
    scratch.drop(edges)
    return labels


def linked(scratch: Scratch, signatures: DataFrame | Sequence[DataFrame], check: Check) -> DataFrame:
    """(node, label) of all nodes with a link; a staged table.

    Shares of the signatures, each with all rows of its signatures, meet one after the other.
    """
    shares = [signatures] if isinstance(signatures, DataFrame) else signatures
    met = [scratch.stage(meetings(share), "met") for share in shares]
    every = reduce(DataFrame.union, met)
    tried = scratch.stage(check.likely(star_pairs(every)), "star-pairs")
    before = rest = scratch.stage(every.where("sig IS NOT NULL").select("sig", F.col("a").alias("node")).distinct(), "rest")
    scratch.drop(*met)
    links = check.linked(tried)
    labels = components(scratch, links)
    scratch.drop(links)
    turns = [tried]
    for turn in range(PIVOTS + 1):
        rest = scratch.stage(open_rows(rest.select("sig", "node"), labels), "open")
        scratch.drop(before)
        before = rest
        n, pairs = open_pairs(rest)
        if not n:
            scratch.drop(rest, *turns)
            return labels
        if turn == PIVOTS or pairs <= FEW_PAIRS * n:
            break
        drawn, (n,) = scratch.observed(_untried(check.likely(pivot_pairs(rest, turn)), turns), "pivot-pairs", F.count("*"))
        turns.append(drawn)
        if not n:
            break
        more = check.linked(drawn)
        if more.isEmpty():
            scratch.drop(more)
            break
        labels = _merged(scratch, labels, more)
    cross, (n,) = scratch.observed(_untried(cross_pairs(rest, check.nodes.drop("tk"), check.near), turns), "cross-pairs", F.count("*"))
    scratch.drop(rest, *turns)
    if n:
        more = check.linked(cross)
        labels = _merged(scratch, labels, more)
    scratch.drop(cross)
    return labels


def _untried(pairs: DataFrame, turns: list[DataFrame]) -> DataFrame:
    """The pairs that no turn before has tried."""
    for tried in turns:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return pairs


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links; both tables are dropped."""
    merged = components(scratch, labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
    scratch.drop(labels, links)
    return merged
