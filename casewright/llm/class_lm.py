"""LM scoring with a Brown class-based bigram model.

Every word belongs to a class. Exchange clustering moves words between classes as long as the
likelihood of the training text's class bigrams grows; the model then is

    p(word | word before) = p(class | class before) * p(word | class)

with smoothed class transitions and word emissions. The class of a word follows from its unit:
a frequent word is a unit of its own, and rarer words share one by their last bytes. A unit has at
least ``UNIT_SHARE`` of the training tokens or is one of ``ENDINGS`` groups, which bounds what
reaches the driver and every task; counts of all words stay in a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, mix, signed, slices, words_of

#: Classes of the clustering; unit tables grow with its square.
CLASSES = 64
#: Training tokens a word needs, as a share of all, for a unit of its own: at most 200,000 units.
UNIT_SHARE = 5e-6
#: Share from which a word's count is sent to every task: at most 2,000,000 words of 12 bytes.
COMMON_SHARE = 5e-7
#: Groups of rare words by their last bytes.
ENDINGS = 4096
ROUNDS = 8
#: One in so many of the proposed moves, by gain, is tried.
SHARES = (1, 4, 16)
#: Words and pairs that a task counts before it sends them on.
GATHER = 2_000_000
ADDED = 0.1
#: Hash of the end of a text, which counts as a token.
END = np.uint64(0x7C15D1B54A32D193)


class Model(NamedTuple):
    """What scoring needs in every task; all parts have a bounded size."""

    common: np.ndarray  # sorted hashes of common words
    counts: np.ndarray  # their training counts
    units: np.ndarray  # sorted hashes of words that are units
    classes: np.ndarray  # class of each unit: of the words in ``units``, then of the endings
    transitions: np.ndarray  # log10 p(class | class before)
    totals: np.ndarray  # training tokens of each class
    words: np.ndarray  # distinct training words of each class
    n: int
    v: int


def held_out(key: int | None) -> bool:
    """Whether a document is kept out of training: by crc32 of its key as text; a null key is the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, endings and text of every token of a slice, each text closed by ``END``."""
    words: Words = words_of(part.column("text"))
    sizes = np.diff(words.first)
    row = np.repeat(np.arange(part.num_rows), sizes + 1)
    last = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(row), bool)
    inner[last] = False
    hashed, ending = np.full(len(row), END), np.zeros(len(row), np.int64)
    hashed[inner] = words.hash
    if len(words.hash):
        data, stop = words.data, words.stop
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
        tail = low[stop - 1]
        for k in (2, 3):
            longer = stop - words.start >= k
            tail = tail * np.uint64(257) + np.where(longer, low[np.maximum(stop - k, 0)], 0).astype(np.uint64)
        ending[inner] = (mix(tail + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)
    return hashed, ending, row


def units_of(hashed: np.ndarray, ending: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Number of each token's unit: place among the unit words, or behind them by ending."""
    at = np.minimum(np.searchsorted(units, hashed), len(units) - 1)
    return np.where(units[at] == hashed, at, len(units) + ending)


class Counter:
    """Counts of pairs of 64-bit keys in a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
        a, b, n = _counted(a, b, np.ones(len(a), np.int64) if n is None else n)
        self.parts.append((a, b, n))
        self.size += len(a)
        if self.size > GATHER:
            self.squeeze()

    def squeeze(self) -> None:
        if self.parts:
            self.parts = [_counted(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def rows(self, least: int, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        """What has been counted, if there are ``least`` pairs."""
        if self.size < least:
            return
        self.squeeze()
        if self.parts and self.size >= least:
            a, b, n = self.parts.pop()
            self.size = 0
            for i in range(0, len(a), 200_000):
                s = slice(i, i + 200_000)
                yield pa.record_batch([pa.array(signed(a[s])), pa.array(signed(b[s])), pa.array(n[s])], names=list(names))


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a)) if len(b) and b.any() else np.argsort(a, kind="stable")
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[start], b[start], np.add.reduceat(n, start)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n): training counts of all words and of the end of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, ending, row = tokens_of(part)
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)[row]
                # A word determines its ending, so it is enough to count words.
                distinct, first, n = np.unique(hashed[train], return_index=True, return_counts=True)
                counter.add(distinct, ending[train][first].astype(np.uint64), n)
            yield from counter.rows(GATHER, ("word", "ending", "n"))
        yield from counter.rows(1, ("word", "ending", "n"))

    counted = docs.select("text", "held_out").mapInArrow(run, "word long, ending long, n long")
    return counted.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, units) -> DataFrame:
    """(a, b, n): training counts of neighbouring units; a text begins after the end of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, ending, row = tokens_of(part)
                unit = units_of(hashed, ending, units.value)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                before[0] = unit[-1]  # the last token of a slice is an end of text
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)[row]
                counter.add(before[train].astype(np.uint64), unit[train].astype(np.uint64))
            yield from counter.rows(GATHER, ("a", "b", "n"))
        yield from counter.rows(1, ("a", "b", "n"))

    counted = docs.select("text", "held_out").mapInArrow(run, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _log(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_moves(left: np.ndarray, right: np.ndarray, own: np.ndarray, own_class: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each unit and its gain in log likelihood, all other units staying where they are.

    ``left`` and ``right`` count a unit's neighbours by class before and after it, without itself;
    ``own`` counts the unit next to itself; ``table`` has the class bigrams.
    """
    best, gain = own_class.copy(), np.zeros(len(own))
    size = table.shape[0]
    for i in range(len(own)):
        a, r, l, s = own_class[i], right[i], left[i], own[i]
        rest = table.copy()
        rest[a] -= r
        rest[:, a] -= l
        rest[a, a] -= s
        out, into = rest.sum(axis=1) + l, rest.sum(axis=0) + r
        dr, dl = np.flatnonzero(r), np.flatnonzero(l)
        # Gain of adding the unit to class c: cells (c, d), (d, c) and (c, c), and the two margins.
        value = (_log(rest[:, dr] + r[dr]) - _log(rest[:, dr])).sum(axis=1)
        value += (_log(rest[dl, :] + l[dl, None]) - _log(rest[dl, :])).sum(axis=0)
        diagonal = np.diag(rest)
        both = _log(diagonal + r + l + s) - _log(diagonal) - (_log(diagonal + r) - _log(diagonal)) - (_log(diagonal + l) - _log(diagonal))
        value += both
        value -= _log(out + r.sum() + s) - _log(out) + _log(into + l.sum() + s) - _log(into)
        c = int(value.argmax())
        if c != a and value[c] > value[a] + 1e-9:
            best[i], gain[i] = c, value[c] - value[a]
    return best, gain


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams but for the part that no class changes."""
    return float(_log(table).sum() - _log(table.sum(axis=1)).sum() - _log(table.sum(axis=0)).sum())


def _class_tables(pairs: DataFrame, choices: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Class bigram counts under each choice of classes, in one pass; a task sends a row a class pair."""
    shared = pairs.sparkSession.sparkContext.broadcast(choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(shared.value), size * size))
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            for total, c in zip(totals, shared.value, strict=True):
                total += np.bincount(c[a] * size + c[b], n, size * size)
        at = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(at), pa.array(totals.ravel()[at].astype(np.int64))], names=["cell", "n"])

    rows = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    tables = np.zeros(len(choices) * size * size)
    tables[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return list(tables.reshape(len(choices), size, size))


def _moves(edges: DataFrame, classes, table, size: int, turn: int) -> DataFrame:
    """(unit, to, gain) of the units whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, c = table.value, classes.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                unit = part.column("unit").to_numpy()
                lists = part.column("edges")
                row = np.repeat(np.arange(len(unit)), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                other, n, after = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                self_ = other == unit[row]
                cell = row * size + c[other]
                r, l = (
                    np.bincount(cell[side], n[side], len(unit) * size).reshape(-1, size)
                    for side in (after & ~self_, ~after & ~self_)
                )
                own = np.bincount(row[self_ & after], n[self_ & after], len(unit))
                mine = np.flatnonzero(mix(unit.astype(np.uint64) + np.uint64(77)) % np.uint64(2) == turn % 2)
                to, gain = best_moves(l[mine], r[mine], own[mine], c[unit[mine]], table_)
                moved = gain > 0
                yield pa.record_batch([
                    pa.array(unit[mine][moved]), pa.array(to[moved]), pa.array(gain[moved])
                ], names=["unit", "to", "gain"])

    return edges.mapInArrow(run, "unit long, to long, gain double")


def cluster(scratch: Scratch, pairs: DataFrame, start: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of units after exchange rounds, and the class bigrams.

    In a round every second unit may move to its best class. Moves made at once can work against each
    other, so all of them and the parts with the largest gains (``SHARES``) are tried in one pass; the
    best is taken if the likelihood grows.
    """
    spark = scratch.spark
    after = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "n", F.lit(True).alias("after"))
    before = pairs.select(F.col("b").alias("unit"), F.col("a").alias("other"), "n", F.lit(False).alias("after"))
    # A list has at most two entries for each unit, of which there are a bounded number.
    edges = after.union(before).groupBy("unit").agg(F.collect_list(F.struct("other", "n", "after")).alias("edges"))
    edges = scratch.stage(edges, "edges")
    classes, table = start, _class_tables(pairs, [start], size)[0]
    for turn in range(rounds):
        moves = _moves(edges, spark.sparkContext.broadcast(classes), spark.sparkContext.broadcast(table), size, turn)
        found = moves.toArrow()  # at most a row per unit
        unit, to, gain = (found.column(c).to_numpy() for c in ("unit", "to", "gain"))
        if not len(unit):
            continue
        order = np.argsort(-gain, kind="stable")
        tried = []
        for share in SHARES:
            some = order[: -(-len(order) // share)]
            tried.append(classes.copy())
            tried[-1][unit[some]] = to[some]
        tables = _class_tables(pairs, tried, size)
        best = max(range(len(tried)), key=lambda i: likelihood(tables[i]))
        if likelihood(tables[best]) > likelihood(table):
            classes, table = tried[best], tables[best]
    return classes, table


def fit(scratch: Scratch, docs: DataFrame, words: DataFrame, size: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Cluster the units and estimate the model from training counts of ``words``."""
    spark = scratch.spark
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    common = words.where(F.col("n") >= max(2.0, COMMON_SHARE * n)).select("word", "n").toArrow()
    hashes, counts = common.column("word").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    units = hashes[counts >= max(2.0, UNIT_SHARE * n)]
    if not len(units):
        units = np.array([END])
    freq = np.zeros(len(units) + ENDINGS)
    at = np.minimum(np.searchsorted(hashes, units), max(len(hashes) - 1, 0))
    freq[: len(units)] = counts[at] if len(hashes) else 0
    shared = spark.sparkContext.broadcast(units)
    pairs = scratch.stage(count_pairs(docs, shared), "pairs")
    # Start: units in the order of frequency take classes in turn; exchange does the rest.
    start = np.zeros(len(freq), np.int64)
    start[np.argsort(-freq, kind="stable")] = np.arange(len(freq)) % size
    classes, table = cluster(scratch, pairs, start, size, rounds)
    placed = spark.sparkContext.broadcast(classes)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            word = batch.column("word").to_numpy().view(np.uint64)
            c = placed.value[units_of(word, batch.column("ending").to_numpy(), shared.value)]
            sums += np.stack([np.bincount(c, batch.column("n").to_numpy(), size), np.bincount(c, minlength=size)]).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(sums[0]), pa.array(sums[1])], names=["class", "n", "v"])

    sums = np.zeros((2, size))
    for c, cn, cv in words.mapInArrow(totals, "class long, n long, v long").groupBy("class").agg(F.sum("n"), F.sum("v")).collect():
        sums[:, c] = cn, cv
    # Transitions back off to the share of the class after.
    share = (table.sum(axis=0) + ADDED) / (table.sum() + ADDED * size)
    smooth = (table + 5 * share) / (table.sum(axis=1, keepdims=True) + 5)
    return Model(hashes, counts, units, classes, np.log10(smooth), sums[0], sums[1], int(n), int(v))


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the key as text is divisible by 10 are held out; the others are learnt
    from. Tokens are words with A-Z as a-z, and one end a text. ``base_score`` is the log10
    probability by counts of words with ``ADDED`` each and one place for all unknown words,
    ``score`` that of the class bigrams; unknown words have the class of their ending. A null text
    is empty and has its end only. Rows with equal keys keep a row each. Other columns are not read;
    an empty table gives an empty result, and without training text all words are unknown.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    with Scratch(spark, "class-lm") as scratch:
        words = scratch.stage(count_words(base), "words")
        model = fit(scratch, base, words, classes, rounds)
        return scratch.result(_scores(scratch, base, words, model, key))


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "rare array<struct<word:bigint,class:bigint,n:bigint>>"
)


def _scores(scratch: Scratch, docs: DataFrame, words: DataFrame, model: Model, key: str) -> DataFrame:
    spark = scratch.spark
    shared = spark.sparkContext.broadcast(tuple(model))
    n, v = model.n, model.v
    floor = np.log10(n + ADDED * (v + 1))
    room = np.log10(model.totals + ADDED * (model.words + 1))
    item = pa.struct([("word", pa.int64()), ("class", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, units, classes, transitions, *_ = shared.value
        logs = np.log10(counts + ADDED)
        task, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, ending, row = tokens_of(part)
                size = part.num_rows
                c = classes[units_of(hashed, ending, units)]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[0] = c[-1]
                at = np.minimum(np.searchsorted(common, hashed), max(len(common) - 1, 0))
                known = common[at] == hashed if len(common) else np.zeros(len(hashed), bool)
                sums = [np.bincount(row, w, size) for w in (
                    np.ones(len(row)), known, np.where(known, (logs[at] if len(common) else 0) - floor, 0),
                    transitions[before, c] + np.where(known, (logs[at] if len(common) else 0) - room[c], 0),
                )]
                # Words that no task knows the count of, each once a document.
                r, w, k = row[~known], hashed[~known], c[~known]
                order = np.lexsort((w, r))
                r, w, k = r[order], w[order], k[order]
                start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])) if len(r) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(r)))
                rare = pa.StructArray.from_arrays(
                    [pa.array(signed(w[start])), pa.array(k[start]), pa.array(times)], fields=list(item)
                )
                offsets = np.searchsorted(r[start], np.arange(size + 1)).astype(np.int32)
                yield pa.record_batch([
                    pa.array(task + done + np.arange(size)), part.column("doc_id"), part.column("held_out"), pa.array(sums[0].astype(np.int64)),
                    pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.ListArray.from_arrays(pa.array(offsets), rare),
                ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
                done += size

    scored = scratch.stage(docs.mapInArrow(run, _SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    room_of = F.element_at(F.array(*[F.lit(float(x)) for x in room]), (F.col("class") + 1).cast("int"))
    counted = rare.join(words.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + ADDED)
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"), F.sum(F.col("n") * (log - float(floor))).alias("base"),
        F.sum(F.col("n") * (log - room_of)).alias("emit"),
    )
    joined = scored.drop("rare").join(sums, "row", "left")
    return joined.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("emit", F.lit(0.0))).alias("score"),
    )
