"""Ranked lexical search: short posting lists summed term by term, long ones skipped document by document.

Documents are scanned once for the terms of the items and their postings are written. Every task
then indexes its postings in blocks of documents. For an item, the lists that are short in the block
are added up into one list of accumulators (term at a time). That list is, with its greatest sum as
bound, one more iterator beside the long lists. Runs of documents are visited in the order of what
all iterators together can reach there; a run, or the rest of its lists, is skipped as soon as no
document in it can come up to the lowest score in the best ``k`` so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import scan_within
from .scratch import Scratch, sized
from .terms import Vocabulary, terms_of
from .words import signed, slices

#: Terms of the items that one pass over the documents looks for; more items take more passes.
PASS_TERMS = 500_000
#: Documents and postings of one block of the index that a task holds.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 2_000_000
#: Documents visited or skipped together.
RUN = 1 << 10
#: A list with fewer than 1/SHORT of a block's documents is added up term by term.
SHORT = 16
SALTS = 32


def _item_terms(column: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found = terms_of(part.column(column))
                sets = [np.unique(found.hash[a:b]) for a, b in zip(found.first[:-1], found.first[1:])]
                sizes = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], [*kept, "terms"])
    return run


def _postings(vocabulary, key: str, text: str):
    """Per document with a term: key, terms ``n``, and numbers and counts of the wanted terms in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Vocabulary(vocabulary.value)
        for batch in batches:
            for part in slices(batch, text):
                found = terms_of(part.column(text))
                n = np.diff(found.first)
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                places, numbers = wanted.numbers(found.hash)
                row = np.searchsorted(found.first, places, "right") - 1
                cell, count = np.unique(row * len(wanted) + numbers, return_counts=True)
                ends = np.searchsorted(cell, np.append(rows, part.num_rows) * len(wanted)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(rows)), pa.array(n[rows]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((cell % max(1, len(wanted))).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32))),
                    ],
                    ["key", "n", "terms", "counts"],
                )
    return run


class Block:
    """Inverted lists of some documents in ascending order of their keys."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_terms: int, weights: np.ndarray):
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.take(pc.sort_indices(table.column("key"), null_placement="at_end")).combine_chunks()
        self.keys = table.column("key")
        size = table.column("n").to_numpy()
        lists = table.column("terms").combine_chunks() if table.num_rows else None
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        counts = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        length = 100 - 50 + (50 * size * n_docs) // n_terms
        gain = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * length[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])
        self.n = table.num_rows
        self.runs = -(-self.n // RUN)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def short(self, term: int) -> bool:
        return (self.at[term + 1] - self.at[term]) * SHORT < self.n

    def runs_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a long list: its first entry in every run, and the greatest gain there."""
        if term not in self.long:
            a, b = self.at[term], self.at[term + 1]
            first = a + np.searchsorted(self.doc[a:b], np.arange(self.runs + 1) * RUN)
            best = np.zeros(self.runs, np.int64)
            np.maximum.at(best, self.doc[a:b] // RUN, self.gain[a:b])
            self.long[term] = first, best
        return self.long[term]


class Best:
    """The ``k`` best (score, key) so far; equal scores by ascending key, null last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple] = []

    @property
    def least(self) -> int:
        """What a document must reach to matter."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, keys: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), keys))
        rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        self.rows = rows[: self.k]


def search_block(block: Block, terms: np.ndarray, best: Best) -> None:
    """Enter the documents of a block that are among the best of an item with these terms."""
    terms = terms[block.at[terms + 1] > block.at[terms]]
    brief = [t for t in terms if block.short(t)]
    # Accumulators: the short lists as one list with sums.
    spans = [slice(block.at[t], block.at[t + 1]) for t in brief]
    doc, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if spans:
        doc = np.concatenate([block.doc[s] for s in spans])
        order = np.argsort(doc, kind="stable")
        doc, starts = np.unique(doc[order], return_index=True)
        total = np.add.reduceat(np.concatenate([block.gain[s] for s in spans])[order], starts)
    first = np.searchsorted(doc, np.arange(block.runs + 1) * RUN)
    reach = np.zeros(block.runs, np.int64)
    np.maximum.at(reach, doc // RUN, total)
    lists = [block.runs_of(t) for t in terms if not block.short(t)]
    for _, most in lists:
        reach += most
    for run in np.argsort(-reach, kind="stable").tolist():
        if reach[run] < best.least:
            break
        base = run * RUN
        sums = np.zeros(min(RUN, block.n - base), np.int64)
        sums[doc[first[run]: first[run + 1]] - base] = total[first[run]: first[run + 1]]
        open_lists = sorted(((int(most[run]), int(at[run]), int(at[run + 1])) for at, most in lists if most[run]), reverse=True)
        rest = sum(most for most, _, _ in open_lists)
        for most, a, b in open_lists:
            if sums.max() + rest < best.least:
                break
            sums[block.doc[a:b] - base] += block.gain[a:b]
            rest -= most
        if rest:
            continue
        hits = np.flatnonzero(sums >= best.least)
        hits = hits[np.argsort(-sums[hits], kind="stable")[: best.k]]
        best.add(sums[hits], block.keys.take(pa.array(hits + base)).to_pylist())


def _search(given, k: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ends, terms, weights, n_docs, n_terms = given.value
        best = [Best(k) for _ in numbers]

        def enter(held: list[pa.RecordBatch]) -> None:
            block = Block(held, n_docs, n_terms, weights)
            for i, found in enumerate(best):
                search_block(block, terms[ends[i]: ends[i + 1]], found)

        held, docs, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                enter(held)
                held, docs, postings = [], 0, 0
        if docs:
            enter(held)
        for number, found in zip(numbers, best):
            if found.rows:
                scores, keys = zip(*found.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(keys), pa.int64()), pa.array(keys, key_type), pa.array(scores, pa.int64())],
                    ["number", "key", "score"],
                )
    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of every item with a score above 0.

    Terms, weights, lengths and scores are whole numbers: a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))) and saturates with its count and the document's length.
    N, df and lengths are counted over all documents; a document is a row, so repeated rows count and
    are ranked each. A null or empty text has no terms: such a document is not counted, such an item
    has no rows. Equal scores are ranked by ascending key, null keys last. Rows of ``items`` are
    ranked each, also with equal ids. Other columns are not read.

    Items are taken in passes of about ``PASS_TERMS`` terms, which bounds what is broadcast; a task
    holds one block of postings and ``k`` documents an item.
    """
    spark = docs.sparkSession
    key_field, item_field = docs.schema[key], items.schema[item]
    with Scratch(spark, "lexical-search") as scratch:
        kinds = T.StructType([T.StructField("item", item_field.dataType), T.StructField("terms", T.ArrayType(T.LongType()))])
        asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("words"))
        asked = asked.mapInArrow(_item_terms("words", ["item"]), kinds).where(F.size("terms") > 0)
        asked = scratch.stage(asked.withColumns({"number": F.monotonically_increasing_id(), "n": F.size("terms").cast("long")}), "items")
        placed = scan_within(asked.select("number", "n"), [], ["number"], sums={"upto": "n"})
        placed = placed.select("number", F.expr(f"(upto - n) div {PASS_TERMS}").alias("pass"))
        placed = scratch.stage(asked.join(sized(placed), "number"), "passes")
        passes = [r[0] for r in placed.select("pass").distinct().orderBy("pass").collect()]
        ranked = None
        for p in passes:
            found = _one_pass(scratch, docs.select(F.col(key).alias("key"), F.col(text).alias("words")), placed.where(F.col("pass") == p), k)
            ranked = found if ranked is None else ranked.unionByName(found)
        if ranked is None:
            kinds = T.StructType([
                T.StructField("item", item_field.dataType), T.StructField("rank", T.IntegerType()),
                T.StructField("key", key_field.dataType), T.StructField("score", T.LongType()),
            ])
            ranked = spark.createDataFrame([], kinds)
        named = ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        return scratch.result(named, "ranked")


def _one_pass(scratch: Scratch, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The best documents of some items whose terms are few enough to be sent to all tasks."""
    context = docs.sparkSession.sparkContext
    rows = items.select("number", "terms").orderBy("number").toArrow().combine_chunks()
    lists = rows.column("terms").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    vocabulary = Vocabulary(hashes)
    wanted = context.broadcast(vocabulary.hashes)
    kinds = T.StructType([
        docs.schema["key"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])
    postings = scratch.stage(docs.mapInArrow(_postings(wanted, "key", "words"), kinds), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    kinds = T.StructType([T.StructField("number", T.LongType()), docs.schema["key"], T.StructField("score", T.LongType())])
    if not n_docs:
        found = docs.sparkSession.createDataFrame([], kinds)
    else:
        # A row per term of the pass.
        counts = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        numbers = rows.column("number").to_pylist()
        given = context.broadcast((numbers, ends, vocabulary.numbers(hashes)[1], weights, n_docs, n_terms))
        key_type = pa.schema([("key", _arrow(docs.schema["key"].dataType))]).field(0).type
        found = postings.mapInArrow(_search(given, k, key_type), kinds)
    # Tasks send at most k rows an item; they meet in salted groups first.
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for by in (["number", "salt"], ["number"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return scratch.stage(salted.join(sized(items.select("number", "item")), "number").select("item", "rank", "key", "score"), "best")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
