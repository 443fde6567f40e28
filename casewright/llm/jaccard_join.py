"""N-gram Jaccard join: exact set-similarity join by a partition of the universe.

Shingles of a set are dealt into segments by hash, with the number of segments fixed for a band of
sizes. Similar sets differ in at most H shingles, so if enough segments are indexed, at least one
of them is equal (or, with one-deletion neighbourhoods, differs in one shingle) in both. Which
segments a set indexes follows from a cost: small bands take few segments with all one-deletion
neighbours; larger ones take the subsets themselves and leave out segments whose shingles are all
frequent, as far as the pigeonhole count allows. Candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import SIGNATURES, Gatherer, linked
from .scratch import Scratch, sized
from .shingles import Check, each_set, describe, frequency, frequency_table, frequent_cells, nodes_of, text_key
from .words import SHINGLE, mix

#: Sizes up to which a band uses one-deletion neighbourhoods.
SMALL = 32


#: Bands by number and percent, filled as they are needed.
_BANDS: dict[tuple[int, int], tuple[int, int, int, bool]] = {}


def _scheme(band: int, percent: int) -> tuple[int, int, int, bool]:
    """Least and greatest smaller set, number of segments, and whether one-deletion is used."""
    if (band, percent) not in _BANDS:
        low = 1 if band == 0 else _scheme(band - 1, percent)[1] + 1
        high = max(low, low * 10_000 // (percent * percent))
        limit = _limit(high, high * 100 // percent, percent)
        delete = high <= SMALL
        _BANDS[band, percent] = low, high, (limit + 2) // 2 if delete else max(limit + 1, (high + 1) // 2), delete
    return _BANDS[band, percent]


def _limit(n: int, m: int, percent: int) -> int:
    """Greatest symmetric difference of similar sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def schemes_of(n: int, percent: int) -> list[int]:
    """Bands in which a set of this size takes part: as the smaller set, or next to a smaller one."""
    out, band = [], 0
    while _scheme(band, percent)[0] <= n:
        if n <= _scheme(band, percent)[1] * 100 // percent:
            out.append(band)
        band += 1
    return out


def signatures_of(members: np.ndarray, percent: int, freq: np.ndarray) -> np.ndarray:
    """Signatures of a non-empty set; two similar sets share at least one."""
    n, out = len(members), []
    salted = mix(members ^ np.uint64(0x5851F42D4C957F2D))
    for band in schemes_of(n, percent):
        _, high, m, delete = _scheme(band, percent)
        spread = mix(members + np.uint64(band + 1))
        segment = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment.astype(np.int64), salted)
        name = mix((np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(band + 1))
        if delete:
            at = segment.astype(np.int64)
            out += [mix(total ^ name), mix((total[at] - salted) ^ name[at])]
            continue
        at = segment.astype(np.int64)
        filled = np.bincount(at, minlength=m) > 0
        limit = _limit(n, min(n * 100 // percent, high * 100 // percent) if n <= high else high, percent)
        spare = (int(filled.sum()) - limit - 1) // 2
        if spare < 0:
            out.append(mix(total ^ name))  # too few filled segments: the empty ones count too
            continue
        rare = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(rare, at, freq)
        which = np.flatnonzero(filled)
        if spare and freq.any():
            which = which[np.argsort(rare[which], kind="stable")]
        out.append(mix(total[which[: len(which) - spare]] ^ name[which[: len(which) - spare]]))
    return np.concatenate(out)


def ngram_jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = SHINGLE,
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (least key reachable by links).

    Two documents link when 100 * common >= percent * union of their shingle sets. A null or blank
    text has the empty set and links with nothing; texts of fewer than ``width`` words have one
    shingle. Documents with equal sets are one class, and links are found between classes. Rows
    with the same key keep a row each; a null key stays null and never becomes a component's name.
    Other columns are not read. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "jaccard-join") as scratch:
        described, labels = classes(scratch, docs, key, text, percent, width)
        return scratch.result(named(described, labels, key))


def classes(scratch: Scratch, docs: DataFrame, key: str, text: str, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Described documents (doc_id, tk, n_shingles, node), and (node, label) of all linked nodes."""
    spark = scratch.spark
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("tk", text_key())
    described = scratch.stage(describe(texts, ["doc_id", "tk"], width), "described")
    nodes = scratch.stage(nodes_of(described), "nodes")
    cells = spark.sparkContext.broadcast(frequent_cells(described))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, table = Gatherer(), set(), frequency_table(*cells.value)
        for batch in batches:
            for _, node, members in each_set(batch, width=width):
                if node and node not in seen:
                    seen.add(node)
                    found.add(signatures_of(members, percent, frequency(members, table)), node)
                    if found.full():
                        yield from found.rows()
                        seen.clear()
        yield from found.rows()

    signatures = texts.select("text").mapInArrow(run, SIGNATURES)
    return described, linked(scratch, signatures, Check(scratch, texts, nodes, percent, width))


def first_of_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = SHINGLE,
) -> DataFrame:
    """The rows of ``docs`` with one document for each group of linked ones.

    The one with the least key stays (of equal keys, the least hash of the text; keys before null).
    Rows that repeat it in key and text go, too. Documents without words stay as they are. Which rows
    stay is written down, and their texts are read from ``docs`` when the result is used.
    """
    with Scratch(docs.sparkSession, "first-of-groups") as scratch:
        described, labels = classes(scratch, docs, key, text, percent, width)
        rows = described.where("cell IS NULL").select("doc_id", "tk", "node").join(labels, "node", "left")
        rows = rows.withColumn("label", F.coalesce("label", "node"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "tk")
        firsts = rows.where("node <> 0").groupBy("label").agg(F.min(order).alias("first"))
        firsts = firsts.select("first.doc_id", "first.tk", F.lit(True).alias("grouped"))
        blank = rows.where("node = 0").select("doc_id", "tk", F.lit(False).alias("grouped")).distinct()
        stay = firsts.union(blank).toDF("__key", "__tk", "__grouped")
        counts = rows.groupBy("doc_id", "tk").count().where("count > 1").toDF("__again", "__hash", "__n")
        match = F.col("__key").eqNullSafe(F.col("__again")) & (F.col("__tk") == F.col("__hash"))
        stay = scratch.result(stay.join(counts, match, "left").select("__key", "__tk", (F.col("__grouped") & F.col("__n").isNotNull()).alias("__one")), "stay")
        own = docs.withColumn("__own", text_key(F.col(text).cast("string")))
        match = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__tk"))
        found = own.join(sized(stay), match)
        # Only repeated rows have to be brought together.
        once = found.where("__one").dropDuplicates(["__key", "__tk"])
        return found.where("NOT __one").union(once).select(*docs.columns)


def named(described: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Documents with the least key of their component."""
    rows = described.where("cell IS NULL").select("doc_id", "n_shingles", "node")
    classes = rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    # Only linked classes and copies need a name other than their own.
    named = placed.join(least, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
