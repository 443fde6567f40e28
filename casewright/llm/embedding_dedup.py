"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation that balances and sharpens the signs of the principal components (ITQ, Gong and
Lazebnik 2011) turns vectors into binary codes. Codes are cut into blocks of ``BLOCK`` bits; two
vectors are candidates when some block differs in one bit at most, which holds for all codes within
2 * blocks - 1 bits. Buckets (label, block, value) are cut into tiles of bounded size, and tiles are
compared as matrices of the original vectors, so no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .scratch import Scratch

#: Vectors that the rotation is learnt from, those with the least hashes; all vectors are indexed.
SAMPLE = 20_000
ROUNDS = 40
BITS = 64
BLOCK = 16
#: Vectors of a tile, about.
TILE = 256


class Rotation(NamedTuple):
    mean: np.ndarray
    matrix: np.ndarray


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> Rotation:
    """ITQ on unit vectors: principal components, then the rotation that is closest to their signs."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    projected = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return Rotation(mean, axes @ turn)


def codes_of(units: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Binary codes as unsigned 64-bit numbers."""
    bits = (units - rotation.mean) @ rotation.matrix > 0
    padded = np.zeros((len(units), BITS), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)[:, 0]


def prepare(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(row, vec_id, label, dim, vec): numbered rows; dim is null for vectors that cannot link."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            dims, vecs = [], []
            for value, name in zip(batch.column("vec"), batch.column("label"), strict=True):
                flat = value.values if value.is_valid and name.is_valid else None
                good = flat is not None and len(flat) and not flat.null_count
                if good:
                    x = flat.to_numpy()
                    good = bool(np.isfinite(x).all() and x.any())
                dims.append(len(flat) if good else None)
                vecs.append(_unit(x).tobytes() if good else None)
            n = batch.num_rows
            yield pa.record_batch([
                pa.array(task + done + np.arange(n)), batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()),
            ], schema=schema)
            done += n

    chosen = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )
    return chosen.mapInArrow(run, "row long, vec_id long, label string, dim int, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _coded(rotation) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(batch.num_rows, -1)
                codes = codes_of(units, Rotation(*rotation.value))
                yield batch.append_column("code", pa.array(codes.view(np.int64)))

    return run


def _compare(least: float):
    """Links between the vectors of two tiles: (row, n, root), the root standing for a local component."""
    width = BITS // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, roots = [], [], []
            get = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                block, same = get["block"][i].as_py(), get["same"][i].as_py()
                a, b = get["a"][i].values, get["b"][i].values
                ra, rb = a.field("row").to_numpy(), b.field("row").to_numpy()
                x, y = (np.frombuffer(b"".join(v.field("vec").to_pylist()), np.float64).reshape(len(v), -1) for v in (a, b))
                near = x @ y.T >= least
                if same:
                    near &= ra[:, None] < rb[None, :]
                if not near.any():
                    continue
                # A pair counts in the first block that finds it.
                p, q = np.nonzero(near)
                apart = a.field("code").to_numpy()[p].view(np.uint64) ^ b.field("code").to_numpy()[q].view(np.uint64)
                parts = np.bitwise_count(apart.view(np.uint16).reshape(-1, width))
                first = ~(parts[:, :block] <= 1).any(axis=1)
                p, q = ra[p[first]], rb[q[first]]
                if not len(p):
                    continue
                ends = np.concatenate([p, q])
                nodes, at = np.unique(ends, return_inverse=True)
                rows.append(nodes)
                counts.append(np.bincount(at))
                roots.append(nodes[_roots(at[: len(p)], at[len(p):], len(nodes))])
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(v)) for v in (rows, counts, roots)], names=["row", "n", "root"])

    return run


def _roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Least member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_pairs(sizes: DataFrame) -> DataFrame:
    """(label, block, va, ta, vb, tb) of the tiles to compare: of one value, or of values one bit apart."""
    other = F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(1 << j)) for j in range(BLOCK)]))
    flipped = sizes.select("label", "block", F.col("value").alias("va"), F.col("tiles").alias("na"), other.alias("value")).where("va < value")
    apart = flipped.join(sizes, ["label", "block", "value"]).select("label", "block", "va", "na", F.col("value").alias("vb"), F.col("tiles").alias("nb"))
    same = sizes.select("label", "block", F.col("value").alias("va"), F.col("tiles").alias("na"), F.col("value").alias("vb"), F.col("tiles").alias("nb"))
    # A bucket of one vector has nothing to compare within itself.
    same = same.join(sizes.where("n > 1").select("label", "block", F.col("value").alias("va")), ["label", "block", "va"], "left_semi")
    every = apart.union(same.select(apart.columns))
    every = every.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    every = every.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return every.where("va <> vb OR ta <= tb").select("label", "block", "va", "ta", "vb", "tb")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98,
) -> DataFrame:
    """One row per vector: key, n_links, component_id (least key reachable by links), kept.

    Vectors of one label link when their cosine in double precision is ``least`` or more. Null and
    zero vectors, vectors with null or non-finite components or without a label, and vectors of
    another length than most link with nothing. Rows with equal keys keep a row each and link if
    their vectors do; a null key never becomes a component's name. ``kept`` holds where the key is
    the component's. Links found are exact; a link is missed if the codes differ in two bits or
    more in every block (at a cosine of 0.98 fewer than 1 in 100). Other columns are not read. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "embeddings") as scratch:
        rows = scratch.stage(prepare(vectors, key, vector, label), "rows")
        common = rows.where("dim IS NOT NULL").groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
        if common is None:
            return scratch.result(_result(rows, None, None, key))
        valid = rows.where(F.col("dim") == common.dim).select("row", "label", "vec")
        drawn = valid.orderBy(F.xxhash64("vec"), "row").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist()
        rotation = learn_rotation(np.frombuffer(b"".join(drawn), np.float64).reshape(len(drawn), -1))
        shared = spark.sparkContext.broadcast(tuple(rotation))
        coded = scratch.stage(valid.mapInArrow(_coded(shared), "row long, label string, vec binary, code long"), "coded")
        blocks = F.posexplode(F.array(*[
            F.shiftrightunsigned("code", BLOCK * k).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int") for k in range(BITS // BLOCK)
        ]))
        spread = coded.select("row", "label", "code", "vec", blocks.alias("block", "value"))
        sizes = spread.groupBy("label", "block", "value").agg(F.count("*").alias("n"))
        sizes = scratch.stage(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "sizes")
        # Large buckets are cut by the hash of the row.
        tile = F.pmod(F.hash("row"), F.col("tiles"))
        tiled = spread.join(sizes.where("tiles > 1").drop("n"), ["label", "block", "value"], "left").withColumn("tile", F.coalesce(tile, F.lit(0)))
        tiles = tiled.groupBy("label", "block", "value", "tile").agg(F.collect_list(F.struct("row", "code", "vec")).alias("members"))
        tiles = scratch.stage(tiles, "tiles")
        pairs = scratch.stage(tile_pairs(sizes), "tile-pairs")
        left = tiles.toDF("label", "block", "va", "ta", "a")
        right = tiles.toDF("label", "block", "vb", "tb", "b")
        work = pairs.join(left, ["label", "block", "va", "ta"]).join(right, ["label", "block", "vb", "tb"])
        work = work.select("block", ((F.col("va") == F.col("vb")) & (F.col("ta") == F.col("tb"))).alias("same"), "a", "b")
        links = scratch.stage(work.mapInArrow(_compare(least), "row long, n long, root long"), "links")
        labels = components(scratch, links.select(F.col("root").alias("a"), F.col("row").alias("b")))
        counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
        return scratch.result(_result(rows, counts, labels, key))


def _result(rows: DataFrame, counts: DataFrame | None, labels: DataFrame | None, key: str) -> DataFrame:
    base = rows.select("row", "vec_id")
    if counts is None:
        joined = base.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    else:
        placed = base.join(labels, F.col("row") == F.col("node")).select("row", "vec_id", "label")
        least = placed.groupBy("label").agg(F.min("vec_id").alias("least"))
        named = placed.join(least, "label").select("row", "least").join(counts, "row")
        joined = base.join(named, "row", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")
        )
    return joined.select(
        F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
