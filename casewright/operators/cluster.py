"""Clusters of encoded cases and their typical and extreme members."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import quoted


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.fillna(0.0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(filled)


def silhouette(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, from the moments of each cluster.

    The mean squared distance of x to a cluster of n points with sum s and squared-norm sum q
    is |x|^2 + q/n - 2 x.s/n, so no pair of rows is formed. ``vector`` is an array of doubles.
    """
    dim = F.size(vector)
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    rows = df.withColumn("_norm", norm)
    total = vector_to_array(Summarizer.sum(array_to_vector(vector)))
    moments = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum("_norm").alias("q"), total.alias("s"))
    packed = moments.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "q", "s")).alias("_clusters"))
    # One row with one entry per cluster.
    clusters = packed.scalar()

    def distance(m):
        dot = F.aggregate(F.zip_with(F.col(vector), m["s"], lambda x, s: x * s), F.lit(0.0), lambda a, x: a + x)
        return F.col("_norm") * m["n"] + m["q"] - 2 * dot

    with_all = rows.withColumn("_clusters", clusters).where(dim > 0)
    own = F.filter("_clusters", lambda m: m["c"] == F.col(cluster))[0]
    others = F.filter("_clusters", lambda m: m["c"] != F.col(cluster))
    measured = with_all.withColumn("_own", own).select(
        F.col("_own.n").alias("_n"), (distance(F.col("_own")) / F.greatest(F.lit(1), F.col("_own.n") - 1)).alias("_a"),
        F.array_min(F.transform(others, lambda m: distance(m) / m["n"])).alias("_b"),
    )
    s = F.when(F.col("_n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    return measured.agg(F.avg(s).alias("silhouette"))


def scan_clusters(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42) -> DataFrame:
    """(n_clusters, silhouette) of k-means on the unscaled encoded set.

    Features are assembled once for all fits, and the silhouettes of all numbers of clusters are read from the rows together.
    """
    vectors = _vectors(df, features).select("_features").persist()
    try:
        labelled = vectors
        for i, k in enumerate(ks):
            # With a column more, the fit sees a table that is not kept yet and keeps its own form of the rows.
            rows = vectors.withColumn("_k", F.lit(k))
            labelled = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=f"_c{i}").fit(rows).transform(labelled)
        found = _silhouettes(labelled.select(vector_to_array("_features").alias("_v"), F.array(*[f"_c{i}" for i in range(len(ks))]).alias("_c")), len(ks))
    finally:
        vectors.unpersist()
    return df.sparkSession.createDataFrame([(int(k), s) for k, s in zip(ks, found)], "n_clusters int, silhouette double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``_v`` and their labels ``_c`` as arrays."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("_v", "_c"))


def _silhouettes(rows: DataFrame, n: int) -> list[float]:
    """``silhouette`` of each of ``n`` labellings of the rows (_v, _c): an array of doubles and one of labels."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for x, labels in _blocks(batches):
            every = np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x])
            for i in range(n):
                for c in np.unique(labels[:, i]).tolist():
                    sums[i, c] = sums.get((i, c), 0.0) + every[labels[:, i] == c].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in sums], "c": [c for _, c in sums], "sums": [s.tolist() for s in sums.values()]})

    total = vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
    # One row per cluster.
    found = rows.mapInArrow(moments, "i long, c long, sums array<double>").groupBy("i", "c").agg(total).orderBy("i", "c").collect()
    clusters = [[(r["c"], np.array(r["sums"])) for r in found if r["i"] == i] for i in range(n)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, labels in _blocks(batches):
            norm, out = (x * x).sum(axis=1), []
            for i, own in enumerate(clusters):
                sizes, squares = np.array([s[0] for _, s in own]), np.array([s[1] for _, s in own])
                distance = norm[:, None] * sizes + squares - 2 * x @ np.array([s[2:] for _, s in own]).T
                at = np.searchsorted([c for c, _ in own], labels[:, i])
                spots = np.arange(len(x)), at
                a = distance[spots] / np.maximum(1, sizes[at] - 1)
                mean = distance / sizes
                mean[spots] = np.inf
                b = mean.min(axis=1)
                top = np.maximum(a, b)
                whole = np.isfinite(b) & (top != 0) & (sizes[at] != 1)
                out.append(float(np.divide(b - a, top, out=np.zeros(len(x)), where=whole).sum()))
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "sums": [out]})

    total = F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
    all_rows = rows.mapInArrow(measure, "n long, sums array<double>").agg(*total).first()
    return [s / all_rows["n"] for s in all_rows["sums"]]


def best_k(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The number of clusters with the highest silhouette per set; the smaller one on a tie."""
    spot = F.struct(F.col("silhouette"), (-F.col("n_clusters")).alias("_k"))
    return scores.groupBy(*by).agg(F.max_by("n_clusters", spot).alias("n_clusters"), F.max("silhouette").alias("silhouette"))


def cluster_scaled(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Rows with ``scaled`` features (an array) and their ``cluster_label``."""
    stages = [
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster_label"),
    ]
    vectors = _vectors(df, features)
    kept = vectors.select("_features").persist()
    try:
        labelled = Pipeline(stages=stages).fit(kept).transform(vectors)
    finally:
        kept.unpersist()
    return labelled.withColumn("scaled", vector_to_array("_scaled")).drop("_features", "_scaled")


def centroid_distance(df: DataFrame, vector: str, cluster: str, out: str = "distance") -> DataFrame:
    """Euclidean distance of each row to the mean of its own cluster."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(vector)))
    centroids = df.groupBy(F.col(cluster).alias("_of")).agg(mean.alias("_centre"))
    # One vector per cluster.
    joined = df.join(F.broadcast(centroids), F.col(cluster) == F.col("_of"))
    squares = F.zip_with(F.col(vector), F.col("_centre"), lambda x, m: (x - m) * (x - m))
    return joined.withColumn(out, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))).drop("_of", "_centre")


def nearest_farthest(df: DataFrame, row: str, cluster: str, distance: str = "distance", complete: Sequence[str] = ()) -> DataFrame:
    """(cluster, nearest, nearest_distance, farthest, farthest_distance) per cluster.

    The farthest row has no null in the ``complete`` columns. Ties go to the smaller row id.
    """
    whole = F.lit(True)
    for c in complete:
        whole = whole & F.col(quoted(c)).isNotNull()
    near = F.min(F.struct(F.col(distance).alias("d"), F.col(row).alias("r")))
    # The largest distance, then the smallest id.
    top = df.where(whole).groupBy(F.col(cluster).alias("_of")).agg(F.max(distance).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(cluster) == F.col("_of"), "left")
    far = F.min(F.when(whole & (F.col(distance) == F.col("_top")), F.col(row)))
    return joined.groupBy(cluster).agg(near.alias("_near"), far.alias("farthest"), F.max("_top").alias("farthest_distance")).select(
        cluster, F.col("_near.r").alias("nearest"), F.col("_near.d").alias("nearest_distance"), "farthest", "farthest_distance"
    )
