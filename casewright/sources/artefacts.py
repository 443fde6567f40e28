"""Encoded sets, catalogues, metrics and matrices as tables on shared storage.

Partition columns take the place of name parts in file names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.associate import pearson_matrix

SET_KEYS = ("dataset", "method", "prefix_length", "set")


def write_parts(rows: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    """Write ``rows`` with a folder per value of ``by``.

    Mode ``replace`` replaces the folders that rows belong to and leaves others as they are, so a run
    can be repeated; ``append`` and ``overwrite`` are those of Spark.
    """
    writer = rows.write.mode("overwrite" if mode == "replace" else mode).partitionBy(*by)
    writer.option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static").parquet(path)


def write_encoded(encoded: DataFrame, path: str, mode: str = "append") -> None:
    """Encoded rows with ``SET_KEYS`` columns, one folder per set."""
    write_parts(encoded, path, SET_KEYS, mode)


def write_catalogue(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Catalogue rows, one per encoded set, so a single file each time; ``replace`` keeps them by log and method."""
    write_parts(rows.coalesce(1), path, ("dataset", "method") if mode == "replace" else (), mode)


def write_metrics(frames: Sequence[DataFrame], path: str, run: str = "run1", mode: str = "append") -> None:
    """Long metric rows of several frames in one job, kept by run."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    write_parts(rows.withColumn("run", F.lit(run)), path, ("run",), mode)


def write_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result table as ``;`` separated text with a header; nested columns become JSON."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("sep", ";").option("header", True).csv(path)


def read_artefact(spark: SparkSession, path: str, **name_parts) -> DataFrame:
    """A stored table restricted to the given partition values."""
    return where_parts(spark.read.parquet(path), name_parts)


def where_parts(df: DataFrame, name_parts: Mapping) -> DataFrame:
    """Rows of the given name parts; on a partitioned table this prunes folders."""
    for c, value in name_parts.items():
        df = df.where(F.col(c) == F.lit(value))
    return df


def correlation_table(encoded: DataFrame, kinds: Mapping[str, Sequence[str]], label: str = "encoded_label") -> DataFrame:
    """(kind, feature_a, feature_b, r) for each kind of features with the label."""
    parts = [
        pearson_matrix(encoded, [*features, label]).select(F.lit(kind).alias("kind"), "feature_a", "feature_b", F.round("r", 3).alias("r"))
        for kind, features in kinds.items() if features
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_correlations(matrices: DataFrame, **name_parts) -> tuple[DataFrame, DataFrame]:
    """(categorical, numerical) matrices of one encoded set."""
    chosen = where_parts(matrices, name_parts)
    return chosen.where(F.col("kind") == "cat").drop("kind"), chosen.where(F.col("kind") == "num").drop("kind")


def list_encoded_sets(
    catalogue: DataFrame, datasets: Mapping[str, Sequence[str]], lengths: Sequence[int] = tuple(range(1, 40, 5))
) -> DataFrame:
    """Training sets of the wanted logs by method; positional sets only at the wanted lengths."""
    wanted = F.lit(False)
    for method, names in datasets.items():
        hit = (F.col("method") == method) & F.col("dataset").isin(list(names))
        if method == "prefix_index":
            hit = hit & F.col("prefix_length").isin(list(lengths))
        wanted = wanted | hit
    return catalogue.where(F.col("dataset_type").contains("training") & wanted)
