"""Equal-width binning, outlier ranges and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted, to_long
from ..functions.ordering import exact_quantiles


def bin_counts(df: DataFrame, columns: Sequence[str], most: int = 4, distinct_from: int = 10) -> dict[str, int]:
    """Bins per column: ``most`` from ``distinct_from`` distinct values on, else their number."""
    values = to_long(df, [], columns).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("feature").agg(F.count("*").alias("n"))
    # One row per column.
    found = {r["feature"]: r["n"] for r in counts.collect()}
    return {c: most if found.get(c, 0) >= distinct_from else found.get(c, 0) for c in columns}


def discretize_uniform(df: DataFrame, columns: Sequence[str], compat: bool = False) -> DataFrame:
    """Columns as equal-width bin numbers; all other columns are left alone.

    With ``compat`` the bin count of the last column is used for all of them.
    """
    columns = list(columns)
    bins = bin_counts(df, columns)
    if compat:
        bins = {c: bins[columns[-1]] for c in columns}
    bounds = df.agg(*[f(quoted(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    place = {c: i for i, c in enumerate(columns)}
    for c in df.columns:
        if c not in place:
            out.append(F.col(quoted(c)))
            continue
        lo, hi, b = bounds[f"lo{place[c]}"], bounds[f"hi{place[c]}"], bins[c]
        x = F.col(quoted(c)).cast("double")
        if lo is None or lo == hi or b < 2:
            out.append(F.when(x.isNotNull(), F.lit(0.0)).alias(c))
            continue
        spot = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(b)))
        out.append(F.least(spot, F.lit(b - 1)).cast("double").alias(c))
    return df.select(*out)


def iqr_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: quartile range limits, outliers, and whether to skip, or draw tight or wide."""
    long = to_long(df, [], columns).where(F.col("value").isNotNull())
    quartiles = exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q75": 0.75})
    reach = (F.col("q75") - F.col("q25")) * 1.5
    limits = quartiles.select("feature", (F.col("q25") - reach).alias("lower"), (F.col("q75") + reach).alias("upper"))
    # One row per column.
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    counts = long.join(F.broadcast(limits), "feature").groupBy("feature", "lower", "upper").agg(
        F.count("*").alias("n"), F.count_if(outside).alias("outliers")
    )
    flag = (
        F.when(F.col("outliers") > F.col("n") * 0.05, "skip")
        .when(F.col("upper") - F.col("lower") < 0.5, "tight").otherwise("wide")
    )
    return counts.withColumn("flag", flag)


def without_outliers(df: DataFrame, column: str, limits: DataFrame) -> DataFrame:
    """Rows whose value lies inside the limits of ``iqr_range``."""
    own = limits.where(F.col("feature") == column)
    low, high = own.select("lower").scalar(), own.select("upper").scalar()
    return df.where((F.col(quoted(column)) >= low) & (F.col(quoted(column)) <= high))


def histogram_edges(lower: float, upper: float, size: float) -> list[float]:
    """Edges aligned to multiples of the bin size that cover [lower, upper]."""
    start = lower - lower % size
    stop = upper - upper % size + size
    n = int((stop - start) / size) + 1
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n)]


def histogram_bins(df: DataFrame, column: str, lower: float, upper: float, size: float) -> DataFrame:
    """(bin, edge, n) over the aligned edges; empty bins have no row."""
    edges = histogram_edges(lower, upper, size)
    width = (edges[-1] - edges[0]) / (len(edges) - 1)
    x = F.col(quoted(column)).cast("double")
    spot = F.least(F.floor((x - F.lit(edges[0])) / F.lit(width)), F.lit(len(edges) - 2))
    rows = df.where((x >= edges[0]) & (x <= edges[-1])).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.lit(edges[0]) + F.col("bin") * F.lit(width)).alias("edge"), "n")
