"""Association measures: Pearson, Cramer's V, mutual information and lists built on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import digamma, pearson, quoted, to_long
from ..functions.ordering import scan_within
from ..session import stage

#: Rows that a task sorts in neighbour searches, whatever the session's shuffle partitions.
SCAN_ROWS = 1 << 19


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) for all ordered pairs, pairwise complete; null for constants.

    The sums of all pairs are matrix products of a task's rows with nulls as zero and a mask, so
    one pass over the data serves any number of columns, with or without nulls.
    """
    return _mirror(_moments(df, list(columns)), "r")


def _mirror(half: DataFrame, value: str) -> DataFrame:
    """Both orders of each pair from one."""
    a, b = F.col("feature_a"), F.col("feature_b")
    there = F.struct(a.alias("feature_a"), b.alias("feature_b"))
    back = F.struct(b.alias("feature_a"), a.alias("feature_b"))
    sides = F.when(a == b, F.array(there)).otherwise(F.array(there, back))
    return half.select(F.explode(sides).alias("_p"), value).select("_p.feature_a", "_p.feature_b", value)


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, r) for each pair in column order, from sums over rows where both are present."""
    chosen = df.select(*[F.col(quoted(c)).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    # Values are shifted by their means, which keeps the differences of sums exact enough.
    means = [x or 0.0 for x in chosen.agg(*[F.avg(c) for c in chosen.columns]).first()]
    first, second = np.triu_indices(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(means)
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - means
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        n, s, q, p = total
        yield pa.record_batch([pa.array(c) for c in (
            first, second, n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], p[first, second]
        )], names=["i", "j", "n", "sa", "sb", "qa", "qb", "p"])

    parts = chosen.mapInArrow(run, "i long, j long, n double, sa double, sb double, qa double, qb double, p double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    names = F.array(*[F.lit(c) for c in columns])
    a, b = (F.col(f"q{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab")
    r = (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(a * b)
    # What rounding leaves of a constant's variance is no variance.
    flat = (F.col("n") == 0) | (a <= 1e-12 * F.col("qa")) | (b <= 1e-12 * F.col("qb"))
    return sums.select(
        F.element_at(names, (F.col("i") + 1).cast("int")).alias("feature_a"), F.element_at(names, (F.col("j") + 1).cast("int")).alias("feature_b"),
        F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )


def pearson_with_label(df: DataFrame, columns: Sequence[str], label: str = "encoded_label") -> DataFrame:
    """(feature, r) of each numeric column with the label."""
    columns = list(columns)
    target = F.col(label).cast("double")
    row = df.agg(*[pearson(F.col(quoted(c)).cast("double"), target).alias(f"r{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def encoded_correlations(
    encoded: DataFrame, features: Sequence[str], categorical: Sequence[str], label: str = "encoded_label"
) -> DataFrame:
    """(kind, feature_a, feature_b, r) rounded to 3, for numeric and categorical features apart.

    Each part includes the label. Constant columns, whose correlations are all null, are left out.
    """
    # One matrix serves both kinds; the label is in both.
    hidden = [f for f in features if f in set(categorical)]
    shown = [f for f in features if f not in set(categorical)]
    matrix = pearson_matrix(encoded, [*features, label]).where(F.col("r").isNotNull())
    sides = F.array_compact(F.array(*[
        F.when(F.col("feature_a").isin([*kept, label]) & F.col("feature_b").isin([*kept, label]), F.lit(kind))
        for kind, kept in (("num", shown), ("cat", hidden)) if kept
    ]))
    return matrix.select(F.explode(sides).alias("kind"), "feature_a", "feature_b", F.round("r", 3).alias("r"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for pairs without nulls."""
    rows = df.where(F.col(quoted(a)).isNotNull() & F.col(quoted(b)).isNotNull())
    return rows.groupBy(quoted(a), quoted(b)).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(feature_a, feature_b, v): bias-corrected Cramer's V, rounded to 3.

    Cells are counted for all pairs in one pass, each task adding up its own first. Empty cells need no rows: their share of
    chi-square follows from the marginals; in a 2 x 2 table Yates' correction applies, where
    all four deviations are equal.
    """
    entries = [
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
            F.col(quoted(a)).cast("string").alias("x"), F.col(quoted(b)).cast("string").alias("y"),
        )
        for a, b in pairs
    ]
    pair = ["feature_a", "feature_b"]
    cells = (
        df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(*pair, "x", "y").agg(F.count("*").alias("o"))
    )
    rows = cells.groupBy(*pair, "x").agg(F.sum("o").alias("nx"))
    cols = cells.groupBy(*pair, "y").agg(F.sum("o").alias("ny"))
    sides = rows.groupBy(*pair).agg(F.sum("nx").alias("n"), F.count("*").alias("r"), F.sum(1 / F.col("nx")).alias("inv_x"))
    tops = cols.groupBy(*pair).agg(F.count("*").alias("k"), F.sum(1 / F.col("ny")).alias("inv_y"))
    joined = cells.join(rows, [*pair, "x"]).join(cols, [*pair, "y"])
    # One row per pair of columns.
    with_n = joined.join(F.broadcast(sides.select(*pair, "n")), pair)
    terms = with_n.groupBy(*pair).agg(
        F.sum(F.col("o") * F.col("o") / (F.col("nx") * F.col("ny"))).alias("_sq"),
        F.max(F.abs(F.col("o") - F.col("nx") * F.col("ny") / F.col("n"))).alias("_dev"),
    )
    table = terms.join(F.broadcast(sides), pair).join(F.broadcast(tops), pair)
    n, r, k = F.col("n").cast("double"), F.col("r"), F.col("k")
    plain = n * (F.col("_sq") - 1)
    shrunk = F.col("_dev") - F.least(F.lit(0.5), F.col("_dev"))
    yates = shrunk * shrunk * n * F.col("inv_x") * F.col("inv_y")
    phi2 = F.when((r == 2) & (k == 2), yates).otherwise(plain) / n
    one = n - 1
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((k - 1) * (r - 1), one))
    rc = r - F.try_divide((r - 1) * (r - 1), one)
    kc = k - F.try_divide((k - 1) * (k - 1), one)
    v = F.sqrt(F.try_divide(phi2c, F.least(kc - 1, rc - 1)))
    return table.select(*pair, F.round(v, 3).alias("v"))


def cramers_v_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs, a column with itself included; each pair is computed once."""
    columns = list(columns)
    half = cramers_v(df, [(a, b) for i, a in enumerate(columns) for b in columns[i:]])
    return _mirror(half, "v")


def cramers_v_with_label(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, v) of each categorical column with the label."""
    scored = cramers_v(df, [(c, label) for c in columns if c != label])
    return scored.select(F.col("feature_a").alias("feature"), "v")


def correlated_with_others(matrix: DataFrame, least: float = 0.8, label: str = "encoded_label") -> DataFrame:
    """(feature, others): partners with absolute correlation of at least ``least``, sorted."""
    near = matrix.where(
        (F.abs("r") >= least) & (F.col("feature_a") != F.col("feature_b")) & (F.col("feature_b") != label)
    )
    return near.groupBy(F.col("feature_a").alias("feature")).agg(F.array_sort(F.collect_list("feature_b")).alias("others"))


def correlated_with_target(matrix: DataFrame, least: float = 0.2, label: str = "encoded_label") -> DataFrame:
    """(feature, r) with absolute label correlation of at least ``least``."""
    near = matrix.where((F.col("feature_b") == label) & (F.abs("r") >= least) & (F.col("feature_a") != label))
    return near.select(F.col("feature_a").alias("feature"), "r")


def interaction_columns(matrix: DataFrame, least: float = 0.2, label: str = "encoded_label") -> DataFrame:
    """Features with label correlation >= ``least`` or <= -``least``, of both kinds of features."""
    return correlated_with_target(matrix, least, label).select("feature").distinct()


def correlation_counts(matrix: DataFrame, least: float = 0.8, label: str = "encoded_label") -> DataFrame:
    """(feature, n_partners, partners): (other, r) pairs above ``least``; features without any stay."""
    partner = F.when(
        (F.abs("r") >= least) & (F.col("feature_a") != F.col("feature_b")) & (F.col("feature_b") != label),
        F.struct(F.col("feature_b").alias("other"), F.col("r")),
    )
    lists = matrix.groupBy(F.col("feature_a").alias("feature")).agg(F.array_sort(F.collect_list(partner)).alias("partners"))
    return lists.select("feature", F.size("partners").cast("long").alias("n_partners"), "partners")


def mutual_info_discrete(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, mi): mutual information in nats of discrete columns with the label; null is a level."""
    long = to_long(df, [label], features, "string")
    cells = long.groupBy("feature", "value", label).agg(F.count("*").alias("o"))
    rows = cells.groupBy("feature", F.col("value").alias("_v")).agg(F.sum("o").alias("nx"))
    cols = cells.groupBy(F.col("feature").alias("_f"), F.col(label).alias("_l")).agg(F.sum("o").alias("ny"))
    totals = cols.groupBy(F.col("_f").alias("_t")).agg(F.sum("ny").alias("n"))
    joined = (
        cells.join(rows.withColumnRenamed("feature", "_g"), (F.col("feature") == F.col("_g")) & F.col("value").eqNullSafe(F.col("_v")))
        .join(cols, (F.col("feature") == F.col("_f")) & F.col(label).eqNullSafe(F.col("_l")))
        # One row per column.
        .join(F.broadcast(totals), F.col("feature") == F.col("_t"))
    )
    p = F.col("o") / F.col("n")
    return joined.groupBy("feature").agg(
        F.greatest(F.lit(0.0), F.sum(p * F.log(p / (F.col("nx") / F.col("n") * (F.col("ny") / F.col("n")))))).alias("mi")
    )


def neighbour_counts(long: DataFrame, row: str, label: str, k: int = 3, block: int = 10_000) -> DataFrame:
    """For (feature, value) rows in long form: radius to the k-th neighbour and points inside it.

    ``radius`` is the distance to the k-th nearest other row of the same feature and label
    (k shrinks to the class size minus one); ``inside`` counts rows of the feature, of any
    label and the row itself included, strictly closer than the radius, or at distance 0 when
    the radius is 0. Rows alone in their class are left out.

    In one dimension the neighbours lie within k sorted places. Places come from
    ``scan_within``; windows then run over runs of ``block`` places, with the k rows at each
    end of a run copied to the next one, so no task holds a whole feature.
    """
    clean = long.where(F.col("value").isNotNull())
    placed = scan_within(clean, ["feature", label], ["value", row], rank="_place")
    run, spot = F.floor((F.col("_place") - 1) / block), F.pmod(F.col("_place") - 1, F.lit(block))
    targets = F.array(
        run, F.when(spot < k, run - 1), F.when(spot >= block - k, run + 1)
    )
    copied = placed.withColumn("_home", run).withColumn("_run", F.explode(F.array_compact(targets)))
    w = Window.partitionBy("feature", label, "_run").orderBy("_place")
    value = F.col("value")
    gaps = [value - F.lag(value, i).over(w) for i in range(1, k + 1)]
    gaps += [F.lead(value, i).over(w) - value for i in range(1, k + 1)]
    near = F.array_sort(F.array_compact(F.array(*gaps)))
    reach = copied.withColumn("_near", near).where((F.col("_run") == F.col("_home")) & (F.size("_near") > 0))
    kk = F.least(F.lit(k), F.size("_near"))
    probes = reach.select("feature", label, row, "value", kk.alias("k"), F.element_at("_near", kk).alias("radius"))
    d = F.col("radius")
    # Order at equal values: a point comes after the upper probe and before the lower probe,
    # so both ends are strict; with radius 0 the probes change sides and copies count.
    low = F.struct((value - d).alias("at"), F.when(d > 0, 2).otherwise(0).alias("turn"), F.lit(-1).alias("end"))
    high = F.struct((value + d).alias("at"), F.when(d > 0, 0).otherwise(2).alias("turn"), F.lit(1).alias("end"))
    ends = probes.select("feature", label, row, F.explode(F.array(low, high)).alias("e")).select(
        "feature", label, row, "e.at", "e.turn", "e.end"
    )
    points = probes.select("feature", label, row, value.alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("end"))
    merged = points.unionByName(ends).withColumn("_point", (F.col("end") == 0).cast("int"))
    counted = scan_within(merged, ["feature"], ["at", "turn", row, "end"], sums={"_upto": "_point"})
    inside = counted.where(F.col("end") != 0).groupBy("feature", row).agg(F.sum(F.col("_upto") * F.col("end")).alias("inside"))
    return probes.join(inside, ["feature", row])


def value_neighbours(counts: DataFrame, label: str, k: int = 3, block: int = 10_000, tasks: int | None = None) -> DataFrame:
    """(feature, label, value, n, k, radius, inside): ``neighbour_counts`` of all points with the same feature, label and value.

    ``counts`` has the number ``n`` of points of each (feature, label, value), values without nulls. Such points differ
    in nothing, so rows are sorted and scanned per value, however many points there are, by ``tasks`` tasks (as many as
    the session has shuffle partitions if not given).
    """
    sizes = counts.groupBy(F.col("feature").alias("_f"), F.col(label).alias("_l")).agg(F.sum("n").alias("_size"))
    # One row per feature and class.
    sized = counts.join(F.broadcast(sizes), (F.col("feature") == F.col("_f")) & F.col(label).eqNullSafe(F.col("_l"))).drop("_f", "_l")
    placed = scan_within(sized.where(F.col("_size") > 1), ["feature", label], ["value"], rank="_place", tasks=tasks)
    run, spot = F.floor((F.col("_place") - 1) / block), F.pmod(F.col("_place") - 1, F.lit(block))
    targets = F.array(run, F.when(spot < k, run - 1), F.when(spot >= block - k, run + 1))
    copied = placed.withColumn("_home", run).withColumn("_run", F.explode(F.array_compact(targets)))
    if tasks:
        copied = copied.repartition(tasks, "feature", label, "_run")
    w = Window.partitionBy("feature", label, "_run").orderBy("_place")
    value, n = F.col("value"), F.col("n")

    def some(gap, many):
        return F.when(many > 0, F.struct(gap.alias("gap"), many.alias("many")))

    # The copies of the point itself, and the k next values on either side.
    near = [some(value - value, n - 1)]
    near += [some(value - F.lag(value, i).over(w), F.lag(n, i).over(w)) for i in range(1, k + 1)]
    near += [some(F.lead(value, i).over(w) - value, F.lead(n, i).over(w)) for i in range(1, k + 1)]
    kk = F.least(F.lit(k), F.col("_size") - 1)
    reach = copied.withColumn("_near", F.array_sort(F.array_compact(F.array(*near)))).where(F.col("_run") == F.col("_home"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("radius"))
    found = F.aggregate("_near", start, lambda a, g: F.struct(
        (a["upto"] + g["many"]).alias("upto"), F.when(a["upto"] < kk, g["gap"]).otherwise(a["radius"]).alias("radius")
    ))
    probes = reach.select("feature", label, "value", "n", kk.cast("int").alias("k"), found["radius"].alias("radius"))
    # The order at equal places is that of ``neighbour_counts``.
    d = F.col("radius")
    low = F.struct((value - d).alias("at"), F.when(d > 0, 2).otherwise(0).alias("turn"), F.lit(-1).alias("end"), F.lit(0).cast("long").alias("points"))
    high = F.struct((value + d).alias("at"), F.when(d > 0, 0).otherwise(2).alias("turn"), F.lit(1).alias("end"), F.lit(0).cast("long").alias("points"))
    point = F.struct(value.alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("end"), n.alias("points"))
    merged = probes.select("*", F.explode(F.array(low, high, point)).alias("e")).select(*probes.columns, "e.*")
    counted = scan_within(merged, ["feature"], ["at", "turn", label, "value", "end"], sums={"_upto": "points"}, tasks=tasks)
    ends = counted.where(F.col("end") != 0)
    return (ends.repartition(tasks, "feature", label, "value") if tasks else ends).groupBy("feature", label, "value").agg(
        F.max("n").alias("n"), F.max("k").alias("k"), F.max("radius").alias("radius"), F.sum(F.col("_upto") * F.col("end")).alias("inside")
    )


def mutual_info_continuous(df: DataFrame, row: str, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mi): nearest-neighbour mutual information of continuous columns with a discrete label.

    The estimator of Ross (2014). No noise is added, so equal values count as neighbours at distance 0. Points are
    counted by value first; those whose ``row`` is null count for others alone, and those that share one add up.
    """
    spot = ["feature", label, "value"]

    def points(rows: DataFrame) -> DataFrame:
        return to_long(rows, [row, label], features).where(F.col("value").isNotNull())

    # Three rows a point are scanned at most.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * len(features) * df.count() // SCAN_ROWS))
    counts = stage(points(df).repartition(tasks, *spot).groupBy(*spot).agg(F.count("*").alias("n")), "counts")
    values = value_neighbours(counts, label, k, tasks=tasks)
    terms = values.select(*spot, "n", "k", "inside")
    repeated = stage(df.groupBy(F.col(row).alias("_row")).agg(F.count("*").alias("_rows")).where("_rows > 1 OR _row IS NULL"), "repeated")
    if not repeated.isEmpty():
        values = stage(values, "values")
        odd = points(df.join(repeated, F.col(row).eqNullSafe(F.col("_row")), "left_semi"))
        same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("feature") == F.col("_f")) & (F.col("value") == F.col("_v"))
        known = values.select(F.col("feature").alias("_f"), F.col(label).alias("_l"), F.col("value").alias("_v"), "k", "inside")
        met = odd.where(F.col(row).isNotNull()).join(known, same).groupBy("feature", row).agg(
            F.collect_list(F.struct(label, "value", "k")).alias("_met"), F.sum("inside").alias("inside")
        )
        added = met.select("feature", "inside", F.explode("_met").alias("e")).select(
            "feature", f"e.{label}", "e.value", F.lit(1).cast("long").alias("n"), "e.k", "inside"
        )
        gone = odd.groupBy(*[F.col(c).alias(o) for c, o in zip(spot, ("_f", "_l", "_v"))]).agg(F.count("*").alias("_gone"))
        left = values.join(gone, same, "left").select(*spot, (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n"), "k", "inside")
        terms = left.where(F.col("n") > 0).unionByName(added.select(*left.columns))
    n = F.col("n")
    terms = terms.where(F.col(label).isNotNull())
    # One row per feature and class.
    classes = terms.groupBy("feature", label).agg(
        F.sum(n).alias("_size"), *[F.sum(n * digamma(F.col(c).cast("double"))).alias(f"_{c}") for c in ("k", "inside")]
    )
    parts = classes.groupBy("feature").agg(
        F.sum("_size").alias("_n"), F.sum("_k").alias("_k"), F.sum("_inside").alias("_m"),
        F.sum(F.col("_size") * digamma(F.col("_size").cast("double"))).alias("_c"),
    )
    mi = digamma(F.col("_n").cast("double")) + (F.col("_k") - F.col("_c") - F.col("_m")) / F.col("_n")
    return parts.select("feature", F.greatest(F.lit(0.0), mi).alias("mi"))


def mutual_info_rank(scores: DataFrame, top: int = 21) -> DataFrame:
    """The features with the highest mutual information."""
    return scores.orderBy(F.col("mi").desc(), "feature").limit(top)
