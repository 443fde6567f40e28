"""Statistics and profiles of raw and encoded logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_non_null, nulls_last, quoted, to_long
from ..functions.keyed import spread_join
from ..functions.ordering import block_quantiles, scan_within, value_blocks
from ..schema import LogSchema
from .prefix import case_heads, max_prefix_rule


def trace_variants(log: DataFrame, schema: LogSchema, max_length: int) -> DataFrame:
    """(variant, n_cases): activity sequences cut to ``max_length`` and joined by ``__``."""
    act = F.coalesce(F.col(schema.activity).cast("string"), F.lit("nan")).alias("act")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", act))), lambda s: s["act"])
    traces = case_heads(log, schema, max_length).groupBy(schema.case).agg(F.array_join(steps, "__").alias("variant"))
    return traces.groupBy("variant").agg(F.count("*").alias("n_cases"))


def case_class_frequencies(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Cases per label, by the first label of a case that is not null."""
    labels = log.groupBy(schema.case).agg(first_non_null(schema.label, schema.order).alias(schema.label))
    return labels.where(F.col(schema.label).isNotNull()).groupBy(schema.label).agg(F.count("*").alias("n_cases"))


def column_cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_values): distinct values per column, null counts as one.

    Values are counted before they are shuffled, so a frequent value costs one row per task.
    """
    values = to_long(df, [], columns, "string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return values.groupBy("feature").agg(F.count("*").alias("n_values"))


def categorical_levels(log: DataFrame, schema: LogSchema) -> DataFrame:
    """(kind, n_levels): summed level counts of static and dynamic categorical columns.

    A column with both roles counts for both.
    """
    roles = [("static", c) for c in schema.static_cat] + [("dynamic", c) for c in schema.dynamic_cat]
    named = log.sparkSession.createDataFrame(roles, "kind string, feature string")
    counts = column_cardinality(log, sorted({c for _, c in roles}))
    return counts.join(F.broadcast(named), "feature").groupBy("kind").agg(F.sum("n_values").alias("n_levels"))


def log_statistics(log: DataFrame, schema: LogSchema, max_length: int | None = None) -> DataFrame:
    """One summary row of thirteen columns; the average trace length is the median."""
    longest = max_prefix_rule(log, schema) if max_length is None else max_length
    cases = log.groupBy(schema.case).agg(F.count("*").alias("length"), first_non_null(schema.label, schema.order).alias("_label"))
    # Lengths have few distinct values: their number grows with the square root of the log at most.
    lengths = cases.groupBy("length").agg(
        F.count("*").alias("_n"), F.count_if(F.col("_label") == schema.positive).alias("_pos")
    ).agg(
        F.sum("_n").alias("traces"), F.min("length").alias("shortest_trace"), F.max("length").alias("longest_trace"),
        F.percentile("length", F.lit(0.5), F.col("_n")).alias("average_trace_length"), F.sum("_pos").alias("_pos"),
    )
    variants = trace_variants(log, schema, longest).agg(F.count("*")).scalar()
    counts = column_cardinality(log, sorted({schema.activity, *schema.categorical}))

    def total(columns: Sequence[str]):
        hit = F.col("feature").isin(list(columns))
        return F.coalesce(F.sum(F.when(hit, F.col("n_values"))), F.lit(0))

    levels = counts.agg(F.struct(
        total([schema.activity]).alias("activity"), total(schema.static_cat).alias("static"), total(schema.dynamic_cat).alias("dynamic")
    )).scalar()
    return lengths.withColumn("_levels", levels).select(
        F.lit(schema.name).alias("dataset"), "traces", "shortest_trace", "average_trace_length", "longest_trace",
        F.lit(longest).alias("max_prefix_length"), variants.alias("trace_variants"),
        F.round(F.col("_pos") / F.col("traces"), 5).alias("positive_share"),
        F.col("_levels.activity").alias("event_classes"),
        F.lit(len(schema.static_cat) + len(schema.static_num)).alias("static_columns"),
        F.lit(len(schema.dynamic_cat) + len(schema.dynamic_num)).alias("dynamic_columns"),
        F.col("_levels.static").alias("static_cat_levels"), F.col("_levels.dynamic").alias("dynamic_cat_levels"),
    )


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: counts, moments, exact quartiles, zeros."""
    long = to_long(df, [], columns)
    value = F.col("value")
    base = long.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_if(value.isNull()).alias("n_missing"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count_if(value == 0).alias("n_zero"),
    )
    blocks = value_blocks(long, ["feature"], "value")
    distinct = blocks.groupBy("feature").agg(F.count("*").alias("n_distinct"))
    quartiles = block_quantiles(blocks, ["feature"], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    # One row per column on each side.
    return (
        base.join(F.broadcast(distinct), "feature", "left").join(F.broadcast(quartiles), "feature", "left")
        .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    )


def profile_categorical(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(feature, rank, value, n, n_rows, n_missing, n_distinct): the most frequent values per column."""
    values = to_long(df, [], columns, "string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = values.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    ranked = scan_within(
        values.where(F.col("value").isNotNull()), ["feature"], [F.col("n").desc(), F.col("value")], rank="rank"
    )
    return ranked.where(F.col("rank") <= top).join(F.broadcast(totals), "feature")


def profile_histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, bin, lower, n): equal-width counts per numeric column."""
    long = to_long(df, [], columns).where(F.col("value").isNotNull())
    bounds = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.floor(F.try_divide(F.col("value") - F.col("_lo"), width))
    # One row per column.
    placed = long.join(F.broadcast(bounds), "feature").select(
        "feature", "_lo", width.alias("_w"), F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).alias("bin")
    )
    counts = placed.groupBy("feature", "bin").agg(F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.count("*").alias("n"))
    return counts.select("feature", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), "n")


def encoded_level_counts(encoded: DataFrame, features: Sequence[str], categorical: Sequence[str], most: int = 20) -> DataFrame:
    """Per encoded column: distinct values, and the counts of categorical ones with few of them.

    ``note`` says why counts are absent: a numeric column, or too many levels.
    """
    long = to_long(encoded, [], features)
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    width = values.groupBy("feature").agg(F.count("*").alias("n_values"))
    is_cat = F.col("feature").isin(list(categorical))
    # Only columns with few values are collected, at most ``most`` entries each.
    few = width.where(is_cat & (F.col("n_values") <= most)).select("feature")
    maps = (
        # A row per column at most.
        values.where(F.col("value").isNotNull()).join(F.broadcast(few), "feature", "left_semi").groupBy("feature")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("value"), F.col("n")))).alias("_pairs"))
        .select("feature", F.map_from_entries("_pairs").alias("value_counts"))
    )
    note = F.when(~is_cat, "Numerical Variable").when(F.col("n_values") > most, "more than 20 cat levels")
    return width.join(maps, "feature", "left").select("feature", "n_values", "value_counts", note.alias("note"))


def value_counts_by_label(
    log: DataFrame, schema: LogSchema, features: Sequence[str], static: Sequence[str] = ()
) -> DataFrame:
    """(feature, value, label, n); static features count once per case."""
    event_level = [c for c in features if c not in static]
    parts = []
    if event_level:
        parts.append(to_long(log, [schema.label], event_level, "string"))
    case_level = [c for c in features if c in static]
    if case_level:
        firsts = log.groupBy(schema.case).agg(
            *[first_non_null(c, schema.order).alias(c) for c in [*case_level, schema.label]]
        )
        parts.append(to_long(firsts, [schema.label], case_level, "string"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.where(F.col("value").isNotNull() & F.col(schema.label).isNotNull())
    return rows.groupBy("feature", "value", schema.label).agg(F.count("*").alias("n"))


def strongly_related(cat_scores: DataFrame, num_scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Features worth a count chart: Cramer's V, or absolute correlation, of at least ``least``."""
    cat = cat_scores.where(F.col("v") >= least).select("feature")
    num = num_scores.where(F.abs("r") >= least).select("feature")
    return cat.unionByName(num).distinct()


def pair_scatter(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Binned counts for each column pair and label: the content of a scatter matrix."""
    columns = list(columns)
    bounds = df.agg(
        *[f(quoted(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    spots = []
    for i, c in enumerate(columns):
        low, high = F.lit(bounds[f"lo{i}"]).cast("double"), F.lit(bounds[f"hi{i}"]).cast("double")
        share = F.try_divide(F.col(quoted(c)) - low, high - low)
        spot = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
        spots.append(F.when(F.col(quoted(c)).isNotNull(), spot).alias(f"s{i}"))
    placed = df.select(label, *spots)
    pairs = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"s{i}").alias("bin_x"), F.col(f"s{j}").alias("bin_y"))
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    ]
    return (
        placed.select(label, F.explode(F.array(*pairs)).alias("p")).select(label, "p.*")
        .where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy("x", "y", "bin_x", "bin_y", label).agg(F.count("*").alias("n"))
    )


def derive_time_features(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Time columns of each event, in seconds; weekday 0 is Monday.

    ``open_cases`` counts the cases that have started and not ended before the event.
    Positions and gaps in a case come from ``scan_within``, so a case of any length works.
    """
    case, ts = schema.case, schema.ts
    unix = log.withColumn("_sec", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    placed = scan_within(unix, [case], nulls_last(schema.order), rank="event_nr", lags={"_before": "_sec"})
    spans = unix.groupBy(case).agg(F.min("_sec").alias("_start"), F.max("_sec").alias("_end"))
    steps = spans.select(F.col("_start").alias("_at"), F.lit(1).alias("_step")).unionByName(
        # A case counts as open up to and including its last event.
        spans.select(F.col("_end").alias("_at"), F.lit(-1).alias("_step"))
    )
    marks = steps.groupBy("_at").agg(
        F.sum(F.when(F.col("_step") > 0, 1).otherwise(0)).alias("_opened"),
        F.sum(F.when(F.col("_step") < 0, 1).otherwise(0)).alias("_closed"),
    )
    times = unix.groupBy(F.col("_sec").alias("_at")).agg(F.lit(0).alias("_opened"), F.lit(0).alias("_closed"))
    timeline = marks.unionByName(times).groupBy("_at").agg(F.sum("_opened").alias("_opened"), F.sum("_closed").alias("_closed"))
    running = scan_within(timeline, [], ["_at"], sums={"_in": "_opened", "_out": "_closed"})
    open_at = running.select(
        F.col("_at").alias("_sec"), (F.col("_in") - F.col("_out") + F.col("_closed")).alias("open_cases")
    )
    joined = spread_join(placed, spans.select(case, "_start"), case)
    joined = spread_join(joined, open_at, "_sec", "left")
    clock = F.col(ts).cast("timestamp")
    midnight = F.unix_micros(F.date_trunc("day", clock)) / 1e6
    return joined.select(
        *log.columns, F.col("event_nr"),
        F.coalesce(F.col("_sec") - F.col("_before"), F.lit(0.0)).alias("timesincelastevent"),
        (F.col("_sec") - F.col("_start")).alias("timesincecasestart"),
        (F.col("_sec") - midnight).alias("timesincemidnight"),
        F.month(clock).alias("month"), F.weekday(clock).alias("weekday"), F.hour(clock).alias("hour"), "open_cases",
    )
