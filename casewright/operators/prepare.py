"""Labels, views, codes and selections of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_non_null, quoted, spot_of, to_long
from ..functions.keyed import hot_keys, spread_join
from ..functions.ordering import scan_within
from ..schema import LogSchema
from ..session import stage


def encode_label(log: DataFrame, schema: LogSchema, out: str = "encoded_label") -> DataFrame:
    """1 for the positive label, otherwise 0 (also for a null label)."""
    return log.withColumn(out, F.when(F.col(schema.label) == schema.positive, 1).otherwise(0))


def case_label(log: DataFrame, schema: LogSchema, out: str = "encoded_label") -> DataFrame:
    """0/1 per case from its first label that is not null."""
    first = log.groupBy(schema.case).agg(first_non_null(schema.label, schema.order).alias("_label"))
    return first.select(schema.case, F.when(F.col("_label") == schema.positive, 1).otherwise(0).alias(out))


def static_view(log: DataFrame, schema: LogSchema) -> DataFrame:
    """One row per case: first non-null static values and the 0/1 label."""
    columns = [*schema.static_num, *schema.static_cat]
    firsts = [first_non_null(c, schema.order).alias(c) for c in [*columns, schema.label]]
    view = log.groupBy(schema.case).agg(*firsts)
    label = F.when(F.col(schema.label) == schema.positive, 1).otherwise(0).alias("encoded_label")
    return view.select(*columns, schema.case, label)


def dynamic_view(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Event-level dynamic columns with case, time and 0/1 label."""
    return encode_label(log, schema).select(
        *schema.dynamic_num, *schema.dynamic_cat, schema.case, schema.ts, "encoded_label"
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value; one pass, two values per column."""
    columns = list(columns or df.columns)
    bounds = []
    for i, c in enumerate(columns):
        bounds += [F.min(quoted(c)).alias(f"lo{i}"), F.max(quoted(c)).alias(f"hi{i}")]
    row = df.agg(*bounds).first()
    return [c for i, c in enumerate(columns) if row[f"lo{i}"] == row[f"hi{i}"]]


def drop_constant(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that carry no information."""
    return df.drop(*[c for c in constant_columns(df, columns) if c not in keep])


#: Levels and their characters up to which the code tables are sent to all tasks.
CODES, CODE_CHARS = 1_000_000, 64 << 20


def ordinal_codes(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Each column as 0..k-1 in level order, null as -1.

    Levels are ranked as a table, so their number is not limited. While all code tables together are
    small, the log is not shuffled at all; beyond that its cells meet the levels in one salted join for
    all columns and are put back by row.
    """
    levels = to_long(df, [], columns, "string").where(F.col("value").isNotNull()).distinct()
    codes = scan_within(levels, ["feature"], ["value"], rank="_rank").withColumn("_code", F.col("_rank") - 1).drop("_rank")
    n, chars = codes.agg(F.count("*"), F.coalesce(F.sum(F.char_length("value")), F.lit(0))).first()
    if n > CODES or chars > CODE_CHARS:
        return _joined_codes(df, columns, codes, suffix)
    coded = df
    for c in columns:
        of_column = codes.where(F.col("feature") == c).select(F.col("value").alias("_level"), F.col("_code").alias(f"{c}{suffix}"))
        coded = coded.withColumn("_level", F.col(quoted(c)).cast("string")).join(F.broadcast(of_column), "_level", "left").drop("_level")
        coded = coded.withColumn(f"{c}{suffix}", F.coalesce(F.col(quoted(f"{c}{suffix}")), F.lit(-1)))
    return coded


def _joined_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, suffix: str) -> DataFrame:
    """Codes by one join of all cells; a level that fills a large share of them is salted."""
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    key = F.concat_ws("\x00", "feature", "value")
    cells = to_long(rows, ["_row"], columns, "string").where(F.col("value").isNotNull()).select("_row", "feature", key.alias("_cell"))
    found = spread_join(cells, codes.select(key.alias("_cell"), "_code"), "_cell")
    by_row = found.groupBy("_row").agg(*[F.max(F.when(F.col("feature") == c, F.col("_code"))).alias(f"{c}{suffix}") for c in columns])
    return rows.join(by_row, "_row", "left").drop("_row").fillna(-1, subset=[f"{c}{suffix}" for c in columns])


def filter_cases(log: DataFrame, schema: LogSchema, cases: DataFrame, keep: bool = True) -> DataFrame:
    """Events of the given cases (or of all others)."""
    hot = hot_keys(log, schema.case)
    wanted = cases.select(schema.case).distinct()
    return spread_join(log, wanted, schema.case, "left_semi" if keep else "left_anti", hot)


def case_index(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Distinct case ids."""
    return log.select(schema.case).where(F.col(schema.case).isNotNull()).distinct()


def original_case_ids(ids: DataFrame, column: str, nr_events: int = 1, out: str = "original_case_id") -> DataFrame:
    """Case ids of prefixes without the ``_<n>`` suffix; unchanged for ``nr_events`` 1."""
    plain = F.regexp_replace(column, "_[^_]*$", "") if nr_events > 1 else F.col(column)
    return ids.withColumn(out, plain)


def prefix_lengths(prefixes: DataFrame, schema: LogSchema, case: str = "prefix_id") -> DataFrame:
    """Last non-null prefix number per prefix."""
    spot = F.when(F.col("prefix_nr").isNotNull(), spot_of(schema.order))
    return prefixes.groupBy(case).agg(F.max_by("prefix_nr", spot).alias("prefix_nr"))


def select_encoded_sets(
    catalogue: DataFrame, min_size: int | None = 500, wide_gap: int = 5, dense_logs: Sequence[str] = ("traffic_fines",)
) -> DataFrame:
    """Catalogue rows at every ``gap``-th prefix length, up to the number of rows of their set.

    The gap is 1 for the single-bucket aggregate method and for ``dense_logs``.
    """
    dense = (F.col("method") == "single_agg") | F.col("dataset").isin(list(dense_logs))
    gap = F.when(dense, 1).otherwise(wide_gap)
    sizes = catalogue.groupBy("dataset", "method").agg(F.count("*").alias("_sets"))
    chosen = catalogue.join(sizes, ["dataset", "method"]).where(
        (F.pmod(F.col("prefix_length") - 1, gap) == 0)
        & (F.col("prefix_length") >= 1) & (F.col("prefix_length") <= F.col("_sets"))
    )
    if min_size is not None:
        chosen = chosen.where(F.col("bucket_size") > min_size)
    return chosen.drop("_sets")


def split_catalogue(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, other) rows of the catalogue, without the type column."""
    training = F.col("dataset_type").contains("training")
    return catalogue.where(training).drop("dataset_type"), catalogue.where(~training).drop("dataset_type")
