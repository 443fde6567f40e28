"""Splits of a log by time, at random and into folds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_non_null
from ..functions.keyed import spread_join
from ..functions.ordering import global_rank, scan_within, with_total
from ..schema import LogSchema
from .prepare import filter_cases


class Parts(NamedTuple):
    train: DataFrame
    test: DataFrame


def _starts(log: DataFrame, schema: LogSchema) -> DataFrame:
    return log.where(F.col(schema.case).isNotNull()).groupBy(schema.case).agg(F.min(schema.ts).alias("_start"))


def temporal_split(log: DataFrame, schema: LogSchema, ratio: float = 0.8) -> Parts:
    """Earliest cases train, the rest test; train events from the first test time on are dropped.

    A train case keeps only events before the first test start, and every event before it
    belongs to a train case. So train is a plain time filter, and only events from that
    time on are matched with cases.
    """
    order = [F.col("_start").asc_nulls_last(), F.col(schema.case)]
    ranked, total = with_total(_starts(log, schema), order)
    test_cases = ranked.where(F.col("rank") > int(ratio * total))
    split = test_cases.agg(F.min("_start")).first()[0]
    if split is None:
        return Parts(log.limit(0), filter_cases(log, schema, test_cases))
    train = log.where((F.col(schema.ts) < F.lit(split)) & F.col(schema.case).isNotNull())
    later = log.where(~(F.col(schema.ts) < F.lit(split)) | F.col(schema.ts).isNull())
    return Parts(train, filter_cases(later, schema, test_cases))


def val_split_temporal(log: DataFrame, schema: LogSchema, ratio: float) -> Parts:
    """The latest cases validate; none if the share rounds down to zero."""
    order = [F.col("_start").asc_nulls_last(), F.col(schema.case)]
    ranked, total = with_total(_starts(log, schema), order)
    return _validate(log, schema, ranked, total, ratio)


def shuffle_key(schema: LogSchema, seed: int, *more: str) -> Column:
    """Order that is random over cases but the same in every run."""
    return F.md5(F.concat_ws("_", schema.case, *more, F.lit(str(seed))))


def val_split_random(log: DataFrame, schema: LogSchema, ratio: float, seed: int = 22) -> Parts:
    """The last cases of a seeded permutation validate."""
    cases = _starts(log, schema)
    ranked, total = with_total(cases, [shuffle_key(schema, seed), F.col(schema.case)])
    return _validate(log, schema, ranked, total, ratio)


def _validate(log: DataFrame, schema: LogSchema, ranked: DataFrame, total: int, ratio: float) -> Parts:
    flags = ranked.select(schema.case, (F.col("rank") > total - int(ratio * total)).alias("_val"))
    marked = spread_join(log.where(F.col(schema.case).isNotNull()), flags, schema.case)
    return Parts(marked.where(~F.col("_val")).drop("_val"), marked.where("_val").drop("_val"))


def fold_numbers(log: DataFrame, schema: LogSchema, folds: int = 5, seed: int = 22) -> DataFrame:
    """(case, fold): cases dealt in turn, class by class, in seeded order.

    Sizes of folds and of each class inside the folds differ by one at most.
    """
    cases = log.where(F.col(schema.case).isNotNull()).groupBy(schema.case).agg(
        first_non_null(schema.label, schema.order).alias("_label")
    )
    ranked = global_rank(cases, [F.col("_label"), shuffle_key(schema, seed), F.col(schema.case)])
    return ranked.select(schema.case, F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def stratified_folds(log: DataFrame, schema: LogSchema, folds: int = 5, seed: int = 22) -> DataFrame:
    """The log with its fold number; fold k tests on ``fold = k`` and trains on the others."""
    return spread_join(log, fold_numbers(log, schema, folds, seed), schema.case)


def class_ratio(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Share of positive events among events with a label."""
    return log.agg(F.avg((F.col(schema.label) == schema.positive).cast("int")).alias("class_ratio"))


def label_share(df: DataFrame, column: str, label) -> DataFrame:
    """Share of rows with a given label."""
    hit = F.when(F.col(column) == F.lit(label), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("label_share"))


def explain_gate(encoded: DataFrame, bucket: str = "bucket", label: str = "encoded_label", share: float = 0.1) -> DataFrame:
    """Per bucket: whether one of the classes is frequent enough to explain the model."""
    ones = F.avg((F.col(label) == 1).cast("int"))
    zeros = F.avg((F.col(label) == 0).cast("int"))
    return encoded.groupBy(bucket).agg(
        F.count("*").alias("n_rows"), ones.alias("share_positive"), ((ones > share) | (zeros > share)).alias("explain")
    )


def every_nth_case(cases: DataFrame, case: str, bucket: str = "bucket", positional: bool = False, small_log: bool = False) -> DataFrame:
    """Cases numbered from 100 per bucket in id order, with the local-explanation flags.

    ``explain``: the case is explained; ``explain_more``: also its attribution path;
    ``stable``: its explanation is repeated to measure stability.
    """
    numbered = scan_within(cases.select(case, bucket).distinct(), [bucket], [case], rank="_rank")
    n = F.col("_rank") + 99
    steps = [5**j for j in (1, 2, 3)] if positional else [10 ** (j + 1) for j in (1, 2, 3)]
    first, second = (steps[0], steps[1]) if small_log else (steps[1], steps[2])
    if positional:
        every, repeat = 5, 25 if small_log else 250
    else:
        every, repeat = 20, 1000 if small_log else 10000
    qualified = (n % first == 0) & (n % every == 0)
    return numbered.select(
        case, bucket, n.alias("case_nr"), qualified.alias("explain"),
        ((n % first == 0) & (n % second == 0)).alias("explain_more"),
        (qualified & (n % repeat == 0)).alias("stable"),
    ).where((F.col("case_nr") % first) == 0)


def first_n_cases(log: DataFrame, schema: LogSchema, n: int) -> DataFrame:
    """Events of the first ``n`` cases in id order."""
    cases = log.select(schema.case).where(F.col(schema.case).isNotNull()).distinct().orderBy(schema.case).limit(n)
    return filter_cases(log, schema, cases)
