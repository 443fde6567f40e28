"""Small column and frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY_LIMIT = 5000


def nulls_last(order: Sequence[str]) -> list[Column]:
    """Ascending sort columns with missing values at the end, such as events without a time."""
    return [F.col(c).asc_nulls_last() for c in order]


def spot_of(order: Sequence[str]) -> Column:
    """Place in ``order`` as a value to compare by, missing values last."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c).alias(f"_at{i}"))])


def first_non_null(column: str, order: Sequence[str]) -> Column:
    """Aggregate: the first value of ``column`` in ``order`` that is not null."""
    spot = spot_of(order)
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), spot))


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str], dtype: str = "double") -> DataFrame:
    """Unpivot to (ids, feature, value)."""
    typed = df.select(*ids, *[F.col(quoted(c)).cast(dtype).alias(c) for c in features])
    return typed.unpivot([F.col(c) for c in ids], [F.col(quoted(c)) for c in features], "feature", "value")


def quoted(name: str) -> str:
    """Column names such as ``case:LoanGoal`` or ``agg__mean_a.b`` need quoting."""
    return "`" + name.replace("`", "``") + "`"


def vocabulary(
    df: DataFrame, columns: Sequence[str], by: str | None = None, limit: int = VOCABULARY_LIMIT
) -> dict[str, dict[str, set]]:
    """Levels per column, and for each level the groups (``by``) it was seen in.

    The only data-sized result that reaches the driver; more than ``limit`` levels raise.
    """
    if not columns:
        return {}
    ids = [by] if by else []
    long = to_long(df, ids, columns, "string").where(F.col("value").isNotNull())
    if by:
        levels = long.groupBy("feature", "value").agg(F.collect_set(by).alias("seen"))
    else:
        levels = long.distinct().withColumn("seen", F.array())
    rows = levels.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels in {list(columns)}; use the long form")
    found: dict[str, dict[str, set]] = {c: {} for c in columns}
    for r in sorted(rows, key=lambda r: (r["feature"], r["value"])):
        found[r["feature"]][r["value"]] = set(r["seen"])
    return found


def digamma(x: Column) -> Column:
    """Digamma for x >= 1: shift by six, then the asymptotic series."""
    shift = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    y = x + 6.0
    z = 1.0 / (y * y)
    series = z * (1.0 / 12 - z * (1.0 / 120 - z * (1.0 / 252 - z * (1.0 / 240 - z / 132))))
    return F.log(y) - 0.5 / y - series - shift


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson over rows where both are present; null if either is constant."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)
