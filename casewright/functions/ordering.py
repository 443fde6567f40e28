"""Ranks, running sums and lags without one task holding a whole group.

Rows are range-partitioned on (group, order), so a group of any size spreads over
several tasks. Each block is scanned on its own; what a block needs from earlier
blocks of the same group is at most one row per block and is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_BLOCK, _SPOT = "__block", "__spot"


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def sorted_blocks(df: DataFrame, order: Sequence[str | Column], tasks: int | None = None) -> DataFrame:
    """Range-partition and sort; adds block number and 0-based position in the block.

    The result is written out, because two readers must see the same blocks. There are as many as the session has
    shuffle partitions, or ``tasks``.
    """
    keys = _columns(order)
    spot = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    df = ranged.sortWithinPartitions(*keys).withColumn(_SPOT, spot)
    return stage(
        df.withColumn(_BLOCK, F.shiftright(_SPOT, 33)).withColumn(_SPOT, F.col(_SPOT).bitwiseAND((1 << 33) - 1)), "blocks"
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """1-based rank over all rows; ``order`` must be total."""
    return with_total(df, order, out)[0]


def with_total(df: DataFrame, order: Sequence[str | Column], out: str = "rank") -> tuple[DataFrame, int]:
    """``global_rank`` and the number of rows, which falls out of the block counts."""
    blocks = sorted_blocks(df, order)
    # One row per partition reaches the driver.
    sizes = sorted((r[_BLOCK], r["n"]) for r in blocks.groupBy(_BLOCK).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for block, n in sizes:
        starts.append((block, total))
        total += n
    base = df.sparkSession.createDataFrame(starts, f"{_BLOCK} long, __base long")
    ranked = (
        blocks.join(F.broadcast(base), _BLOCK)
        .withColumn(out, F.col("__base") + F.col(_SPOT) + 1)
        .drop(_BLOCK, _SPOT, "__base")
    )
    return ranked, total


def scan_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    rank: str | None = None,
    sums: Mapping[str, str] | None = None,
    lags: Mapping[str, str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Rank, inclusive running sums and one-row lags inside groups of any size.

    ``sums`` and ``lags`` map an output column to its input column. ``order`` must be
    total inside a group. ``tasks`` bounds what one task sorts where the session's shuffle partitions are too few.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    by = list(by)
    blocks = sorted_blocks(df, [*by, *order], tasks)
    inside = Window.partitionBy(_BLOCK, *by).orderBy(_SPOT)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggregates = [F.count("*").alias("__n")]
    aggregates += [F.sum(c).alias(f"__sum_{o}") for o, c in sums.items()]
    aggregates += [F.max_by(c, _SPOT).alias(f"__last_{o}") for o, c in lags.items()]
    parts = blocks.groupBy(_BLOCK, *by).agg(*aggregates)
    keys = by if by else [F.lit(0)]
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("__n").over(before).alias("__carry_n")]
    carried += [F.sum(f"__sum_{o}").over(before).alias(f"__carry_{o}") for o in sums]
    carried += [F.lag(f"__last_{o}").over(earlier).alias(f"__carry_{o}") for o in lags]
    # Only continued groups need a carry: fewer rows than there are partitions.
    named = [F.col(c).alias(f"__at_{i}") for i, c in enumerate(by)]
    carry = parts.select(F.col(_BLOCK).alias("__at"), *named, *carried).where(F.col("__carry_n").isNotNull())
    condition = F.col(_BLOCK) == F.col("__at")
    for i, c in enumerate(by):
        condition = condition & F.col(c).eqNullSafe(F.col(f"__at_{i}"))
    dealt = blocks.repartition(tasks, _BLOCK, *by) if tasks else blocks
    joined = dealt.join(F.broadcast(carry), condition, "left")
    added = []
    if rank:
        added.append((F.row_number().over(inside).cast("long") + F.coalesce("__carry_n", F.lit(0))).alias(rank))
    for o, c in sums.items():
        added.append((F.coalesce(F.sum(c).over(until), F.lit(0)) + F.coalesce(f"__carry_{o}", F.lit(0))).alias(o))
    for o, c in lags.items():
        first = F.row_number().over(inside) == 1
        added.append(F.when(first, F.col(f"__carry_{o}")).otherwise(F.lag(c).over(inside)).alias(o))
    return joined.select(*df.columns, *added)


def value_blocks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts ``_c`` of each non-null value ``_v`` per group, sorted into blocks and written out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return sorted_blocks(counts, [*by, "_v"])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``."""
    return block_quantiles(value_blocks(df, by, value), by, probs)


def block_quantiles(blocks: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from ``value_blocks``: block sizes tell where the wanted ranks are, and only those are scanned."""
    by, names = list(by), list(probs)
    # One row per group and block.
    parts = blocks.groupBy(_BLOCK, *by).agg(F.sum("_c").alias("_sum"))
    keys = [F.col(c) for c in by] or [F.lit(0)]
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumn(
        "_n", F.sum("_sum").over(Window.partitionBy(*keys))
    )
    targets = []
    for i, p in enumerate(probs.values()):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        for side, at in ((0, F.floor(spot)), (1, F.ceil(spot))):
            targets.append(F.struct(F.lit(2 * i + side).alias("which"), (at - F.col("_before")).alias("at"), (spot - F.floor(spot)).alias("share")))
    here = F.filter(F.array(*targets), lambda t: (t["at"] >= 0) & (t["at"] < F.col("_sum")))
    wanted = placed.select(
        F.col(_BLOCK).alias("_wb"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(by)], here.alias("_here")
    ).where(F.size("_here") > 0)
    condition = F.col(_BLOCK) == F.col("_wb")
    for i, c in enumerate(by):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    # At most two blocks per group and probability.
    chosen = blocks.join(F.broadcast(wanted), condition)
    inside = Window.partitionBy(_BLOCK, *by).orderBy(_SPOT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = chosen.withColumn("_upto", F.sum("_c").over(inside))
    hits = F.filter("_here", lambda t: (t["at"] >= F.col("_upto") - F.col("_c")) & (t["at"] < F.col("_upto")))
    found = running.select(*by, "_v", F.explode(hits).alias("_t"))

    def end(i: int, side: int) -> Column:
        return F.max(F.when(F.col("_t.which") == 2 * i + side, F.col("_v")))

    def share(i: int) -> Column:
        return F.max(F.when(F.col("_t.which") == 2 * i, F.col("_t.share")))

    sides = [(end(i, 0) + (end(i, 1) - end(i, 0)) * share(i)).alias(n) for i, n in enumerate(names)]
    return found.groupBy(*by).agg(*sides)
