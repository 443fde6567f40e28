"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its words are demanded in proportion to
the integral of its schedule; inverting that cumulative demand at a document's place among the
words of its source gives the time at which the document is trained on. Documents are then
range-sorted by time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import global_rank, scan_within
from .scratch import Scratch, sized

WORD = r"[^\x20\x09-\x0D]+"
Schedule = Sequence[tuple[float, float]]
#: Weight schedules (time, weight), linear in between: early, even and late sources in turn.
SCHEDULES: tuple[Schedule, ...] = (((0, 1.5), (1, 0.5)), ((0, 1.0), (1, 1.0)), ((0, 0.5), (1, 1.5)))


class Mix(NamedTuple):
    """Sources in code point order, null last, take ``weights`` and ``schedules`` in turn."""

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    schedules: Sequence[Schedule] = SCHEDULES
    seed: str = "mix"


def inverse_demand(u: Column, schedule: Schedule) -> Column:
    """Time at which the integral of the schedule reaches the share ``u`` of its total."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    total, done = sum(area), 0.0
    out = F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), part in zip(schedule, schedule[1:], area):
        rest, slope = u * total - done, (w1 - w0) / (t1 - t0)
        # Solves w0 x + slope x^2 / 2 = rest for x; this form also holds for slope 0.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w0 * w0)) + 2 * slope * rest))
        x = F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(float(w0)) + root))
        done += part
        pieces.append((done / total, F.least(F.lit(float(t1)), F.lit(float(t0)) + x)))
    for upper, time in reversed(pieces):
        out = F.when(u <= upper, time).otherwise(out)
    return out


def targets(scratch: Scratch, sized: DataFrame, mix: Mix) -> DataFrame:
    """source, sid, source_size, target: water-filling by weight below ``repeats`` times the size."""
    totals = sized.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ranked = global_rank(totals, [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (1 + (F.col("sid") - 1) % len(mix.weights)).cast("int"))
    ranked = scratch.stage(
        ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(mix.repeats)), "sources"
    )
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # Sources whose cap lies below the level are full; the rest share what remains by weight.
        above = F.col("cap") <= F.col("weight") * level
        n, filled, open_ = ranked.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == full or not open_:
            break
        full, level = n, (mix.share * words - (filled or 0.0)) / open_
    target = F.least(F.col("cap"), F.col("weight") * level)
    return ranked.select("source", "sid", "source_size", target.alias("target"))


def plan(scratch: Scratch, docs: DataFrame, key: str, text: str, source: str, mix: Mix) -> DataFrame:
    """A row per distinct (key, source, text) with its number of rows n and its place in its source.

    ``start`` counts the source's words before it in the order of md5(seed, key).
    """
    units = (
        docs.select(
            F.col(key).alias("key"), F.col(source).cast("string").alias("source"), unit(key, text).alias("unit"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("key", "source", "unit").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    )
    units = scratch.stage(units, "units")
    facts = targets(scratch, units, mix)
    # As many rows as sources; AQE broadcasts them if they are few.
    placed = units.join(facts, units.source.eqNullSafe(facts.source)).drop(facts.source)
    order = F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    placed = placed.withColumn("order", order).withColumn("mass", F.col("n") * F.col("size"))
    summed = scan_within(placed, ["sid"], ["order", "key", "size", "unit"], sums={"upto": "mass"})
    goal = F.floor(F.col("target") + 0.5)
    return summed.withColumn("start", F.col("upto") - F.col("mass")).withColumn("goal", goal)


def unit(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def passes(planned: DataFrame, mix: Mix) -> DataFrame:
    """One row for every row of the input, with takes: an array of (taken, position), one a pass."""
    rows = planned.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    start = F.col("start") + F.col("copy") * F.col("size")
    takes = []
    for k in range(mix.repeats):
        at = start + k * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - at))
        u = (at + taken / 2) / F.greatest(F.col("goal"), F.lit(1))
        times = [inverse_demand(u, s) for s in mix.schedules]
        time = F.element_at(F.array(*times), (1 + (F.col("sid") - 1) % len(times)).cast("int"))
        takes.append(F.struct(taken.alias("taken"), F.when(taken > 0, time).alias("position")))
    return rows.withColumn("takes", F.array(*takes))


def mixing_table(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix(),
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken and its positions in time.

    The words taken of each source are its rounded target exactly: a source's documents are taken
    whole in hashed order, once or twice round, and the last one in part. A null or blank text has
    size 0 and takes nothing; null is a source of its own. Equal rows are planned one after the
    other. An empty table gives an empty result. Other columns are not read.
    """
    with Scratch(docs.sparkSession, "mixing") as scratch:
        rows = passes(plan(scratch, docs, key, text, source, mix), mix)
        taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["taken"])
        return scratch.result(rows.select(
            F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"),
            *(F.col("takes")[k]["position"].alias(f"position_{k + 1}") for k in range(mix.repeats)),
        ))


def mix_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix(),
) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs``, a row for each pass over a document.

    Texts stay whole: the document at the end of a source's last pass, which ``mixing_table`` takes
    in part, is taken if at least half of it is due, and otherwise left out. So a source misses its
    target by half a document at most. If that document is its first with words, it is taken in any
    case, so no source with a target of a word or more is lost to one very long document.
    """
    spark: SparkSession = docs.sparkSession
    with Scratch(spark, "mixed") as scratch:
        rows = passes(plan(scratch, docs, key, text, source, mix), mix)
        takes = rows.select("unit", "source", "size", "n", (F.col("start") + F.col("copy") * F.col("size")).alias("at"), F.posexplode("takes").alias("turn", "take"))
        takes = takes.where("take.taken > 0 AND (2 * take.taken >= size OR turn = 0 AND at = 0)")
        takes = scratch.stage(takes.select("unit", F.col("source").alias("__source"), "n", "take.position"), "takes")
        marked = docs.withColumn("__unit", unit(key, text))
        same = (F.col("__unit") == F.col("__m_unit")) & F.col(source).cast("string").eqNullSafe(F.col("__source"))
        facts = takes.select(*(F.col(c).alias(f"__m_{c}") for c in ("unit", "n", "position")), "__source")
        repeated = facts.where("__m_n > 1")
        single = marked.join(sized(facts.where("__m_n = 1")), same)
        many = marked.join(sized(repeated.select("__m_unit", "__source").distinct()), same, "left_semi")
        many = many.dropDuplicates(["__unit", source]).join(repeated, same)
        every = single.union(many.select(single.columns))
        ordered = every.repartitionByRange("__m_position", "__m_unit").sortWithinPartitions("__m_position", "__m_unit")
        return scratch.result(ordered.select(*docs.columns))
