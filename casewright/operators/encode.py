"""Encoders: one wide row of features per prefix.

A fitted ``EncoderModel`` holds the columns explicitly. Features come either from a prefix
log by one grouping (``encode``), or straight from the event log by running aggregates over
each case (``encode_running``), which never multiplies events by prefix length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import VOCABULARY_LIMIT, first_non_null, nulls_last, quoted, to_long, vocabulary
from ..functions.keyed import hot_keys
from ..functions.ordering import scan_within
from ..schema import LogSchema
from .prefix import case_heads

NUMERIC_STATS = ("mean", "max", "min", "sum", "std")
KINDS = ("static", "agg", "bool", "index")
METHODS = {"agg": ("static", "agg"), "index": ("static", "index")}


@dataclass(frozen=True)
class EncoderModel:
    """Levels and length seen when fitting one encoder.

    ``levels`` maps a column (or ``column_position``) to its levels, each with the buckets it
    was seen in; an empty bucket set stands for everywhere.
    """

    kind: str
    cat: tuple[str, ...]
    num: tuple[str, ...]
    levels: dict[str, dict[str, frozenset]] = field(default_factory=dict)
    max_events: int = 0
    bucket_max: tuple[tuple[int, int], ...] = ()

    @property
    def columns(self) -> list[str]:
        dummies = [f"{c}_{level}" for c, found in self.levels.items() for level in found]
        if self.kind == "static":
            return [*self.num, *dummies]
        if self.kind == "index":
            return [f"{c}_{i}" for i in range(self.max_events) for c in self.num] + dummies
        return dummies + [f"{s}_{c}" for s in NUMERIC_STATS for c in self.num]

    @property
    def categorical_columns(self) -> list[str]:
        """Feature names that come from a categorical column."""
        return [f"{c}_{level}" for c, found in self.levels.items() for level in found]


def _freeze(found: dict[str, dict[str, set]]) -> dict[str, dict[str, frozenset]]:
    return {c: {level: frozenset(seen) for level, seen in levels.items()} for c, levels in found.items()}


def fit(
    kind: str, prefixes: DataFrame, schema: LogSchema, case: str = "prefix_id", bucket: str | None = None,
    max_events: int | None = None, limit: int = VOCABULARY_LIMIT,
) -> EncoderModel:
    """Fit an encoder on a prefix log; with ``bucket`` each bucket has its own vocabulary."""
    if kind not in KINDS:
        raise ValueError(f"unknown encoder {kind!r}; use one of {KINDS}")
    if kind == "static":
        cat, num = schema.static_cat, schema.static_num
        keys = [case, *([bucket] if bucket else [])]
        seen = prefixes
        if cat:
            seen = prefixes.groupBy(*keys).agg(*[first_non_null(c, schema.order).alias(c) for c in cat])
        return EncoderModel(kind, cat, num, _freeze(vocabulary(seen, cat, bucket, limit)))
    cat, num = schema.dynamic_cat, schema.dynamic_num
    if kind != "index":
        return EncoderModel(kind, cat, num, _freeze(vocabulary(prefixes, cat, bucket, limit)))
    group = F.col(bucket) if bucket else F.lit(0)
    sizes = prefixes.groupBy(case, group.alias("_g")).agg(F.count("*").alias("_m"))
    # One row per bucket.
    longest = sizes.groupBy("_g").agg(F.max("_m").alias("_m")).collect()
    bucket_max = tuple(sorted((r["_g"], r["_m"]) for r in longest if r["_g"] is not None))
    length = max_events or max((m for _, m in bucket_max), default=0)
    if length * len(num) > limit:
        raise ValueError(f"{length} positions make more than {limit} columns; use the long form or max_events")
    seen = _with_position(prefixes, schema, case)
    return _fit_positions(seen, cat, num, bucket, length, bucket_max, limit)


def _fit_positions(seen, cat, num, bucket, length, bucket_max, limit) -> EncoderModel:
    """Levels of each categorical column at each position, column by column."""
    levels: dict[str, dict[str, frozenset]] = {}
    if cat:
        ids = ["pos", *([bucket] if bucket else [])]
        long = to_long(seen.where(F.col("pos") <= length), ids, cat, "string").where(F.col("value").isNotNull())
        placed = long.withColumn("slot", F.concat_ws("_", "feature", (F.col("pos") - 1).cast("string")))
        if bucket:
            slots = placed.groupBy("slot", "value").agg(F.collect_set(bucket).alias("seen"))
        else:
            slots = placed.select("slot", "value").distinct().withColumn("seen", F.array())
        rows = slots.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} levels by position; use the long form")
        levels = {f"{c}_{i}": {} for c in cat for i in range(length)}
        for r in sorted(rows, key=lambda r: r["value"]):
            levels[r["slot"]][r["value"]] = frozenset(r["seen"])
        levels = {slot: found for slot, found in levels.items() if found}
    return EncoderModel("index", cat, num, levels, length, bucket_max if bucket else ())


def _with_position(prefixes: DataFrame, schema: LogSchema, case: str) -> DataFrame:
    """1-based ``pos`` of each event; cases too long for one task are ranked in blocks."""
    if "pos" in prefixes.columns:
        return prefixes
    if hot_keys(prefixes, case):
        return scan_within(prefixes, [case], nulls_last(schema.order), rank="pos")
    inside = Window.partitionBy(case).orderBy(*nulls_last(schema.order))
    return prefixes.withColumn("pos", F.row_number().over(inside))


class _Grouped:
    """Aggregates of a grouping by prefix."""

    def __init__(self, schema: LogSchema):
        self.order = schema.order

    def stat(self, name: str, c: str) -> Column:
        column = F.col(quoted(c))
        functions: dict[str, Callable] = {
            "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp,
        }
        return functions[name](column)

    def count(self, hit: Column, presence: bool) -> Column:
        return F.max(hit.cast("int")) if presence else F.sum(hit.cast("int"))

    def first(self, c: str) -> Column:
        return first_non_null(quoted(c), self.order)

    def at(self, column: Column, i: int) -> Column:
        return F.max(F.when(F.col("pos") == i + 1, column))


class _Running(_Grouped):
    """The same, as running aggregates over the events of a case."""

    def __init__(self, schema: LogSchema):
        super().__init__(schema)
        inside = Window.partitionBy(schema.case).orderBy("pos")
        self.until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def stat(self, name, c):
        return super().stat(name, c).over(self.until)

    def count(self, hit, presence):
        return super().count(hit, presence).over(self.until)

    def first(self, c):
        return F.first(F.col(quoted(c)), ignorenulls=True).over(self.until)

    def at(self, column, i):
        return super().at(column, i).over(self.until)


def _raw_columns(model: EncoderModel, how: _Grouped, tag: str) -> list[Column]:
    """What has to be aggregated; names are internal and numbered."""
    out = []
    if model.kind == "static":
        out += [how.first(c).alias(f"{tag}n{i}") for i, c in enumerate(model.num)]
        out += [how.first(c).alias(f"{tag}c{i}") for i, c in enumerate(model.cat)]
    elif model.kind == "index":
        for i in range(model.max_events):
            out += [how.at(F.col(quoted(c)), i).alias(f"{tag}n{i}_{j}") for j, c in enumerate(model.num)]
            out += [how.at(F.col(quoted(c)), i).alias(f"{tag}c{i}_{j}") for j, c in enumerate(model.cat)]
    else:
        for j, c in enumerate(model.cat):
            for k, level in enumerate(model.levels.get(c, {})):
                hit = F.coalesce(F.col(quoted(c)) == level, F.lit(False))
                out.append(how.count(hit, model.kind == "bool").alias(f"{tag}c{j}_{k}"))
        for s in NUMERIC_STATS:
            out += [how.stat(s, c).alias(f"{tag}{s}{j}") for j, c in enumerate(model.num)]
    return out


def _masked(value: Column, seen: frozenset, buckets: frozenset) -> Column:
    """Zero outside the buckets whose training part had the level."""
    if not seen or seen == buckets:
        return value
    return F.when(F.col("bucket").isin(sorted(seen)), value).otherwise(0.0)


def _feature_columns(model: EncoderModel, tag: str, buckets: frozenset) -> list[tuple[str, Column]]:
    """(name, column) pairs in the order of ``model.columns``; nulls are 0."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def dummy(name: str, level: str) -> Column:
        return F.when(F.col(name) == level, 1.0).otherwise(0.0)

    out: list[tuple[str, Column]] = []
    if model.kind == "static":
        out += [(c, number(f"{tag}n{i}")) for i, c in enumerate(model.num)]
        for i, c in enumerate(model.cat):
            for level, seen in model.levels.get(c, {}).items():
                out.append((f"{c}_{level}", _masked(dummy(f"{tag}c{i}", level), seen, buckets)))
    elif model.kind == "index":
        for i in range(model.max_events):
            fits = frozenset(b for b, m in model.bucket_max if m > i)
            for j, c in enumerate(model.num):
                out.append((f"{c}_{i}", _masked(number(f"{tag}n{i}_{j}"), fits, buckets)))
        for j, c in enumerate(model.cat):
            for i in range(model.max_events):
                for level, seen in model.levels.get(f"{c}_{i}", {}).items():
                    out.append((f"{c}_{i}_{level}", _masked(dummy(f"{tag}c{i}_{j}", level), seen, buckets)))
    else:
        for j, c in enumerate(model.cat):
            for k, (level, seen) in enumerate(model.levels.get(c, {}).items()):
                out.append((f"{c}_{level}", _masked(number(f"{tag}c{j}_{k}"), seen, buckets)))
        for s in NUMERIC_STATS:
            out += [(f"{s}_{c}", number(f"{tag}{s}{j}")) for j, c in enumerate(model.num)]
    return out


def _select(
    raw: DataFrame, models: Sequence[EncoderModel], keys: Sequence[str | Column], prefixed: bool
) -> DataFrame:
    buckets = frozenset(b for m in models for found in m.levels.values() for seen in found.values() for b in seen)
    buckets |= frozenset(b for m in models for b, _ in m.bucket_max)
    columns = []
    for t, model in enumerate(models):
        for name, column in _feature_columns(model, f"_{t}_", buckets):
            columns.append(column.alias(f"{model.kind}__{name}" if prefixed else name))
    return raw.select(*keys, *columns)


def encode(
    prefixes: DataFrame, schema: LogSchema, models: EncoderModel | Sequence[EncoderModel],
    case: str = "prefix_id", keep: Sequence[str] = (),
) -> DataFrame:
    """Encode a prefix log with one or several fitted encoders in a single grouping.

    Several encoders are a union of features named ``<encoder>__<column>``. ``keep`` are
    columns that are constant in a prefix and stay beside its id.
    """
    union = not isinstance(models, EncoderModel)
    models = list(models) if union else [models]
    if any(m.kind == "index" for m in models):
        prefixes = _with_position(prefixes, schema, case)
    keys = [case, *keep]
    how = _Grouped(schema)
    raw = [c for t, m in enumerate(models) for c in _raw_columns(m, how, f"_{t}_")]
    grouped = prefixes.groupBy(*keys).agg(*raw) if raw else prefixes.select(*keys).distinct()
    return _select(grouped, models, keys, union)


def running_heads(log: DataFrame, schema: LogSchema, max_length: int) -> DataFrame:
    """First events of each case with static values and label as known so far, and ``case_start``.

    A static value is the first one that is not null up to the event. Applying this twice
    changes nothing, and cutting a case after any event leaves the rows before it as they are.
    """
    heads = case_heads(log, schema, max_length)
    inside = Window.partitionBy(schema.case).orderBy(*nulls_last(schema.order))
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fixed = (*schema.static_num, *schema.static_cat, schema.label)
    filled = {c: F.first(F.col(quoted(c)), ignorenulls=True).over(until) for c in fixed}
    used = dict.fromkeys([schema.case, schema.ts, *schema.dynamic_num, *schema.dynamic_cat, *fixed])
    return heads.select(
        *[filled[c].alias(c) if c in filled else F.col(quoted(c)) for c in used],
        "pos", "case_length", F.min(schema.ts).over(whole).alias("case_start"),
    )


def encode_running(
    log: DataFrame, schema: LogSchema, models: Sequence[EncoderModel], max_length: int, gap: int = 1,
    buckets: DataFrame | None = None, label: str = "encoded_label",
) -> DataFrame:
    """Encode all prefixes of a log by running aggregates: one shuffle, one row per prefix."""
    return encode_heads(case_heads(log, schema, max_length), schema, models, gap, buckets, label)


def encode_heads(
    heads: DataFrame, schema: LogSchema, models: Sequence[EncoderModel], gap: int = 1, buckets: DataFrame | None = None,
    label: str = "encoded_label", keep: Sequence[str] = (),
) -> DataFrame:
    """One encoded row per prefix from the first events of each case (``case_heads``).

    ``buckets`` maps a prefix size to its bucket (``floor_sizes``); without it all prefixes
    are in bucket 1. Adds ``prefix_id``, ``original_case_id``, ``prefix_nr``, ``bucket`` and the label.
    """
    how = _Running(schema)
    raw = [c for t, m in enumerate(models) for c in _raw_columns(m, how, f"_{t}_")]
    first_label = F.when(how.first(schema.label) == schema.positive, 1).otherwise(0).alias("_label")
    running = heads.select(schema.case, "pos", *keep, *raw, first_label)
    if gap > 1:
        running = running.where((F.col("pos") - 1) % gap == 0)
    if buckets is None:
        running = running.withColumn("bucket", F.lit(1).cast("long"))
    else:
        # One row per prefix length.
        running = running.join(F.broadcast(buckets), F.col("pos") == F.col("size"), "left")
    first = F.col("pos") == 1
    keys = [
        *keep,
        F.when(first, F.col(schema.case)).otherwise(F.concat_ws("_", schema.case, "pos")).alias("prefix_id"),
        F.col(schema.case).alias("original_case_id"), F.col("pos").alias("prefix_nr"), F.col("bucket"),
    ]
    return _select(running.withColumnRenamed("_label", label), models, [*keys, F.col(label)], True)


def fit_heads(
    kinds: Iterable[str], heads: DataFrame, schema: LogSchema, by_length: bool = False, limit: int = VOCABULARY_LIMIT
) -> list[EncoderModel]:
    """Fit on the prefixes that ``running_heads`` stands for, without building them.

    Bucket b (one per length) holds the first b events of all cases with at least b, so a
    level is known in bucket b if some such case shows it at a position up to b; a static
    value belongs to its own position only.
    """
    models = []
    for kind in kinds:
        cat = schema.static_cat if kind == "static" else schema.dynamic_cat
        num = schema.static_num if kind == "static" else schema.dynamic_num
        if kind == "index":
            models.append(_fit_running_positions(heads, cat, num, by_length, limit))
            continue
        seen = heads.withColumn("case_length", F.col("pos")) if kind == "static" else heads
        models.append(EncoderModel(kind, cat, num, _levels_by_span(seen, cat, by_length, limit)))
    return models


def _levels_by_span(seen: DataFrame, cat: Sequence[str], by_length: bool, limit: int) -> dict[str, dict[str, frozenset]]:
    if not cat:
        return {}
    if not by_length:
        return _freeze(vocabulary(seen, cat, None, limit))
    spans = (
        to_long(seen, ["pos", "case_length"], cat, "string").where(F.col("value").isNotNull())
        .groupBy("feature", "value", "pos").agg(F.max("case_length").alias("_longest"))
        .select("feature", "value", F.explode(F.sequence("pos", "_longest")).alias("size"))
        .groupBy("feature", "value").agg(F.collect_set("size").alias("sizes"))
    )
    rows = spans.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels; use the long form")
    found: dict[str, dict[str, frozenset]] = {c: {} for c in cat}
    for r in sorted(rows, key=lambda r: r["value"]):
        found[r["feature"]][r["value"]] = frozenset(r["sizes"])
    return found


def _fit_running_positions(heads, cat, num, by_length, limit) -> EncoderModel:
    longest = heads.agg(F.max("pos")).first()[0] or 0
    bucket_max = tuple((b, b) for b in range(1, longest + 1)) if by_length else ()
    levels: dict[str, dict[str, frozenset]] = {f"{c}_{i}": {} for c in cat for i in range(longest)}
    if cat:
        rows = (
            to_long(heads, ["pos", "case_length"], cat, "string").where(F.col("value").isNotNull())
            .groupBy("feature", "pos", "value").agg(F.max("case_length").alias("longest")).limit(limit + 1).collect()
        )
        if len(rows) > limit:
            raise ValueError(f"more than {limit} levels by position; use the long form")
        for r in sorted(rows, key=lambda r: r["value"]):
            sizes = frozenset(range(r["pos"], r["longest"] + 1)) if by_length else frozenset()
            levels[f"{r['feature']}_{r['pos'] - 1}"][r["value"]] = sizes
    return EncoderModel("index", tuple(cat), tuple(num), {k: v for k, v in levels.items() if v}, longest, bucket_max)


def align_columns(encoded: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The fitted columns only: missing ones are 0, unknown ones are dropped."""
    have = set(encoded.columns)
    aligned = [
        F.coalesce(F.col(quoted(c)), F.lit(0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in columns
    ]
    return encoded.select(*keys, *aligned)


def fill_zero(encoded: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls to 0 in the given (or all numeric) columns."""
    return encoded.fillna(0, subset=list(columns) if columns else None)


def encode_index_long(prefixes: DataFrame, schema: LogSchema, case: str = "prefix_id") -> DataFrame:
    """Positional features in long form ``(case, feature, value)``, non-zero entries only.

    For vocabularies too wide for columns: nothing is collected, and no pivot is built.
    """
    placed = _with_position(prefixes, schema, case)
    at = (F.col("pos") - 1).cast("string")
    numbers = to_long(placed, [case, "pos"], schema.dynamic_num).select(
        case, F.concat_ws("_", "feature", at).alias("feature"), "value"
    )
    levels = to_long(placed, [case, "pos"], schema.dynamic_cat, "string").select(
        case, F.concat_ws("_", "feature", at, "value").alias("feature"),
        F.when(F.col("value").isNotNull(), 1.0).alias("value"),
    )
    return numbers.unionByName(levels).where(F.col("value") != 0)
