"""Scoring running cases that end: a case is kept until it has been idle for a while.

Every event updates the sums of its case. Cases are kept in groups dealt by hash, one state and one timer in
event time a group, as each call for a state and each group's output has a price far above that of an event. When the
watermark passes the earliest end in a group, the last scores of its ended cases are given out as final and the cases are
removed, so what is kept follows the number of cases that run at a time. Later events are dropped, and counted by Spark.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.frames import quoted
from ..operators.encode import EncoderModel
from ..operators.model import SCORE, Scorer
from ..schema import LogSchema

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "due long, cases binary"
#: Groups that cases are dealt to: each is rewritten when one of its cases is touched.
GROUPS = 1024


class _Sums:
    """Counts of levels, and count, mean, squared deviations, least and greatest value of numbers, of one case."""

    def __init__(self, n_counts: int, n_numbers: int, kept: tuple | None):
        if kept is None:
            kept = (0, 0, [0.0] * n_counts, *([0.0] * n_numbers for _ in range(3)), [math.inf] * n_numbers, [-math.inf] * n_numbers)
        self.events, self.ends = kept[0], kept[1]
        self.counts, self.n, self.mean, self.spread, self.least, self.most = (list(x) for x in kept[2:])

    def add(self, hits: list[int], numbers: list[float | None]) -> None:
        self.events += 1
        for i in hits:
            self.counts[i] += 1
        for j, x in enumerate(numbers):
            if x is None:
                continue
            self.n[j] += 1
            change = x - self.mean[j]
            self.mean[j] += change / self.n[j]
            self.spread[j] += change * (x - self.mean[j])
            self.least[j], self.most[j] = min(self.least[j], x), max(self.most[j], x)

    def kept(self) -> tuple:
        return self.events, self.ends, self.counts, self.n, self.mean, self.spread, self.least, self.most

    def features(self, presence: bool) -> list[float]:
        """Features in the order of an aggregate encoder; without values they are 0."""
        out = [min(1.0, c) for c in self.counts] if presence else list(self.counts)
        some = [n > 0 for n in self.n]
        out += [m if s else 0.0 for m, s in zip(self.mean, some)]
        out += [x if s else 0.0 for x, s in zip(self.most, some)]
        out += [x if s else 0.0 for x, s in zip(self.least, some)]
        out += [m * n for m, n in zip(self.mean, self.n)]
        out += [math.sqrt(max(0.0, d) / (n - 1)) if n > 1 else 0.0 for d, n in zip(self.spread, self.n)]
        return out


class CaseProcessor(StatefulProcessor):
    """Gives out the features of a group's cases after each batch of their events, and once more, as final, when they end."""

    def __init__(self, n_counts: int, n_numbers: int, presence: bool, idle_ms: int):
        self.shape, self.presence, self.idle_ms = (n_counts, n_numbers), presence, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cases", _STATE)

    def _kept(self) -> tuple[int | None, dict]:
        """(timer, what is kept of each case)"""
        found = self.state.get()
        return (found[0], pickle.loads(bytes(found[1]))) if found else (None, {})

    def _keep(self, cases: dict, timer: int | None) -> None:
        """Keep the cases; ``timer`` is the one that is set."""
        due = min((kept[1] for kept in cases.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if cases:
            self.state.update((due, pickle.dumps(cases)))
        else:
            self.state.clear()

    def _row(self, case, sums: _Sums, final: bool) -> Row:
        return Row(case=case, events=sums.events, final=final, features=sums.features(self.presence))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timer, cases = self._kept()
        touched: dict = {}
        for _, case, event in rows:
            sums = touched.get(case)
            if sums is None:
                sums = touched[case] = _Sums(*self.shape, cases.get(case))
            at, hits, numbers = event.split(";")
            sums.add([int(i) for i in hits.split(",")] if hits else [], [float(x) if x else None for x in numbers.split(",")] if self.shape[1] else [])
            sums.ends = max(sums.ends, int(at) + self.idle_ms)
        cases.update((case, sums.kept()) for case, sums in touched.items())
        self._keep(cases, timer)
        for case, sums in touched.items():
            yield self._row(case, sums, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        _, cases = self._kept()
        passed, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        ended = {case: kept for case, kept in cases.items() if kept[1] <= passed or kept[1] < now}
        # Spark removes the timer that has passed.
        self._keep({case: kept for case, kept in cases.items() if case not in ended}, None)
        for case, kept in ended.items():
            yield self._row(case, _Sums(*self.shape, kept), True)

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def case_features(stream: DataFrame, schema: LogSchema, model: EncoderModel, idle: str, lateness: str, groups: int = GROUPS) -> DataFrame:
    """(case, events, final, features) of every touched or ended case; features are named as the encoder names them.

    ``lateness`` is how far an event may lie behind the newest one, ``idle`` how long after its last event a
    case ends. Events without a case or a time are left out; an event that comes again within the lateness
    counts once.
    """
    if model.kind not in ("agg", "bool"):
        raise ValueError("only aggregate encoders can be updated event by event")
    levels = [(c, level) for c in model.cat for level in model.levels.get(c, {})]
    places = F.array(*[F.when(F.col(quoted(c)) == level, F.lit(i)) for i, (c, level) in enumerate(levels)]) if levels else F.array().cast("array<int>")
    given = stream.where(F.col(schema.case).isNotNull() & F.col(schema.ts).isNotNull()).withWatermark(schema.ts, lateness)
    once = given.dropDuplicatesWithinWatermark([schema.case, *schema.tiebreak])
    numbers = F.array(*[F.col(quoted(c)).cast("double").cast("string") for c in model.num]).cast("array<string>")
    # Text is read in Python far faster than lists; doubles come back from it as they were.
    event = F.concat_ws(";", F.unix_millis(schema.ts), F.array_join(F.array_compact(places).cast("array<string>"), ","), F.array_join(numbers, ",", ""))
    events = once.select(F.pmod(F.xxhash64(schema.case), F.lit(groups)).cast("int").alias("_group"), F.col(schema.case).alias("_case"), event.alias("_event"))
    span = stream.sparkSession.sql(f"SELECT INTERVAL {idle} AS i").select((F.expr("timestamp_millis(0) + i").cast("double") * 1000).cast("long"))
    processor = CaseProcessor(len(levels), len(model.num), model.kind == "bool", span.first()[0])
    kind = stream.schema[schema.case].dataType.simpleString()
    ended = events.groupBy("_group").transformWithState(
        processor, f"case {kind}, events long, final boolean, features array<double>", "Append", "EventTime"
    )
    named = [F.col("features")[i].alias(f"{model.kind}__{c}") for i, c in enumerate(model.columns)]
    return ended.select(F.col("case").alias(schema.case), "events", "final", *named)


def score_ending_cases(
    stream: DataFrame, schema: LogSchema, model: EncoderModel, scorer: Scorer, sink: Callable[[DataFrame, int], None],
    checkpoint: str, idle: str = "7 days", lateness: str = "1 hour", groups: int = GROUPS, **trigger,
) -> StreamingQuery:
    """Hand (case, events, final, score) of the cases touched or ended by each micro-batch to ``sink``."""
    def handle(batch: DataFrame, number: int) -> None:
        sink(scorer(batch).select(schema.case, "events", "final", SCORE), number)

    with _rocksdb(stream.sparkSession):
        features = case_features(stream, schema, model, idle, lateness, groups)
        writer = features.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def progress_of(query: StreamingQuery) -> list[tuple[int, int]]:
    """(groups of cases and timers kept, events dropped as late) of each finished batch."""
    return [
        (p["stateOperators"][0]["numRowsTotal"], sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]))
        for p in query.recentProgress if p["stateOperators"]
    ]
