"""Scoring running cases as their events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import EncoderModel, encode
from ..operators.model import SCORE, Scorer
from ..schema import LogSchema


def running_features(stream: DataFrame, schema: LogSchema, model: EncoderModel, lateness: str | None = "1 hour") -> DataFrame:
    """Aggregate-encoded features of every case so far, as a streaming aggregation.

    Spark's state store keeps counts, sums, extremes and moments per case; events themselves
    are not kept. With ``lateness`` an event that comes again, or later than that behind the
    newest one, is dropped.
    """
    if model.kind not in ("agg", "bool"):
        raise ValueError("only aggregate encoders can be updated event by event")
    if lateness is not None:
        stream = stream.withWatermark(schema.ts, lateness).dropDuplicatesWithinWatermark([schema.case, *schema.tiebreak])
    return encode(stream, schema, [model], case=schema.case)


def score_running_cases(
    stream: DataFrame, schema: LogSchema, model: EncoderModel, scorer: Scorer, sink: Callable[[DataFrame, int], None],
    checkpoint: str, lateness: str | None = "1 hour", **trigger,
) -> StreamingQuery:
    """Score the cases touched by each micro-batch and hand (case, score) to ``sink``."""
    features = running_features(stream, schema, model, lateness)

    def handle(batch: DataFrame, number: int) -> None:
        sink(scorer(batch).select(schema.case, SCORE), number)

    writer = features.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
