"""The journal as a stream: each event is accepted or rejected by its attempt's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.journal import STEPS

OUT = "attempt string, sequence bigint, kind string, accepted boolean"


def _judge(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    done, failed = state.get if state.exists else (0, False)
    rows = []
    for p in sorted((x for d in parts for x in d.itertuples(index=False)), key=lambda x: x.sequence):
        failed = failed or done >= len(STEPS) or p.kind != STEPS[done]
        done += not failed
        rows.append((key[0], p.sequence, p.kind, not failed))
    state.update((done, failed))
    yield pd.DataFrame(rows, columns=["attempt", "sequence", "kind", "accepted"])


def judge(events: DataFrame) -> DataFrame:
    """(attempt, sequence, kind, accepted) of a stream (or batch) of ``events(attempt, sequence, kind)``.

    The state of an attempt is two values: how many steps it has taken, and whether one was out of order; after that all
    its steps are rejected. Events of one trigger are taken in sequence order.
    """
    e = events.where(F.col("kind").isin(*STEPS)).select("attempt", "sequence", "kind")
    return e.groupBy("attempt").applyInPandasWithState(_judge, OUT, "done int, failed boolean", "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows of event time; what is later than the watermark is dropped. (Spark's own; no parity claim.)"""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
