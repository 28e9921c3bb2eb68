"""Cleaning of streams: rules that need no statistics run on the stream itself, others by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cleanloom.operators import steps as S
from cleanloom.plans.pipeline import Configuration, build

STATELESS = frozenset("EM")
NOT_ON_STREAMS = frozenset(["enforce_schema", "add_audit_columns"])


def clean_stream(stream: DataFrame, configuration: Configuration) -> DataFrame:
    """A stream through expression-only steps; a step that needs the whole table is an error."""
    for entry in configuration:
        for name, kwargs in entry.items():
            step = S.create(name, **(kwargs or {}))
            if step.kind not in STATELESS or name in NOT_ON_STREAMS:
                raise ValueError(f"{name} needs a whole table: use clean_batches")
            stream = step(stream)
    return stream


def clean_batches(
    stream: DataFrame, configuration: Configuration, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Every micro-batch through the whole pipeline, then to ``sink``; statistics are those of the batch."""
    return (
        stream.writeStream.foreachBatch(lambda df, epoch: sink(build(configuration).run(df), epoch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
