"""A saved plan in a stream: every micro-batch is written as one sorted file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from keelsort.plans.models import RewritePlan
from keelsort.sources.writer import write_sorted


def sorted_batches(plan: RewritePlan, destination: str, **settings) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch`. A batch that is replayed after a failure writes its file again, so the result is exact once.

    Ties keep the order of the batch's partitions.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            n = rows.count()
            if n:
                write_sorted(rows, plan.bind(rows.schema, n), f"{destination.rstrip('/')}/batch-{batch_id:010d}.parquet", overwrite=True, **settings)
        finally:
            rows.unpersist()

    return run
