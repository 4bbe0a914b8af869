"""Action requests as a file stream: each micro-batch goes through the batch validator, which drops replays."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = ("request_id string, action string, vendor_id string, event_id string, alert_id string, status string, "
          "company_number string, criticality string, owner string, note string, actor string, "
          "requested_at timestamp")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Requests from JSON files. Repeated request ids are dropped against the log, so no request is ever too late."""
    return spark.readStream.schema(SCHEMA).json(folder)


def start(requests: DataFrame, handle: Callable[[DataFrame, str], None], checkpoint: str) -> StreamingQuery:
    """Runs `handle` (usually plans.job.act) on every batch that is there, then stops.

    handle gets the batch and its id, the same again on a retry.
    """
    return (requests.writeStream.foreachBatch(lambda batch, n: handle(batch, f"stream-{n}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
