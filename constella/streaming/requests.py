"""Plans that arrive as a stream, batched by Structured Streaming, and event windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from constella.multiquery.engine import Engine, PlanResult
from constella.plans.ir import from_json


def serve(requests: DataFrame, engine: Engine, done: Callable[[list[PlanResult]], None], checkpoint: str, window: str | None = "100 milliseconds") -> StreamingQuery:
    """Runs each micro-batch of ``plan`` JSON strings as one batch; ``window`` None: what there is, then stop."""

    def batch(df: DataFrame, _: int) -> None:
        plans = [from_json(r.plan) for r in df.select("plan").collect()]  # requests of one window
        if plans:
            done(engine.run(plans))

    trigger = {"processingTime": window} if window else {"availableNow": True}
    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def event_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and key; events later than ``late`` behind the newest are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
