"""From raw events to incidents in one streaming query: parse, drop repeats, inspect, judge, merge.

Raw rows are JSON envelopes (``value``) and the text that the event is about
(``content``, may be null).  What is no good envelope, or another tenant's, goes to a side
table; both come from one source with a checkpoint each, and file sinks take each row
once, so that a query that stops anywhere goes on without losing or doubling rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inspect import inspect
from ..operators.policy import evaluate
from ..plans.bundles import Bundle
from ..plans.packs import Pack
from .events import distinct_events, facts_of, parse_envelopes
from .incidents import incident_events, keyed_incidents


def _parsed(raw: DataFrame, bundle: Bundle) -> DataFrame:
    """Envelope columns with content, raw value and error."""
    rows = parse_envelopes(raw, keep=("content", "value"))
    other = F.when(F.col("tenant_id") != bundle.tenant_id, F.lit("another tenant's event"))
    return rows.withColumn("error", F.coalesce("error", other))


def rejected(raw: DataFrame, bundle: Bundle) -> DataFrame:
    """(value, error) of the rows that can't be judged."""
    return _parsed(raw, bundle).filter("error IS NOT NULL").select(F.col("value").cast("string").alias("value"), "error")


def verdicts(raw: DataFrame, bundle: Bundle, *, now: datetime | Column, late: str = "1 hour", packs: list[Pack] | None = None) -> DataFrame:
    """Good events, each once, with inspection of their content and verdict."""
    good = _parsed(raw, bundle).filter("error IS NULL").drop("error", "verdict", "inspection", "value")
    seen = inspect(distinct_events(good, late), "content", packs)
    return evaluate(seen.withColumn("facts", facts_of(seen)), bundle, now=now)


def incidents(raw: DataFrame, bundle: Bundle, *, now: datetime | Column, late: str = "1 hour", window: timedelta = timedelta(hours=1), packs: list[Pack] | None = None) -> DataFrame:
    """Closed incidents: the whole way as one query with two stateful steps, by event id and by incident key."""
    asked = incident_events(verdicts(raw, bundle, now=now, late=late, packs=packs))
    return keyed_incidents(asked, window=window, late=None, distinct=False)


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet files what is there now, each row once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
