"""The first accepted event of each user, as a stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajectree.registry import query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OUT = "user_id long, event_id long, n_wrong long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a user: errors so far, and whether the first purchase has come. Only two numbers a user are kept."""
    wrong, done = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    found = []
    for event_id, kind in zip(rows["event_id"], rows["event_type"]):
        if not done and kind == "purchase":
            done = True
            found.append((key[0], event_id, wrong))
        wrong += kind == "error" and not done
    state.update((int(wrong), done))
    yield pd.DataFrame(found, columns=["user_id", "event_id", "n_wrong"])


def first_accepts(events: DataFrame) -> DataFrame:
    """A row for each user when the first purchase comes: the event, and the errors before it. Events come in order of time from batch to batch."""
    rows = events.select("user_id", "event_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_advance, OUT, "wrong long, done boolean", "append", GroupStateTimeout.NoTimeout)


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events),
f as (select *, min(case when event_type = 'purchase' then seq end) over (partition by user_id) as first from r)
select user_id, max_by(event_id, seq) as event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_wrong from f where seq <= first group by 1""")
def stream_first_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, once through what is there."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{shared or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}"
    run = first_accepts(events).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
