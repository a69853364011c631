"""Small programs made from events: one per event, its template by event_type and its constant from the user's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.sources.tables import table

#: Program templates by event type; {u} is the user's number and {e} the event's number modulo 7 (fixed values).
TEMPLATES = {
    "error": "x = {u}\nprint(x)",
    "click": "for i in range({u}):\n    print(i)",
    "view": "n = int(input())\nif n > {e}:\n    print(n)",
    "signup": "total = 0\ntotal += {u}\nprint(total)",
    "purchase": "x = {u}\ny = {e}\nprint(x, y)",
}


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, event_type, value, e and code."""
    events = table(spark, sf_dir, "events").withColumn("e", F.col("event_id") % 7)
    code = None
    for kind, template in TEMPLATES.items():
        filled = F.replace(F.replace(F.lit(template), F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{e}"), F.col("e").cast("string"))
        code = F.when(F.col("event_type") == kind, filled) if code is None else code.when(F.col("event_type") == kind, filled)
    return events.select("event_id", "user_id", "ts", "event_type", "value", "e", code.alias("code"))
