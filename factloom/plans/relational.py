"""Queries of the relational core."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "best_open_per_entity",
    """
    WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value >= 200),
    best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events
             WHERE user_id NOT IN (SELECT user_id FROM done))
    SELECT b.user_id, b.event_id, b.event_type, b.value, c.c_name, c.c_mktsegment
    FROM best b JOIN customer c ON c.c_custkey = b.user_id WHERE rn = 1
    """,
)
def best_open_per_entity(spark, sf_dir):
    """The best event of each entity that never reached its target, with its dimension row, best first."""
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    done = events.filter("event_type = 'purchase' AND value >= 200").select("user_id")
    rank = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    best = events.join(done, "user_id", "left_anti").withColumn("rn", F.row_number().over(rank)).filter("rn = 1")
    return (
        best.join(customer, best.user_id == customer.c_custkey)
        .select("user_id", "event_id", "event_type", "value", "c_name", "c_mktsegment")
        .orderBy(F.desc("value"), "event_id")
    )
