"""Added scope, not part of the document engine's own operators: relational and event-time queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.runtime import load
from quillspan.streaming.ingest import event_windows, sessions


def host_event_windows(spark, d):
    return event_windows(load(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("string"))


def host_sessions(spark, d):
    s = sessions(load(spark, d, "events"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


def host_rollup(spark, d):
    g = load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("items"),
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return g.na.fill("ALL", ["l_returnflag", "l_linestatus"])


def host_asof(spark, d):
    """Last event of each user at or before each hour's first event of that user: an as-of join by a union and a running value, without a range join."""
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    left = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("ts"))
    both = e.where("event_type = 'click'").select("user_id", "ts", F.lit(0).alias("side"), F.col("event_id").alias("v"), F.lit(None)
        .cast("timestamp_ntz").alias("day")).unionByName(left.select("user_id", "ts", F.lit(1).alias("side"), F.lit(None)
            .cast("long").alias("v"), F.col("day").cast("timestamp_ntz").alias("day")))
    w = Window.partitionBy("user_id").orderBy("ts", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("click", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("user_id", F.col("day")
        .cast("date").cast("string").alias("day"), "click")


def host_json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"))


def host_set_ops(spark, d):
    a, b = load(spark, d, "orders").select(F.col("o_custkey").alias("key")), load(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return a.intersect(b).select("key", F.lit("both").alias("side")).unionByName(b.exceptAll(a.distinct()).select("key", F.lit("customer").alias("side")))


def host_top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey", "n")


QUERIES = {f.__name__: f for f in (host_event_windows, host_sessions, host_rollup, host_asof, host_json_props, host_set_ops, host_top_orders)}

ORACLE = {
    "host_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "host_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, n""",
    "host_rollup": "SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, coalesce(l_linestatus, 'ALL') AS l_linestatus, count(*) AS items, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "host_asof": """WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts FROM events GROUP BY ALL)
SELECT l.user_id, CAST(day AS VARCHAR) AS day, (SELECT arg_max(event_id, {'a': e.ts, 'b': e.event_id}) FROM events e WHERE e.user_id = l.user_id AND e.event_type = 'click' AND e.ts <= l.ts) AS click FROM l""",
    "host_json_props": "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS k_sum, count(props->>'$.k') AS k_count FROM events GROUP BY event_type",
    "host_set_ops": "SELECT key, 'both' AS side FROM (SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT key, 'customer' FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders)",
    "host_top_orders": "SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3",
}
