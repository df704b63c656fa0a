"""Change feeds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.plans.registry import question
from ravelin.sources.files import scratch
from ravelin.streaming import events, state

c = F.col


@question("feed_changes", "SELECT event_id AS id, false AS deleted FROM events WHERE ts > TIMESTAMP '2024-01-25' AND event_type <> 'error' UNION ALL SELECT event_id, true FROM events WHERE ts > TIMESTAMP '2024-01-25' AND event_type = 'error'")
def _(t):
    return t.events.where(c("ts") > F.lit("2024-01-25").cast("timestamp")).select(c("event_id").alias("id"), (c("event_type") == "error").alias("deleted"))


@question("feed_edges", "SELECT l_orderkey, l_partkey, l_linestatus = 'F' AS cut FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01'")
def _(t):
    return t.lineitem.where(c("l_shipdate") > F.lit("2001-06-01").cast("timestamp")).select("l_orderkey", "l_partkey", (c("l_linestatus") == "F").alias("cut"))


@question("metric_audit_periods", "SELECT DISTINCT date_trunc('month', d)::DATE AS period FROM (SELECT l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_shipdate + INTERVAL 40 DAY FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')")
def _(t):
    # an edit touches the periods of its values before and after; a deletion has no value after. The log holds both as JSON
    snap = lambda d: F.to_json(F.struct(F.date_format(d, "yyyy-MM-dd").alias("d")))
    log = t.lineitem.where("l_returnflag = 'R'").select(snap("l_shipdate").alias("before"), F.when(c("l_linestatus") == "F", snap(c("l_shipdate") + F.expr("interval 40 days"))).alias("after"))
    both = log.select(F.explode(F.array("before", "after")).alias("side")).where("side is not null")
    return both.select(F.to_date(F.date_trunc("month", F.to_date(F.get_json_object("side", "$.d")))).alias("period")).distinct()


@question("metric_foreign_change", "SELECT 'customer' AS type, (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AS last, (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') > TIMESTAMP '1999-01-01' AS foreign UNION ALL SELECT 'part', (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag = 'N'), (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag = 'N') > TIMESTAMP '1999-01-01'")
def _(t):
    # a refresh isn't incremental if another type that the metric reads has changed since the last one
    last = t.orders.where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("last")).select(F.lit("customer").alias("type"), "last")
    last = last.union(t.lineitem.where("l_returnflag = 'N'").agg(F.max("l_shipdate").alias("last")).select(F.lit("part").alias("type"), "last"))
    return last.withColumn("foreign", c("last") > F.lit("1999-01-01").cast("timestamp_ntz"))


@question("stream_watermark", "SELECT least(max(ts), min(CASE WHEN event_type = 'error' AND ts > TIMESTAMP '2024-01-28' THEN ts END)) AS watermark FROM events")
def _(t):
    # the earliest time that no open transaction can still fall before: the begin of the oldest open one, else the latest time
    open_ = (c("event_type") == "error") & (c("ts") > F.lit("2024-01-28").cast("timestamp_ntz"))
    return t.events.agg(F.least(F.max("ts"), F.min(F.when(open_, c("ts")))).alias("watermark"))


@question("stream_tumbling", "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(t):
    return events.settled(events.tumbling(events.stream(t.spark, t.folder), "ts", "1 day", "2 days", ["event_type"]), "tumbling", "update", ["start", "end", "event_type"])


@question("stream_sliding", "SELECT s AS start, s + INTERVAL 2 DAY AS \"end\", count(*) AS n FROM (SELECT date_trunc('day', ts) - to_days(k::INT) AS s FROM events, range(2) r(k)) GROUP BY 1")
def _(t):
    return events.settled(events.sliding(events.stream(t.spark, t.folder), "ts", "2 days", "1 day", "2 days", []), "sliding", "update", ["start", "end"])


@question("stream_session", "SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR)::INT AS new FROM events)) GROUP BY user_id, coalesce(g, 0)")
def _(t):
    # closed sessions come out of the stream, those that the watermark hasn't passed are read from its state
    state.on_rocksdb(t.spark)
    place, gap = scratch(t.spark), "6 hours"
    rows = events.timed(events.stream(t.spark, t.folder), "ts").where("user_id is not null and ts is not null")
    run = state.sessions(rows, "ts", gap, "1 day", ["user_id"]).writeStream.outputMode("append").format("parquet").option("path", f"{place}/closed").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    open_ = state.open_sessions(t.spark, f"{place}/state", gap, ["user_id"])
    both = t.spark.read.schema(open_.schema).parquet(f"{place}/closed").unionByName(open_)
    return both.select(*[c(k).cast("timestamp_ntz").alias(k) for k in ("start", "end")], "user_id", "n")


@question("stream_upsert", "SELECT user_id, event_type, event_id AS last_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    # the newest row of each external id replaces the stored one; a row that is sent again changes nothing, and other buckets stay as they are
    state.on_rocksdb(t.spark)
    place, rows = scratch(t.spark), events.stream(t.spark, t.folder)
    table = state.Buckets(t.spark, f"{place}/table", rows.schema, ["user_id", "event_type"], ["ts", "event_id"])
    state.upserts(rows, table, f"{place}/state")
    return table.table().select("user_id", "event_type", c("event_id").alias("last_id"), "value")
