"""Queries over moving values, sketches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import moving as m
from tessera.operators import sketches as k
from tessera.plans.registry import Registry, table
from tessera.streaming import streams

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col

PLACES_SQL = "SELECT user_id, ts, min(value) AS x, min(event_id % 100)::DOUBLE AS y FROM events GROUP BY user_id, ts"
STEPS_SQL = f"SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(ts) OVER w AS until FROM ({PLACES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


def trips(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("value").alias("x"), F.min(c("event_id") % 100).cast("double").alias("y"))
    return m.trips(e, ["user_id"], "ts", "x", "y")


@R.add("trip_length", f"SELECT user_id, count(*)::INT AS n, round(sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))), 4) AS len FROM ({STEPS_SQL}) WHERE until IS NOT NULL GROUP BY user_id")
def trip_length(spark, sf_dir):
    return trips(spark, sf_dir).select("user_id", F.size("units").alias("n"), F.round(m.travelled(c("units")), 4).alias("len"))


@R.add(
    "atinstant",
    f"""WITH t AS (SELECT TIMESTAMP '2024-01-10 12:00:00' AS t), s AS ({STEPS_SQL})
    SELECT user_id, round(x + (x2 - x) * epoch(t.t - ts) / epoch(until - ts), 5) AS x, round(y + (y2 - y) * epoch(t.t - ts) / epoch(until - ts), 5) AS y
    FROM s, t WHERE ts <= t.t AND t.t < until""",
)
def atinstant(spark, sf_dir):
    p = trips(spark, sf_dir).select("user_id", m.atinstant_point(c("units"), F.lit("2024-01-10 12:00:00").cast("timestamp")).alias("p"))
    return p.filter("p is not null").select("user_id", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@R.add(
    "ever_nearer_than",
    f"""WITH s AS (SELECT user_id, x - 50 AS px, y - 50 AS py, x2 - x AS dx, y2 - y AS dy FROM ({STEPS_SQL}) WHERE until IS NOT NULL),
    f AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(greatest(-(px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) END AS u FROM s)
    SELECT user_id, min(sqrt(pow(px + u * dx, 2) + pow(py + u * dy, 2))) < 3 AS near FROM f GROUP BY user_id""",
)
def ever_nearer_than(spark, sf_dir):
    return trips(spark, sf_dir).select("user_id", m.ever_nearer_than(c("units"), F.lit(50.0), F.lit(50.0), 3.0).alias("near"))


@R.add("deftime", f"SELECT user_id, min(ts) AS s, max(until) AS e, 1 AS periods FROM ({STEPS_SQL}) WHERE until IS NOT NULL GROUP BY user_id")
def deftime(spark, sf_dir):
    p = trips(spark, sf_dir).select("user_id", m.deftime(c("units")).alias("p"))
    return p.select("user_id", c("p")[0]["s"].alias("s"), F.element_at("p", -1)["e"].alias("e"), F.size("p").alias("periods"))


@R.add(
    "symbolic_passes",
    """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events)
    SELECT user_id, count(*)::INT AS units, count(*) FILTER (event_type = 'purchase') > 0 AS buys FROM l WHERE before IS NULL OR before <> event_type
    GROUP BY user_id""",
)
def symbolic_passes(spark, sf_dir):
    u = m.labels(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")
    return u.select("user_id", F.size("units").alias("units"), m.passes(c("units"), "purchase").alias("buys"))


@R.add(
    "symbolic_matches",
    """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events),
    s AS (SELECT user_id, string_agg(event_type, ';' ORDER BY ts, event_type) || ';' AS path FROM l WHERE before IS NULL OR before <> event_type
    GROUP BY user_id)
    SELECT user_id, regexp_full_match(path, '([^;]*;)*view;click;([^;]*;)*') AS hit FROM s""",
)
def symbolic_matches(spark, sf_dir):
    u = m.labels(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")
    return u.select("user_id", m.matches(c("units"), "* view click *").alias("hit"))


@R.add("bloom_contains", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bloom_contains(spark, sf_dir):
    od = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    maybe = k.bloom_contains(table(spark, sf_dir, "customer"), "c_custkey", k.bloom_filter(od, "o_custkey")).filter("maybe")
    return maybe.join(od, c("c_custkey") == c("o_custkey"), "left_semi").agg(F.count("*").alias("n"))


@R.add("lossy_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def lossy_counts(spark, sf_dir):
    return k.lc_frequent(k.lossy_counts(table(spark, sf_dir, "events"), "event_type", 0.01), 1).select("value", "n")


@R.add(
    "outliers",
    """WITH o AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id FROM o WHERE n >= 5
    AND abs(value - m) > 2.5 * s""",
)
def outliers(spark, sf_dir):
    return k.outliers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 2.5).select("event_id")


@R.add("stream_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def stream_filter(spark, sf_dir):
    s = streams.replay(spark, f"{sf_dir}/events.parquet")
    return streams.run_bounded(s.filter("event_type = 'purchase' and value > 50").select("event_id", "user_id"))


@R.add("stream_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    s = streams.replay(spark, f"{sf_dir}/events.parquet")
    return streams.run_bounded(s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete")


@R.add("stream_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    s = streams.replay(spark, f"{sf_dir}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    w = streams.windowed(s, "ts", "1 hour", None, "400 days", ["event_type"], n=F.count("*"))
    return streams.run_bounded(w, "complete").select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.add("variable_tuples", "SELECT event_id, event_type FROM events")
def variable_tuples(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return streams.typed(streams.variable(e), "value", "event_id long, event_type string")
