"""Queries over rasters, regions, histograms, patterns, nested values and distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import histograms as h
from tessera.functions import moving as m
from tessera.functions import regions
from tessera.operators import distribution, graph, order, patterns, raster, relational, sketches, timeseries
from tessera.operators.propertygraph import PropertyGraph
from tessera.plans.registry import Registry, table
from tessera.plans.spatial_queries import NODE_SQL, POINT_SQL, edges, points
from tessera.session import spread
from tessera.sources import tables

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col

RASTER_SQL = f"SELECT floor(x / 0.05)::INT AS cell_x, floor(y / 0.05)::INT AS cell_y, count(*)::DOUBLE AS v FROM ({POINT_SQL}) GROUP BY ALL"


def grid(spark, sf_dir):
    return raster.tile(points(spark, sf_dir), c("x"), c("y"), 0.05, F.count("*").cast("double"))


@R.add("raster_tile", RASTER_SQL)
def raster_tile(spark, sf_dir):
    return grid(spark, sf_dir)


@R.add("raster_neighbourhood", f"WITH r AS ({RASTER_SQL}) SELECT a.cell_x, a.cell_y, sum(b.v) AS v FROM r a JOIN r b ON abs(a.cell_x - b.cell_x) <= 1 AND abs(a.cell_y - b.cell_y) <= 1 GROUP BY ALL")
def raster_neighbourhood(spark, sf_dir):
    return raster.neighbourhood(grid(spark, sf_dir), 1, F.sum)


@R.add("raster_map2", f"WITH r AS ({RASTER_SQL}) SELECT cell_x, cell_y, v * 3 AS v FROM r")
def raster_map2(spark, sf_dir):
    r = grid(spark, sf_dir)
    return raster.map2(r, raster.map1(r, lambda v: v * 2), lambda a, b: a + b)


@R.add("raster_coarser", f"WITH r AS ({RASTER_SQL}) SELECT floor(cell_x / 4.0)::INT AS cell_x, floor(cell_y / 4.0)::INT AS cell_y, round(avg(v), 6) AS v FROM r GROUP BY ALL")
def raster_coarser(spark, sf_dir):
    return raster.upsample(grid(spark, sf_dir), 4).withColumn("v", F.round("v", 6))


def _square(x, y, size):
    return F.array(F.array(*(g.point(a, b) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size)))))


@R.add(
    "region_operations",
    """WITH s AS (SELECT p_partkey, p_size / 10.0 AS x, greatest(4 - p_size / 10.0, 0) * 3 AS c FROM part)
    SELECT p_partkey, round(c, 6)::DOUBLE AS common, round(31 - c, 6)::DOUBLE AS both_, round(16 - c, 6)::DOUBLE AS rest, CASE WHEN x < 4 THEN 'overlap'
    WHEN x = 4 THEN 'meet' ELSE 'disjoint' END AS rel FROM s""",
)
def region_operations(spark, sf_dir):
    x = c("p_size") / 10
    b = F.array(F.array(*(g.point(u, v) for u, v in ((x, F.lit(1.0)), (x + 5, F.lit(1.0)), (x + 5, F.lit(4.0)), (x, F.lit(4.0))))))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", _square(F.lit(0.0), F.lit(0.0), 4.0).alias("a"), b.alias("b"))
    p = p.select("p_partkey", *(f(c("a"), c("b")).alias(n) for n,
        f in (("i", regions.region_intersection), ("u", regions.region_union), ("m", regions.region_minus), ("rel", regions.topology))))
    size = lambda r: F.round(F.aggregate(F.transform(r, g.ring_area), F.lit(0.0), lambda t, v: t + v), 6)
    return p.select("p_partkey", size(c("i")).alias("common"), size(c("u")).alias("both_"), size(c("m")).alias("rest"), "rel")


@R.add(
    "histogram_value",
    "SELECT [count(*) FILTER (l_quantity < 10), count(*) FILTER (l_quantity >= 10 AND l_quantity < 20), count(*) FILTER (l_quantity >= 20 AND l_quantity < 60)]::VARCHAR AS counts FROM lineitem",
)
def histogram_value(spark, sf_dir):
    made = h.create(table(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 20, 60])
    return made.select(F.concat(F.lit("["), F.array_join(c("histogram")["counts"].cast("array<long>"), ", "), F.lit("]")).alias("counts"))


@R.add("knn_join", f"WITH p AS ({POINT_SQL}) SELECT a.vec_id AS a, b.vec_id AS b FROM p a, LATERAL (SELECT vec_id FROM p ORDER BY pow(p.x - a.x, 2) + pow(p.y - a.y, 2), p.x, p.y LIMIT 3) b")
def knn_join(spark, sf_dir):
    return patterns.knn_join(points(spark, sf_dir), points(spark, sf_dir, "q", "u", "v"), "vec_id", ("x", "y"), ("u", "v"), 3,
        0.05).select(c("vec_id").alias("a"), c("q").alias("b"))


@R.add("optics")
def optics(spark, sf_dir):
    return patterns.optics(points(spark, sf_dir), "vec_id", "x", "y", 0.05, 4)


@R.add(
    "sequence_pattern",
    """SELECT DISTINCT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) JOIN events c ON b.user_id = c.user_id AND (b.ts, b.event_id) < (c.ts, c.event_id)
    WHERE a.event_type = 'signup' AND b.event_type = 'error' AND b.value > 90 AND c.event_type = 'purchase' AND c.value > 95""",
)
def sequence_pattern(spark, sf_dir):
    steps = [c("event_type") == "signup", (c("event_type") == "error") & (c("value") > 90), (c("event_type") == "purchase") & (c("value") > 95)]
    return patterns.sequence_pattern(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], steps)


@R.add(
    "map_match",
    f"""WITH p AS ({POINT_SQL}), r AS (SELECT range AS road, range / 10.0 AS x FROM range(-10, 11)), d AS (SELECT vec_id, road, sqrt(pow(p.x - r.x, 2) + pow(greatest(abs(y) - 0.1, 0), 2)) AS away FROM p, r),
    m AS (SELECT vec_id, arg_min(road, away) AS road, min(away) AS away FROM d WHERE away <= 0.2 GROUP BY vec_id) SELECT vec_id, road::BIGINT AS road,
    round(away, 6) AS away FROM p LEFT JOIN m USING (vec_id)""",
)
def map_match(spark, sf_dir):
    roads = spark.range(-10, 11).select(c("id").alias("road"), (c("id") / 10).alias("x1"), F.lit(-0.1).alias("y1"), (c("id") / 10).alias("x2"),
        F.lit(0.1).alias("y2"))
    return patterns.map_match(points(spark, sf_dir), roads, ["vec_id"], "x", "y", 0.2).select("vec_id", "road", F.round("away", 6).alias("away"))


@R.add("hub_labels", f"SELECT node, root AS hub, depth::DOUBLE AS distance FROM ({NODE_SQL}) WHERE root IN (0, 3)")
def hub_labels(spark, sf_dir):
    e = edges(spark, sf_dir)
    return patterns.hub_labels(e.union(e.select("b", "a")), [0, 3], graph.shortest_paths).select("node", F.col("hub").cast("long").alias("hub"), "distance")


@R.add("tilted_time", "WITH a AS (SELECT epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events) SELECT CASE WHEN age < 86400 THEN 0 WHEN age < 864000 THEN 1 ELSE 2 END AS level, (age // CASE WHEN age < 86400 THEN 8640 WHEN age < 864000 THEN 86400 ELSE 864000 END)::BIGINT AS slot, count(*) AS n FROM a GROUP BY ALL")
def tilted_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return sketches.tilted_time(e, c("ts"), F.lit("2024-02-01").cast("timestamp"), [86_400, 864_000], n=F.count("*"))


@R.add("dmap", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def dmap(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return distribution.dmap(distribution.distribute_hash(n, 4, "n_nationkey"), lambda f: f.assign(n_name=f.n_name.str.upper()), n.schema)


@R.add("conversation_turns", "SELECT conv_id, count(*)::INT AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    nested = relational.nest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turns")
    return nested.select("conv_id", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: t["role"]), ">").alias("roles"))


@R.add("speed", "WITH s AS (SELECT user_id, ts, x, lead(x) OVER w AS x2, lead(ts) OVER w AS until FROM (SELECT user_id, ts, min(value) AS x FROM events GROUP BY user_id, ts) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, round(max(abs(x2 - x) / epoch(until - ts)), 6) AS top FROM s WHERE until IS NOT NULL GROUP BY user_id")
def speed(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("value").alias("x")).withColumn("y", F.lit(0.0))
    return m.trips(e, ["user_id"], "ts", "x", "y").select("user_id", F.round(m.maximum(m.speed(c("units"))), 6).alias("top"))


@R.add("split_at_gaps", "WITH s AS (SELECT user_id, ts, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 14400 AS late FROM (SELECT DISTINCT user_id, ts FROM events)), t AS (SELECT user_id, sum(late::INT) OVER (PARTITION BY user_id ORDER BY ts) AS trip FROM (SELECT user_id, ts, coalesce(late, false) AS late FROM s)), g AS (SELECT user_id, trip, count(*) AS n FROM t GROUP BY ALL) SELECT user_id, count(*) AS trips FROM g WHERE n > 1 GROUP BY user_id")
def split_at_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("value").alias("x")).withColumn("y", F.lit(0.0))
    return m.trips(e, ["user_id"], "ts", "x", "y", 14_400).groupBy("user_id").agg(F.count("*").alias("trips"))


@R.add("xth", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 41")
def xth(spark, sf_dir):
    return order.xth(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 42, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@R.add("intstream", "SELECT range::INT AS Elem FROM range(5, 26)")
def intstream(spark, sf_dir):
    return tables.intstream(spark, 5, 25)


@R.add("realstream", "SELECT round(1 + range * 0.25, 6) AS Elem FROM range(0, 9)")
def realstream(spark, sf_dir):
    return tables.realstream(spark, 1.0, 3.0, 0.25).select(F.round("Elem", 6).alias("Elem"))


@R.add("collect_box", f"SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM ({POINT_SQL})")
def collect_box(spark, sf_dir):
    return tables.collect_box(points(spark, sf_dir), "x", "y", "x", "y")


@R.add(
    "property_graph",
    """SELECT c_name AS c, l_quantity AS q, s_name AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey = s_nationkey AND l_quantity > 48""",
)
def property_graph(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    p = PropertyGraph()
    p.add_nodes("customer", t("customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    p.add_nodes("order", t("orders").select("o_orderkey"), "o_orderkey")
    p.add_nodes("supplier", t("supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    p.add_edges("placed", t("orders").select("o_custkey", F.col("o_orderkey").alias("o")), "o_custkey", "customer", "o", "order")
    p.add_edges("supplied", t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_suppkey", "supplier", "l_orderkey", "order")
    return p.match("(a:customer)-[:placed]->(b:order)<-[l:supplied]-(s:supplier)", "a.c_nationkey = s.s_nationkey and l.l_quantity > 48",
        ["a.c_name as c", "l.l_quantity as q", "s.s_name as s"])


@R.add("trend", "SELECT event_type, round(regr_slope(value, event_id), 9) AS slope, round(regr_r2(value, event_id), 6) AS r2 FROM events GROUP BY event_type")
def trend(spark, sf_dir):
    out = timeseries.trend(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return out.select("event_type", F.round("slope", 9).alias("slope"), F.round("r2", 6).alias("r2"))


@R.add("autocorrelation", "SELECT event_type, 1 AS lag, round(corr(value, before), 6) AS r FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events) GROUP BY event_type")
def autocorrelation(spark, sf_dir):
    out = timeseries.autocorrelation(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", [1])
    return out.select("event_type", "lag", F.round("r", 6).alias("r"))


@R.add("line_reference", "SELECT p_partkey, round(least(p_size / 10.0, 4), 6) AS x, round(greatest(p_size / 10.0 - 4, 0), 6) AS y FROM part")
def line_reference(spark, sf_dir):
    line = g.polyline(F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4)))))
    p = table(spark, sf_dir, "part").select("p_partkey", g.line_at(line, c("p_size") / 10).alias("p"))
    return p.select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
