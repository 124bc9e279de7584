"""Queries over moving values, geometry and sketches, each with the same values in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import moving as m
from tessera.functions import regions
from tessera.functions import scalars as s
from tessera.functions.moving_forms import form
from tessera.operators import graph, patterns, sketches, spatial
from tessera.plans.registry import Registry, table
from tessera.plans.spatial_queries import EDGE_SQL, POINT_SQL, edges, points
from tessera.plans.stream_queries import STEPS_SQL, trips
from tessera.session import spread

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col

UNITS_SQL = f"SELECT *, epoch(until) - epoch(ts) AS span, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS way FROM ({STEPS_SQL}) WHERE until IS NOT NULL"
SPAN = "2024-01-05 00:00:00", "2024-01-12 06:00:00"
AT = "2024-01-08 12:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


def span():
    """A period set of one half-open interval."""
    return F.array(F.struct(*m.interval(at(SPAN[0]), at(SPAN[1]))))


@R.add(
    "moving_ends",
    f"""WITH u AS ({UNITS_SQL}) SELECT user_id, min(ts) AS first_, arg_min(x, ts) AS x1, max(until) AS last_, arg_max(y2, ts) AS y2, count(*) FILTER (x <> x2 OR y <> y2)::INT AS segments,
    bool_or(ts <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < until) AS there, round(sum(span), 3) AS seconds FROM u GROUP BY user_id""",
)
def moving_ends(spark, sf_dir):
    u = c("units")
    t = trips(spark, sf_dir).select("user_id", m.initial_point(u).alias("a"), m.final_point(u).alias("b"), F.size(m.trajectory(u)).alias("segments"),
        m.present(u, at(AT)).alias("there"), F.round(m.duration(u), 3).alias("seconds"))
    return t.select("user_id", c("a.inst").alias("first_"), c("a.val.x").alias("x1"), c("b.inst").alias("last_"), c("b.val.y").alias("y2"), "segments", "there",
        "seconds")


@R.add(
    "moving_atperiods",
    f"""WITH u AS ({UNITS_SQL}), k AS (SELECT *, greatest(ts, TIMESTAMP '{SPAN[0]}') AS s, least(until, TIMESTAMP '{SPAN[1]}') AS e FROM u)
    SELECT user_id, count(*) FILTER (s < e)::INT AS pieces, round(coalesce(sum(way * (epoch(e) - epoch(s)) / span) FILTER (s < e), 0), 4) AS way FROM k
    GROUP BY user_id""",
)
def moving_atperiods(spark, sf_dir):
    cut = trips(spark, sf_dir).select("user_id", m.atperiods_point(c("units"), span()).alias("u"))
    return cut.select("user_id", F.size("u").alias("pieces"), F.round(m.travelled(c("u")), 4).alias("way"))


@R.add(
    "moving_velocity",
    f"""SELECT user_id, round(max(way / span) * 1000, 6) AS fastest, round(max((x2 - x) / span) * 1000, 6) AS east, round(min((x2 - x) / span * 86400), 4) AS slope,
    count(*) FILTER (least(x, x2) = lo)::INT AS lows, count(*) FILTER (greatest(x, x2) = hi)::INT AS highs, any_value(lo) AS lo, any_value(hi) AS hi
    FROM (SELECT *, min(least(x, x2)) OVER (PARTITION BY user_id) AS lo, max(greatest(x, x2)) OVER (PARTITION BY user_id) AS hi FROM ({UNITS_SQL}))
    GROUP BY user_id""",
)
def moving_velocity(spark, sf_dir):
    u = c("units")
    days = lambda w: (m.seconds(w["e"]) - m.seconds(w["s"])) / m.DAY
    real = F.transform(u, lambda w: m.unit_real(w["s"], w["e"], F.lit(0.0), (w["x2"] - w["x1"]) / days(w), w["x1"]))
    # ends of a linear unit are reached up to rounding, so extremes are compared on a coarser scale
    t = spread(trips(spark, sf_dir)).select("user_id", real.alias("r"), m.speed(u).alias("sp"), m.velocity(u).alias("v"))
    most = lambda a, f: F.round(F.array_max(F.transform(a, f)) * 1000, 6)
    rounded = F.transform("r", lambda w: F.struct(F.round(F.least(w["c"], w["c"] + w["b"] * days(w)), 6).alias("lo"),
        F.round(F.greatest(w["c"], w["c"] + w["b"] * days(w)), 6).alias("hi")))
    t = t.select("user_id", "r", "sp", "v", rounded.alias("k"), F.round(m.minimum(c("r")), 6).alias("lo"), F.round(m.maximum(c("r")), 6).alias("hi"),
        F.size(m.atmin(c("r"))).alias("n"), F.size(m.atmax(c("r"))).alias("k2"))
    return t.filter("n > 0 and k2 > 0").select(
        "user_id", most("sp", lambda w: w["c"]).alias("fastest"), most("v", lambda w: w["x1"]).alias("east"),
            F.round(F.array_min(F.transform(m.derivative(c("r")), lambda w: w["c"])), 4).alias("slope"),
        F.size(F.filter("k", lambda w: w["lo"] == c("lo"))).alias("lows"), F.size(F.filter("k", lambda w: w["hi"] == c("hi"))).alias("highs"), "lo", "hi",
    )


LABEL_SQL = """SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS until FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events)
    WHERE before IS NULL OR before <> event_type"""


@R.add(
    "symbolic_parts",
    f"""WITH u AS ({LABEL_SQL}) SELECT user_id, arg_min(event_type, ts) AS first_, arg_max(event_type, ts) AS last_, count(*) FILTER (event_type = 'view')::INT AS views, count(*) FILTER (event_type = 'click')::INT AS periods,
    count(*) FILTER (event_type = 'purchase') > 0 AS ever, count(*) FILTER (event_type <> 'purchase') = 0 AS only_, count(*) FILTER (ts < TIMESTAMP '{SPAN[1]}'
    AND coalesce(until > TIMESTAMP '{SPAN[0]}', true))::INT AS within_,
    arg_max(event_type, ts) FILTER (ts <= TIMESTAMP '{AT}') AS now_ FROM u GROUP BY user_id""",
)
def symbolic_parts(spark, sf_dir):
    u = c("units")
    flags = lambda v: F.transform(u, lambda w: m.unit_const(w["s"], w["e"], w["v"] == v, w["lc"], w["rc"]))
    t = m.labels(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")
    return t.select(
        "user_id", m.initial(u)["val"].alias("first_"), m.final(u)["val"].alias("last_"), F.size(m.at(u, "view")).alias("views"),
            F.size(m.when_true(flags("click"))).alias("periods"),
        m.sometimes(flags("purchase")).alias("ever"), m.always(flags("purchase")).alias("only_"), F.size(m.atperiods(u, span())).alias("within_"),
            m.atinstant(u, at(AT)).alias("now_"),
    )


@R.add(
    "symbolic_rewrite",
    f"""WITH u AS ({LABEL_SQL}), s AS (SELECT user_id, string_agg(event_type, ';' ORDER BY ts) || ';' AS path FROM u GROUP BY user_id)
    SELECT user_id, regexp_replace(path, 'view;click;', 'interest;') AS path FROM s WHERE path LIKE '%view;click;%'""",
)
def symbolic_rewrite(spark, sf_dir):
    t = m.labels(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type").select("user_id",
        m.rewrite(c("units"), ["view", "click"], "interest").alias("u")).filter("u is not null")
    return t.select("user_id", F.concat(F.array_join(F.transform("u", lambda w: w["v"]), ";"), F.lit(";")).alias("path"))


@R.add(
    "trajectory_distances",
    """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 11)::DOUBLE AS b FROM part), d AS (SELECT *, sqrt(pow(a - b, 2) + 1) AS d1, sqrt(pow(a + 2 - b, 2) + 9) AS d2 FROM p)
    SELECT p_partkey, round(greatest(d1, d2), 6) AS frechet, round(d1 + d2, 6) AS dtw,
    CASE WHEN abs(a - b) <= 3 AND abs(a + 2 - b) <= 3 THEN 1.0 WHEN abs(a - b) <= 3 OR abs(a + 2 - b) <= 3 THEN 0.5 ELSE 0.0 END AS lcss FROM d""",
)
def trajectory_distances(spark, sf_dir):
    """Of two ways of two points each: (a, 0), (a + 2, 3) and (b, 1), (b, 0)."""
    a, b = c("p_size").cast("double"), (c("p_partkey") % 11).cast("double")
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(g.point(a, F.lit(0.0)), g.point(a + 2, F.lit(3.0))).alias("p"),
        F.array(g.point(b, F.lit(1.0)), g.point(b, F.lit(0.0))).alias("q"))
    return p.select("p_partkey", F.round(m.frechet(c("p"), c("q")), 6).alias("frechet"), F.round(patterns.dtw(c("p"), c("q")), 6).alias("dtw"),
        m.lcss(3.0)(c("p"), c("q")).alias("lcss"))


N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
MERIDIAN_SQL = f"""(SELECT p_partkey, lat, 2 * sqrt({N!r}) / (1 + {N!r}) AS e, 6378137.0 / (1 + {N!r}) * (1 + pow({N!r}, 2) / 4 + pow({N!r}, 4) / 64) AS r FROM (SELECT p_partkey, (p_partkey % 80)::DOUBLE AS lat FROM part))"""


@R.add(
    "geometry_parts",
    f"""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b FROM part), k AS (SELECT p_partkey, r, atan(sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat))))) AS xi FROM {MERIDIAN_SQL})
    SELECT p.p_partkey, round(a + sqrt(a * a + b * b), 6) AS len, [0.0, 0.0] AS lo, [a, b] AS hi, 2 AS segments, b >= 1 AS meet, CASE WHEN b > 0 THEN 4
    ELSE 2 END AS hull,
    CASE WHEN b > 2 THEN 3 ELSE 2 END AS simple, 500000.0 AS east,
    round(0.9996 * r * (xi + ({N!r} / 2 - 2 * pow({N!r}, 2) / 3 + 5 * pow({N!r}, 3) / 16) * sin(2 * xi) + (13 * pow({N!r}, 2) / 48 - 3 * pow({N!r},
    3) / 5) * sin(4 * xi) + 61 * pow({N!r}, 3) / 240 * sin(6 * xi)), 3) AS north,
    3500000.0 AS gk, sqrt(a * a + b * b) <= 9 AS near, CASE WHEN b > 2 THEN 1 ELSE 2 END AS parts FROM p JOIN k ON p.p_partkey = k.p_partkey""",
)
def geometry_parts(spark, sf_dir):
    """The way (0, 0), (a, 0), (a, b), with a segment across, its corners, and places on meridians."""
    a, b = c("p_size").cast("double"), (c("p_partkey") % 7).cast("double")
    zero, lat = F.lit(0.0), (c("p_partkey") % 80).cast("double")
    corners = F.array(g.point(zero, zero), g.point(a, zero), g.point(a, b), g.point(zero, b))
    across = F.array(g.segment(a / 2, F.lit(1.0), a * 2, F.lit(1.0)))
    bend = F.array(g.point(zero, zero), g.point(F.lit(5.0), b), g.point(F.lit(10.0), zero))
    utm, gk = g.utm(lat, F.lit(9.0)), g.gauss_krueger(lat, F.lit(9.0))
    pair = F.array(g.segment(zero, zero, F.lit(1.0), zero), g.segment(F.when(b > 2, 1.0).otherwise(2.0), zero, F.lit(3.0), b))
    two = F.array(g.segment(zero, zero, a, zero), g.segment(zero, zero, a, b))
    p = table(spark, sf_dir, "part").select("p_partkey", two.alias("way"), F.array(g.segment(a, zero, a, b)).alias("side"), corners.alias("corners"),
        across.alias("across"), bend.alias("bend"), utm.alias("utm"), gk.alias("gk"), pair.alias("pair"), g.point(zero, zero).alias("o"),
            g.point(a, b).alias("far"))
    return p.select(
        "p_partkey", F.round(g.length(c("way")), 6).alias("len"), g.bbox(c("way"))["lo"].alias("lo"), g.bbox(c("way"))["hi"].alias("hi"),
            F.size("way").alias("segments"), g.lines_intersect(c("side"), c("across")).alias("meet"),
        F.size(g.convex_hull(c("corners"))).alias("hull"), F.size(g.simplify(c("bend"), 2.0)).alias("simple"), F.round(c("utm.x"), 3).alias("east"),
            F.round(c("utm.y"), 3).alias("north"), F.round(c("gk.x"), 3).alias("gk"),
        g.distance_within(c("o"), c("far"), 9.0).alias("near"), F.size(g.components(c("pair"))).alias("parts"),
    )


@R.add(
    "region_relations",
    """SELECT p_partkey, CASE WHEN p_size < 40 THEN '111111111' WHEN p_size = 40 THEN '001011111' ELSE '001001111' END AS bits, p_size = 40 AS adjacent_, p_size < 40 AS overlaps_, p_size = 40 AS touches_,
    round((2 + p_size / 10.0) * 5, 6)::DOUBLE AS left_, round((8 - p_size / 10.0) * 5 + 50, 6)::DOUBLE AS right_ FROM part""",
)
def region_relations(spark, sf_dir):
    """Squares that are shifted against each other, and the cells of two points in a box of 10 by 10."""
    x = c("p_size") / 10
    square = lambda u, low, high: F.array(F.array(*(g.point(p, q) for p, q in ((u, low), (u + 4, low), (u + 4, high), (u, high)))))
    pts = F.array(g.point(F.lit(2.0), F.lit(5.0)), g.point(x, F.lit(5.0)))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", square(F.lit(0.0), F.lit(0.0), F.lit(4.0)).alias("a"),
        square(x, F.lit(1.0), F.lit(5.0)).alias("b"), pts.alias("pts"))
    p = p.select("p_partkey", "p_size", regions.toprel(c("a"), c("b")).alias("bits"), regions.adjacent(c("a"), c("b")).alias("adjacent_"),
        regions.overlaps(c("a"), c("b")).alias("overlaps_"), regions.touches(c("a"), c("b")).alias("touches_"),
            regions.voronoi(c("pts"), (0.0, 0.0), (10.0, 10.0)).alias("v"))
    left = F.when(c("p_size") < 20, g.ring_area(c("v")[1])).when(c("p_size") > 20, g.ring_area(c("v")[0])).otherwise(20.0)
    return p.select("p_partkey", "bits", "adjacent_", "overlaps_", "touches_", F.round(left, 6).alias("left_"), F.round(100 - left + 0.0, 6).alias("right_"))


@R.add(
    "moving_forms",
    f"""WITH u AS ({UNITS_SQL}), l AS ({LABEL_SQL}), k AS (SELECT *, greatest(ts, TIMESTAMP '{SPAN[0]}') AS s, least(until, TIMESTAMP '{SPAN[1]}') AS e FROM u),
    p AS (SELECT user_id, round(max(x + (x2 - x) * (epoch(TIMESTAMP '{AT}') - epoch(ts)) / span) FILTER (ts <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < until),
    5) AS x, count(*) FILTER (s < e AND way > 0)::INT AS ways,
    min(s) FILTER (s < e) AS since, bool_or(ts <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < until) AS there, count(*) FILTER (s < e) > 0 AS any_ FROM k
    GROUP BY user_id),
    q AS (SELECT user_id, count(*) FILTER (event_type = 'view')::INT AS views, list_sort(list(DISTINCT event_type)) AS kinds,
    bool_or(event_type = 'purchase') AS buys FROM l GROUP BY user_id)
    SELECT p.*, views, kinds, buys FROM p JOIN q USING (user_id)""",
)
def moving_forms(spark, sf_dir):
    labels = m.labels(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type").select("user_id", c("units").alias("lab"))
    t = trips(spark, sf_dir).join(labels, "user_id").withColumns({"six": at(AT), "week": span(), "view": F.lit("view"), "purchase": F.lit("purchase")})
    f = lambda text: form(t, text)
    return t.select(
        "user_id", F.round(f("get units:pos from [units, six] where units:t = six:t")["x"], 5).alias("x"),
            F.size(f("get units:pos from [units, week] where units:t = week:t")).alias("ways"),
        f("get units:t from [units, week] where units:t = week:t")[0]["s"].alias("since"),
            f("exists(get * from [units, six] where units:t = six:t)").alias("there"),
        f("exists(get * from [units, week] where units:t = week:t)").alias("any_"), F.size(f("get * from [lab, view] where lab:v = view:v")).alias("views"),
            f("get lab:v from lab").alias("kinds"),
        f("exists (get * from [lab, purchase] where lab:v = purchase:v)").alias("buys"),
    )


@R.add("z_cells", "SELECT p_partkey, list_sum(list_transform(range(0, 16), lambda i: (((p_size >> i) & 1) << (2 * i)) + (((p_partkey >> i) & 1) << (2 * i + 1))))::BIGINT AS z FROM (SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size FROM part)")
def z_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", s.z_order(c("p_size"), c("p_partkey")).alias("z"))


@R.add(
    "dbscan",
    f"""WITH RECURSIVE p AS ({POINT_SQL}), n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02), k AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4),
    e AS (SELECT n.i, n.j FROM n JOIN k a ON n.i = a.i JOIN k b ON n.j = b.i), r(id, other) AS (SELECT i, i FROM k UNION SELECT r.id, e.j FROM r
    JOIN e ON r.other = e.i),
    o AS (SELECT id, min(other) AS cluster FROM r GROUP BY id), b AS (SELECT n.i, min(cluster) AS cluster FROM n JOIN o ON n.j = o.id GROUP BY n.i)
    SELECT vec_id, coalesce(o.cluster, b.cluster) AS cluster FROM p LEFT JOIN o ON vec_id = o.id LEFT JOIN b ON vec_id = b.i""",
)
def dbscan(spark, sf_dir):
    return spatial.dbscan(points(spark, sf_dir), "vec_id", "x", "y", 0.02, 4)


def _rank_sql(rounds, damping=0.85):
    out = f"WITH l AS (SELECT DISTINCT a, b FROM ({EDGE_SQL})), d AS (SELECT a, count(*) AS n FROM l GROUP BY a), v AS (SELECT a AS node FROM l UNION SELECT b FROM l), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c)"
    for i in range(1, rounds + 1):
        out += f""", g{i} AS (SELECT v.node, coalesce(sum(r.rank / d.n), 0) AS got FROM v LEFT JOIN l ON l.b = v.node LEFT JOIN r{i - 1} r ON r.node = l.a LEFT JOIN d ON d.a = l.a GROUP BY v.node),
        r{i} AS (SELECT node, (1 - {damping}) / c.n + {damping} * (got + (1 - (SELECT sum(got) FROM g{i})) / c.n) AS rank FROM g{i}, c)"""
    return f"{out} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@R.add("page_rank", _rank_sql(5))
def page_rank(spark, sf_dir):
    return graph.page_rank(edges(spark, sf_dir), rounds=5).select("node", F.round("rank", 9).alias("rank"))


@R.add("reservoir", "SELECT event_id FROM events ORDER BY md5('7:' || event_id::VARCHAR), event_id LIMIT 50")
def reservoir(spark, sf_dir):
    return sketches.reservoir(table(spark, sf_dir, "events"), 50, c("event_id"), 7).select("event_id")


@R.add("cm_count", "SELECT user_id, count(*)::BIGINT AS estimate FROM events GROUP BY user_id")
def cm_count(spark, sf_dir):
    """Users that are alone in a cell are counted by the sketch, the others by their events, so the counts are exact however many users there are."""
    e = table(spark, sf_dir, "events")
    sketch = sketches.count_min(e, "user_id", 8192, 7, ends=True)
    return sketches.cm_count(e.select("user_id").distinct(), "user_id", sketch, 8192, 7, e).select("user_id", "estimate")


@R.add("ams_second_moment", "SELECT sum(n * n)::BIGINT AS f2 FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def ams_second_moment(spark, sf_dir):
    """Few values in many cells: the median row has no collision."""
    return sketches.ams_estimate(sketches.ams(table(spark, sf_dir, "events"), "event_type", 4096, 9)).select(c("f2").cast("long").alias("f2"))


@R.add("distinct_count", "SELECT count(DISTINCT event_type) AS n FROM events")
def distinct_count(spark, sf_dir):
    """Few values are counted exactly."""
    return sketches.distinct_count(table(spark, sf_dir, "events"), "event_type")
