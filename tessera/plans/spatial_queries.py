"""Queries over space, metric spaces and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import graph, spatial
from tessera.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col

BOX_SQL = "SELECT p_partkey, p_size * 10.0 AS x1, p_size * 10.0 + p_partkey % 13 AS x2, p_retailprice AS y1, p_retailprice + p_partkey % 9 AS y2 FROM part"


def boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = c("p_size") * 10.0, c("p_retailprice")
    return p.select("p_partkey", x.alias("x1"), (x + c("p_partkey") % 13).alias("x2"), y.alias("y1"), (y + c("p_partkey") % 9).alias("y2"))


@R.add("spatial_join", f"WITH b AS ({BOX_SQL}) SELECT a.p_partkey AS a, b.p_partkey AS b FROM b a JOIN b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE a.p_partkey < b.p_partkey")
def spatial_join(spark, sf_dir):
    a = boxes(spark, sf_dir)
    b = a.toDF("q", "u1", "u2", "v1", "v2")
    out = spatial.spatial_join(a, b, spatial.box_of("x1", "y1", "x2", "y2"), spatial.box_of("u1", "v1", "u2", "v2"), refine=c("p_partkey") < c("q"))
    return out.select(c("p_partkey").alias("a"), c("q").alias("b"))


@R.add("window_intersects", f"SELECT p_partkey FROM ({BOX_SQL}) WHERE x1 <= 200 AND x2 >= 100 AND y1 <= 1200 AND y2 >= 1000")
def window_intersects(spark, sf_dir):
    return spatial.window_intersects(boxes(spark, sf_dir), spatial.box_of("x1", "y1", "x2", "y2"), 100, 1000, 200, 1200).select("p_partkey")


POINT_SQL = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def points(spark, sf_dir, a="vec_id", x="x", y="y"):
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias(a), c("embedding")[0].cast("double").alias(x), c("embedding")[1].cast("double").alias(y))


@R.add("distance_join", f"WITH p AS ({POINT_SQL}) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.01")
def distance_join(spark, sf_dir):
    out = spatial.distance_join(points(spark, sf_dir), points(spark, sf_dir, "q", "u", "v"), ("x", "y"), ("u", "v"), 0.01)
    return out.filter("vec_id < q").select(c("vec_id").alias("a"), c("q").alias("b"), F.round("distance", 6).alias("d"))


@R.add("closest_pairs", "WITH p AS (SELECT list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT round(sqrt(pow(a.e[1] - b.e[3], 2) + pow(a.e[2] - b.e[4], 2)), 9) AS d FROM p a, p b ORDER BY d LIMIT 10")
def closest_pairs(spark, sf_dir):
    e = c("embedding").cast("array<double>")
    b = table(spark, sf_dir, "embeddings").select(e[2].alias("u"), e[3].alias("v"))
    return spatial.closest_pairs(points(spark, sf_dir), b, ("x", "y"), ("u", "v"), 10, 0.001).select(F.round("distance", 9).alias("d"))


@R.add("distance_scan", "SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 15")
def distance_scan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    target = [float(x) for x in e.filter("vec_id = 7").first().embedding]
    d = spatial.euclid(c("embedding").cast("array<double>"), F.array(*map(F.lit, target)))
    return spatial.distance_scan(e, d, 15, ["vec_id"]).select("vec_id")


@R.add("range_search", "SELECT vec_id FROM embeddings WHERE list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) <= 1.2")
def range_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    target = [float(x) for x in e.filter("vec_id = 7").first().embedding]
    return spatial.range_search(e, spatial.euclid(c("embedding").cast("array<double>"), F.array(*map(F.lit, target))), 1.2).select("vec_id")


@R.add("metric_join", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.2")
def metric_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    pivots = [list(r.e) for r in e.orderBy("vec_id").limit(2).collect()]
    out = spatial.metric_join(e, e.toDF("q", "f"), "e", "f", spatial.euclid, 1.2, pivots)
    return out.filter("vec_id < q").select(c("vec_id").alias("a"), c("q").alias("b"))


@R.add(
    "geometry",
    """SELECT p_partkey, round(sqrt(p_size * p_size + 16.0), 6) AS d, round((degrees(atan2(4.0, p_size)) + 360) % 360, 6) AS dir, p_size * 4.0 AS area, 2.0 * (p_size + 4) AS around,
    p_size > 10 AS holds FROM part""",
)
def geometry(spark, sf_dir):
    s = c("p_size").cast("double")
    zero = F.lit(0.0)
    ring = F.array(g.point(zero, zero), g.point(s, zero), g.point(s, F.lit(4.0)), g.point(zero, F.lit(4.0)))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(ring).alias("r"), g.point(zero, zero).alias("a"), g.point(s, F.lit(4.0)).alias("b"))
    return p.select(
        "p_partkey", F.round(g.distance(c("a"), c("b")), 6).alias("d"), F.round(g.direction(c("a"), c("b")), 6).alias("dir"), g.area(c("r")).alias("area"),
            g.region_perimeter(c("r")).alias("around"),
        g.inside(g.point(F.lit(10.0), F.lit(1.0)), c("r")).alias("holds"),
    )


#: A forest over whole tables: customers and suppliers below nations below regions. Keys are shifted so that nodes differ.
EDGE_SQL = """SELECT n_nationkey + 100 AS a, n_regionkey::BIGINT AS b FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer
UNION ALL SELECT s_suppkey + 1000000000000, s_nationkey + 100 FROM supplier"""
#: node, root (its region) and depth.
NODE_SQL = """SELECT r_regionkey::BIGINT AS node, r_regionkey::BIGINT AS root, 0 AS depth FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, 1 FROM nation
UNION ALL SELECT c_custkey + 1000, n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_suppkey + 1000000000000, n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    long = lambda x: x.cast("long")
    n = t("nation").select((long(c("n_nationkey")) + 100).alias("a"), long(c("n_regionkey")).alias("b"))
    cu = t("customer").select(c("c_custkey") + 1000, long(c("c_nationkey")) + 100)
    return n.union(cu).union(t("supplier").select(c("s_suppkey") + 1_000_000_000_000, long(c("s_nationkey")) + 100))


@R.add("connected_components", f"SELECT node, root FROM ({NODE_SQL})")
def connected_components(spark, sf_dir):
    return graph.connected_components(edges(spark, sf_dir))


@R.add("shortest_paths", f"SELECT node, depth::DOUBLE AS distance FROM ({NODE_SQL}) WHERE root = 1")
def shortest_paths(spark, sf_dir):
    return graph.shortest_paths(edges(spark, sf_dir), 1, "b", "a")


@R.add("match_path", "SELECT c_custkey AS n0, o_orderkey AS n1, l_partkey AS n2 FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 49")
def match_path(spark, sf_dir):
    cu = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    od = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(cu, c("o_custkey") == c("c_custkey"), "left_semi")
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_partkey")
    return graph.match_path([(od, "o_custkey", "o_orderkey"), (li, "l_orderkey", "l_partkey")])


ITEMS_SQL = """WITH b AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS items FROM orders GROUP BY o_custkey), n AS (SELECT count(*) AS n FROM b),
    p AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders), k AS (SELECT ps, unnest(range(1, (1 << len(ps))::BIGINT)) AS mask FROM p),
    s AS (SELECT list_filter(ps, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s FROM k), f AS (SELECT s, count(*) AS f FROM s JOIN b ON list_has_all(b.items,
    s.s) GROUP BY s)"""


@R.add("frequent_itemsets", f"{ITEMS_SQL} SELECT array_to_string(s, ',') AS Itemset, round(f / n, 6) AS Support FROM f, n WHERE f >= ceil(0.05 * n)")
def frequent_itemsets(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("items"))
    return graph.frequent_itemsets(b, "items", 0.05).select(F.array_join("Itemset", ",").alias("Itemset"), F.round("Support", 6).alias("Support"))


@R.add(
    "strong_rules",
    f"""{ITEMS_SQL}, g AS (SELECT * FROM f, n WHERE f >= ceil(0.05 * n)), r AS (SELECT s, f, unnest(s) AS c FROM g WHERE len(s) > 1)
    SELECT array_to_string(a.s, ',') AS Antecedent, c AS Consequent, round(r.f / a.f, 6) AS Confidence FROM r JOIN g a ON a.s = list_filter(r.s,
    lambda x: x <> r.c) WHERE r.f / a.f >= 0.5""",
)
def strong_rules(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("items"))
    out = graph.strong_rules(b, "items", 0.05, 0.5)
    return out.select(F.array_join("Antecedent", ",").alias("Antecedent"), F.array_join("Consequent", ",").alias("Consequent"),
        F.round("Confidence", 6).alias("Confidence"))
