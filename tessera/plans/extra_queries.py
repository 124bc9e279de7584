"""Queries over moving regions, networks, constraint tables, ciphers, sockets and the operators of the operator language."""

from __future__ import annotations

import socket
import threading
import uuid

from pyspark.sql import functions as F

from tessera.functions import blowfish
from tessera.functions import geometry as g
from tessera.functions import moving as m
from tessera.functions import moving_regions as mr
from tessera.operators import constraints, network
from tessera.plans.oplang import Session
from tessera.plans.registry import Registry, table
from tessera.session import shared_folder, spread
from tessera.streaming import streams

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col


@R.add(
    "moving_regions",
    """SELECT p_partkey, round(p_size * (1 + p_size / 2.0) / 2, 6) AS area, [0.0, 0.0]::DOUBLE[] AS lo, [p_size + p_partkey % 5, p_size / 2.0 + 1]::DOUBLE[] AS hi,
    (p_partkey % 5) / 2.0 <= 2 AND 2 < p_size + (p_partkey % 5) / 2.0 AND 0.5 < (1 + p_size / 2.0) / 2 AS within_, NULL::DOUBLE AS later FROM part""",
)
def moving_regions(spark, sf_dir):
    """A rectangle of size by 1 that becomes size by size / 2 + ... while it moves to the right, and a point that rests at (2, 0.5)."""
    size, step = c("p_size").cast("double"), (c("p_partkey") % 5).cast("double")
    at = lambda h: F.lit(f"2024-01-01 {h}:00:00").cast("timestamp")
    ring = lambda x, w, h: F.array(g.point(x, F.lit(0.0)), g.point(x + w, F.lit(0.0)), g.point(x + w, h), g.point(x, h))
    start, end = ring(F.lit(0.0), size, F.lit(0.0)), ring(step, size, size / 2 + 1)
    rests = F.array(m.unit_point(at("00"), at("12"), F.lit(2.0), F.lit(0.5), F.lit(2.0), F.lit(0.5)))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(mr.unit_region(at("00"), at("12"), start, end)).alias("r"), rests.alias("q"))
    box = mr.region_trajectory_box(c("r"))
    return p.select(
        "p_partkey", F.round(mr.area_at(c("r"), at("06")), 6).alias("area"), box["lo"].alias("lo"), box["hi"].alias("hi"),
            mr.inside_at(c("q"), c("r"), at("06")).alias("within_"),
        mr.area_at(c("r"), at("13")).alias("later"),
    )


@R.add(
    "network_distances",
    """WITH s AS (SELECT n_nationkey AS sid, n_regionkey AS k, n_nationkey + 1.0 AS len FROM nation), o AS (SELECT * FROM s WHERE sid = 3)
    SELECT s.sid, CASE WHEN s.sid = 3 THEN abs(s.len / 2 - 0.5) WHEN s.k = o.k THEN o.len - 0.5 + s.len / 2 END AS distance FROM s, o""",
)
def network_distances(spark, sf_dir):
    """Sections lead from nations to their regions; distances are those of their middles from a place on one of them."""
    sections = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("sid"), (c("n_nationkey") + 100).alias("a"), c("n_regionkey").alias("b"),
        (c("n_nationkey") + 1.0).alias("len"))
    middles = sections.select("sid", (c("len") / 2).alias("at"))
    return network.network_distances(sections, "sid", "a", "b", "len", (3, 0.5), middles, "at").select("sid", "distance")


@R.add("adjacent_sections",
    "SELECT a.n_nationkey AS sid, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def adjacent_sections(spark, sf_dir):
    sections = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("sid"), (c("n_nationkey") + 100).alias("a"), c("n_regionkey").alias("b"))
    return network.adjacent_sections(sections, "sid", "a", "b")


@R.add(
    "constraint_join",
    """WITH t AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_partkey % 20 + 0.0 AS y FROM part WHERE p_partkey < 200)
    SELECT a.k AS a, b.k AS b, 8 AS n FROM t a JOIN t b ON a.x <= b.x + 1.5 AND b.x <= a.x + 1.5 AND a.y <= b.y + 1.5 AND b.y <= a.y + 1.5 WHERE a.k < b.k""",
)
def constraint_join(spark, sf_dir):
    x, y = c("p_size").cast("double"), c("p_partkey") % 20 + 0.0
    t = table(spark, sf_dir, "part").filter("p_partkey < 200").select(c("p_partkey").alias("a"), constraints.box_constraints(x, y, x + 1.5, y + 1.5).alias("k"))
    return constraints.cjoin(t, t.toDF("b", "l"), "k", "l").filter("a < b").select("a", "b", F.size("constraints").alias("n"))


@R.add("cipher_round_trip", "SELECT n_nationkey, n_name AS plain, (2 * 8 * ceil(length(n_name) / 8.0))::INT AS digits, '4ef997456198dd78' AS known FROM nation")
def cipher_round_trip(spark, sf_dir):
    """Texts come back, and a block of zeros under a key of eight zeros gives the published digits."""
    known = blowfish.Cipher(b"\0" * 8).apply(b"\0" * 8, False).hex()
    n = table(spark, sf_dir, "nation").select("n_nationkey", blowfish.encode(c("n_name"), "some key").alias("h"))
    return n.select("n_nationkey", blowfish.decode(c("h"), "some key").alias("plain"), F.length("h").alias("digits"), F.lit(known).alias("known"))


OPERATORS = """query lineitem feed filter[(.l_quantity >= 10) and not(.l_quantity > 40) or (.l_tax = 0.08) sor FALSE and TRUE]
projectextend[l_orderkey, l_linenumber; a: .l_quantity + .l_tax - 1, b: .l_extendedprice / 4, d: .l_orderkey div 3, m: .l_orderkey mod 3,
    t: .l_returnflag + "-" + .l_linestatus,
lt: .l_tax < 0.05, le: .l_tax <= 0.05, ge: .l_quantity >= 20, eq: .l_returnflag = "R", ne: .l_returnflag # "R", has: .l_shipmode2 contains "x",
    s: (.l_linenumber = 1) sand (.l_tax > 0.01), after: .l_shipdate > .l_shipdate, n: -.l_linenumber, up: .l_linenumber++]"""


@R.add(
    "oplang_operators",
    """SELECT l_orderkey, l_linenumber, l_quantity + l_tax - 1 AS a, l_extendedprice / 4 AS b, l_orderkey // 3 AS d, l_orderkey % 3 AS m, l_returnflag || '-' || l_linestatus AS t,
    l_tax < 0.05 AS lt, l_tax <= 0.05 AS le, l_quantity >= 20 AS ge, l_returnflag = 'R' AS eq, l_returnflag <> 'R' AS ne, contains(l_returnflag || 'x',
    'x') AS has, l_linenumber = 1 AND l_tax > 0.01 AS s,
    false AS after, -l_linenumber AS n, l_linenumber + 1 AS up FROM lineitem WHERE l_quantity >= 10 AND NOT (l_quantity > 40) OR l_tax = 0.08 OR (false
    AND true)""",
)
def oplang_operators(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmode2", F.concat("l_returnflag", F.lit("x")))
    return Session(spark, {"lineitem": rows}).run(OPERATORS.replace("\n", " "))


COLLECTIONS = """query orders feed groupby[o_custkey; xs: group feed collect_set[o_shippriority7], ys: group feed collect_set[o_shippriority5]]
projectextend[o_custkey; both: .xs + .ys, more: insert(.ys, 9), joined: concat(.xs, .ys), u: union(.xs, .ys), i: intersection(.xs, .ys), d: difference(.xs,
    .ys), sd: sdiff(.ys, .xs), lo: minCommon(.xs, .ys),
eq: .xs = .ys, ne: .xs # .ys, lt: .xs < .ys, le: .xs <= .ys, gt: .xs > .ys, ge: .xs >= .ys, n: size(.xs), has: contains(.xs, 3), within: inside(.ys, .xs),
    meet: intersects(.xs, .ys)]"""


@R.add(
    "oplang_collections",
    """WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 7))) AS xs, list_sort(list_distinct(list(o_orderkey % 5))) AS ys FROM orders GROUP BY o_custkey)
    SELECT o_custkey, list_concat(xs, ys) AS both, list_append(ys, 9) AS more, list_concat(xs, ys) AS joined, list_sort(list_distinct(list_concat(xs,
    ys))) AS u, list_sort(list_intersect(xs, ys)) AS i,
    list_filter(xs, lambda x: NOT list_contains(ys, x)) AS d, list_filter(ys, lambda y: NOT list_contains(xs, y)) AS sd, list_min(list_intersect(xs,
    ys)) AS lo, xs = ys AS eq, xs <> ys AS ne, xs < ys AS lt, xs <= ys AS le,
    xs > ys AS gt, xs >= ys AS ge, len(xs)::INT AS n, list_contains(xs, 3) AS has, len(list_filter(ys, lambda y: NOT list_contains(xs, y))) = 0 AS within,
    len(list_intersect(xs, ys)) > 0 AS meet FROM g""",
)
def oplang_collections(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"o_shippriority7": c("o_orderkey") % 7, "o_shippriority5": c("o_orderkey") % 5})
    return Session(spark, {"orders": rows}).run(COLLECTIONS.replace("\n", " "))


@R.add(
    "oplang_instants",
    """SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 36 HOUR AS later, o_orderdate::TIMESTAMP - INTERVAL 1 DAY AS sooner, round(epoch(o_orderdate::TIMESTAMP - TIMESTAMP '1995-01-01') / 86400, 6) AS since,
    o_orderdate::TIMESTAMP < TIMESTAMP '1995-01-01' AS early, o_orderdate::TIMESTAMP = TIMESTAMP '1995-01-01' AS same,
    o_orderdate::TIMESTAMP > TIMESTAMP '1995-01-01' AS late,
    o_orderdate::TIMESTAMP <= TIMESTAMP '1996-01-01' AS upto FROM orders WHERE year(o_orderdate) = 1995 OR year(o_orderdate) = 1994""",
)
def oplang_instants(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderdate").cast("timestamp_ntz").alias("t"))
    text = """query orders feed filter[(year_of(.t) = 1995) or (year_of(.t) = 1994)] projectextend[o_orderkey; later: .t + create_duration(1, 43200000), sooner: .t - create_duration(1),
    since: round(duration2real(.t - theInstant(1995)), 6), early: .t < theInstant(1995), same: .t = theInstant(1995, 1, 1), late: .t > theInstant(1995),
    upto: .t <= theInstant(1996)]"""
    return Session(spark, {"orders": rows}).run(text.replace("\n", " "))


@R.add(
    "oplang_objects",
    """SELECT '(' || n_nationkey || ' "' || n_name || '")' AS value, true AS there, false AS gone, 'string' AS kind, 'filter' AS op, 25 + 1 AS n FROM nation WHERE n_regionkey = 4""",
)
def oplang_objects(spark, sf_dir):
    """Objects are made, changed, derived, listed and deleted by functions of the session."""
    session = Session(spark, {"nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")})
    session.run('query letObject(few, "nation feed filter[.n_regionkey = 1] project[n_nationkey, n_name]")')
    session.run('query updateObject(few, "nation feed filter[.n_regionkey = 4] project[n_nationkey, n_name]")')
    session.run('query deriveObject(number, "nation feed count")')
    session.run("let one = 1")
    there = session.run("query isDBObject(few)") and session.run("query getObjectTypeNL(few)") == "(rel (tuple ((n_nationkey int) (n_name string))))"
    found = {r.ObjectName for r in session.run("query getcatalog()").collect()}
    there = there and {"few", "number", "nation", "one"} <= found and {r.ObjectName for r in session.run('query dbobjects("derived")').collect()} == {"number"}
    n = session.run('query executeScript("let more = number; query more")') + session.run("query one")
    rows = session.run("query getObjectValueNL(few)")
    session.run("query deleteObject(few)")
    takes = session.run("query matchingOperators(string, string)").filter("Name = 'ldistance'").first()
    kind = "string" if takes is not None and takes.Type == "int" and session.run('query toObject("7", "int")') == 7 else "none"
    op = session.run('query getOpName("nation feed filter[.n_regionkey = 1]")')
    return rows.select("value", F.lit(there).alias("there"), F.lit(session.known("few")).alias("gone"), F.lit(kind).alias("kind"), F.lit(op).alias("op"),
        F.lit(n).alias("n"))


@R.add(
    "oplang_simjoin",
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.01""",
)
def oplang_simjoin(spark, sf_dir):
    e = c("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("a"), g.point(e[0], e[1]).alias("p"))
    session = Session(spark, {"left": rows, "right": rows.toDF("b", "q")})
    return session.run("query left feed right feed simJoin[p, q, 0.01] filter[.a < .b] project[a, b]")


class _Server:
    """A server on this host for one stream: it gives lines to every caller, or takes lines from all."""

    def __init__(self, lines: list[str] | None = None) -> None:
        self.lines, self.taken, self.server = lines, [], socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self.run, daemon=True).start()

    def run(self) -> None:
        while True:
            try:
                conn, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self.serve, args=(conn,), daemon=True).start()

    def serve(self, conn: socket.socket) -> None:
        with conn:
            if self.lines is not None:
                conn.sendall("".join(f"{x}\n" for x in self.lines).encode())
                conn.recv(1)
            else:
                data = b""
                while part := conn.recv(1 << 16):
                    data += part
                self.taken += data.decode().splitlines()


@R.add("socket_streams", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2")
def socket_streams(spark, sf_dir):
    """Rows are sent to a server as lines, and read from a server as typed rows; a line that doesn't fit is dropped."""
    nation, out = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(c("n_nationkey").alias("k"),
        c("n_name").alias("name")), f"{shared_folder(spark).rstrip('/')}/socket-{uuid.uuid4().hex}"
    nation.write.parquet(f"{out}/in")
    taker = _Server()
    q = streams.to_socket(streams.replay(spark, f"{out}/in"), "127.0.0.1", taker.port, f"{out}/state1")
    q.processAllAvailable()
    q.stop()
    giver = _Server([*taker.taken, "not a row"])
    rows = streams.from_socket(spark, "127.0.0.1", giver.port, "k int, name string")
    q = rows.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/out/{n}")).option("checkpointLocation", f"{out}/state2").start()
    try:
        for _ in range(600):
            q.processAllAvailable()
            found = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{out}/out") if q.lastProgress else None
            if found is not None and found.count() >= len(taker.taken):
                return found
            q.awaitTermination(1)
        raise TimeoutError("the lines have not come")
    finally:
        q.stop()
        for x in (taker, giver):
            x.server.close()
