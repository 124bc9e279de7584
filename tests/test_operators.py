"""Operators on small tables against plain Python, with nulls, ties and empty inputs."""

import datetime as dt
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import histograms as h
from tessera.functions import moving as m
from tessera.functions import regions
from tessera.functions import scalars as s
from tessera.operators import distribution, graph, order, patterns, raster, relational, sketches, spatial
from tessera.plans.dialect import Dialect, DialectError
from tessera.plans.oplang import QueryError, Session
from tessera.sources import files
from tessera.streaming import streams


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_order_operators(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 4)
    df = spark.createDataFrame([(i, None if i == 3 else i * i % 7) for i in range(23)], "i int, v int").repartition(5)
    vs = [None if i == 3 else i * i % 7 for i in range(23)]
    got = dict(rows(order.extend_last(df, ["i"], d=(lambda last: F.col("v") - last("v"), -1)).select("i", "d")))
    assert got == {i: -1 if i == 0 else None if None in (vs[i], vs[i - 1]) else vs[i] - vs[i - 1] for i in range(23)}
    got = dict(rows(order.extend_next(df, ["i"], n=lambda after: after("v")).select("i", "n")))
    assert got == {i: vs[i + 1] if i < 22 else None for i in range(23)}
    got = {r.i: (r.a, r.b, r.c) for r in order.extend_aggr(df, ["i"], a=("sum", "v"), b=("max", "v"), c=("count", "v")).collect()}
    for i in range(23):
        seen = [v for v in vs[: i + 1] if v is not None]
        assert got[i] == (sum(seen), max(seen), len(seen))
    got = dict(rows(order.sliding_window(df, 5, 3, ["i"], n=F.sum("i"))))
    assert got == {w: sum(range(3 * w, 3 * w + 5)) for w in range(7)}
    assert [r.i for r in order.tail(df, 3, ["i"]).collect()] == [20, 21, 22]
    assert sorted(r.i for r in order.nth(df, 10, ["i"]).collect()) == [0, 10, 20]
    assert [r.i for r in order.xth(df, 5, ["i desc"]).collect()] == [18]
    assert order.is_ordered(df, ["i"], ["i"]) and not order.is_ordered(df, ["v"], ["i"])
    assert rows(order.obojoin(df.limit(0), df.select(F.col("i").alias("j")), ["i"], ["j"])) == []
    assert sorted(order.reduce_runs(df.withColumn("k", F.floor(F.col("i") / 9)), ["k"], ["i"], n=F.count("*")).select("run", "n").collect()) == [(0, 9), (1, 9), (2, 5)]


def test_matchbelow(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([None, rng.random()]), rng.choice("ab")) for i in range(60)]
    right = [(rng.random(), j, rng.choice("ab")) for j in range(40)] + [(None, 99, "a")]
    a, b = spark.createDataFrame(left, "i int, t double, k string"), spark.createDataFrame(right, "u double, j int, q string")
    for by in (None, ("k", "q")):
        got = {r.i: r.j for r in relational.matchbelow(a, b, "t", "u", by, ["j"]).collect()}
        for i, t, k in left:
            below = [(u, j) for u, j, q in right if u is not None and t is not None and u <= t and (by is None or q == k)]
            assert got[i] == (max(below)[1] if below else None)


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "i int, s string, x double")
    fields = relational.to_fields(df.distinct(), "i")
    assert ("s", "string", None) in [(r.Field, r.Type, r.Value) for r in fields.collect()]
    assert sorted(rows(relational.from_fields(fields, ["i"], {"s": "string", "x": "double"}))) == [(1, "a", None), (2, None, 1.5)]
    assert rows(relational.unnest(relational.nest(df, ["i"], "r"), "r").orderBy("i")) == rows(df.orderBy("i"))
    assert relational.delete(df, df.filter("i = 2"), ["i", "s"]).count() == 1
    assert relational.validate_attr(df.toDF("a b", "1x", "a_b")).columns == ["a_b", "a_1x", "a_b_2"]
    assert relational.extract(df.limit(0), "i", 7) == 7 and not relational.exist(df.limit(0)) and relational.ensure(df, 3)
    assert relational.krdup(df, ["s"], ["i"]).count() == 2
    assert sorted(rows(relational.fold(df.withColumn("r", F.monotonically_increasing_id()), "i", lambda a, x: a + x, 0))) == [(5,)]
    assert relational.whiledo(1, lambda x: x < 20, lambda x: x * 3) == [1, 3, 9, 27]
    assert [r.i for r in relational.sortby(df, "x", "i").collect()] == [1, 2, 2]
    with pytest.raises(ValueError):
        relational.replace_attr(df, nothing=F.lit(1))


def test_scalars(spark):
    x = lambda v: F.lit(v)
    r = one(
        spark, s.compare(x(None).cast("int"), x(1)), s.substring(x("abcdef"), 2, 4), s.sentences(x("A b. C? D")), s.dice(x("night"), x("nacht")), s.trim_all(x("  a \t b ")), s.trim_all_undefined(x("  ")),
        s.file_extension(x("a/b.tar.gz")), s.text_to_int(x("7x")), s.dms_to_degrees(x(10), x(30), x(36)), s.duration_to_real(s.create_duration(2, 43_200_000)), s.tie(F.array(x(5), x(2), x(1)), lambda a, b: a - b),
        s.cumulate(F.array(x(1), x(2), x(3)), lambda a, b: a + b), s.sort_array(F.array(x(3), x(-4), x(1)), F.abs), s.tie(F.array().cast("array<int>"), lambda a, b: a + b), s.switch((x(False), 1), (x(True), 2), default=3),
        s.set_(3, 1, 3), s.put(F.array(x(1), x(2)), 9, 1), s.rectangle(3, 1), s.cell_number(s.rectangle(0.5, 2.5, 0.5, 1.5), 0.0, 0.0, 1.0, 1.0, 10),
    )
    assert list(r)[:8] == [-1, "bcd", ["A b.", "C?", "D"], 0.25, "a b", None, "gz", None]
    assert math.isclose(r[8], 10.51) and r[9] == 2.5 and r[10] == 2 and r[11] == [1, 3, 6] and r[12] == [1, 3, -4] and r[13] is None and r[14] == 2
    assert r[15] == [1, 3] and r[16] == [1, 9] and r[17] is None and r[18] == [1, 2, 3, 11, 12, 13]


def square(x, y, size):
    return F.array(*(g.point(F.lit(float(a)), F.lit(float(b))) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))))


def test_geometry(spark):
    pts = F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (2, 2))))
    flat = F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0.01), (2, 0), (3, 3))))
    r = one(spark, g.convex_hull(pts).alias("h"), g.simplify(flat, 0.1).alias("s"), g.length(g.polyline(flat)).alias("l"), g.point_line_distance(g.point(F.lit(1.0), F.lit(5.0)), g.edges(square(0, 0, 2))).alias("d"),
            g.lines_intersect(g.edges(square(0, 0, 2)), g.edges(square(1, 1, 2))).alias("x"), g.regions_intersect(F.array(square(0, 0, 9)), F.array(square(1, 1, 2))).alias("y"), g.utm(F.lit(51.5), F.lit(7.5)).alias("u"))
    assert [(p.x, p.y) for p in r.h] == [(0, 0), (4, 0), (4, 4), (0, 4)] and [(p.x, p.y) for p in r.s] == [(0, 0), (2, 0), (3, 3)]
    assert r.d == 3 and r.x and r.y and abs(r.u.x - 395_866) < 200 and abs(r.u.y - 5_706_600) < 900 and r.u.zone == 32


def test_regions(spark):
    a, b, c = F.array(square(0, 0, 4)), F.array(square(2, 2, 4)), F.array(square(1, 1, 1))
    area = lambda r: sum(abs(sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 for ring in r)
    r = one(spark, regions.region_union(a, b).alias("u"), regions.region_intersection(a, b).alias("i"), regions.region_minus(a, b).alias("m"), regions.region_minus(a, c).alias("h"), g.area(regions.region_minus(a, c)).alias("ha"),
            *(regions.topology(x, y).alias(n) for n, x, y in (("t1", a, b), ("t2", a, F.array(square(9, 9, 1))), ("t3", a, c), ("t4", c, a), ("t5", a, a), ("t6", a, F.array(square(4, 0, 4))), ("t7", a, F.array(square(0, 0, 2))))))
    assert area(r.u) == 28 and area(r.i) == 4 and area(r.m) == 12 and len(r.h) == 2 and r.ha == 15
    assert [r.t1, r.t2, r.t3, r.t4, r.t5, r.t6, r.t7] == ["overlap", "disjoint", "contains", "inside", "equal", "meet", "covers"]
    cells = one(spark, regions.voronoi(F.array(g.point(F.lit(1.0), F.lit(1.0)), g.point(F.lit(3.0), F.lit(1.0))), (0, 0), (4, 2)).alias("c")).c
    assert [area([x]) for x in cells] == [4, 4]


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 1.6, 3.9, 4.0, None)], "x double")
    r = h.create(df, "x", [0, 1, 2, 4]).select("*", h.mean(F.col("histogram")).alias("m"), h.find_bin(F.col("histogram"), F.lit(1.0)).alias("b"), h.find_maxbin(F.col("histogram")).alias("top"), h.insert(F.col("histogram"), F.lit(0.2)).alias("i"), h.shrink(F.col("histogram"), 0.5, 4.0).alias("s")).first()
    assert list(r.histogram.counts) == [1, 2, 1] and r.m == (0.5 + 3 + 3) / 4 and r.b == 1 and r.top == [1] and list(r.i.counts) == [2, 2, 1] and list(r.s.bounds) == [1, 2, 4]


def test_moving(spark):
    t = lambda minute: F.lit(dt.datetime(2024, 1, 1, 0, minute)).cast("timestamp")
    flags = F.array(m.unit_const(t(0), t(10), F.lit(True)), m.unit_const(t(10), t(20), F.lit(False)), m.unit_const(t(30), t(40), F.lit(True)))
    other = F.array(m.unit_const(t(5), t(35), F.lit(True)))
    way = F.array(m.unit_point(t(0), t(10), *(F.lit(float(v)) for v in (0, 0, 10, 0))), m.unit_point(t(10), t(20), *(F.lit(float(v)) for v in (10, 0, 10, 5))))
    r = one(spark, m.deftime(flags).alias("d"), m.when_true(flags).alias("w"), m.lifted(flags, other, lambda a, b: a & b).alias("l"), m.atinstant_point(way, t(5)).alias("p"), m.minimum(m.distance_to(way, F.lit(5.0), F.lit(3.0))).alias("n"),
            m.travelled(way).alias("len"), m.atperiods_point(way, F.array(F.struct(*m.interval(t(5), t(15))))).alias("c"), m.compact(F.array(m.unit_const(t(0), t(1), F.lit(1)), m.unit_const(t(1), t(2), F.lit(1)), m.unit_const(t(2), t(3), F.lit(2)))).alias("k"),
            m.present(way, t(20)).alias("e"), m.deftime(F.filter(flags, lambda u: F.lit(False))).alias("z"), m.frechet(F.array(g.point(F.lit(0.0), F.lit(0.0)), g.point(F.lit(1.0), F.lit(0.0))), F.array(g.point(F.lit(0.0), F.lit(2.0)), g.point(F.lit(1.0), F.lit(2.0)))).alias("f"),
            m.lcss(0.5)(F.array(g.point(F.lit(0.0), F.lit(0.0)), g.point(F.lit(1.0), F.lit(0.0))), F.array(g.point(F.lit(1.0), F.lit(0.1)))).alias("q"), m.matches(F.array(m.unit_const(t(0), t(1), F.lit("a")), m.unit_const(t(1), t(2), F.lit("b"))), "a (b | c)").alias("y"))
    minutes = lambda ps: [(p.s.minute, p.e.minute) for p in ps]
    assert minutes(r.d) == [(0, 20), (30, 40)] and minutes(r.w) == [(0, 10), (30, 40)] and [(u.s.minute, u.e.minute, u.v) for u in r.l] == [(5, 10, True), (10, 20, False), (30, 35, True)]
    assert (r.p.x, r.p.y) == (5, 0) and math.isclose(r.n, 3) and r.len == 15 and [(u.x1, u.y1, u.x2, u.y2) for u in r.c] == [(5, 0, 10, 0), (10, 0, 10, 2.5)]
    assert [(u.s.minute, u.e.minute, u.v) for u in r.k] == [(0, 2, 1), (2, 3, 2)] and not r.e and r.z == [] and r.f == 2 and r.q == 1 and r.y


def test_spatial_and_patterns(spark):
    rng = random.Random(5)
    pts = [(i, rng.random(), rng.random()) for i in range(150)]
    a = spark.createDataFrame(pts, "i int, x double, y double")
    b = a.toDF("j", "u", "v")
    d = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    got = {(r.i, r.j) for r in spatial.distance_join(a, b, ("x", "y"), ("u", "v"), 0.07).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if d(p, q) <= 0.07}
    got = patterns.knn_join(a, b, "i", ("x", "y"), ("u", "v"), 3, 0.02).collect()
    assert len(got) == 450
    for p in pts[:20]:
        assert [r.j for r in sorted((r for r in got if r.i == p[0]), key=lambda r: r["rank"])] == [q[0] for q in sorted(pts, key=lambda q: d(p, q))[:3]]
    near = {p[0]: [q[0] for q in pts if d(p, q) <= 0.06] for p in pts}
    core = {i for i in near if len(near[i]) >= 4}
    root = {i: i for i in core}
    for _ in range(150):
        for i in core:
            root[i] = min(root[j] for j in near[i] if j in core)
    want = {i: root[i] if i in core else min((root[j] for j in near[i] if j in core), default=None) for i in near}
    assert {r.i: r.cluster for r in spatial.dbscan(a, "i", "x", "y", 0.06, 4).collect()} == want
    seen = patterns.optics(a, "i", "x", "y", 0.06, 4).collect()
    assert len(seen) == 150 and sum(r.reach is None and r.core is not None for r in seen) == len({c for c in want.values() if c is not None})
    assert sum(r.n for r in patterns.kmeans(a.select(F.array("x", "y").alias("v")), "v", 4).collect()) == 150
    move = [(o, t, o * 0.1 + (5 if o > 2 and t > 1 else 0), t * 1.0) for o in range(5) for t in range(4)]
    f = patterns.flocks(spark.createDataFrame(move, "o int, t int, x double, y double"), "o", "t", "x", "y", 0.11, 3, 2)
    assert sorted((list(r.members), r["first"], r["last"]) for r in f.collect()) == [([0, 1, 2], 2, 3), ([0, 1, 2, 3, 4], 0, 1)]
    roads = spark.createDataFrame([("h", 0.0, 0.5, 1.0, 0.5), ("v", 0.5, 0.0, 0.5, 1.0)], "road string, x1 double, y1 double, x2 double, y2 double")
    for r in patterns.map_match(a, roads, ["i"], "x", "y", 0.2).collect():
        away = {"h": abs(r.y - 0.5), "v": abs(r.x - 0.5)}
        assert r.road == (min(away, key=away.get) if min(away.values()) <= 0.2 else None)
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a"), (3, 1, "a"), (3, 9, "b")], "k int, t int, e string")
    steps = [F.col("e") == "a", F.col("e") == "b"]
    assert sorted(r.k for r in patterns.sequence_pattern(ev, ["k"], ["t"], steps).collect()) == [1, 3]
    assert sorted(r.k for r in patterns.sequence_pattern(ev, ["k"], ["t"], steps, 5, "t").collect()) == [1]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 4.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (9, 8, 1.0)], "a int, b int, w double")
    assert {r.node: r.distance for r in graph.shortest_paths(e, 1, cost="w").collect()} == {1: 0, 3: 1, 2: 2, 4: 3}
    assert {r.node: r.root for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert graph.connected_components(e.limit(0)).collect() == []
    assert abs(sum(r["rank"] for r in graph.page_rank(e).collect()) - 1) < 1e-9
    both = e.select("a", "b", "w").union(e.select("b", "a", "w"))
    labels = patterns.hub_labels(both, [1, 3], lambda x, h: graph.shortest_paths(x, h, cost="w"))
    assert rows(patterns.hub_distance(labels, spark.createDataFrame([(2, 3)], "p int, q int"), "p", "q")) == [(2, 3, 1.0)]


def test_raster_and_distribution(spark):
    r = spark.createDataFrame([(x, y, float(x + 2 * y)) for x in range(4) for y in range(4)], "cell_x int, cell_y int, v double")
    assert {t for t in rows(raster.slope(r, 1.0).select("v"))} == {(math.hypot(1, 2),)}
    assert raster.neighbourhood(r, 1, F.count).filter("v = 9").count() == 4
    assert raster.map2(r, raster.clip(r, 0, 0, 1, 1), lambda a, b: a + b).count() == 4 and raster.upsample(r, 2).count() == 4
    assert raster.contour_cells(r, 4.5).count() > 0 and rows(raster.at(r, 2, 1)) == [(4.0,)]
    assert distribution.slot_counts(distribution.distribute_hash(r, 3, "cell_x")).agg(F.sum("count")).first()[0] == 16
    assert distribution.dmap(r, lambda f: f.assign(v=f.v * 2), r.schema).agg(F.max("v")).first()[0] == 18


def test_sketches(spark):
    df = spark.createDataFrame([(f"k{min(i % 50, i % 7)}",) for i in range(5000)], "k string")
    exact = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    counts = {r.value: (r.n, r.missed) for r in sketches.lossy_counts(df, "k", 0.2).collect()}
    assert all(n <= exact[v] <= n + missed for v, (n, missed) in counts.items())
    bloom = sketches.bloom_filter(df, "k", 1 << 15)
    probe = sketches.bloom_contains(spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,)], "k string"), "k", bloom, 1 << 15).collect()
    assert all(r.maybe for r in probe if r.k in exact) and sum(r.maybe for r in probe) < len(exact) + 20
    assert sketches.reservoir(df.withColumn("i", F.monotonically_increasing_id()), 10, F.col("i")).count() == 10


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("skip\nskip\n# no\n1;x\n2;\n")
    assert rows(files.csvimport(spark, f"{tmp_path}/a.csv", "i int, s string", 2, "#", ";")) == [(1, "x"), (2, None)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1]]]}, "properties": {"n": 1}}]}))
    r = files.geojson(spark, f"{tmp_path}/a.geojson").first()
    assert r.Kind == "Polygon" and [(p.x, p.y) for p in r.Parts[0]] == [(0, 0), (1, 0), (0, 1)] and json.loads(r.Properties) == {"n": 1}
    (tmp_path / "a.gpx").write_text('<gpx xmlns="x"><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    assert [(r.Track, r.Lat, r.Lon, r.Elevation) for r in files.gpximport(spark, f"{tmp_path}/a.gpx").collect()] == [(0, 1, 2, 3)]
    (tmp_path / "a.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2\n3 -9\n")
    assert sorted((r.cell_x, r.cell_y, r.v) for r in files.esri_grid(spark, f"{tmp_path}/a.asc").collect()) == [(0, 0, 3), (0, 1, 1), (1, 1, 2)]
    body = struct.pack("<i2d", 1, 7.0, 8.0)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    r = files.shpimport(spark, f"{tmp_path}/a.shp").first()
    assert (r.No, r.Kind, r.Parts[0][0].x) == (1, "point", 7)
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, 2, 32 + 64 + 1, 1 + 5 + 4)
    field = lambda n, w: n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15
    (tmp_path / "a.dbf").write_bytes(head + field("NAME", 5) + field("N", 4) + b"\r" + b" ab     12" + b"*gone    1")
    assert rows(files.dbimport(spark, f"{tmp_path}/a.dbf", "NAME string, N int")) == [("ab", 12)]
    (tmp_path / "a.ais").write_text("!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C\nnoise\n")
    r = files.importais(spark, f"{tmp_path}/a.ais").first()
    assert r.Mmsi == 477553000 and abs(r.Lat - 47.58) < 0.01 and abs(r.Lon + 122.35) < 0.01
    files.sqlexport(spark.createDataFrame([(1, "it's"), (None, None)], "i int, s string"), f"{tmp_path}/sql", "t")
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/sql").collect()) == ["INSERT INTO t VALUES (1, 'it''s');", "INSERT INTO t VALUES (NULL, NULL);"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("ab", 12, 1.5, True, dt.date(2024, 1, 2)), (None, None, None, None, None)], "s string, i int, x double, b boolean, d date")
    files.db3export(df, f"{tmp_path}/o.dbf")
    assert rows(files.dbimport(spark, f"{tmp_path}/o.dbf", "s string, i int, x double, b string, d date")) == [("ab", 12, 1.5, "T", dt.date(2024, 1, 2)), (None, None, None, None, None)]
    shapes = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]],), (None,)], f"p array<{files.POINTS}>")
    files.shpexport(shapes, f"{tmp_path}/o.shp", "p", "region")
    got = sorted(files.shpimport(spark, f"{tmp_path}/o.shp").collect(), key=lambda r: r.No)
    assert sorted(r.Kind for r in got) == ["null", "region"] and [len(x) for r in got if r.Parts for x in r.Parts] == [3, 3]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, k int").repartition(3).write.parquet(f"{tmp_path}/in")
    got = []
    c = streams.Coordinator()
    c.register("zero", "k = 0", lambda df, n: got.extend(r.i for r in df.collect()))
    q = c.start(streams.replay(spark, f"{tmp_path}/in", 1), f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == list(range(0, 30, 3))
    s = streams.replay(spark, f"{tmp_path}/in").groupBy("k").count()
    assert sorted(rows(streams.run_bounded(s, "complete"))) == [(0, 10), (1, 10), (2, 10)]


def test_languages(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    q = Session(spark, {"t": df})
    assert q.run("query t feed count") == 3 and q.run("query t feed filter[.i > 1] sum[i]") == 5
    assert q.run("let x = t feed head[2]") is None and q.run("query x feed count") == 2
    assert q.run('query t feed filter[.s # "a"] count') == 1 and q.run("query t feed sortby[i desc] extract[s]") is None
    assert q.run("query intstream(1, 10) feed filter[.Elem mod 2 = 0] count") == 5 and q.run("query realstream(0, 1, 0.25) count") == 5
    assert sorted(rows(q.run("query intstream(1, 4) extend_last[d: .Elem - ..Elem]"))) == [(1, None), (2, 1), (3, 1), (4, 1)]
    assert sorted(rows(q.run("query intstream(1, 6) slidingwindow[3, 2; s: group feed sum[Elem]]"))) == [(0, 6), (1, 12)]
    assert q.run("query t feed isOrderedBy[i]") and q.run("query t feed some[.i = 3]")
    for bad in ("query nothing feed", "query t feed filter[", "query t feed t feed", "query t feed head[.i]", "query t feed filter[eval(1)]"):
        with pytest.raises(QueryError):
            q.run(bad)
    df.createOrReplaceTempView("t")
    d = Dialect(spark)
    assert rows(d.run('select [i] from t where [i > 1, s # "a"]')) == [(2,)]
    assert rows(d.run("select nonempty s from t orderby s last 1")) == [("b",)]
    assert sorted(rows(d.run("intersection [select i from t where i < 3, select i from t where i > 1]"))) == [(2,)]
    d.run("create table n columns [a: int, b: string]")
    d.run('insert into n values [1, "x"]')
    assert rows(d.run("select * from n")) == [(1, "x")]
    for bad in ("select a", "from t select a", "", "select a from t last 2"):
        with pytest.raises(DialectError):
            d.run(bad)


def test_property_graph(spark):
    from tessera.operators.propertygraph import PatternError, PropertyGraph

    graph_ = PropertyGraph()
    graph_.add_nodes("person", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string"), "id")
    graph_.add_edges("knows", spark.createDataFrame([(1, 2, 5), (2, 3, 1), (3, 1, 2), (2, 1, 9)], "x int, y int, w int"), "x", "person", "y", "person")
    out = graph_.match("(a:person)-[e:knows]->(b)<-[:knows]-(c)", "a.id <> c.id and e.w > 1", ["a.name as a", "b.name as b", "c.name as c"])
    assert sorted(rows(out)) == [("b", "a", "c"), ("c", "a", "b")]
    assert sorted(rows(graph_.match("(a)-[:knows]->(b)-[:knows]->(a)", None, ["a.id", "b.id"]))) == [(1, 2), (2, 1)]
    for bad in ("(a)-[:likes]->(b)", "a", "(a)-[:knows]-(b)"):
        with pytest.raises(PatternError):
            graph_.match(bad)


def test_time_series(spark):
    from tessera.operators import timeseries as ts

    df = spark.createDataFrame([("k", i, 3.0 * i + 1 + (i % 2)) for i in range(20)] + [("z", 0, None)], "k string, t int, v double")
    assert abs(ts.trend(df.filter("t % 2 = 0"), ["k"], "t", "v").filter("k = 'k'").first().slope - 3) < 1e-9
    got = [r.smooth for r in ts.exponential_smoothing(df, ["k"], ["t"], "v", 0.5).orderBy("t").collect()]
    want = [1.0]
    for i in range(1, 20):
        want.append(0.5 * (3 * i + 1 + i % 2) + 0.5 * want[-1])
    assert all(math.isclose(a, b) for a, b in zip(got, want, strict=True))
    line = df.filter("k = 'k'").withColumn("v", F.col("t") * 2.0)
    assert [round(r.value, 6) for r in ts.forecast_ar(line, ["k"], ["t"], "v", 2, 3).orderBy("step").collect()] == [40, 42, 44]
    assert {round(r.effect, 6) for r in ts.season(df.filter("k = 'k'").withColumn("v", F.col("t") % 2 * 1.0).withColumn("p", F.col("t") % 2), ["k"], "p", "v").collect()} == {-0.5, 0.5}
    assert round(ts.autocorrelation(line, ["k"], ["t"], "v", [1]).first().r, 6) == 1


def test_lines_and_periods(spark):
    pts = F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4))))
    line, other = g.polyline(pts), g.polyline(F.array(g.point(F.lit(2.0), F.lit(-1.0)), g.point(F.lit(2.0), F.lit(1.0))))
    t = lambda h: F.lit(dt.datetime(2024, 1, 1, h)).cast("timestamp")
    r = one(spark, g.line_at(line, F.lit(5.0)).alias("p"), g.line_locate(line, g.point(F.lit(9.0), F.lit(3.0))).alias("at"), g.crossings(line, other).alias("x"), g.rotate(line, 0, 0, 90)[0].alias("r"), g.length(g.scale(g.translate(line, 1, 1), 2)).alias("l"),
            m.repeated(F.array(m.unit_const(t(0), t(1), F.lit(7))), 86400, 3).alias("u"), m.the_period(2024, 2).alias("m"))
    assert (r.p.x, r.p.y, r.at, r.l) == (4, 1, 7, 16) and [(p.x, p.y) for p in r.x] == [(2, 0)] and math.isclose(r.r.y2, 4)
    assert [u.s.day for u in r.u] == [1, 2, 3] and (r.m[0].s, r.m[0].e) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))


def test_tables(spark, tmp_path):
    from tessera.sources import tables

    df = spark.createDataFrame([(i, i % 3) for i in range(200)], "i int, k int")
    for name in ("stored_k", "stored_o"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        assert tables.consume(df, "stored_k", ["k"]).count() == 200
        tables.clear(spark, "stored_k")
        assert spark.table("stored_k").count() == 0
        stored = tables.oconsume(df, "stored_o", ["k"], 4)
        plan = stored.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and stored.count() == 200
    finally:
        for name in ("stored_k", "stored_o"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert tables.tconsume(df, "seen").count() == 200 and tables.dumpstream(df, f"{tmp_path}/dump").count() == 200
    assert spark.read.text(f"{tmp_path}/dump").count() == 200
    picked = tables.sample(df, 20, 0.05, F.col("i"))
    assert 15 <= picked.count() <= 60 and rows(picked) == rows(tables.sample(df, 20, 0.05, F.col("i")))
    assert tables.sample(df.limit(0), 20, 0.05, F.col("i")).count() == 0 and tables.realstream(spark, 1, 0, 0.5).count() == 0
    assert [r.Elem for r in tables.realstream(spark, 0, 1, 0.5).collect()] == [0, 0.5, 1]
    assert tables.probability_filter(df, 0.0, F.col("i")).count() == 0 and tables.probability_filter(df, 1.0, F.col("i")).count() == 200


def test_closest_pairs_and_neighbours_without_places(spark):
    from tessera.operators import patterns, spatial

    a = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, None, None)], "i int, x double, y double")
    b = spark.createDataFrame([(9, 3.0, 4.0), (8, None, 2.0)], "j int, u double, v double")
    got = spatial.closest_pairs(a, b, ("x", "y"), ("u", "v"), 2, 1.0).collect()
    assert [(r.i, r.j, r.distance) for r in got] == [(1, 9, 5.0)]
    assert spatial.closest_pairs(a.limit(0), b, ("x", "y"), ("u", "v"), 2, 1.0).collect() == []
    assert [(r.i, r.j, r["rank"]) for r in patterns.knn_join(a, b, "i", ("x", "y"), ("u", "v"), 3, 0.5).collect()] == [(1, 9, 1)]
    assert patterns.knn_join(a, b.limit(0), "i", ("x", "y"), ("u", "v"), 3, 1.0).collect() == []


def test_matchbelow_over_ranges_and_hot_keys(spark):
    import random

    from tessera.operators import relational as r

    rng = random.Random(2)
    left = [(i, rng.choice([None, *range(100)]), rng.choice(["hot"] * 9 + ["cold"])) for i in range(600)]
    right = [(rng.randrange(100), rng.choice(["hot"] * 9 + ["cold"]), f"v{i}") for i in range(80)]
    a = spark.createDataFrame(left, "i int, at int, k string")
    b = spark.createDataFrame(right, "since int, k2 string, v string")
    best = lambda at, k: max(((s, v) for s, k2, v in right if at is not None and s <= at and k in (None, k2)), default=(None, None))
    got = {x.i: (x.since, x.v) for x in r.matchbelow(a, b, "at", "since", ("k", "k2"), ["v"]).collect()}
    assert got == {i: best(at, k) for i, at, k in left}
    got = {x.i: x.since for x in r.matchbelow(a, b, "at", "since", kept=["v"]).collect()}
    assert got == {i: best(at, None)[0] for i, at, _ in left}


def test_fold_of_equal_rows(spark):
    from tessera.operators import relational as r

    df = spark.range(100_000).selectExpr("cast(1 as long) as v")
    assert r.fold(df, "v", lambda a, b: a + b, F.lit(0).cast("long")).first()[0] == 100_000
    assert r.fold(df.limit(0), "v", lambda a, b: a + b, F.lit(0).cast("long")).first()[0] == 0


def test_streams_drop_what_does_not_fit(spark, tmp_path):
    import pytest

    from tessera.streaming import streams

    df = spark.createDataFrame([('{"a": 1}',), ("broken",), ('{"a": "x"}',), (None,)], "value string")
    assert [x.a for x in streams.typed(df, "value", "a int").collect()] == [1]
    df.write.parquet(f"{tmp_path}/in")
    slow = streams.replay(spark, f"{tmp_path}/in").withColumn("z", F.udf(lambda v: __import__("time").sleep(8))("value"))
    with pytest.raises(TimeoutError):
        streams.run_bounded(slow, timeout=1)


def test_csv_after_some_lines(spark, tmp_path):
    from tessera.sources import files

    for n in (1, 2):
        with open(f"{tmp_path}/{n}.csv", "w") as f:
            f.write("title\n\nmore\n" + "".join(f"{n},{i}\n" for i in range(50)) + "#end\n")
    got = files.csvimport(spark, str(tmp_path), "a int, b int", skip=3, comment="#").collect()
    assert sorted((r.a, r.b) for r in got) == sorted((n, i) for n in (1, 2) for i in range(50))


def test_shared_folder_on_a_cluster(monkeypatch):
    import pytest

    from tessera import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Fake:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())


def test_spatial_join_of_boxes_of_all_sizes(spark):
    rng = random.Random(5)
    box = lambda i: (i, (x := rng.uniform(-50, 50)), (y := rng.uniform(-50, 50)), x + rng.choice([0, 0.01, 1, 40, 1e7]) * rng.random(), y + rng.choice([0, 0.02, 2, 1e6]) * rng.random())
    a, b = [box(i) for i in range(120)], [box(i) for i in range(120)] + [(999, None, None, None, None)]
    left, right = spark.createDataFrame(a, "i int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(b, "j int, u1 double, v1 double, u2 double, v2 double")
    want = sorted((p[0], q[0]) for p in a for q in b if q[1] is not None and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for size in (0.05, 5.0, None):
        got = spatial.spatial_join(left, right, spatial.box_of("x1", "y1", "x2", "y2"), spatial.box_of("u1", "v1", "u2", "v2"), size)
        assert got.columns == [*left.columns, *right.columns] and sorted((r.i, r.j) for r in got.collect()) == want
    assert spatial.spatial_join(left.limit(0), right, spatial.box_of("x1", "y1", "x2", "y2"), spatial.box_of("u1", "v1", "u2", "v2")).collect() == []


def test_language_rejects_what_it_does_not_know(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(-7, 8)], "n int, s string")
    session = Session(spark, {"t": df})
    for text in ("query t feed head[5, 10]", "query t feed filter[.n > 1", "query t feed exactmatch[n; 3] count 4", "query t feed nosuch[1]", "query updateObject(q, \"t feed count\")"):
        with pytest.raises(QueryError):
            session.run(text)
    got = session.run("query t feed projectextend[n; d: .n div 2, m: .n mod 2, t: .s + \"!\"]").collect()
    assert all(r.d == int(r.n / 2) and r.m == math.fmod(r.n, 2) and r.t[1] == "!" for r in got)
    assert session.run("query t feed t feed {u} hashjoin[n, n_u, 997] count") == 15
    session.run('query deriveObject(many, "t feed filter[.n > 3] count")')
    assert session.run("query many") == 4 and session.run("query t feed getTypeNL") == "(rel (tuple ((n int) (s string))))"
    session.run("let t = t feed head[0]")
    assert session.run("query many") == 0 and session.run('query checkOperatorTypeMap(substr, "array<int>")') is None


def test_dialect_any_and_all_with_nulls(spark):
    spark.createDataFrame([(1,), (5,), (9,), (None,)], "a int").createOrReplaceTempView("xs")
    spark.createDataFrame([(3,), (7,)], "b int").createOrReplaceTempView("ys")
    spark.createDataFrame([(3,), (None,)], "b int").createOrReplaceTempView("zs")
    run = lambda where: sorted(r.a if r.a is not None else -1 for r in Dialect(spark).run(f"select [a] from xs where [{where}]").collect())
    assert run("a > any (select b from ys)") == [5, 9] and run("a > all (select b from ys)") == [9] and run("a < all (select b from ys)") == [1]
    assert run("a <= some (select b from ys)") == [1, 5] and run("a # any (select b from ys)") == [1, 5, 9] and run("a = any (select b from ys)") == []
    assert run("a > all (select b from zs)") == [] and run("a > any (select b from zs)") == [5, 9]
    assert run("a < all (select b from ys where b > 100)") == [-1, 1, 5, 9] and run("a < any (select b from ys where b > 100)") == []
    assert run("a # all (select b from ys)") == [1, 5, 9] and run("a = all (select b from ys where b = 3), a > 0") == []


def test_moving_forms_reject(spark):
    from tessera.functions.moving_forms import FormError, form

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for text in ("get a:t from a", "get x", "exists (get * from a"):
        with pytest.raises(FormError):
            form(df, text)
