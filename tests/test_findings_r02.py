"""What the second round of findings asked for, on small tables."""

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import regions
from tessera.llm import spotsigs
from tessera.operators import patterns, relational, sketches
from tessera.plans import catalogue
from tessera.sources import files

SMALL = "/root/testdata/sf0.001"


def box(x, y, w, h):
    return F.array(F.array(*(g.point(p, q) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h)))))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_of_regions_are_one_evaluation_in_even_tasks(spark):
    df = spark.range(1).select(box(F.lit(0.0), F.lit(0.0), 4, 4).alias("a"), box(F.col("id") + 1.0, F.lit(1.0), 4, 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = df.select(regions.toprel(a, b), regions.adjacent(a, b), regions.overlaps(a, b), regions.touches(a, b))
    line = next(x for x in plan(both).splitlines() if "ArrowEvalPython" in x)
    assert line.split("],")[0].count("_relations(") == 1
    assert catalogue.QUERIES["region_relations"](spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_region_operations_in_even_tasks_add_up(spark):
    assert catalogue.QUERIES["region_operations"](spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    rng = random.Random(4)
    rows = [(i, *(float(rng.randrange(6)) for _ in range(2)), *(float(rng.randrange(1, 5)) for _ in range(2))) for i in range(40)] + [(40, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double, w double, h double")
    a, b = box(F.lit(2.0), F.lit(2.0), 3, 3), F.when(F.col("x").isNotNull(), box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    df = df.select("*", a.alias("a"), b.alias("b"))
    size = lambda r: F.aggregate(F.transform(r, g.ring_area), F.lit(0.0), lambda t, v: t + v)
    got = df.select("*", *(size(f(F.col("a"), F.col("b"))).alias(n) for n, f in (("u", regions.region_union), ("c", regions.region_intersection)))).collect()
    for r in got:
        if r.x is None:
            assert r.u is None and r.c is None
            continue
        common = max(0, min(5, r.x + r.w) - max(2, r.x)) * max(0, min(5, r.y + r.h) - max(2, r.y))
        assert abs(r.c - common) < 1e-9
        if not (r.x > 2 and r.y > 2 and r.x + r.w < 5 and r.y + r.h < 5):
            assert abs(r.u - (9 + r.w * r.h - common)) < 1e-9


def test_a_database_in_an_archive_is_read_by_any_process(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 0.5), (2, None, None), (3, "", 1.5)], "k int, t string, v double").repartition(3)
    url = files.derby(df, f"{tmp_path}/d", "T")
    assert url.startswith(f"jdbc:derby:jar:({tmp_path}")
    got = files.jdbc(spark, url, 'SELECT * FROM "T"', ("k", 0, 4, 2), driver=files.DERBY)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert not list((tmp_path / "d" / "db").glob("*.lck"))  # closed, so that others may open it


def test_counts_by_a_crowded_sketch_are_exact(spark):
    df = spark.createDataFrame([(i % 50 if i % 7 else None,) for i in range(700)], "v int")
    asked = df.distinct().union(spark.createDataFrame([(99,)], "v int"))
    got = sketches.cm_count(asked, "v", sketches.count_min(df, "v", 16, 2, ends=True), 16, 2, df)
    want = {r.v: r["count"] for r in df.groupBy("v").count().collect()} | {99: 0}
    assert {r.v: r.estimate for r in got.collect()} == want


def test_pairs_of_one_key_are_made_by_many_tasks(spark):
    a, b = spark.range(400).selectExpr("id as x", "id % 2 as k"), spark.range(30).selectExpr("id as y", "id % 3 as l")
    predicate = (F.col("k") == F.col("l")) & (F.col("x") > 10 * F.col("y"))
    got = relational.symmjoin(a, b, predicate, 16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, relational.symmjoin(a, b, predicate).collect()))
    assert "_slice" in plan(catalogue.QUERIES["symmjoin"](spark, SMALL))


def test_shapes_and_dbase_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows come to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    df = spark.range(9).repartition(3).select(F.array(F.array(g.point(F.col("id"), F.lit(1.0)), g.point(F.col("id"), F.lit(2.0)))).alias("p"))
    files.shpexport(df, f"{tmp_path}/a.shp", "p", "line")
    got = files.shpimport(spark, f"{tmp_path}/a.shp").collect()
    assert sorted(r.No for r in got) == list(range(1, 10)) and sorted(r.Parts[0][1].x for r in got) == list(range(9))
    files.db3export(spark.range(5).selectExpr("id", "concat('n', id) as t"), f"{tmp_path}/a.dbf")
    assert sorted(map(tuple, files.dbimport(spark, f"{tmp_path}/a.dbf", "id long, t string").collect())) == [(i, f"n{i}") for i in range(5)]


def test_moving_regions_in_even_tasks(spark):
    assert catalogue.QUERIES["moving_regions"](spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_moving_velocity_in_even_tasks(spark):
    assert "RoundRobinPartitioning" in plan(catalogue.QUERIES["moving_velocity"](spark, SMALL))


def whole_optics(xy, eps, least):
    n = len(xy)
    done, order, reach, core = np.zeros(n, bool), [], np.full(n, np.inf), np.full(n, np.inf)
    for i in range(n):
        d = np.sort(np.linalg.norm(xy - xy[i], axis=1))
        if n >= least and d[least - 1] <= eps:
            core[i] = d[least - 1]
    while len(order) < n:
        left = np.flatnonzero(~done)
        i = left[np.argmin(reach[left])]
        done[i] = True
        order.append(int(i))
        if np.isfinite(core[i]):
            d = np.linalg.norm(xy - xy[i], axis=1)
            near = ~done & (d <= eps)
            reach[near] = np.minimum(reach[near], np.maximum(core[i], d[near]))
    return order, reach, core


def test_optics_by_cells_is_optics_over_all_points():
    rng = np.random.default_rng(1)
    for n, eps, digits in ((1, 0.05, 9), (3, 0.05, 9), (600, 0.05, 1), (700, 0.05, 9), (300, 0.3, 2)):
        xy = np.round(rng.normal(0, 0.12, (n, 2)), digits)
        got, want = patterns.optics_order(xy, eps, 4), whole_optics(xy, eps, 4)
        assert got[0] == want[0] and np.array_equal(got[1], want[1]) and np.array_equal(got[2], want[2])


def test_parts_are_the_components_of_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, i % 2, rng.random() * 3, rng.random() * 3) for i in range(300)] + [(7, 1, 9.0, 9.0), (8, 0, 9.1, 9.0)]
    got = patterns.linked_parts(spark.createDataFrame(points, "i int, t int, x double, y double"), "i", "x", "y", 0.2, "t").collect()
    root = {(t, i): (t, i) for i, t, _, _ in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, t, x, y in points:
        for j, u, p, q in points:
            if t == u and (x - p) ** 2 + (y - q) ** 2 <= 0.04:
                a, b = find((t, i)), find((u, j))
                root[max(a, b)] = min(a, b)
    assert {((r.t, r.i), tuple(r.root)) for r in got} == {((t, i), find((t, i))) for i, t, _, _ in points}


def test_nearest_rows_among_copies_take_few_pairs(spark, monkeypatch):
    points = [(i, (i % 90) / 100, (i % 7) / 100) for i in range(360)]
    a, b = spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(points, "j int, u double, v double")
    made, join = [], patterns.distance_join
    monkeypatch.setattr(patterns, "distance_join", lambda *args: made.append(join(*args)) or made[-1])
    got = patterns.knn_join(a, b, "i", ("x", "y"), ("u", "v"), 3, 2.0).groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 9).alias("d")).collect()
    where = {i: (x, y) for i, x, y in points}
    want = {i: round(sum(sorted(((x - u) ** 2 + (y - v) ** 2) ** 0.5 for _, u, v in points)[:3]), 9) for i, (x, y) in where.items()}
    assert {r.i: r.d for r in got} == want and {r.n for r in got} == {3}
    assert made[0].count() < 360 * 360 / 4


def test_texts_that_share_little_are_left_out_before_the_join(spark, monkeypatch):
    rows = [(i, " ".join(f"the w{i}x{j} and w{j}" for j in range(30))) for i in range(40)]
    rows += [(40, rows[7][1] + " of more"), (41, "the a of b or c is d"), (42, "the a of b or c is d in e")]
    made, write = [], spotsigs.materialise
    monkeypatch.setattr(spotsigs, "materialise", lambda df: made.append(write(df)) or made[-1])
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: 7 if i == 40 else i for i in range(43)}
    assert {r.rep for r in made[-1].select("rep").collect()} == {7, 40}
