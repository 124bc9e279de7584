"""Joins and searches by place and distance, and clustering.

Joins file both sides under grid cells and join on the cell: a pair is reported only in the cell that holds the least corner of
its common box, so nothing is reported twice and no pair is made outside a common cell. Dense cells are split by adaptive
execution, as they are plain join keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.graph import connected_components
from tessera.session import materialise


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def box_of(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.struct(F.col(x1).cast("double").alias("x1"), F.col(y1).cast("double").alias("y1"), F.col(x2).cast("double").alias("x2"),
        F.col(y2).cast("double").alias("y2"))


def cell_size(*sides: tuple[DataFrame, Column]) -> float:
    """Twice the mean side of the boxes of the larger kind, so that a box meets few cells; 1 for points."""
    means = [df.select(((box["x2"] - box["x1"] + box["y2"] - box["y1"]) / 2).alias("v"), F.lit(i).alias("i")) for i, (df, box) in enumerate(sides)]
    every = means[0]
    for m in means[1:]:
        every = every.union(m)
    mean = max((r.v for r in every.groupBy("i").agg(F.avg("v").alias("v")).collect() if r.v is not None), default=0.0)
    return 2 * float(mean) if mean else 1.0


def spatial_join(a: DataFrame, b: DataFrame, box_a: Column, box_b: Column, size: float | None = None, refine: Column | None = None) -> DataFrame:
    """Pairs of rows whose boxes (x1, y1, x2, y2) meet, with all columns of both; refine is checked on the pairs.

    Grids are in levels, each with cells of twice the side of the one before. A box belongs to the first level whose cells have half its
    side or more, so it meets nine cells at most however large it is, and is also filed in the coarser levels that occur; a pair meets in the level of its larger box.
    """
    size = size or cell_size((a, box_a), (b, box_b))

    def placed(df: DataFrame, box: Column, name: str) -> DataFrame:
        df = df.withColumn(name, box).filter(F.col(name)["x1"].isNotNull())
        side = F.greatest(F.col(name)["x2"] - F.col(name)["x1"], F.col(name)["y2"] - F.col(name)["y1"])
        return df.withColumn(f"{name}_level", F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(side / (2 * size))), F.lit(0))).cast("int"))

    left, right = placed(a, box_a, "_a"), placed(b, box_b, "_b")
    found = left.select(F.col("_a_level").alias("level")).union(right.select("_b_level")).distinct().collect()  # a few numbers
    levels = sorted(r.level for r in found)

    def filed(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels or [0])), lambda x: x >= F.col(f"{name}_level"))))
        step = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
        df = df.withColumn("_cx", F.explode(_cells(F.col(name)["x1"], F.col(name)["x2"], step)))
        return df.withColumn("_cy", F.explode(_cells(F.col(name)["y1"], F.col(name)["y2"], step)))

    pairs = filed(left, "_a").join(filed(right, "_b"), ["_level", "_cx", "_cy"]).filter(F.col("_level") == F.greatest("_a_level", "_b_level"))
    p, q = F.col("_a"), F.col("_b")
    meet = (p["x1"] <= q["x2"]) & (q["x1"] <= p["x2"]) & (p["y1"] <= q["y2"]) & (q["y1"] <= p["y2"])
    step = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    own = (F.floor(F.greatest(p["x1"], q["x1"]) / step) == F.col("_cx")) & (F.floor(F.greatest(p["y1"], q["y1"]) / step) == F.col("_cy"))
    out = pairs.filter(meet & own)
    return (out if refine is None else out.filter(refine)).drop("_a", "_b", "_a_level", "_b_level", "_level", "_cx", "_cy")


def distance_join(a: DataFrame, b: DataFrame, pa: tuple[str, str], pb: tuple[str, str], eps: float, name: str = "distance") -> DataFrame:
    """Pairs of points within eps, with their distance."""
    x, y = (F.col(c).cast("double") for c in pa)
    u, v = (F.col(c).cast("double") for c in pb)
    box = lambda x, y, r: F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"))
    pairs = spatial_join(a, b, box(x, y, eps / 2 + 1e-12), box(u, v, eps / 2 + 1e-12), eps)
    return pairs.withColumn(name, F.hypot(x - u, y - v)).filter(F.col(name) <= eps)


def closest_pairs(a: DataFrame, b: DataFrame, pa: tuple[str, str], pb: tuple[str, str], k: int, start: float) -> DataFrame:
    """The k closest pairs, or all if there are fewer: the radius of a distance join doubles until it gives enough or covers all points.

    Rows without coordinates have no pairs.
    """
    a, b = a.dropna(subset=list(pa)), b.dropna(subset=list(pb))
    ends = lambda df, c: df.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
    reach = 0.0
    for u, v in zip(pa, pb, strict=True):
        sides = [x for x in (*ends(a, u), *ends(b, v)) if x is not None]
        reach += (max(sides) - min(sides)) if sides else 0.0
    while True:
        pairs = materialise(distance_join(a, b, pa, pb, start))
        if start >= reach or pairs.limit(k).count() >= k:
            return pairs.orderBy("distance", *pa, *pb).limit(k)
        start *= 2


def window_intersects(df: DataFrame, box: Column, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    return df.filter((box["x1"] <= x2) & (box["x2"] >= x1) & (box["y1"] <= y2) & (box["y2"] >= y1))


def distance_scan(df: DataFrame, distance: Column, k: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows by distance; the nearest k are found without sorting all."""
    out = df.withColumn("distance", distance).filter("distance is not null").orderBy("distance", *(ties or []))
    return out if k is None else out.limit(k)


def range_search(df: DataFrame, distance: Column, radius: float) -> DataFrame:
    return df.filter(distance <= radius)


def euclid(a: Column, b: Column) -> Column:
    """Distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def metric_join(a: DataFrame, b: DataFrame, va: str, vb: str, distance: Callable[[Column, Column], Column], eps: float, pivots: list[list[float]]) -> DataFrame:
    """Pairs within eps by any metric: rows are filed in rings around pivots, and the triangle inequality leaves neighbouring rings only."""
    ring = lambda c, p: F.floor(distance(F.col(c), F.array(*map(F.lit, p))) / eps)
    left, right = a, b
    names = []
    for i, p in enumerate(pivots):
        r = f"_r{i}"
        names.append(r)
        left = left.withColumn(r, F.explode(F.array(*(ring(va, p) + d for d in (-1, 0, 1)))))
        right = right.withColumn(r, ring(vb, p))
    pairs = left.join(right, names).drop(*names)
    return pairs.withColumn("distance", distance(F.col(va), F.col(vb))).filter(F.col("distance") <= eps)


def dbscan(df: DataFrame, ident: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """ident, cluster (least core id of its component; null for noise): core points have `least` points within eps, themselves included.

    A border point joins the reachable core point with the least cluster.
    """
    points = df.select(F.col(ident).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    others = points.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = materialise(distance_join(points, others, ("x", "y"), ("u", "v"), eps).select("i", "j"))
    core = near.groupBy("i").count().filter(F.col("count") >= least).select("i")
    inner = near.join(core, "i").join(core.select(F.col("i").alias("j")), "j")
    found = connected_components(inner.filter("i < j"), "i", "j")
    own = core.join(found, F.col("i") == F.col("node"), "left").select("i", F.coalesce("root", "i").alias("cluster"))
    reached = near.join(own.withColumnsRenamed({"i": "j", "cluster": "c"}), "j").groupBy("i").agg(F.min("c").alias("c"))
    out = points.select("i").join(own, "i", "left").join(reached, "i", "left")
    return out.select(F.col("i").alias(ident), F.coalesce("cluster", "c").alias("cluster"))
