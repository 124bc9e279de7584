"""Patterns of moving objects and points: groups that travel together, nearest neighbours, sequences of events, clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import connected_components
from tessera.operators.spatial import distance_join
from tessera.session import materialise, spread


def knn_join(a: DataFrame, b: DataFrame, ident: str, pa: tuple[str, str], pb: tuple[str, str], k: int, start: float) -> DataFrame:
    """The k nearest rows of b for each row of a (fewer, if b is smaller), with distance and rank: rows that lack neighbours try again with twice the radius.

    Rows without coordinates have no neighbours and are left out. From the round on in which the radius covers all points every row is done.
    Each place of a is looked up once, k rows of b at a place are enough, and the first radius is start or, among crowded points, a smaller one that
    leaves about 32 k pairs a place.
    """
    every, named = a.dropna(subset=list(pa)), [*a.columns, *b.columns, "distance", "rank"]
    a, b = a.dropna(subset=list(pa)), b.dropna(subset=list(pb))
    total = b.limit(k).count()
    ends = [df.agg(*(f(F.col(c).cast("double")) for c in p for f in (F.min, F.max))).first() for df, p in ((a, pa), (b, pb))]
    if total == 0 or ends[0][0] is None:
        return distance_join(a, b, pa, pb, start).withColumn("rank", F.lit(1)).limit(0)
    reach = sum(max(ends[0][i + 1], ends[1][i + 1]) - min(ends[0][i], ends[1][i]) for i in (0, 2))
    a = materialise(a.select(*pa).distinct())
    some = F.row_number().over(Window.partitionBy(*pb).orderBy(F.monotonically_increasing_id()))
    b = materialise(b.withColumn("_same", some).filter(F.col("_same") <= k).drop("_same"))
    keys, left, out, radius = list(pa), a, None, start
    enough, before = 32 * k * a.count(), None
    while True:
        cells = [df.groupBy(*(F.floor(F.col(c).cast("double") / radius).alias(f"_c{i}") for i, c in enumerate(p))).count().withColumnRenamed("count", n)
            for df, p, n in ((a, pa, "_m"), (b, pb, "_n"))]
        pairs = cells[0].join(cells[1], ["_c0", "_c1"]).agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0.0
        if 9 * pairs <= enough or (before is not None and pairs > 0.9 * before):
            break
        radius, before = radius * min(0.5, (enough / (9 * pairs)) ** 0.5), pairs
    while True:
        pairs = distance_join(left, b, pa, pb, radius)
        best = Window.partitionBy(*keys).orderBy("distance", *pb)
        ranked = materialise(pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        full = ranked.groupBy(*keys).count().filter(F.col("count") >= total).select(*keys)
        done = ranked.join(full, keys, "left_semi")
        out = done if out is None else out.union(done)
        left = materialise(left.join(full, keys, "left_anti"))
        if radius >= reach or left.isEmpty():
            return every.join(out, keys).select(*named)
        radius *= 2


def linked_parts(df: DataFrame, ident: str, x: str, y: str, eps: float, step: str | None = None) -> DataFrame:
    """df (rows with coordinates) with root: the least ident of the component of its graph of neighbours within eps, at each step by itself (then (step, ident)).

    The graph isn't made. Points of a grid cell whose diagonal is eps are neighbours of each other, so only cells are linked: those that have
    a pair of points within eps, which is looked for among their different points and not beyond the first one found. Rows of one ident are one node.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    node = F.col(ident) if step is None else F.struct(F.col(step), F.col(ident))
    when = F.lit(0) if step is None else F.col(step)
    place = lambda c: F.floor(F.col(c).cast("double") / side)
    rows = df.dropna(subset=[x, y]).withColumns({"_n": node, "_t": when, "_cx": place(x), "_cy": place(y)})
    spot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = materialise(rows.groupBy("_t", "_cx", "_cy").agg(F.min("_n").alias("rep"), F.collect_set(spot).alias("spots")))
    steps = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    left = cells.withColumn("_s", near).select("_t", (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"),
        F.col("rep").alias("a"), F.col("spots").alias("p"))
    pairs = spread(left.join(cells, ["_t", "_cx", "_cy"]).select("a", F.col("rep").alias("b"), "p", "spots"))
    links = pairs.filter(_meet(eps)(F.col("p"), F.col("spots"))).select("a", "b")
    placed = rows.join(cells.drop("spots"), ["_t", "_cx", "_cy"])
    same = placed.groupBy("_n").agg(F.collect_set("rep").alias("r")).filter(F.size("r") > 1).select(F.col("r")[0].alias("a"), F.explode("r").alias("b"))
    roots = connected_components(links.union(same))
    return placed.join(roots, F.col("rep") == F.col("node"), "left").select(*df.columns, F.coalesce("root", "rep").alias("root"))


def _meet(eps: float) -> Callable[[Column, Column], Column]:
    """Whether two arrays of points have a pair within eps."""

    def spots(column: pa.Array) -> list[np.ndarray]:
        xy = np.column_stack([column.values.field(n).to_numpy(zero_copy_only=False) for n in "xy"])
        at = column.offsets.to_pylist()
        return [xy[i:j] for i, j in zip(at, at[1:], strict=False)]

    def close(p: np.ndarray, q: np.ndarray) -> bool:
        gap = lambda a, b: np.hypot(*np.maximum(np.maximum(b.min(0) - a, a - b.max(0)), 0).T) <= eps
        p = p[gap(p, q)]
        q = q[gap(q, p)] if len(p) else p
        size = max(1, 1_000_000 // max(1, len(q)))
        return any((np.hypot(p[i : i + size, :1] - q[:, 0], p[i : i + size, 1:] - q[:, 1]) <= eps).any() for i in range(0, len(p), size)) if len(q) else False

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bool(close(p, q)) for p, q in zip(spots(a), spots(b), strict=True)])

    return lambda a, b: F.arrow_udf(run, "boolean")(a, b)


def flocks(positions: DataFrame, ident: str, step: str, x: str, y: str, radius: float, least: int, steps: int) -> DataFrame:
    """Groups that stay together: members (sorted ids), first, last (steps): at each of at least `steps` successive steps a component of the graph of neighbours within radius, of at least `least` objects, has these members."""
    rows = positions.select(F.col(ident).alias("i"), F.col(step).cast("long").alias("t"), F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"))
    found = linked_parts(rows, "i", "x", "y", radius, "t").groupBy("root").agg(F.array_sort(F.collect_set("i")).alias("members"), F.first("t").alias("t"))
    found = found.filter(F.size("members") >= max(least, 2))
    w = Window.partitionBy("members").orderBy("t")
    runs = found.withColumn("run", F.col("t") - F.row_number().over(w)).groupBy("members", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= steps).select("members", "first", "last")


def sequence_pattern(df: DataFrame, by: list[str], order: list[str], steps: list[Column], within_seconds: float | None = None,
    time: str | None = None) -> DataFrame:
    """Keys at which rows fulfil the steps one after another: the earliest end of each prefix is carried along, so a key takes one pass."""
    matched = df
    for i, s in enumerate(steps):
        matched = matched.withColumn(f"_s{i}", F.coalesce(s, F.lit(False)))
    at = F.struct(*order)
    after = lambda place: lambda x: x > place
    got = matched.groupBy(*by).agg(*(F.array_sort(F.collect_list(F.when(F.col(f"_s{i}"), at))).alias(f"_a{i}") for i in range(len(steps))))
    if within_seconds is None:
        reached = F.get(F.col("_a0"), F.lit(0))
        for i in range(1, len(steps)):
            reached = F.get(F.filter(f"_a{i}", after(reached)), F.lit(0))
        return got.filter(reached.isNotNull()).select(*by)

    def fulfils(start: Column) -> Column:
        reached = start
        for i in range(1, len(steps)):
            reached = F.get(F.filter(f"_a{i}", after(reached)), F.lit(0))
        return reached.isNotNull() & (reached[time].cast("double") - start[time].cast("double") <= within_seconds)

    return got.filter(F.exists("_a0", fulfils)).select(*by)


def kmeans(df: DataFrame, vector: str, k: int, rounds: int = 10, start: list[list[float]] | None = None) -> DataFrame:
    """cluster, n, centre (array) by Lloyd's rounds; centres begin at start, or at the k rows whose hashes are least. Only centres come to the driver."""
    v = F.col(vector).cast("array<double>")
    rows = materialise(df.filter(F.col(vector).isNotNull()).select(v.alias("v")))
    centres = start or [list(r.v) for r in rows.distinct().orderBy(F.xxhash64(F.to_json("v"))).limit(k).collect()]
    found = []
    for _ in range(rounds):
        lit = F.array(*(F.array(*map(F.lit, c)) for c in centres))
        far = F.transform(lit, lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
        placed = rows.withColumn("cluster", (F.array_position(far, F.array_min(far)) - 1).cast("int"))
        dims = len(centres[0])
        found = placed.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(dims))).orderBy("cluster").collect()
        new = list(centres)
        for r in found:
            new[r.cluster] = [r[f"c{i}"] for i in range(dims)]
        if np.allclose(new, centres):
            break
        centres = new
    out = [(r.cluster, r.n, centres[r.cluster]) for r in found]
    return df.sparkSession.createDataFrame(out, "cluster int, n long, centre array<double>")


def optics_order(xy: np.ndarray, eps: float, least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The order of points by OPTICS, their reachability and core distances (infinite where undefined); of equal ones the first goes first.

    Points are filed in grid cells. A core distance is looked for in rings of cells around the point's; a point that is placed touches only cells that
    hold a point whose reachability it can lower.
    """
    n = len(xy)
    low, high = xy.min(0), xy.max(0)
    side = min(eps, max(eps / 8, float(np.prod(np.maximum(high - low, eps)) * 64 / n) ** 0.5))
    at = np.floor((xy - low) / side).astype(np.int64)
    cells, cell = np.unique(at, axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    filed = np.argsort(cell, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(cells)))])
    members = [filed[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    known = {(int(u), int(v)): k for k, (u, v) in enumerate(cells)}
    reach, core = np.full(n, np.inf), np.full(n, np.inf)
    for (u, v), k in known.items():
        left, r = members[k], 1
        while len(left):
            around = [known[c] for i in range(u - r, u + r + 1) for j in range(v - r, v + r + 1) if (c := (i, j)) in known]
            near = np.concatenate([members[c] for c in around])
            sure = min(eps, r * side * (1 - 1e-9)) if r * side < eps * (1 + 1e-6) else eps
            again = []
            for part in np.array_split(left, -(-len(left) * len(near) // 1_000_000)):
                if len(near) < least:
                    again.append(part)
                    continue
                d = np.partition(np.sqrt((xy[part, :1] - xy[near, 0]) ** 2 + (xy[part, 1:] - xy[near, 1]) ** 2), least - 1, axis=1)[:, least - 1]
                core[part[d <= sure]] = d[d <= sure]
                again.append(part[d > sure])
            left = np.concatenate(again)
            if r * side >= eps * (1 + 1e-6):
                break
            r += 1
    least_of, most_of = np.full(len(cells), np.inf), np.full(len(cells), np.inf)
    lo, open_ = low + cells * side, np.ones(n, bool)
    order, first = [], 0

    def settle(c: int) -> None:
        left = reach[members[c][open_[members[c]]]]
        least_of[c], most_of[c] = (left.min(), left.max()) if len(left) else (np.inf, -np.inf)

    while len(order) < n:
        best = least_of.min()
        if np.isfinite(best):
            i = min(int((m := members[c])[open_[m] & (reach[m] == best)].min()) for c in np.flatnonzero(least_of == best))
        else:
            while not open_[first]:
                first += 1
            i = first
        open_[i] = False
        order.append(i)
        changed = {int(cell[i])}
        if np.isfinite(core[i]):
            away = np.maximum(np.maximum(lo - xy[i], xy[i] - lo - side), 0)
            away = np.sqrt(away[:, 0] ** 2 + away[:, 1] ** 2) * (1 - 1e-9)
            touched = np.flatnonzero((away <= eps) & (np.maximum(away, core[i]) < most_of))
            if len(touched):
                near = np.concatenate([members[c] for c in touched])
                near = near[open_[near]]
                d = np.sqrt((xy[near, 0] - xy[i, 0]) ** 2 + (xy[near, 1] - xy[i, 1]) ** 2)
                near, d = near[d <= eps], d[d <= eps]
                reach[near] = np.minimum(reach[near], np.maximum(core[i], d))
                changed.update(touched.tolist())
        for c in changed:
            settle(c)
    return order, reach, core


def optics(df: DataFrame, ident: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """OPTICS: ident, part, place, reach (null at a start), core (null if not one).

    Points are parted by the components of the graph of neighbours within eps (part: the least ident of the component). No point is
    reached from another part, so the order within each part is that of the whole. A part is ordered by one task, in memory for its points.
    """
    df = df.select(ident, x, y).dropna(subset=[x, y])
    df = linked_parts(df, ident, x, y, eps).select(F.col("root").alias("part"), ident, x, y)
    by = ["part"]
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident, kind="stable")
        order, reach, core = optics_order(frame[[x, y]].to_numpy(float), eps, least)
        out = frame.iloc[order][[*by, ident]].copy()
        out["place"] = range(len(order))
        out["reach"] = [None if not np.isfinite(reach[i]) else float(reach[i]) for i in order]
        out["core"] = [None if not np.isfinite(core[i]) else float(core[i]) for i in order]
        return out

    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"{ident} {kinds[ident]}", "place int", "reach double", "core double"])
    return df.groupBy(*by).applyInPandas(run, schema)


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping of two arrays of points (x, y): least sum of distances."""
    from pyspark.sql.types import DoubleType

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is None or q is None or not len(p) or not len(q):
                out.append(None)
                continue
            u, v = (np.array([(k["x"], k["y"]) for k in s]) for s in (p, q))
            d = np.linalg.norm(u[:, None] - v[None, :], axis=2)
            row = np.cumsum(d[0])
            for i in range(1, len(d)):
                new = np.empty_like(row)
                new[0] = row[0] + d[i, 0]
                for j in range(1, len(row)):
                    new[j] = min(row[j], row[j - 1], new[j - 1]) + d[i, j]
                row = new
            out.append(float(row[-1]))
        return pd.Series(out)

    return F.pandas_udf(run, DoubleType())(a, b)


def random_values(df: DataFrame, key: Column, seed: int, kind: str = "uniform", a: float = 0.0, b: float = 1.0) -> Column:
    """Numbers by hash of a key, the same at every run: uniform in a to b, normal with mean a and deviation b, exponential with rate a, poisson with mean a (small)."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed + salt), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if kind == "uniform":
        return a + (b - a) * u(0)
    if kind == "normal":
        return a + b * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    if kind == "exponential":
        return -F.log(u(0)) / a
    if kind == "poisson":
        steps = F.sequence(F.lit(1), F.lit(int(a + 10 * a**0.5 + 20)))
        terms = F.aggregate(steps, F.struct(F.exp(F.lit(-a)).alias("p"), F.exp(F.lit(-a)).alias("c"), F.lit(0).alias("n")),
            lambda s, k: F.struct((s["p"] * a / k).alias("p"), (s["c"] + s["p"] * a / k).alias("c"),
                F.when(s["c"] < u(0), s["n"] + 1).otherwise(s["n"]).alias("n")))
        return terms["n"]
    raise ValueError(f"no distribution {kind!r}")


def hub_labels(edges: DataFrame, sources: list, shortest: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """node, hub, distance for chosen hubs: distances from hubs along an undirected graph; a query takes the least sum over common hubs."""
    out = None
    for h in sources:
        d = shortest(edges, h).withColumn("hub", F.lit(h)).select("node", "hub", "distance")
        out = d if out is None else out.union(d)
    return materialise(out)


def hub_distance(labels: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with distance: the shortest way over a hub (an upper bound of the distance, exact if the hubs cover the pair)."""
    left, right = labels.toDF("_a", "_h", "_d"), labels.toDF("_b", "_g", "_e")
    both = pairs.join(left, F.col(a) == F.col("_a")).join(right, (F.col(b) == F.col("_b")) & (F.col("_h") == F.col("_g")))
    return both.groupBy(*pairs.columns).agg(F.min(F.col("_d") + F.col("_e")).alias("distance"))


def map_match(positions: DataFrame, roads: DataFrame, ident: list[str], x: str, y: str, radius: float) -> DataFrame:
    """positions with the road (roads: road, x1, y1, x2, y2) nearest to them within a radius, and where it is met; null if there is none."""
    from tessera.functions.geometry import point, point_segment_distance
    from tessera.operators.spatial import spatial_join

    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    r = roads.select("road", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    box = F.struct((px - radius).alias("x1"), (py - radius).alias("y1"), (px + radius).alias("x2"), (py + radius).alias("y2"))
    road_box = F.struct(F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"),
        F.greatest("y1", "y2").alias("y2"))
    pairs = spatial_join(positions, r, box, road_box, max(2 * radius, 1e-9))
    away = point_segment_distance(point(px, py), F.struct("x1", "y1", "x2", "y2"))
    best = pairs.withColumn("away", away).filter(F.col("away") <= radius).groupBy(*ident).agg(F.min(F.struct("away", "road")).alias("_m"))
    return positions.join(best, ident, "left").select(*positions.columns, F.col("_m.road").alias("road"), F.col("_m.away").alias("away"))


