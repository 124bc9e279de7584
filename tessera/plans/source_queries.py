"""Round trips through sources and sinks, stored tables, slots and streams: what is read back is compared with the table in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import distribution, graph, order, patterns, relational, sketches
from tessera.plans.registry import Registry, table
from tessera.plans.spatial_queries import points
from tessera.session import materialise, shared_folder
from tessera.sources import files, tables
from tessera.streaming import streams

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col


def folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_file(spark, name, lines):
    """A text file of these lines on the shared folder; its path."""
    path = folder(spark, name)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


PART_SQL = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


@R.add("csv_round_trip", PART_SQL)
def csv_round_trip(spark, sf_dir):
    df, path = parts(spark, sf_dir), folder(spark, "csv")
    files.csvexport(df, path, ";", header=True)
    return files.csvimport(spark, path, df.schema, 1, "#", ";")


@R.add("sql_export", "SELECT 'INSERT INTO t VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' AS line FROM region")
def sql_export(spark, sf_dir):
    path = folder(spark, "sql")
    files.sqlexport(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path, "t")
    return spark.read.text(path).toDF("line")


@R.add("text_files", "SELECT n_name || chr(10) AS text, length(n_name)::INT AS n FROM nation WHERE n_nationkey = 5")
def text_files(spark, sf_dir):
    path = folder(spark, "text")
    files.write_file(table(spark, sf_dir, "nation").filter("n_nationkey = 5").select(c("n_name").alias("text")), path)
    return files.read_file(spark, path).filter("text <> ''").select("text", (F.length("text") - 1).alias("n"))


@R.add("dumped_lines", "SELECT n_nationkey || ', ' || n_name || ', ' || coalesce(nullif(n_regionkey, 2)::VARCHAR, 'undefined') AS line FROM nation")
def dumped_lines(spark, sf_dir):
    path = folder(spark, "dump")
    tables.dumpstream(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(2)).alias("k")), path)
    return spark.read.text(path).toDF("line")


@R.add("db3_round_trip", "SELECT p_partkey, p_name, p_size, p_size > 25 AS large FROM part")
def db3_round_trip(spark, sf_dir):
    df, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", (c("p_size") > 25).alias("large")), folder(spark, "dbase")
    files.db3export(df, f"{path}/part.dbf")
    return files.dbimport(spark, path, "p_partkey long, p_name string, p_size int, large boolean")


@R.add("shp_round_trip", "SELECT 'region' AS kind, p_size::DOUBLE AS x, (p_partkey % 20 + 1)::DOUBLE AS y FROM part")
def shp_round_trip(spark, sf_dir):
    x, y = c("p_size").cast("double"), (c("p_partkey") % 20 + 1).cast("double")
    ring = F.array(F.array(g.point(F.lit(0.0), F.lit(0.0)), g.point(x, F.lit(0.0)), g.point(x, y)))
    path = folder(spark, "shapes")
    files.shpexport(table(spark, sf_dir, "part").select(ring.alias("parts")), f"{path}/part.shp", "parts", "region")
    last = F.get(F.get("Parts", F.lit(0)), F.lit(2))
    return files.shpimport(spark, path).select(c("Kind").alias("kind"), last["x"].alias("x"), last["y"].alias("y"))


@R.add("geojson_import", "SELECT n_nationkey::INT AS No, 'LineString' AS Kind, 2 AS points, n_regionkey::DOUBLE AS x, n_name AS name FROM nation")
def geojson_import(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    feature = F.concat(
        F.lit('{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], ['), c("n_regionkey").cast("string"),
            F.lit(', 1]]}, "properties": {"name": "'), c("n_name"), F.lit('"}}')
    )
    whole = nation.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", feature.alias("f")))), lambda x: x["f"]), ", "),
            F.lit("]}")).alias("value"))
    path = folder(spark, "geojson")
    whole.coalesce(1).write.text(path)
    got = files.geojson(spark, path)
    return got.select("No", "Kind", F.size(c("Parts")[0]).alias("points"), c("Parts")[0][1]["x"].alias("x"),
        F.get_json_object("Properties", "$.name").alias("name"))


@R.add("gpx_import", "SELECT 0 AS Track, 0 AS Segment, n_nationkey + 0.5 AS Lat, n_regionkey::DOUBLE AS Lon, n_nationkey * 10.0 AS Elevation, TIMESTAMP '2024-01-01' + to_seconds(n_nationkey) AS t FROM nation")
def gpx_import(spark, sf_dir):
    point = F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele><time>%s</time></trkpt>', c("n_nationkey") + 0.5, c("n_regionkey"), c("n_nationkey") * 10,
        F.date_format(F.timestamp_seconds(c("n_nationkey") + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    whole = table(spark, sf_dir, "nation").agg(F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'),
        F.array_join(F.collect_list(point), ""), F.lit("</trkseg></trk></gpx>")).alias("value"))
    path = folder(spark, "gpx")
    whole.coalesce(1).write.text(path)
    return files.gpximport(spark, path).select("Track", "Segment", "Lat", "Lon", "Elevation", c("Time").alias("t"))


@R.add("esri_grid_import", "SELECT (n_nationkey % 5)::INT AS cell_x, (4 - n_nationkey // 5)::INT AS cell_y, 10.0 + 2 * (n_nationkey % 5) AS x, n_regionkey::DOUBLE AS v FROM nation WHERE n_regionkey <> 4")
def esri_grid_import(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey",
        "n_regionkey").groupBy(F.floor(c("n_nationkey") / 5).alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey",
            "n_regionkey"))), lambda s: F.when(s["n_regionkey"] == 4, "-9").otherwise(s["n_regionkey"].cast("string"))), " ").alias("line"))
    head = "ncols 5\nnrows 5\nxllcorner 10\nyllcorner 0\ncellsize 2\nNODATA_value -9\n"
    whole = rows.agg(F.concat(F.lit(head),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n")).alias("value"))
    path = folder(spark, "grid")
    whole.coalesce(1).write.text(path)
    return files.esri_grid(spark, path).select("cell_x", "cell_y", "x", "v")


@R.add("xyz_import", "SELECT p_partkey::DOUBLE AS x, p_size::DOUBLE AS y, p_retailprice AS z FROM part")
def xyz_import(spark, sf_dir):
    path = folder(spark, "xyz")
    files.csvexport(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), path, " ", header=False)
    return files.xyz(spark, path)


@R.add("ais_import", "SELECT 1 AS Kind, 477553000::BIGINT AS Mmsi, 5 AS Status, -122.34583::DOUBLE AS lon, 47.58283::DOUBLE AS lat FROM region LIMIT 1")
def ais_import(spark, sf_dir):
    path = text_file(spark, "ais", ["!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C", "not a message",
        "!AIVDM,2,1,3,B,55P5TL01VIaAL@7WKO@mBplU@<PDhh000000001S;AJ::4A80?4i@E53,0*3E"])
    return files.importais(spark, path).select("Kind", "Mmsi", "Status", F.round("Lon", 5).alias("lon"), F.round("Lat", 5).alias("lat"))


@R.add("external_sql", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def external_sql(spark, sf_dir):
    """A table goes to an external SQL system and comes back as the result of a query there; each executor opens the system's archive itself."""
    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("A"), c("n_regionkey").alias("K"))
    url = files.derby(nation, folder(spark, "derby"), "NATION")
    out = files.jdbc(spark, url, "SELECT K, COUNT(*) AS N FROM NATION GROUP BY K", ("K", 0, 5, 2), driver=files.DERBY)
    return materialise(out.toDF("k", "n")).select("k", c("n").cast("long").alias("n"))


@R.add("stored_tables", "SELECT o_custkey, count(*) * 4 AS n, sum(o_orderkey)::BIGINT * 4 AS s FROM orders GROUP BY o_custkey")
def stored_tables(spark, sf_dir):
    """The same rows by a stored table, a bucketed one, a temporary name and the executors' memory."""
    od, name = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), f"t{uuid.uuid4().hex}"
    try:
        found = tables.consume(od, f"{name}_a").union(tables.oconsume(od, f"{name}_b", ["o_custkey"], 4)).union(tables.tconsume(od,
            f"{name}_c")).union(tables.mconsume(od))
        return materialise(found.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")))
    finally:
        for n in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{n}")
        spark.catalog.dropTempView(f"{name}_c")


@R.add("cleared_table", "SELECT 0::BIGINT AS n, 5::BIGINT AS before_ FROM region LIMIT 1")
def cleared_table(spark, sf_dir):
    name = f"t{uuid.uuid4().hex}"
    try:
        before = tables.consume(table(spark, sf_dir, "region"), name).count()
        tables.clear(spark, name)
        return materialise(spark.table(name).agg(F.count("*").alias("n"), F.lit(before).cast("long").alias("before_")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@R.add("value_streams", "SELECT n_name AS Elem FROM nation UNION ALL SELECT 'one'")
def value_streams(spark, sf_dir):
    names = tables.project_transform_stream(table(spark, sf_dir, "nation"), "n_name")
    return tables.named_transform_stream(names, "Elem").union(tables.value_stream(spark, "one"))


@R.add("collected_lines", "SELECT n_regionkey, count(*)::INT AS segments, sum(n_nationkey)::DOUBLE AS reach FROM nation GROUP BY n_regionkey")
def collected_lines(spark, sf_dir):
    k = c("n_nationkey").cast("double")
    lines = tables.collect_line(table(spark, sf_dir, "nation"), ["n_regionkey"], g.segment(F.lit(0.0), F.lit(0.0), k, F.lit(0.0)))
    return lines.select("n_regionkey", F.size("line").alias("segments"), g.length(c("line")).alias("reach"))


@R.add("window_time", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20 AND ts + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06'")
def window_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", c("ts").cast("timestamp"))
    box = F.struct(*(x.alias(n) for x, n in zip((c("value"), F.lit(0.0), c("value"), F.lit(0.0)), ("x1", "y1", "x2", "y2"), strict=True)))
    span = tuple(F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-06"))
    return tables.window_time_intersects(e, box, (10, -1, 20, 1), c("t"), c("t") + F.expr("INTERVAL 1 HOUR"), span).select("event_id")


SAMPLE_SQL = "SELECT o_orderkey FROM orders, (SELECT least(1.0, greatest(0.01, 100.0 / count(*) * 1.05 + 5.0 / count(*))) AS rate FROM orders) WHERE ('0x' || substr(md5('0:' || o_orderkey::VARCHAR), 1, 13))::BIGINT < floor(rate * 4503599627370496)"


@R.add("sample", SAMPLE_SQL)
def sample(spark, sf_dir):
    return tables.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, 0.01, c("o_orderkey"))


@R.add("probable_rows", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('3:' || o_orderkey::VARCHAR), 1, 13))::BIGINT / 4503599627370496 < (o_orderkey % 10) / 10.0")
def probable_rows(spark, sf_dir):
    return tables.probability_filter(table(spark, sf_dir, "orders").select("o_orderkey"), c("o_orderkey") % 10 / 10, c("o_orderkey"), 3)


@R.add("distribute_range", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place FROM orders")
def distribute_range(spark, sf_dir):
    """Slots are ranges and each is sorted, so rows are in order from slot to slot."""
    slots = distribution.lsortby(distribution.distribute_range(table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey"), "o_orderkey")
    return order.numbered(slots.withColumn("_stored", F.monotonically_increasing_id()), ["_stored"], "place").drop("_stored")


@R.add("grid_slots", "SELECT count(DISTINCT (floor(embedding[1] / 0.25), floor(embedding[2] / 0.25)))::BIGINT AS cells, 1::BIGINT AS most FROM embeddings")
def grid_slots(spark, sf_dir):
    p = distribution.distribute_grid(points(spark, sf_dir), 8, c("x"), c("y"), 0.25).withColumn("slot", F.spark_partition_id())
    found = p.groupBy(F.floor(c("x") / 0.25).alias("a"), F.floor(c("y") / 0.25).alias("b")).agg(F.countDistinct("slot").alias("slots"))
    return found.agg(F.count("*").alias("cells"), F.max("slots").alias("most"))


@R.add("sorted_rows", "SELECT s_name, s_nationkey, (row_number() OVER (ORDER BY s_nationkey DESC, s_name) - 1)::BIGINT AS place FROM supplier")
def sorted_rows(spark, sf_dir):
    """sortby, and columns by name; the place is that of the sorted stream."""
    rows = relational.sortby(relational.sortattr(table(spark, sf_dir, "supplier").select("s_nationkey", "s_name")), "s_nationkey desc", "s_name")
    return order.numbered(rows.withColumn("_stored", F.monotonically_increasing_id()), ["_stored"], "place").drop("_stored")


@R.add("sorted_whole", "SELECT n_regionkey, n_nationkey, (row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1)::BIGINT AS place FROM nation")
def sorted_whole(spark, sf_dir):
    rows = relational.sort(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"))
    return order.numbered(rows.withColumn("_stored", F.monotonically_increasing_id()), ["_stored"], "place").drop("_stored")


@R.add("merged_streams", "SELECT k, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS place FROM (SELECT r_name AS k FROM region UNION ALL SELECT n_name FROM nation)")
def merged_streams(spark, sf_dir):
    rows = relational.pmerge(table(spark, sf_dir, "region").select(c("r_name").alias("k")), table(spark, sf_dir, "nation").select("n_name"), "k")
    return order.numbered(rows.withColumn("_stored", F.monotonically_increasing_id()), ["_stored"], "place").drop("_stored")


@R.add("legal_names", "SELECT n_nationkey AS a_1st_key, n_name AS full_name, n_regionkey AS full_name_2 FROM nation")
def legal_names(spark, sf_dir):
    return relational.validate_attr(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF("1st key", "full name", "full-name"))


@R.add("equal_count_bins", "SELECT count(*)::BIGINT AS rows, true AS even_ FROM part")
def equal_count_bins(spark, sf_dir):
    bins = relational.histogram_equicount(table(spark, sf_dir, "part"), "p_retailprice", 4)
    return bins.agg(F.sum("n").alias("rows"), ((F.max("n") <= 1.2 * F.min("n")) & (F.count("*") == 4)).alias("even_"))


@R.add("values_of_functions", "SELECT r_regionkey, 2 * r_regionkey + 1 AS twice, [1, 2, 4, 8, 16] AS doubled FROM region")
def values_of_functions(spark, sf_dir):
    doubled = relational.whiledo(1, lambda x: x < 10, lambda x: 2 * x)
    return relational.within(table(spark, sf_dir, "region"),
        lambda r: r.select("r_regionkey", (2 * c("r_regionkey") + 1).alias("twice"), F.array(*map(F.lit, doubled)).alias("doubled")))


@R.add("supersteps", "SELECT n_nationkey AS node, n_regionkey + 3 AS value FROM nation")
def supersteps(spark, sf_dir):
    """Each vertex adds 1 for each of three messages."""
    start = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("node"), c("n_regionkey").alias("value"))

    def compute(vertices, messages):
        new = vertices.join(messages.withColumnRenamed("node", "to"), c("node") == c("to")).select("node", (c("value") + 1).alias("value"), "left")
        return new.select("node", "value"), new.filter("left > 1").select("node", (c("left") - 1).alias("left"))

    return graph.pregel(start, start.select("node", F.lit(3).alias("left")), compute)


@R.add("optics_cores", "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), d AS (SELECT a.vec_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a, p b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS i FROM d) SELECT vec_id, CASE WHEN d <= 0.05 THEN round(d, 9) END AS core FROM r WHERE i = 4")
def optics_cores(spark, sf_dir):
    return patterns.optics(points(spark, sf_dir), "vec_id", "x", "y", 0.05, 4).select("vec_id", F.round("core", 9).alias("core"))


FLOCK_SQL = """WITH RECURSIVE p AS (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY ALL),
    e AS (SELECT a.day, a.user_id AS i, b.user_id AS j FROM p a JOIN p b ON a.day = b.day AND a.user_id <> b.user_id AND abs(a.x - b.x) <= 0.2),
    r(day, id, other) AS (SELECT day, user_id, user_id FROM p UNION SELECT r.day, r.id, e.j FROM r JOIN e ON r.day = e.day AND r.other = e.i),
    g AS (SELECT DISTINCT day, members FROM (SELECT day, id, list_sort(list(other)) AS members FROM r GROUP BY day, id) WHERE len(members) >= 2),
    w AS (SELECT *, day - row_number() OVER (PARTITION BY members ORDER BY day) AS run FROM g) SELECT members, min(day) AS first, max(day) AS last FROM w
    GROUP BY members, run"""


@R.add("flocks", FLOCK_SQL)
def flocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    at = e.select("user_id", F.floor(c("ts").cast("timestamp").cast("long") / 86400).alias("day"), "value").groupBy("user_id",
        "day").agg(F.avg("value").alias("x"))
    return patterns.flocks(at.withColumn("y", F.lit(0.0)), "user_id", "day", "x", "y", 0.2, 2, 1)


def _kmeans_sql(k, rounds):
    out = f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster, e FROM v ORDER BY vec_id LIMIT {k})"
    for i in range(1, rounds + 1):
        out += f""", a{i} AS (SELECT vec_id, v.e AS e, arg_min(cluster, list_distance(v.e, c{i - 1}.e)) AS cluster FROM v, c{i - 1} GROUP BY vec_id, v.e),
        c{i} AS (SELECT cluster, list(m ORDER BY d) AS e FROM (SELECT cluster, d, avg(x) AS m FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e,
        1) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster)"""
    return f"{out} SELECT cluster, count(*) AS n FROM a{rounds} GROUP BY cluster"


@R.add("kmeans", _kmeans_sql(4, 3))
def kmeans(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    start = [list(map(float, r.embedding)) for r in e.orderBy("vec_id").limit(4).collect()]
    return patterns.kmeans(e, "embedding", 4, 3, start).select("cluster", "n")


@R.add("stream_clients", "SELECT 'cheap' AS client, count(*) AS n, sum(event_id)::BIGINT AS s FROM events WHERE value < 10 UNION ALL SELECT 'errors', count(*), sum(event_id)::BIGINT FROM events WHERE event_type = 'error'")
def stream_clients(spark, sf_dir):
    """Clients of one stream get their rows of every batch, until the stream is stopped."""
    out, hub = folder(spark, "clients"), streams.Coordinator()
    store = lambda name: lambda rows, n: rows.select(F.lit(name).alias("client"), "event_id").write.mode("overwrite").parquet(f"{out}/{name}/{n}")
    hub.register("cheap", "value < 10", store("cheap"))
    hub.register("errors", c("event_type") == "error", store("errors"))
    hub.register("gone", "true", store("gone"))
    hub.unregister("gone")
    q = hub.start(streams.replay(spark, f"{sf_dir}/events.parquet"), f"{out}-state")
    q.processAllAvailable()
    streams.stop_after(q, 1)
    return spark.read.schema("client string, event_id long").option("recursiveFileLookup", True).parquet(out).groupBy("client").agg(F.count("*").alias("n"),
        F.sum("event_id").alias("s"))


@R.add("stream_side_effects", "SELECT count(*) * 2 AS n, sum(value)::BIGINT AS whole FROM (SELECT event_id, floor(value) AS value FROM events)")
def stream_side_effects(spark, sf_dir):
    """What each batch stores beside the stream, once at once and once at a fixed interval."""
    out = folder(spark, "effects")
    for name, start in (("a", streams.side_effect), ("b", lambda df, f, state: streams.paced(df, "1 second", f, state))):
        q = start(streams.replay(spark, f"{sf_dir}/events.parquet"),
            lambda rows, n, name=name: rows.select("event_id", F.lit(name).alias("name"),
                F.floor("value").alias("v")).write.mode("overwrite").parquet(f"{out}/{name}/{n}"), f"{out}-{name}")
        q.processAllAvailable()
        q.stop()
    found = spark.read.schema("event_id long, name string, v long").option("recursiveFileLookup", True).parquet(out)
    return found.agg(F.count("*").alias("n"), F.sum(F.when(c("name") == "b", c("v"))).alias("whole"))


@R.add("lossy_counts_few", "WITH l AS (SELECT greatest(l_linenumber, 3)::VARCHAR AS value FROM lineitem) SELECT value FROM l GROUP BY value HAVING count(*) > 0.25 * (SELECT count(*) FROM l)")
def lossy_counts_few(spark, sf_dir):
    """Fewer counters than values: the frequent ones are surely among those found."""
    rows = table(spark, sf_dir, "lineitem").select(F.greatest(c("l_linenumber"), F.lit(3)).cast("string").alias("line"))
    found = sketches.lossy_counts(rows, "line", 0.25)
    total = rows.agg((F.count("*") * 0.25).alias("least"))
    frequent = rows.groupBy("line").count().crossJoin(total).filter("count > least").select("line")  # one row
    return found.join(frequent, c("value") == c("line")).select("value")
