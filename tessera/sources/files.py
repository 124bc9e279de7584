"""File formats: CSV by a template's schema, JSON lines, texts, GeoJSON, GPX, ESRI shapefiles and grids, dBase, point clouds, AIS messages.

Files are listed and read by Spark (any storage it knows); each binary file is parsed by one task, many files by many. Writers are
Spark's own, or text that Spark writes.
"""

from __future__ import annotations

import json
import re
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

POINTS = "array<struct<x:double,y:double>>"


def csvimport(spark: SparkSession, path: str, schema: StructType | str, skip: int = 0, comment: str = "", separator: str = ",") -> DataFrame:
    """CSV with the schema of a template; the first `skip` lines of each file and lines that begin with the comment mark don't count."""
    reader = spark.read.schema(schema).option("sep", separator).option("mode", "PERMISSIVE")
    reader = reader.option("comment", comment) if comment else reader
    if skip == 0:
        return reader.csv(path)
    if skip == 1:
        return reader.option("header", True).option("enforceSchema", True).csv(path)
    # the first lines are in the first split of a file, in the order in which they are read
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    heads = Window.partitionBy("_file").orderBy("_block", "_id")
    first = lines.filter("_block = 0").withColumn("_row", F.row_number().over(heads)).filter(F.col("_row") <= skip).select("_id")
    lines = lines.join(F.broadcast(first), "_id", "left_anti").filter(F.length("value") > 0)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    text = schema if isinstance(schema, str) else schema.toDDL()
    return lines.select(F.from_csv("value", text, {"sep": separator}).alias("r")).select("r.*")


def csvexport(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    df.write.option("sep", separator).option("header", header).csv(path)


def sqlexport(df: DataFrame, path: str, table: str) -> None:
    """One INSERT statement a line."""
    shown = (F.when(F.col(c).isNull(),
        "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if t in ("string", "timestamp",
            "timestamp_ntz", "date") else F.col(c).cast("string")) for c, t in df.dtypes)
    df.select(F.concat(F.lit(f"INSERT INTO {table} VALUES ("), F.concat_ws(", ", *shown), F.lit(");"))).write.text(path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_file(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.text(path)


def jsonimport(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def jdbc(spark: SparkSession, url: str, query: str, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """An external SQL system's result. With split (column, low, high, parts) it is read by so many tasks, each with a range of the column, else by one."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if split is None:
        return reader.option("query", query).load()
    column, low, high, parts = split
    return reader.options(dbtable=f"({query}) T", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
DERBY_TYPES = {"tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "string": "VARCHAR(32672)"}


def derby(df: DataFrame, path: str, name: str) -> str:
    """Write df as the table `name` of a Derby database and return its URL: an archive in a folder that all processes mount, which any number of them may read.

    A database in memory, or a folder that a process has opened, can't be seen by others. Tasks write the rows as CSV, the driver's Derby imports them.
    """
    spark = df.sparkSession
    local = _local(path)
    if local is None:
        raise ValueError(f"Derby reads mounted folders only, not {path}")
    df.write.option("emptyValue", '""').option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{path}/rows")
    jvm = spark._jvm
    driver = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(DERBY).getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class,
        0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    connect = lambda more: driver.connect(f"jdbc:derby:{local}/db;{more}", jvm.java.util.Properties())
    connection = connect("create=true")
    do = connection.createStatement()
    do.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)} {DERBY_TYPES.get(t) or t.upper()}" for c, t in df.dtypes)})')
    for part in sorted(Path(local, "rows").glob("part-*")):
        do.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name}', '{part}', ',', '\"', 'UTF-8', 0)")
    # a read-only database sorts outside its archive
    do.execute(f"CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.tempDirectory', '{tempfile.gettempdir()}')")
    connection.close()
    try:
        connect("shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # that is how Derby says it has closed the database
            raise
    with zipfile.ZipFile(f"{local}/db.jar", "w") as archive:
        for file in sorted(Path(local, "db").rglob("*")):
            if file.name not in ("db.lck", "dbex.lck"):
                archive.write(file, file.relative_to(local))
    return f"jdbc:derby:jar:({local}/db.jar)db"


def _local(path: str) -> str | None:
    """The path on this machine's file system, or None for other storages."""
    if path.startswith("file:"):
        return re.sub(r"^file:/*", "/", path)
    return path if path.startswith("/") else None


def _parsed(spark: SparkSession, path: str, schema: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = parse(bytes(content))
                while part := [x for _, x in zip(range(5000), rows, strict=False)]:
                    yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _shapes(data: bytes) -> Iterator[tuple]:
    at, number = 100, 0
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, at, number = data[at + 8 : at + 8 + size], at + 8 + size, number + 1
        kind = struct.unpack("<i", body[:4])[0] % 10
        point = lambda o, body=body: dict(zip(("x", "y"), struct.unpack("<2d", body[o : o + 16]), strict=True))
        if kind == 1:
            yield number, "point", [[point(4)]]
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            yield number, "points", [[point(40 + 16 * i) for i in range(n)]]
        elif kind in (3, 5):
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            base = 44 + 4 * parts
            yield number, "line" if kind == 3 else "region", [[point(base + 16 * i) for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        else:
            yield number, "null", None


def shpimport(spark: SparkSession, path: str) -> DataFrame:
    """No (record number from 1), Kind (point, points, line, region, null), Parts (arrays of points)."""
    return _parsed(spark, path, f"No int, Kind string, Parts array<{POINTS}>", _shapes)


def _records(fields: list[str]):
    def parse(data: bytes) -> Iterator[tuple]:
        count, head, size = struct.unpack("<IHH", data[4:12])
        columns, at = [], 32
        while data[at] != 0x0D:
            columns.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
            at += 32
        for i in range(count):
            row = data[head + i * size : head + (i + 1) * size]
            if row[:1] == b"*":
                continue
            values, o = {}, 1
            for name, width in columns:
                values[name] = row[o : o + width].decode("latin-1").strip() or None
                o += width
            yield tuple(values.get(f) for f in fields)

    return parse


def dbimport(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """dBase III with the given columns; deleted records are left out, texts that don't fit a type are null."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = kind.fieldNames()
    texts = _parsed(spark, path, ", ".join(f"{n} string" for n in names), _records(names))
    cast = {f.name: F.to_date(f.name, "yyyyMMdd") if f.dataType.simpleString() == "date" else F.col(f.name).try_cast(f.dataType) for f in kind}
    return texts.select(*(c.alias(n) for n, c in cast.items()))


def _tracks(data: bytes) -> Iterator[tuple]:
    local = lambda e: e.tag.rpartition("}")[2]
    track = segment = -1
    for e in ET.fromstring(data).iter():
        if local(e) in ("trk", "rte"):
            track, segment = track + 1, -1 if local(e) == "trk" else 0
        elif local(e) == "trkseg":
            segment += 1
        elif local(e) in ("trkpt", "rtept", "wpt"):
            values = {local(x): x.text for x in e}
            yield track, max(segment, 0), float(e.get("lat")), float(e.get("lon")), float(values["ele"]) if values.get("ele") else None, values.get("time"), values.get("name")


def gpximport(spark: SparkSession, path: str) -> DataFrame:
    """Track (-1 for way points), Segment, Lat, Lon, Elevation, Time, Name."""
    out = _parsed(spark, path, "Track int, Segment int, Lat double, Lon double, Elevation double, Time string, Name string", _tracks)
    return out.withColumn("Time", F.try_to_timestamp("Time"))


def _features(data: bytes) -> Iterator[tuple]:
    top = json.loads(data)
    for i, f in enumerate(top["features"] if top.get("type") == "FeatureCollection" else [top]):
        g = f.get("geometry", f) or {}
        kind, xs = g.get("type"), g.get("coordinates")
        depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}.get(kind)
        if depth is None:
            continue
        for _ in range(2 - depth):
            xs = [xs]
        xs = [ring for polygon in xs for ring in polygon] if depth == 3 else xs
        yield i, kind, [[{"x": float(p[0]), "y": float(p[1])} for p in part] for part in xs], json.dumps(f.get("properties") or {})


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """No, Kind, Parts, Properties (JSON) of a file's features."""
    return _parsed(spark, path, f"No int, Kind string, Parts array<{POINTS}>, Properties string", _features)


def _grid(data: bytes) -> Iterator[tuple]:
    lines = data.decode().split("\n")
    head: dict[str, float] = {}
    while lines and re.match(r"\s*[A-Za-z]", lines[0]):
        name, value = lines.pop(0).split()[:2]
        head[name.lower()] = float(value)
    values = " ".join(lines).split()
    columns, rows = int(head["ncols"]), int(head["nrows"])
    for i, v in enumerate(values[: columns * rows]):
        if float(v) != head.get("nodata_value"):
            yield i % columns, rows - 1 - i // columns, head.get("xllcorner", 0.0) + (i % columns) * head["cellsize"], head.get("yllcorner",
                0.0) + (rows - 1 - i // columns) * head["cellsize"], float(v)


def esri_grid(spark: SparkSession, path: str) -> DataFrame:
    """cell_x, cell_y (from the lower left), x, y (the cell's corner), v; cells without data are left out."""
    return _parsed(spark, path, "cell_x int, cell_y int, x double, y double, v double", _grid)


def xyz(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """A point cloud: x, y, z."""
    return spark.read.schema("x double, y double, z double").option("sep", separator).option("mode", "DROPMALFORMED").csv(path)


def _ais(line: str) -> tuple | None:
    parts = line.strip().split(",")
    if len(parts) < 7 or not parts[0].startswith(("!AIVDM", "!AIVDO")) or parts[1] != "1":
        return None
    codes = (ord(c) - 48 for c in parts[5])
    bits = "".join(format(v - 8 if v > 40 else v, "06b") for v in codes)
    if len(bits) < 137 or int(bits[:6], 2) not in (1, 2, 3):
        return None
    signed = lambda a, b: int(bits[a:b], 2) - (1 << (b - a) if bits[a] == "1" else 0)
    return int(bits[:6], 2), int(bits[8:38], 2), int(bits[38:42], 2), int(bits[50:60], 2) / 10, signed(61, 89) / 600_000, signed(89,
        116) / 600_000, int(bits[116:128], 2) / 10, int(bits[137:143] or "0", 2)


def importais(spark: SparkSession, path: str) -> DataFrame:
    """Position reports of AIS text messages: Kind, Mmsi, Status, Speed, Lon, Lat, Course, Second; other messages are left out."""
    schema = "Kind int, Mmsi long, Status int, Speed double, Lon double, Lat double, Course double, Second int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for x in map(_ais, frame["value"]) if x], columns=names)

    return spark.read.text(path).mapInPandas(run, schema)


# Writers for formats that are one file: tasks encode the rows, and one of them writes the file as a stream. Nothing of it comes to the driver


def _write_file(df: DataFrame, path: str, encode: Callable[[tuple], bytes], head: bytes, tail: bytes = b"", numbered: bool = False) -> None:
    """A file of the encoded rows of df in their order, between head and tail; numbered: each behind its number (from 1) as four bytes."""

    def encoded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at, *columns = (c.to_pylist() for c in frame.columns)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(list(map(encode, zip(*columns, strict=True))), pa.binary())], ["at", "data"])

    def written(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, n = _local(path), 0
        if local is None:
            storage, place = pafs.FileSystem.from_uri(path)
            target = storage.open_output_stream(place)
        else:
            Path(local).parent.mkdir(parents=True, exist_ok=True)
            target = open(local, "wb")  # noqa: SIM115
        with target:
            target.write(head)
            for frame in frames:
                data = frame.column(1).to_pylist()
                if numbered:
                    data = [struct.pack(">i", i) + x for i, x in enumerate(data, n + 1)]
                n += len(data)
                target.write(b"".join(data))
            target.write(tail)
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.monotonically_increasing_id().alias("_at"), *df.columns).mapInArrow(encoded, "at long, data binary")
    rows.repartition(1).sortWithinPartitions("at").mapInArrow(written, "n long").collect()


def db3export(df: DataFrame, path: str) -> None:
    """dBase III: texts as C (at most 254 bytes, longer ones are an error), numbers as N, dates as D, booleans as L; null is blank."""
    shown, fields = [], []
    widths = df.agg(*(F.max(F.octet_length(F.col(c).cast("string"))).alias(f"_{i}") for i, c in enumerate(df.columns))).first()
    for i, (c, t) in enumerate(df.dtypes):
        kind = "L" if t == "boolean" else "D" if t == "date" else "N" if t in ("tinyint", "smallint", "int", "bigint", "double",
            "float") or t.startswith("decimal") else "C"
        width = 1 if kind == "L" else 8 if kind == "D" else max(1, widths[i] or 1)
        if width > 254:
            raise ValueError(f"a text in {c} has more than 254 bytes")
        fields.append(c.encode()[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14)
        text = F.when(F.col(c), "T").otherwise("F") if kind == "L" else F.date_format(c, "yyyyMMdd") if kind == "D" else F.col(c).cast("string")
        shown.append((F.when(F.col(c).isNotNull(), text), kind, width))
    size = 1 + sum(w for _, _, w in shown)

    def record(row: tuple) -> bytes:
        cells = ((x or "").encode() for x in row)
        return b" " + b"".join(x.rjust(w) if kind == "N" else x.ljust(w) for x, (kind, w) in zip(cells, kinds, strict=True))

    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, df.count(), 32 + 32 * len(fields) + 1, size) + b"".join(fields) + b"\r"
    kinds = [(kind, width) for _, kind, width in shown]
    _write_file(df.select(*(c.alias(f"c{i}") for i, (c, _, _) in enumerate(shown))), path, record, head, b"\x1a")


def shpexport(df: DataFrame, path: str, parts: str, kind: str) -> None:
    """A shapefile of points, lines or regions (kind point, line or region) from a column of parts (arrays of points); null is a null shape."""
    code = {"point": 1, "line": 3, "region": 5}[kind]
    low_high = lambda n: (F.min(F.array_min(F.transform(F.flatten(parts), lambda p: p[n]))),
        F.max(F.array_max(F.transform(F.flatten(parts), lambda p: p[n]))))
    n_points, n_parts = F.size(F.flatten(parts)), F.size(parts)
    words = F.when(F.col(parts).isNull(), 2).otherwise(10 if code == 1 else (44 + 4 * n_parts + 16 * n_points) / 2)
    x, y, total = low_high("x"), low_high("y"), F.sum(words + 4)
    stats = df.agg(x[0].alias("a"), y[0].alias("b"), x[1].alias("c"), y[1].alias("d"), total.alias("n")).first()

    def record(row: tuple) -> bytes:
        shape = row[0] and [[(p["x"], p["y"]) for p in part] for part in row[0]]
        if row[0] is None:
            body = struct.pack("<i", 0)
        elif code == 1:
            body = struct.pack("<i2d", 1, *shape[0][0])
        else:
            flat, starts, at = [p for part in shape for p in part], [], 0
            for part in shape:
                starts.append(at)
                at += len(part)
            box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
            body = struct.pack(f"<i4d2i{len(starts)}i", code, *box, len(starts), len(flat), *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        return struct.pack(">i", len(body) // 2) + body

    box = [stats[n] or 0.0 for n in "abcd"]
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + int(stats.n or 0)) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0)
    _write_file(df.select(parts), path, record, head, numbered=True)
