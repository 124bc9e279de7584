"""Structured Streaming: sources, continuous queries and sinks.

Functions take and give streaming DataFrames; `run_bounded` drives one over all input that is there and gives the result as a
batch, for tests and replays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.session import shared_folder


def replay(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: StructType | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(path) if not name.endswith(".parquet") else reader.option("pathGlobFilter", f"{name}").parquet(folder) if not _is_folder(spark,
        path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def from_kafka(spark: SparkSession, servers: str, topic: str, schema: StructType | str, keep_waiting: bool = True) -> DataFrame:
    """JSON values of a topic as typed rows; needs Spark's Kafka package. Without keep_waiting: what is there now, as a batch."""
    reader = (spark.readStream if keep_waiting else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return typed(reader.option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value")), "value", schema)


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def from_socket(spark: SparkSession, host: str, port: int, schema: StructType | str) -> DataFrame:
    return typed(spark.readStream.format("socket").option("host", host).option("port", port).load(), "value", schema)


def forever(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """An endless test stream: timestamp, value."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def variable(df: DataFrame) -> DataFrame:
    """Typed rows to variable ones: one text column `value` with JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def typed(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Variable rows to typed ones; those that don't fit are dropped."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    marked = StructType([*fields.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(column, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.select(parsed.alias("r")).filter("r is not null and r._corrupt is null").select(*(F.col("r")[c].alias(c) for c in fields.fieldNames()))


def windowed(df: DataFrame, time: str, size: str, slide: str | None, late: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by event-time window and keys; rows later than `late` behind the newest are dropped by a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = df.withWatermark(time, late) if df.isStreaming else df
    out = g.groupBy(w.alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, late: str, by: list[str], **aggregates: Column) -> DataFrame:
    g = df.withWatermark(time, late) if df.isStreaming else df
    out = g.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


class Coordinator:
    """Continuous queries over one stream: clients register with a filter and get their rows of every batch."""

    def __init__(self) -> None:
        self.clients: dict[str, tuple[Column | str, Callable[[DataFrame, int], None]]] = {}

    def register(self, name: str, predicate: Column | str, sink: Callable[[DataFrame, int], None]) -> None:
        self.clients[name] = predicate, sink

    def unregister(self, name: str) -> None:
        self.clients.pop(name, None)

    def start(self, df: DataFrame, checkpoint: str):
        def batch(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            for predicate, sink in list(self.clients.values()):
                sink(rows.filter(predicate), number)
            rows.unpersist()

        return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def side_effect(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str):
    return df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).start()


def run_bounded(df: DataFrame, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """All results for the input that is there now, by one run that stops at its end; written in the shared folder.

    With a timeout (seconds) a run that isn't at its end by then is stopped, and TimeoutError is raised: there are no partial results.
    """

    def wait(q) -> None:
        ended = q.awaitTermination() if timeout is None else q.awaitTermination(timeout)
        if timeout is not None and not ended:
            q.stop()
            raise TimeoutError(f"the stream has not ended after {timeout} seconds")

    spark = df.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        wait(q)
        return spark.read.schema(df.schema).parquet(f"{base}/out")

    def overwrite(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(overwrite).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    wait(q)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stop_after(query, seconds: float) -> bool:
    """Wait for a query's end, but stop it after so many seconds; whether it ended by itself."""
    ended = query.awaitTermination(int(seconds))
    if not ended:
        query.stop()
    return bool(ended)


def to_console(df: DataFrame):
    return df.writeStream.format("console").start()


def paced(df: DataFrame, every: str, f: Callable[[DataFrame, int], None], checkpoint: str):
    """A batch at a fixed interval, such as a replay of a table's files."""
    return df.writeStream.trigger(processingTime=every).foreachBatch(f).option("checkpointLocation", checkpoint).start()


def to_socket(df: DataFrame, host: str, port: int, checkpoint: str):
    """Rows as JSON lines to a server; each partition opens its own connection."""

    def send(rows) -> None:
        import socket

        with socket.create_connection((host, port)) as s:
            for r in rows:
                s.sendall((r.value + "\n").encode())

    return variable(df).writeStream.foreachBatch(lambda b, _: b.foreachPartition(send)).option("checkpointLocation", checkpoint).start()
