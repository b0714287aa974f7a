"""Progress of collection as streams of source events: counts so far, windows, distinct events, a feed from a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 8) -> DataFrame:
    """Events as they land as Parquet under ``path``; offsets are the files seen, so a restart goes on where it was.

    Files come in the order in which they were written. ``files_per_trigger`` None takes all that are there as one micro-batch: for
    logs at rest whose files overlap in time, where events of a later file are not to be late.

    A path that is one file is watched for in its folder. Times without a zone are read in the session's.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(path.rsplit("/", 1)[-1]):
        folder, _, name = path.rpartition("/")
        out = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        out = reader.parquet(path)
    return out.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in out.schema.fields])


def phase_counts(events: DataFrame, phase: str = "event_type") -> DataFrame:
    """How many events of each phase so far (complete or update mode)."""
    return events.groupBy(phase).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", phase: str = "event_type", size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each phase by event-time window; windows close when the watermark passes them."""
    at = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(at.alias("w"), phase).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), phase, "n")


def sessions(events: DataFrame, time: str = "ts", who: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), who).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), who, "n")


def distinct_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """Each event once, if its repeats come within ``late``; older keys are forgotten, so state stays bounded.

    Events behind the watermark are dropped, so with a ``late`` they have to land about in order of time. ``late`` None takes
    each once in whatever order they land and however far apart repeats are: no key is forgotten, state has them all on disk.
    """
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


def since(feed: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """What a poll from ``cursor`` gets."""
    return feed.where(F.col(order) > cursor)


def start(df: DataFrame, name: str, mode: str = "complete", every: str | None = "400 milliseconds") -> StreamingQuery:
    """A query that keeps its result in a table ``name``; ``every`` None takes what is there and ends. ``stop()`` cancels.

    That table lies in the driver's memory: for counts of phases and the like. Rows of events go :func:`into` files.
    """
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(df: DataFrame, at: str, mode: str = "complete") -> DataFrame:
    """The result over all that is there, kept as files in the new folder ``at``: executors write it, no row of it reaches the driver."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(f"{at}/rows/batch=-1")  # the schema, if nothing comes
    into(df, f"{at}/rows", f"{at}/checkpoint", mode=mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows").select(*df.columns)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def into(events: DataFrame, path: str, checkpoint: str, batch=None, mode: str = "append") -> StreamingQuery:
    """Each micro-batch appended to ``path``; its number is a partition that a repeat overwrites, so every event is there once.

    In complete mode a batch is the whole result and takes the place of the last one. State lies in RocksDB, on disk, not in
    the executors' heaps.
    """

    def put(df: DataFrame, number: int) -> None:
        (batch(df) if batch else df).write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    conf = events.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return events.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_STORE, before)
