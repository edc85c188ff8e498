"""Continuous operation: change detection, debounce, running totals and metering."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.lineage import ensure_checkpoint_dir


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change, changed) between two listings (path, changed): new, changed or deleted files."""
    p = previous.select("path", F.col("changed").alias("__before"))
    c = current.select("path", F.col("changed").alias("__after"))
    kind = F.when(F.col("__before").isNull(), "new").when(F.col("__after").isNull(), "deleted").when(F.col("__before") != F.col("__after"), "changed")
    return p.join(c, "path", "full").select("path", kind.alias("change"), F.coalesce("__after", "__before").alias("changed")).where("change is not null")


def trigger(found: DataFrame) -> DataFrame:
    """The change that sets off an analysis: the first by time, then path."""
    return found.orderBy("changed", "path").limit(1)


def bursts(events: DataFrame, key: str, at: str, gap: str = "200 milliseconds") -> DataFrame:
    """(key, started, ended, events): events closer than ``gap`` form one burst, which fires once, a gap after its last event."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.max(at).alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "events")


def metering(runs: DataFrame, user: str = "user_id", at: str = "timestamp") -> DataFrame:
    """Running (user_id, month, analyses) of a stream or a table of runs."""
    return runs.groupBy(F.col(user).alias("user_id"), F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("analyses"))


def totals(runs: DataFrame) -> DataFrame:
    """Running totals of runs and issues."""
    return runs.groupBy().agg(F.count("*").alias("runs"), F.sum(F.coalesce("total_issues", F.lit(0))).alias("issues"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is available and gives its result table, kept in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/stream-{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    save: Callable[[DataFrame, int], None] = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(folder + "/table")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder + "/log").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/table")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, with the schema that the table has."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a file source reads folders


def _stored(spark: SparkSession, folder: str) -> int:
    """The number of the newest listing that is stored whole below ``folder``, -1 for none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return -1
    names = [x.getPath().getName() for x in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return max((int(n) for n in names if n.isdigit()), default=-1)


class Watcher:
    """What the watch loop keeps between ticks: the listing of the last tick, and the one that was analysed last, which is
    stored below ``folder``, so that a loop that starts again finds what changed while it was down."""

    def __init__(self, spark: SparkSession, listing: Callable[[], DataFrame], analyse: Callable[[DataFrame], None], folder: str):
        self.spark, self.listing, self.analyse, self.folder = spark, listing, analyse, folder
        self.number = _stored(spark, folder)
        first = self._seen()
        if self.number < 0:
            self._store(first)
        self.analysed = spark.read.schema(first.schema).parquet(f"{folder}/{self.number}")
        self.last, self.pending = first, not changes(self.analysed, first).isEmpty()

    def _seen(self) -> DataFrame:
        return self.listing().cache()

    def _store(self, listing: DataFrame) -> None:
        self.number += 1
        listing.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{self.number}")

    def tick(self) -> None:
        """Compares the listing with the last one; once it has been quiet for a tick, what changed since the last analysis is analysed."""
        now = self._seen()
        if not changes(self.last, now).isEmpty():
            self.pending = True
        elif self.pending:
            self.pending = False
            self.analyse(changes(self.analysed, now))
            self._store(now)  # stored after the analysis: one that fails is made again
            self.analysed = self.spark.read.schema(now.schema).parquet(f"{self.folder}/{self.number}")
        self.last.unpersist()
        self.last = now


def watch(spark: SparkSession, listing: Callable[[], DataFrame], analyse: Callable[[DataFrame], None], every: str = "500 milliseconds", location: str | None = None):
    """Starts the loop: at every tick the listing (path, changed) is compared with the one kept from the last tick;
    ``analyse`` receives all changes since the last analysis if the listing has been quiet for one tick. With ``location``
    a loop that starts again goes on from the listing that was analysed last. Returns the query."""
    if not location:
        ensure_checkpoint_dir(spark)
        location = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/watch-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    watcher = Watcher(spark, listing, analyse, location + "/listings")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, __: watcher.tick())
    return writer.option("checkpointLocation", location + "/log").start()
