"""Feed entries as a stream into a ledger table, one micro-batch at a time.

A batch writes what it adds, under its own number, so that a batch that runs
twice writes the same rows twice in one place. Every GATHER batches the ledger
is gathered into one table without what is no longer kept, and what only older
tables were made of is deleted. So a batch reads one table and less than twice GATHER
small ones, however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.ledger import KEEP, new_entries, on_top, retained

LEDGER = (
    "channel string, seq bigint, title string, description string, audio_url string, pub_date string, "
    "guid string, duration bigint, file_size bigint"
)


#: Batches from one gathered table to the next.
GATHER = 20


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The batches whose tables under path are whole."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    found = (int(x[2:]) for x in names if x.startswith("v="))
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def read_ledger(spark: SparkSession, path: str, before: int | None = None, keep: int = KEEP) -> DataFrame:
    """The ledger, or what it was before a batch; empty if there is none."""
    earlier = lambda kind: [n for n in _numbers(spark, f"{path}/{kind}") if before is None or n < before]
    base = max(earlier("gathered"), default=-1)
    tables = [f"{path}/gathered/v={base}"] * (base >= 0) + [f"{path}/added/v={n}" for n in earlier("added") if n > base]
    if not tables:
        return spark.createDataFrame([], LEDGER)
    return retained(spark.read.schema(LEDGER).parquet(*tables), keep).where("kept").drop("kept")


def publish_stream(entries: DataFrame, path: str, checkpoint: str, keep: int = KEEP, website: str = "") -> StreamingQuery:
    """Start a query that publishes entries (channel, pos, title, description, link, pub_date, audio_url) as they come.

    An entry without a date gets the time of its batch, one without a link a
    guid of that time, its channel and its place in the ledger.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        history = read_ledger(spark, path, number, keep)
        fresh = new_entries(rows, history, by=("channel",)).withColumns(
            {"guid": F.col("link"), "duration": F.lit(0).cast("bigint"), "file_size": F.lit(0).cast("bigint")}
        )
        on_top(history, fresh.drop("link"), F.current_timestamp(), F.lit(website)).write.mode("overwrite").parquet(f"{path}/added/v={number}")
        if number % GATHER == GATHER - 1:
            added = spark.read.schema(LEDGER).parquet(f"{path}/added/v={number}")
            whole = retained(history.unionByName(added), keep).where("kept").drop("kept")
            whole.write.mode("overwrite").parquet(f"{path}/gathered/v={number}")
            # this batch may run again, from the gathered table before it
            last = max((n for n in _numbers(spark, f"{path}/gathered") if n < number), default=-1)
            for kind, upto in (("gathered", last - 1), ("added", last)):
                for n in _numbers(spark, f"{path}/{kind}"):
                    if n <= upto:
                        _delete(spark, f"{path}/{kind}/v={n}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
