"""Changes as a stream.

One query writes a table, micro-batch by micro-batch, so writes are serial.  The number of
the last batch is part of the table's metadata and published with the data: a batch that is
run again after a failure changes nothing, so each change takes effect once.  What became of
each change, refused ones too, is written with its batch: ``Table.outcomes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine

OPS = "seq bigint, op string, key string, body string"


def changes(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON lines (seq, op, key, body) from a folder; at most so many files a batch."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", max_files).json(path)


def ingest(engine: Engine, db: str, table: str, stream: DataFrame, checkpoint: str, name: str = "ingest", available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Start applying a stream of changes to a table."""
    engine.table(db, table)

    def batch(df: DataFrame, number: int) -> None:
        engine.apply(db, table, df, (name, number))

    writer = stream.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    query = writer.start()
    engine.streams.append(query)
    return query
