"""Sentence vectors of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators.documents import IN_PLACE_LIMIT_BYTES, transform_documents
from lexivec.operators.lookup import table_bytes
from lexivec.sources.shared_tables import new_path


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet table at ``path``, be it a folder of part files or one file. (A file stream
    reads folders only, so for one file it is the folder above with a filter on the name.)"""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    alone = any(f.rpartition("/")[2] == name for f in table.inputFiles())
    stream = spark.readStream.schema(table.schema)
    return stream.option("pathGlobFilter", name).parquet(folder) if alone else stream.parquet(path)


def stream_transform(stream: DataFrame, model: DataFrame, input_col: str,
                     output_col: str) -> DataFrame:
    """A streaming ``stream`` plus ``output_col``: a stateless projection, so any sink, trigger
    and output mode will do. For models beyond a broadcast see ``drain_transformed``."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return transform_documents(stream, model, input_col, output_col)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Writes everything available now to the shared folder and returns the written rows."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{path}-progress")
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_transformed(stream: DataFrame, model: DataFrame, input_col: str, output_col: str, label: str,
                      limit: int = IN_PLACE_LIMIT_BYTES) -> DataFrame:
    """Everything available now plus ``output_col``, written to the shared folder.

    A model of at most ``limit`` bytes is applied in the stream; a larger one is joined to each
    micro-batch, whose rows go to a folder of their own, so that a repeated batch replaces itself.
    """
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    if table_bytes(model) <= limit:
        return drain(stream_transform(stream, model, input_col, output_col), label)
    spark = stream.sparkSession
    path = new_path(spark, label)

    def join_batch(rows: DataFrame, number: int) -> None:
        out = transform_documents(rows, model, input_col, output_col, limit)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (stream.writeStream.foreachBatch(join_batch)
             .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start())
    query.awaitTermination()
    vector = stream.limit(0).withColumn(output_col, F.lit(None).cast("array<double>"))
    return spark.read.schema(vector.schema).parquet(f"{path}/batch=*")
