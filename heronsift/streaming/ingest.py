"""Incremental ingestion: new chunks only, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest_once(spark: SparkSession, source: str, schema, store: str, checkpoint: str, id_col: str = "chunk_id") -> None:
    """Append rows of new files under ``source`` whose ids ``store`` lacks.

    A repeated batch finds its rows stored and adds nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([id_col])
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(store)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.schema(batch.schema).parquet(store).select(id_col), id_col, "left_anti")
        new.write.mode("append").parquet(store)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
