"""Row-local stages as a stream: new JSON-lines files are parsed, flattened and checked as they arrive.

Everything is narrow, so that append mode needs no state or watermark; the sink's checkpoint makes it exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.checks import detect
from loomspark.operators.normalise import flatten
from loomspark.sources.records import parse_lines


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parsed lines of all text files that the folder has or gets."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Processes what is there and ends: flat records, anomalies and rejected lines go to three tables under ``out``.

    A batch that is repeated after a failure overwrites its own partition, so that nothing is written twice.
    """

    def sink(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        good = batch.where("status = 'ok'").drop("value", "status", "errors")
        for name, df in (("candidates", flatten(good)), ("anomalies", detect(good)), ("rejected", batch.where("status <> 'ok'").select("value", "status", "errors"))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        batch.unpersist()

    q = stream_lines(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def counts(spark: SparkSession, out: str) -> DataFrame:
    """Rows by table and batch."""
    parts = [spark.read.option("basePath", f"{out}/{t}").parquet(f"{out}/{t}").groupBy("batch").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "batch", "rows") for t in ("candidates", "anomalies", "rejected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
