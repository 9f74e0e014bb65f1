"""Continuous ingestion of a folder of text files into chunk tables.

Decoding, cleaning and chunking work row by row, so the stream keeps no state; each micro-batch is appended to the collection.
Collection-wide statistics (document frequencies, mean lengths) are recomputed from the collection in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.config import DEFAULTS, EngineConfig
from lexloom.functions import text as T
from lexloom.operators import chunking
from lexloom.sources.readers import decode, document_id, law_name


def documents_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(folder)
    rows = files.select(document_id(F.col("path"), F.lit(0)).alias("doc_id"), T.normalize(T.clean(decode(F.col("content")))).alias("text"), law_name(F.col("path")).alias("law_name"))
    return rows.where("text <> ''")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, strategy: str = "article", config: EngineConfig = DEFAULTS, once: bool = False) -> StreamingQuery:
    """Chunks of new files appended to ``out`` as Parquet; a batch that is retried replaces its own folder, so none is doubled."""
    docs = documents_stream(spark, folder)

    def write(batch: DataFrame, epoch: int) -> None:
        options = {"size": config.chunk_size, "overlap": config.chunk_overlap} if strategy in ("article", "sliding_window", "recursive") else {}
        chunking.chunk(batch, strategy, **options).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
