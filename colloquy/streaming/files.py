"""Transcript files as a stream: each micro-batch of new files is parsed like a batch of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.session import ship
from colloquy.sources.readers import parse_transcripts, quarantine


def stream_turns(spark: SparkSession, source: str, sink: str, checkpoint: str, merge: bool = True, max_gap_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Turns of every new file under `source` appended to the table `sink`/turns, unreadable files to `sink`/quarantine.

    A file is one document, so no state is kept between batches; `checkpoint` makes each file count once. A batch that is
    run again after a failure overwrites its own folder.
    """
    ship(spark)
    files = spark.readStream.format("text").option("wholetext", "true").load(source)
    files = files.select(F.col("_metadata.file_path").alias("transcript_id"), F.regexp_replace(F.make_valid_utf8("value"), r"\r\n?", "\n").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        parse_transcripts(batch, merge=merge, max_gap_ms=max_gap_ms).write.mode("overwrite").parquet(f"{sink}/turns/batch={number}")
        quarantine(batch).select("transcript_id", "reason").write.mode("overwrite").parquet(f"{sink}/quarantine/batch={number}")

    out = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
