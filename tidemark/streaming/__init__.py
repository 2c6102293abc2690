"""Position cleaning on a stream.

Cleaning is row-local, so the batch operator serves streams unchanged; nothing else in
the library needs state across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ais import clean_positions


def append_stream(raw: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Clean a streaming source and append it to the position store, one folder per day, as the batch ``stream``."""
    out = clean_positions(raw).withColumns({"date": F.to_date("ts"), "batch": F.lit("stream")})
    writer = (out.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
              .partitionBy("date", "batch").outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
