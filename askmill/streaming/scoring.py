"""An extension: scoring predictions as they arrive.

Each micro-batch appends the scores of predictions that aren't scored yet; a replayed batch finds its rows
already there, so the sink holds each prediction once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from askmill.operators.scoring import matched, official_rows


def score_stream(predictions: DataFrame, examples: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    spark = examples.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = official_rows(matched(batch, examples))
        try:
            rows = rows.join(spark.read.parquet(sink).select("pred_id"), "pred_id", "left_anti")
        except Exception as e:  # the first batch has no sink yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(sink)

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
