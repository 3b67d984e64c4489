"""Scoring of a stream of embeddings against a fixed bank. Without state: each batch is scored as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from patchmill.operators.knn import anomaly_scores, knn_join


def score_stream(stream: DataFrame, bank: DataFrame, out: str, checkpoint: str, *, query_id: str, bank_id: str, vector: str, dim: int, threshold: float, k: int = 1, keys: list[str] = []) -> StreamingQuery:  # noqa: B006
    """Starts a query that appends (keys, query_id, score, flag) to the Parquet folder `out`, each batch in a folder of its
    own, so that a batch that runs again after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        near = knn_join(df, bank, query_id=query_id, bank_id=bank_id, vector=vector, k=k, keys=keys)
        scored = anomaly_scores(near, keys, query_id, dim).withColumn("flag", F.col("score") > threshold)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
