"""D6 over a stream of questions: Structured Streaming + a static index.

Each micro-batch of questions runs the same batch retrieval plan against
the (materialised) term index; results go to ``<sink>/epoch=<id>`` with
overwrite, so a re-run batch after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieve as rt
from ..operators.index import TermIndex


def start_retrieval(questions: DataFrame, index: TermIndex, sink: str, checkpoint: str,
                    k: int = 5, ranker: str = "bm25", available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``questions`` is a streaming ``(query_id, question)`` frame."""

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        top = rt.retrieve(index, batch.select("query_id", "question"), k=k, ranker=ranker)
        top.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch_id}")

    writer = questions.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
