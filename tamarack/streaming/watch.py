"""Conformance of a stream: every micro-batch is judged as a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tamarack.ontology import Ontology
from tamarack.operators.conformance import check
from tamarack.sources.catalog import from_frames


def watch(stream: DataFrame, table: str, ontology: Ontology, out: str, checkpoint: str, script: str = "", once: bool = False) -> StreamingQuery:
    """Writes the findings of each micro-batch of ``stream``, taken as ``table``, to ``out/batch=N``.

    A batch that is run again after a failure overwrites its findings. ``checkpoint`` and ``out`` are
    folders that all executors share. With ``once``, what is there is judged and the query ends.
    """

    def judge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            report = check(ontology, from_frames({table: batch}, script, f"{table}, batch {number}"), batch.sparkSession.version)
            report.to_frame(batch.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
