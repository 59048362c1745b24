"""Event capture as Structured Streaming: ledger rows become outbox events, drained in bounded micro-batches.

Delivery is at least once with a key for dropping repeats (the ledger seq), which makes files exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import publish_subject

LEDGER = "seq bigint, instance_id string, type string, body string, created_by string, ts timestamp"


def events(ledger: DataFrame, kernel: str) -> DataFrame:
    """(ledger_seq, subject, payload, headers) of ledger rows; works on batches and streams."""
    headers = F.map_filter(F.create_map(F.lit("Ck-Seq"), F.col("seq").cast("string"), F.lit("Content-Type"), F.lit("application/json"), F.lit("by"), F.col("created_by")), lambda k, v: v.isNotNull())
    return ledger.select(F.col("seq").alias("ledger_seq"), publish_subject(F.lit(kernel), F.col("type")).alias("subject"), F.encode("body", "UTF-8").alias("payload"), headers.alias("headers"))


def results(requests: DataFrame) -> DataFrame:
    """Replies to requests (kernel, verb, trace_id, seq, reply): their subject and the headers that correlate them."""
    return requests.select(F.concat(F.lit("result.kernel."), "kernel", F.lit("."), "verb").alias("subject"), F.create_map(F.lit("Trace-Id"), "trace_id", F.lit("Ck-Seq"), F.col("seq").cast("string")).alias("headers"), "reply")


def read_ledger(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", max_files).parquet(path)


def capture(spark: SparkSession, ledger_path: str, out_path: str, checkpoint: str, kernel: str, max_files: int = 1):
    """Drain what the ledger has now into an outbox of Parquet files; later calls go on from there."""
    stream = events(read_ledger(spark, ledger_path, max_files), kernel)
    query = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch, without repeated ledger numbers, to ``publish``."""

    def once(batch: DataFrame, number: int) -> None:
        publish(batch.dropDuplicates(["ledger_seq"]), number)

    query = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batches(outbox: DataFrame, size: int = 100) -> DataFrame:
    """Outbox rows with the number of their drain batch, ``size`` rows each; seq is gapless from 1."""
    return outbox.withColumn("batch", F.floor((F.col("ledger_seq") - 1) / size).cast("bigint"))


def inbound(stream: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Requests (msg_id, ts, …) without repeats of an id within the watermark."""
    return stream.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["msg_id"])


FOLD = "id string, body string, seq bigint, changes bigint"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    body, seq, changes = state.get if state.exists else (None, -1, 0)
    for f in frames:
        if f.empty:
            continue
        last = f.loc[f["seq"].idxmax()]
        changes += len(f)
        if int(last["seq"]) > seq:
            body, seq = last["body"], int(last["seq"])
    state.update((body, seq, changes))
    yield pd.DataFrame({"id": [key[0]], "body": [body], "seq": [seq], "changes": [changes]})


def fold(stream: DataFrame) -> DataFrame:
    """The latest body of each instance and how often it changed, folded over a stream of ledger rows."""
    return stream.groupBy("instance_id").applyInPandasWithState(_fold, FOLD, "body string, seq bigint, changes bigint", "update", "NoTimeout")


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows by seq: a bounded buffer."""
    return rows.orderBy(F.desc("seq")).limit(n)
