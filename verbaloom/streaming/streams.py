"""The column operators over streams: stateless appends in micro-batches, and a running count of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbaloom.functions import content
from verbaloom.operators.detect import Detector, LanguageDetection
from verbaloom.operators.translate import Translation


def read_rows(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; a micro-batch reads a bounded number of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def with_rule_label(stream: DataFrame, text_col: str) -> DataFrame:
    return stream.withColumns({"rule": content.rule_label(F.col(text_col)), "letters": content.letter_count(F.col(text_col))})


def detect_stream(stream: DataFrame, id_col: str, text_col: str, detection: LanguageDetection) -> DataFrame:
    """Models that score row by row only: they need neither state nor a join, and give what the batch gives."""
    if not isinstance(detection.detector, Detector) or detection.detector.column(F.lit("")) is None:
        raise TypeError("a stream needs a detector that works row by row; this model is a table that has to be joined")
    return detection.detect(stream, id_col, text_col)


def translate_stream(stream: DataFrame, text_col: str, result_col: str, translation: Translation, **options) -> DataFrame:
    """Row by row, so without the join that dedupe would need; an error is its row's status and the stream goes on."""
    if options.get("dedupe"):
        raise ValueError("a stream is translated row by row; dedupe needs a whole table")
    return translation.translate(stream, text_col, result_col, **options)


def first_rows(stream: DataFrame, n: int, checkpoint: str) -> list:
    """The first n rows of an append stream, after which it stops; of what lies ahead no further batch is read."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"n is a whole number of at least 1, not {n!r}")
    found: list = []

    def take(batch: DataFrame, _: int) -> None:
        if len(found) < n:
            found.extend(batch.limit(n - len(found)).collect())

    query = stream.writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        while len(found) < n and query.isActive and (query.status["isDataAvailable"] or query.status["isTriggerActive"] or query.lastProgress is None):
            query.awaitTermination(0.05)
    finally:
        query.stop()
    return found[:n]


def label_counts(stream: DataFrame, label: str) -> DataFrame:
    """Rows per label so far; for complete or update mode."""
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what there is and stops; a restart with the same checkpoint goes on after it."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
