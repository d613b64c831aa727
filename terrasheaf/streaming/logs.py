"""Provenance and comment logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrasheaf.operators.logs import append_new, append_provenance, validate_comments


def stream_provenance(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends provenance rows (column `at`) by day. With a column entry_id, each entry lands once, whatever is replayed and
    with a new checkpoint too; without one, the file sink and its checkpoint write each row once."""
    if "entry_id" in stream.columns:
        writer = stream.writeStream.foreachBatch(lambda batch, _: append_provenance(batch, path)).option("checkpointLocation", checkpoint)
    else:
        writer = stream.withColumn("day", F.to_date("at")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_comments(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """One row per comment id, the first seen; state is kept for the watermark only, so a copy later than it may pass.
    land_comments() keeps late copies out as well."""
    good, _ = validate_comments(stream)
    return good.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["id"])


def land_comments(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Comments of a stream at path, one row per id, that of the first batch and in it the earliest.

    However late a copy comes, it meets the ids that have landed; the table itself is the state, and only its ids are
    read. A batch that is run again appends nothing."""

    def land(batch: DataFrame, _: int) -> None:
        good, _bad = validate_comments(batch)
        cols = good.columns
        first = good.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("created_at", F.to_json(F.struct(*cols)))).alias("row")).select("row.*")
        append_new(first, path, "id")

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
