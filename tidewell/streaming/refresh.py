"""Streams that meet a published snapshot, the newest one that is whole, anew in each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewell.plans.maintenance import snapshots


def newest_whole(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """Tables of the newest snapshot below ``root`` that opens and has as many rows as its name tells; None if there is none.

    Rows are counted from the files' footers.  A snapshot that is damaged is passed over for
    the one before.
    """
    for name, labels in snapshots(spark, root):
        try:
            tables = {label: spark.read.parquet(f"{root}/{name}/{label}") for label in labels}
            if all(tables[label].count() == n for label, n in labels.items()):
                return tables
        except Exception:  # whatever is wrong with its files, it is not whole
            continue
    return None


def with_snapshot(stream: DataFrame, root: str, meet: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write ``meet(batch, tables)`` of each batch below ``path``, with the tables of newest_whole() as they are when the batch begins.

    A snapshot that is published between two batches is in the next one.  A batch waits for
    its first snapshot by failing; one that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = newest_whole(batch.sparkSession, root)
        if tables is None:
            raise FileNotFoundError(f"no whole snapshot below {root}")
        meet(batch, tables).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
