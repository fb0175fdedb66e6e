"""A report that is rewritten after each batch of volumes, each row once whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from volspark.session import drop_path, list_names, path_exists
from volspark.sources.sinks import upsert


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose report is whole, in order."""
    return sorted(int(n[2:]) for n in list_names(spark, folder) if n.startswith("v=") and path_exists(spark, f"{folder}/{n}/_SUCCESS"))


def read_report(spark: SparkSession, folder: str) -> DataFrame | None:
    """The report as of the last batch; None before the first."""
    found = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={found[-1]}") if found else None


def keep_report(arriving: DataFrame, summary: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "vol_id", keep: int = 2) -> StreamingQuery:
    """Upserts summary(batch), one row a key, into the report after each batch of a stream that takes what there is and ends.

    A batch makes the version of its number out of the version before it. A batch that is repeated after a failure has the same number and the same rows, so it
    overwrites what it may have written and changes nothing else; readers see whole versions alone."""
    folder = folder.rstrip("/")

    def rewrite(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, folder) if v < number]
        old = spark.read.parquet(f"{folder}/v={earlier[-1]}") if earlier else None
        upsert(old, summary(batch), key).write.mode("overwrite").parquet(f"{folder}/v={number}")
        for v in earlier[: -(keep - 1) or None]:
            drop_path(spark, f"{folder}/v={v}")

    return arriving.writeStream.foreachBatch(rewrite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
