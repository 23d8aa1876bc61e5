"""Listing pages as they arrive: each new file's entries, appended once. The same parsers as for whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, parser: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Takes the pages (page_id, html) in Parquet files that have come below `path` since the last call, and appends what
    `parser` makes of them to `out`. A batch that is done again replaces its own folder, so entries come once."""

    def append(pages: DataFrame, batch: int) -> None:
        parser(pages).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    pages = spark.readStream.schema("page_id bigint, html string").parquet(path)
    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
