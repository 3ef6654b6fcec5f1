"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions, where they are short but cost much each.

    A table of many short rows is a few row groups, and each is one task's; a number given
    with the keys keeps AQE from joining the partitions by their size.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(n, frame.sparkSession.sparkContext.defaultParallelism), *keys)
