"""Row numbers over a distributed sort, with no window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodiag.runtime import materialize


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str) -> DataFrame:
    """Add ``rank``, which is no column of ``df``: 0, 1, ... within each group, by ``order``.

    Rows are range-partitioned by group and order, so a large group spans many tasks. In each
    sorted partition ``monotonically_increasing_id`` numbers the rows; a count for each (group,
    partition) gives where a partition's share of the group begins. Those counts have at most
    as many rows as groups and partitions together.
    """
    keys = [F.col(g).asc_nulls_last() for g in group]
    by = [*keys, *order]
    # whole rows are one column, so that no name of theirs meets one of ours
    split = df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.struct("*").alias("row"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), F.monotonically_increasing_id().alias("id"))
    split = materialize(split.withColumn("part", F.shiftright("id", 33)), "ranked")
    key = [F.coalesce(F.col(f"g{i}").cast("string"), F.lit("")).alias(f"k{i}") for i in range(len(group))]
    null = [F.col(f"g{i}").isNull().alias(f"n{i}") for i in range(len(group))]
    names = [f"{x}{i}" for x in "kn" for i in range(len(group))]
    tagged = split.select("row", "id", "part", *key, *null)
    counts = tagged.groupBy(*names, "part").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    # a group's parts are far fewer than its rows: one for each range partition it touches
    w = (Window.partitionBy(*names) if group else Window.partitionBy(F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the join below is planned by its true size and doesn't deal out the rows again
    starts = counts.select(*names, "part", "first", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    starts = materialize(starts, "starts")
    return tagged.join(starts, [*names, "part"]).select(*(F.col("row")[c].alias(c) for c in df.columns), (F.col("id") - F.col("first") + F.col("before")).alias(rank))
