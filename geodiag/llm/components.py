"""Connected components as DataFrame iterations: nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.runtime import discard, materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge; the component is its smallest node.

    Minimum labels move along edges, then labels jump to their label's label, until no label
    changes. The minimum is combined before each shuffle and the joins' hot sides can be
    split, so a star with very many leaves stays spread. Null ends are left out. Each round's
    table replaces the last in the shared folder, so lost executors cost one round at most.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        discard(labels)
        discard(hooked)
        moved = new.where("was <> label").limit(1).count()
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
