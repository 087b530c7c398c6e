"""Connected components of a link table by minimum labels and pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> v, label: the smallest vertex of the component, for every vertex that has a link.

    A round gives each vertex the smallest label around it and then that label's own label; the number of rounds grows with
    the logarithm of a component's diameter in most graphs and never exceeds the diameter.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    first = edges.groupBy("a").agg(F.min("b").alias("least"))
    labels = written(first.select(F.col("a").alias("v"), F.least("a", "least").alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("v").alias("label"), F.col("label").alias("jump"))
        step = written(hooked.join(own, "label", "left").select("v", F.least("label", F.coalesce("jump", "label")).alias("label"), "old"), "cc-labels")
        discard(labels)
        labels = step.select("v", "label")
        labels._written = step._written
        if step.filter("label <> old").limit(1).count() == 0:
            discard(edges)
            return labels
