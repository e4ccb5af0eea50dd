"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``key, label``: for every end of an edge ``(a, b)`` the least key of its component.

    Every round takes the least label among the neighbours, then the label of that label, so long chains shorten by
    doubling; rounds are written to the shared folder. Hubs cost no more than their edges: minima are taken in tasks first.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")))
    while True:
        seen = both.join(labels, both["b"] == labels["key"]).groupBy(F.col("a").alias("k")).agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["key"] == seen["k"], "left").select("key", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("key").alias("k2"), F.col("label").alias("jump"))
        stepped = cut(near.join(far, near["label"] == far["k2"], "left").select("key", "old", F.least("label", "jump").alias("label")))
        changed = stepped.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = stepped.select("key", "label")
        if not changed:
            return labels
