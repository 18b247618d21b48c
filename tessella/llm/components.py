"""Connected components of a table of links, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of `links` (a, b: long): label is the smallest node that can be reached.

    Each round hooks every tree onto the smallest label that one of its nodes sees, then halves the depth of the
    trees, so that rounds grow as the logarithm of the longest chain. Hot nodes are only reduced by minima, which
    combine before the shuffle, and meet tables that were written before, whose skew Spark can split.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        hooked = written(labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "m").alias("m")), "hooked")
        roots = written(hooked.groupBy(F.col("label").alias("root")).agg(F.min("m").alias("up")), "roots")
        after = written(hooked.join(roots, hooked.label == roots.root).select("node", "label", F.least("m", "up").alias("now")), "after")
        far = after.select(F.col("node").alias("via"), F.col("now").alias("end"))
        new = written(after.join(far, after.now == far.via).select("node", "label", F.least("now", "end").alias("now")), "new")
        moved = new.where("label <> now").limit(1).count()
        drop(spark, labels.path, hooked.path, roots.path, after.path)
        labels = new.select("node", F.col("now").alias("label"))
        labels.path = new.path
        if not moved:
            drop(spark, both.path)
            return labels
