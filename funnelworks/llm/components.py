"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then that label's own label,
    so a chain shrinks by more than half; it ends when no label changes. Rounds are cut off by
    ``checkpoint()`` into the shared folder; only the count of changes reaches the driver. A node
    with very many links is pre-aggregated before the shuffle (a minimum), and the joins carry one
    row per link, so AQE may split them.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")).checkpoint()
    while True:
        near = (both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        hop = label.select(F.col("node").alias("near_root"), F.col("root").alias("hop"))
        step = (label.join(near, "node").select("node", "root", F.least("root", "near").alias("near_root"))
                .join(hop, "near_root").select("node", F.col("root").alias("old"), F.least("near_root", "hop").alias("root")))
        step = step.checkpoint()
        changed = step.where("root <> old").limit(1).count()
        label = step.select("node", "root")
        if not changed:
            return label
