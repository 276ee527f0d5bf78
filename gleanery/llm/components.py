"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_shuffles, stash, unstash


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that links reach) of every id in links (a, b bigint).

    Each round gives every id the least label among its neighbours' and its own, then the label's own label (pointer jumping), so
    chains shorten by more than half a round. Hubs are aggregated before they are shuffled. Labels are kept in the shared folder.
    """
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("c"))
        top = labels.select(F.col("id").alias("t"), F.col("component").alias("tc"))
        step = stash(step.join(top, step["c"] == top["t"], "left").select("id", "was", F.least("c", F.coalesce("tc", "c")).alias("component")))
        moved = step.where("component < was").limit(1).count()
        unstash(labels)
        labels = step.select("id", "component")
        labels._stash_path = step._stash_path
        if not moved:
            unstash(both)
            return labels
        free_shuffles(links.sparkSession)
