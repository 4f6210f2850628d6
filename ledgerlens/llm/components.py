"""Connected components of links, by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every id they name.

    Each round takes the smallest label among neighbours, then that label's own
    label, so that long chains shorten by half or more.  Rounds are written
    tables; a node with very many links only takes part in joins and partial
    minima.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct()
    both = stage(both.toDF("id", "other"), "links")
    labels = stage(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("reached")), "other")
        near = near.groupBy("id").agg(F.min("reached").alias("reached"))
        lower = labels.join(near, "id").select("id", F.least("component", "reached").alias("next"), "component")
        lower = stage(lower, "labels-lower")
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("further"))
        after = lower.join(jump, "next").select("id", F.least("next", "further").alias("component"),
                                                F.col("component").alias("before"))
        after = stage(after, "labels")
        labels = after.select("id", "component")
        if after.filter("component < before").limit(1).count() == 0:
            return labels


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of earlier ones (id, component) and further links (a, b) together."""
    if labels is None:
        return components(links)
    of = labels.select(F.col("id").alias("x"), F.col("component").alias("y"))
    for side in ("a", "b"):
        links = links.join(of.withColumnRenamed("x", side), side, "left").withColumn(side, F.coalesce("y", side)).drop("y")
    merged = components(links).withColumnsRenamed({"id": "x", "component": "y"})
    moved = labels.join(merged.withColumnRenamed("x", "component"), "component", "left")
    moved = moved.select("id", F.coalesce("y", "component").alias("component"))
    fresh = merged.join(labels, merged["x"] == labels["id"], "left_anti").select(F.col("x").alias("id"), F.col("y").alias("component"))
    return stage(moved.union(fresh), "components")
