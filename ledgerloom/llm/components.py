"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links`` (u, v).

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shrink by
    half at least; rounds end when nothing changes. Labels are written to the shared folder after each round, and those of the
    round before are removed. Nothing is collected. A node with very many links is a skewed key of a join whose other side has
    one row for it; its links are added up before they are shuffled. Links with a null end are left out, links of a node to
    itself only name no node; repeated links count once. Empty input gives no rows.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialize(both.where("u <> v").distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), f"{tag}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        new = materialize(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("old")).alias("changed")), f"{tag}-labels")
        discard(labels)
        if new.where("changed").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new
