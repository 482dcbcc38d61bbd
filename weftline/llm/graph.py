"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def connected_components(links: DataFrame, held: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b) links -> id, label: the least id of each component, for every linked id.

    Each round takes the least label among the neighbours and then the label's
    own label, so long chains halve. Labels are written once a round; nothing
    but one count comes to the driver.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    edges = held.keep(both.where("id <> to").distinct(), "edges")
    labels = held.keep(edges.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("id").alias("up"), F.col("label").alias("top"))
        moved = lower.join(jump, lower["label"] == jump["up"], "left").select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        moved = held.keep(moved, "labels")
        labels = moved.select("id", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
