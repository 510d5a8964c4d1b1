"""Connected components of a table of links, by labels that shrink to the smallest node.

Each round every node takes the smallest label among its own and its neighbours', and then its label's label, so that long chains close
in few rounds. Labels and links stay in tables; a round is cut by a reliable checkpoint.

Cases: no links give no rows; links that repeat or join a node to itself change nothing; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links of a partition: small tables are kept in few files.
PART_LINKS = 10_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node with a link to another."""
    parts = 1 + links.count() // PART_LINKS
    pairs = links.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    both = checkpointed(pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), parts)
    labels = checkpointed(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), parts)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        after = checkpointed(lower.join(jump, "low").select("node", F.least("low", "next").alias("component"), (F.least("low", "next") != F.col("component")).alias("moved")), parts)
        labels = after.select("node", "component")
        if not after.where("moved").limit(1).count():
            return labels
