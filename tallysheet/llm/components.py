"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, label: the smallest node that can be reached from each node with a link.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so the rounds grow with the logarithm of the longest path. Rounds are written to
    the shared folder. Partial minima are taken before every shuffle. Null ends are ignored.
    """
    # both directions from one reading of the links, whose making may be long
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    both = stage(links.select(F.explode(ways).alias("way")).select("way.*").filter("u <> v").distinct())
    # the first round needs no join: the neighbours' labels are the neighbours
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stage(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = after.select("node", "label")
        if not after.filter("label <> old").head(1):
            return labels
