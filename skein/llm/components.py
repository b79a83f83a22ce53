"""Connected components of links between numbers, by rounds of joins that are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import heavy_keys, materialize, spread_join


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a long, b long).

    Each round a node takes the smallest root among its neighbours and then its root's root, so the paths to a root
    halve; every round is written to the shared folder. Minima are taken before the shuffle, and what many nodes ask
    for (a hub's or a large component's root) is broadcast, so no group is gathered in one place.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    hubs = heavy_keys(both, ["b"])
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "root"), ["b"], heavy=hubs).groupBy("a").agg(F.min("root").alias("near"))
        hooked = materialize(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("hook"), F.col("root").alias("was")), "hooks")
        far = labels.select(F.col("node").alias("hook"), F.col("root").alias("far"))
        new = materialize(spread_join(hooked, far, ["hook"]).select("node", F.least("hook", "far").alias("root"), "was"), "roots")
        if new.filter("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
