"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return id and component, the smallest id reachable, for every id in a link.

    Large-star and small-star steps alternate until every id points straight at
    its component's smallest.  A step only ever sends an id its neighbourhood's
    minimum, aggregated on the map side, so an id with very many links is no
    hot spot; those minima are written out, which lets adaptive execution split
    the links' side of the join that brings them back.  Rounds grow with the logarithm of the longest path.
    Links with a null end are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges, "components")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = cut(least, "components-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "components-large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        # Done when every id has one link and no link leads on.
        onward = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        twice = edges.groupBy("u").agg(F.count("*").alias("c")).where("c > 1")
        if onward.select("v").unionByName(twice.select(F.col("u").alias("v"))).isEmpty():
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
