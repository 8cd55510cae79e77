"""Connected components of a link table, as joins over written tables.

A link is kept once, as its smaller and its larger end.  Each round hangs every
larger end under its smallest neighbour, follows these parents to their roots by
doubling, and replaces the ends of all links by their roots: links inside one
tree go, links between the same trees become one.  A root that no link has joined
gets a smaller neighbour in this way, so two rounds at least halve the nodes that
still have links, and later rounds read few rows.  At the end the rounds' roots
are put one upon another, from the last to the first.  Every round is written to
the shared folder.  Links between nodes and themselves are ignored; repeated and
reversed links count once; links with a null end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, new_folder, written


def rooted(parents: DataFrame, base: str) -> DataFrame:
    """``parents`` (node, up), up smaller than node, to (node, up, root): the end of each node's path upwards."""
    paths = written(parents.withColumn("root", F.col("up")), f"{base}-0")
    n = 0
    while True:
        n += 1
        above = paths.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = written(paths.join(above, "root", "left").select("node", "up", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{base}-{n}")
        drop_folder(parents.sparkSession, f"{base}-{n - 1}")
        paths = after.drop("moved")
        if after.where("moved").isEmpty():
            return paths


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) to (node, component): the smallest node reachable, for each node that has a link."""
    base = new_folder(links.sparkSession, "components")
    left = links.where("u <> v").select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).distinct()
    edges = written(left, f"{base}/edges-0")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        n = len(rounds)
        rounds.append(rooted(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up")), f"{base}/roots-{n}"))
        # links to a parent or a root end inside their tree, whatever the other end's root is
        far = edges.join(rounds[-1].withColumnRenamed("node", "high"), "high").where("low <> up and low <> root").select("low", F.col("root").alias("one"))
        ends = far.join(rounds[-1].select(F.col("node").alias("low"), "root"), "low", "left").select("one", F.coalesce("root", "low").alias("two"))
        edges = written(ends.where("one <> two").select(F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high")).distinct(), f"{base}/edges-{n + 1}")
    known = rounds[-1].select("node", F.col("root").alias("component"))
    for n, own in reversed(list(enumerate(rounds[:-1]))):
        # a node gets a root in one round only; that root may have got one in a later round
        further = known.select(F.col("node").alias("root"), "component")
        known = written(own.join(further, "root", "left").select("node", F.coalesce("component", "root").alias("component")).unionByName(known), f"{base}/known-{n}")
    return written(known.unionByName(known.select(F.col("component").alias("node"), "component").distinct()), f"{base}/whole")
