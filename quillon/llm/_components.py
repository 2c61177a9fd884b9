"""Connected components as DataFrame joins; nothing but counts of rows reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

#: Rows of a key from which on its value is broadcast; at most BROADCAST_KEYS keys are, 16 bytes each.
HEAVY, BROADCAST_KEYS = 500, 200_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, count: str) -> DataFrame:
    """`rows` with the `value` that `table` has for their `key`, null without one; `table` is computed already.

    `count` is about how many rows ask for a key. Keys that many ask for are broadcast, so that their
    rows stay where they are; the number of rows that makes a key one of them grows with the table,
    to keep the broadcast in its bound. All others meet by a shuffle.
    """
    least = HEAVY
    while (heavy := table.filter(F.col(count) > least)).count() > BROADCAST_KEYS:
        least *= 4
    if heavy.isEmpty():
        return rows.join(table.select(key, value), key, "left")
    rows = rows.join(F.broadcast(heavy.select(key, F.col(value).alias("_heavy"))), key, "left")
    # What is settled, and null keys, are dealt by a hash of the whole row and find nothing.
    settled = F.col("_heavy").isNotNull() | F.col(key).isNull()
    rows = rows.withColumns({"_settled": settled, "_key": F.when(settled, F.xxhash64(*rows.columns)).otherwise(F.col(key))})
    light = table.filter(F.col(count) <= least).select(F.col(key).alias("_key"), F.lit(False).alias("_settled"), F.col(value).alias("_light"))
    return rows.join(light, ["_key", "_settled"], "left").withColumn(value, F.coalesce("_heavy", "_light")).drop("_key", "_settled", "_heavy", "_light")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b: bigint, not null); root is the smallest of its component.

    Each round points every node at its smallest neighbour and contracts the links along these
    pointers, which at least halves the nodes that still have links; the rounds are composed.
    """
    links = _lineage.cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _lineage.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"), F.count("*").alias("n")))
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            # How many nodes a root has is not counted; roots are the hubs of their links.
            moved = step.select(F.col("a").alias("root"), "p", "n")
            labels = looked_up(labels, "root", moved, "p", "n").select("node", F.coalesce("p", "root").alias("root"))
        labels = _lineage.cut(labels)
        at = looked_up(links, "a", step.select("a", F.col("p").alias("pa"), "n"), "pa", "n")
        at = looked_up(at, "b", step.select(F.col("a").alias("b"), F.col("p").alias("pb"), "n"), "pb", "n")
        links = _lineage.cut(at.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
