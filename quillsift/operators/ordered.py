"""Named ordered maps as one table (tree, key, value): lookups, counters, and steps in key order.

Updates are rows too, with a number ``seq``; of one key the last counts.  Keys are in byte
order.  Nothing is held in memory: each function is a plan over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """The map after (tree, key, value, seq): new keys added, values of others replaced."""
    last = updates.groupBy("tree", "key").agg(F.max_by("value", "seq").alias("__new"))
    both = rows.join(last, ["tree", "key"], "full")
    return both.select("tree", "key", F.coalesce("__new", "value").alias("value"))


def increment(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """The map after adding (tree, key, value); a key that is not there counts from 0."""
    return rows.select("tree", "key", "value").unionByName(steps.select("tree", "key", "value")).groupBy("tree", "key").agg(F.sum("value").alias("value"))


def get(rows: DataFrame, tree: str, key: str) -> DataFrame:
    return rows.where((F.col("tree") == tree) & (F.col("key") == key)).select("key", "value")


def first(rows: DataFrame, tree: str) -> DataFrame:
    """The entry of the least key: one row or none."""
    return rows.where(F.col("tree") == tree).select("key", "value").orderBy("key").limit(1)


def after(rows: DataFrame, tree: str, key: str) -> DataFrame:
    """The entry of the least key beyond ``key``: one row or none."""
    return rows.where((F.col("tree") == tree) & (F.col("key") > key)).select("key", "value").orderBy("key").limit(1)
