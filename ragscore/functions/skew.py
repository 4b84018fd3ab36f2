"""Joins whose keys may be very unevenly frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds at least one in so many rows; so there are never more frequent keys than this.
SHARE = 10_000


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of facts (one row for each key; ``count`` says how frequent it is), null where there are none.

    Facts of keys that hold at least 1 in SHARE of all counted rows, which are at most SHARE, are broadcast; their rows
    are dealt anywhere in the shuffled join in which all other keys meet, and none of those holds more than that share.
    """
    own = [c for c in facts.columns if c != key]
    total = F.broadcast(facts.agg(F.sum(count).alias("_total")))  # one row
    known = facts.join(total).select(key, F.struct(*own).alias("_facts"), (F.col(count) * SHARE >= F.col("_total")).alias("_hot"))
    hot = known.where("_hot").select(key, F.col("_facts").alias("_hot_facts"))
    # the salt is no literal: Spark would fold one out of the join's keys and deal all rows of frequent keys, null there, to one task
    rare = known.where("not _hot").select(F.col(key).alias("_key"), F.xxhash64(key).alias("_salt"), "_facts")
    near = rows.join(F.broadcast(hot), key, "left")
    told = F.col("_hot_facts").isNotNull()
    near = near.withColumns({"_key": F.when(~told, F.col(key)), "_salt": F.when(told | F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))})
    met = near.join(rare, ["_key", "_salt"], "left")
    got = F.coalesce("_hot_facts", "_facts")
    return met.select(*rows.columns, *[got[c].alias(c) for c in own])
