"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

Items are spread by hash over shards of about ``items_per_shard`` items, whatever their source, and each shard
is packed by itself: with thousands of containers in a shard, what sharding costs is about one container's
space per shard. Nothing is sampled or left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_PER_SHARD = 20_000


class RemainingTree:
    """Open bins by remaining capacity; finds the tightest bin with room in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        node = self.leaves + remaining
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (remaining, number) of the tightest bin with at least ``size`` left."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return remaining, self.bins[remaining].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; ``sizes`` must be in decreasing order and none above ``capacity``."""
    tree, where, bins = RemainingTree(capacity), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            found = (capacity, bins)
            bins += 1
        remaining, number = found
        where.append(number)
        tree.add(remaining - size, number)
    return where


def _pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["piece_size", "item", "piece_no"], ascending=[False, True, True], kind="stable")
    frame["bin_no"] = best_fit_decreasing(frame["piece_size"].tolist(), int(frame["capacity"].iloc[0]))
    return frame[["container_kind", "shard", "bin_no", "item", "piece_no", "piece_size", "capacity"]]


def pack_items(items: DataFrame, item: str, size: str, containers: list[tuple[str, int]], n_items: int, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(container_kind, shard, bin_no, item, piece_no, piece_size, capacity): the container of every item, for each
    of the ``containers`` (name, capacity).

    A container is known by its kind, shard and bin number. An item is cut only if it alone exceeds the
    capacity: into full pieces and a remainder, numbered from 0. Items of size 0 or null take a place of size 0.
    ``n_items`` sets the number of shards. Repeated ids are items of their own. An empty table gives an empty result.
    """
    shards = max(1, -(-n_items // items_per_shard))
    kinds = F.array(*(F.struct(F.lit(name).alias("container_kind"), F.lit(int(capacity)).cast("bigint").alias("capacity")) for name, capacity in containers))
    pieces = (
        items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
        .select("item", "_size", F.inline(kinds))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("_size") / F.col("capacity")), F.lit(1)) - 1)))
        .withColumn("piece_size", F.least(F.col("capacity"), F.col("_size") - F.col("piece_no") * F.col("capacity")))
        .withColumn("shard", F.pmod(F.xxhash64("item", "piece_no"), F.lit(shards)).cast("int"))
        .drop("_size")
    )
    return pieces.groupBy("container_kind", "shard").applyInPandas(_pack_shard, "container_kind string, shard int, bin_no bigint, item bigint, piece_no bigint, piece_size bigint, capacity bigint")
