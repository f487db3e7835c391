"""Fingerprints within a few bits of each other, by the blocks that they must share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit, settle

BITS = 64


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _spanning(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the index of the first one of its group, groups linked at distance bits or fewer.

    A breadth-first walk that compares a frontier only with what is not yet reached: a dense group is
    reached from its first member at once, so the cost follows the members, not their pairs."""
    root = np.full(len(fps), -1)
    rest = np.arange(len(fps))
    while len(rest):
        first, rest = rest[0], rest[1:]
        root[first], frontier = first, [first]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                reached = rest[near]
                root[reached] = first
                frontier += reached.tolist()
                rest = rest[~near]
    return root


def blocks_for(n: int, distance: int = 4, filled: int = 4) -> int:
    """The fewest blocks whose combinations have, for n spread fingerprints, buckets of filled ones or fewer on average.

    More blocks make more bits of a fingerprint part of a bucket's key (21 with 6 blocks, 27 with 7, 32 with 8, at distance
    4), but also more buckets for each fingerprint (15, 35, 70), so their number follows the counted fingerprints."""
    blocks = distance + 2
    while BITS // blocks * (blocks - distance) < np.log2(max(1, n / filled)) and blocks < 2 * distance + 4:
        blocks += 1
    return blocks


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, cap: int = 1500) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes(fp, node) within distance bits.

    Any pair within distance bits agrees on at least blocks - distance of the blocks, so it meets under
    one of the block combinations; each bucket emits a spanning star per group instead of its pairs.  blocks follows
    the number of nodes unless it is given.  A bucket of over cap fingerprints is cut into chunks, and every two
    chunks meet in a task of their own, so no task holds more than about 2 * cap and no pair is lost.
    """
    blocks = blocks or blocks_for(nodes.count(), distance)
    edges = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    parts = [
        F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])
    ]
    keys = F.array(
        *(
            F.xxhash64(F.lit(i), *(parts[b] for b in combo))
            for i, combo in enumerate(combinations(range(blocks), blocks - distance))
        )
    )
    rows = nodes.select("fp", "node", F.explode(keys).alias("key"))
    sizes = settle(rows.groupBy("key").count().where("count > 1"))
    hot = sizes.where(F.col("count") > cap).select("key", F.ceil(F.col("count") / cap).cast("int").alias("k"))
    rows = rows.join(fit(sizes.select("key")), "key", "left_semi")
    if not hot.isEmpty():
        rows = rows.join(fit(hot), "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        rows = rows.withColumn("mine", mine).select(
            "fp", "node", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
        )
        rows = rows.select(
            "fp", "node", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
        )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = whole["key"].to_numpy() == whole["key"].iloc[-1]  # this bucket may go on in the next batch
            held = whole[last]
            yield _edges(whole[~last], distance)
        if held is not None:
            yield _edges(held, distance)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").distinct()


def _edges(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    key, fps, node = (rows[c].to_numpy() for c in ("key", "fp", "node"))
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, int)
    out_a, out_b = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            own = node[lo:hi]
            root = _spanning(fps[lo:hi].view(np.uint64), distance)
            far = root != np.arange(hi - lo)
            out_a.append(own[far])
            out_b.append(own[root[far]])
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(out_a or empty), "b": np.concatenate(out_b or empty)})
