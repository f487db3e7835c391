"""Near copies by the exact Jaccard similarity of word shingles: SimHash fingerprints by their pigeonhole blocks propose links, MinHash
bands those of texts whose fingerprints lie further apart, and every link is checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fit, settle, words_of
from .components import components
from .pigeonhole import links as blocks, majority

SHINGLE = 5
#: Two texts are linked where their shingle sets have a Jaccard similarity of 4 / 5 or more.
LEAST = (4, 5)
#: A pair at the least similarity shares none of 40 bands of 5 minima once in eight million times (0.67232 ** 40).
BANDS, ROWS = 40, 5
#: Bytes that a candidate (id, node, name, key) takes in a broadcast hash relation.
CANDIDATE_BYTES = 128
#: A cluster of candidates over so many texts or shingles is cut into chunks that meet pairwise.
CAP, CAP_SHINGLES = 1500, 1_000_000

_ODD = np.random.default_rng(5).integers(0, 1 << 63, 2 * BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS, _MIX = _ODD[: BANDS * ROWS, None], _ODD[BANDS * ROWS :].reshape(BANDS, ROWS)


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the ASCII-lower-cased words' shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words).lower()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n))


def set_name(text_col: str) -> F.Column:
    """The 128-bit name of a text's shingle set."""

    def names(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh3_128_digest(shingles(t).tobytes()))

    return F.pandas_udf(names, "binary")(F.col(text_col))


def bands(own: np.ndarray) -> np.ndarray:
    """One key per band of the set's minima under multiplications by odd numbers; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):  # bounded memory for very long texts
        least = np.minimum(least, (_TURNS * own[at : at + 1024]).min(axis=1))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, n, keys, sim): a 128-bit name of the shingle set, its size, its band keys and its SimHash fingerprint, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["t"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "n": [len(s) for s in sets],
                    "keys": [bands(s) for s in sets],
                    "sim": np.array([majority(s) for s in sets], np.uint64).view(np.int64),
                }
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(
        scan, f"id {kind}, fp binary, n long, keys array<long>, sim long"
    )


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of the first one of its group, groups linked at the least similarity; no set is empty.

    A breadth-first walk as in simhash: a dense group is reached from its first member at once."""
    part, whole = LEAST
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    root, seen = np.full(len(sets), -1), np.zeros(len(values), bool)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], frontier = first, [first]
        while frontier and (root < 0).any():
            at = frontier.pop()
            own = flat[starts[at] : starts[at] + sizes[at]]
            seen[own] = True
            common = np.add.reduceat(seen[flat], starts, dtype=np.int64)
            seen[own] = False
            near = (root < 0) & ((part + whole) * common >= part * (sizes + sizes[at]))
            root[near] = first
            frontier += np.flatnonzero(near).tolist()
    return root


def proposed(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes(node, n, sim) whose fingerprints differ by four bits or fewer; equal fingerprints are one before the blocks."""
    own = nodes.where("n > 0").select("node", "sim")
    firsts = settle(own.groupBy("sim").agg(F.min("node").alias("b"), F.count("*").alias("c")))
    same = own.join(firsts.where("c > 1").drop("c"), "sim").where("node != b").select(F.col("node").alias("a"), "b")
    out = settle(same.unionByName(blocks(firsts.select(F.col("sim").alias("fp"), F.col("b").alias("node")))))
    discard(firsts)
    return out


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, cap: int = CAP) -> DataFrame:
    """Edges (a, b) that join the nodes(node, id, fp, n, keys, sim) whose texts have the least similarity.

    A node's text is that of a row of docs with its id whose shingle set has the name fp: rows of one id may differ.

    The links that fingerprints propose and the stars of the bands give clusters of candidates; each text goes once to its cluster, where all its pairs are
    compared.  A cluster over the caps is cut into chunks that each link their own texts; then the first text of each
    group found so far asks all chunks of its cluster, and last every text outside the cluster's largest group does.
    Of two texts in different groups one is outside the largest, so no pair is lost, and a dense cluster ships each of
    its texts three times and not once a chunk.  The edges are written; what they were made from is deleted.
    """
    rows = nodes.select("node", F.explode("keys").alias("key"))
    roots = settle(rows.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c"))
    near = proposed(nodes)
    stars = rows.join(roots, "key").select(F.col("node").alias("a"), "b").where("a != b")
    clusters = settle(components(stars.unionByName(near)))
    sizes = nodes.join(clusters, "node").groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    k = F.ceil(F.greatest(F.col("c") / cap, F.col("n") / CAP_SHINGLES)).cast("int")
    hot = settle(sizes.select("component", k.alias("k")).where("k > 1"))
    dealt = clusters.withColumnRenamed("component", "cluster")
    dealt = dealt.join(fit(hot.withColumnRenamed("component", "cluster")), "cluster", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("key", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    dealt = settle(dealt.join(nodes.select("node", "id", "fp"), "node"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    met = texts.join(fit(dealt.select("id", "node", "fp", "key"), CANDIDATE_BYTES), "id")
    found, passes = settle(_within(met)), () if hot.isEmpty() else (False, True)
    cut = dealt.where("k > 1")
    for last in passes:
        groups = components(found)
        named = settle(cut.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component"))
        if last:
            counts = named.groupBy("cluster", "grp").agg(F.count("*").alias("c"))
            largest = counts.groupBy("cluster").agg(F.max_by("grp", F.struct("c", "grp")).alias("grp"))
            asks = named.join(largest, ["cluster", "grp"], "left_anti")
        else:
            asks = named.where("node = grp")
        before, found = found, settle(found.unionByName(_asked(texts, named, asks)))
        for done in (before, groups, named):
            discard(done)
    for done in (roots, near, clusters, hot, dealt):
        discard(done)
    return found


def _own(text: str | None, fp: bytes) -> np.ndarray:
    """The shingles of a text if they have the name fp, else none."""
    found = shingles(text)
    return found if xxhash.xxh3_128_digest(found.tobytes()) == fp else found[:0]


def _within(rows: DataFrame) -> DataFrame:
    """Edges between the texts of one key in rows(node, fp, t, key)."""

    def edges(node: list, sets: list[np.ndarray]) -> pd.DataFrame:
        own, root = np.array(node, np.int64), _linked(sets) if len(sets) > 1 else np.zeros(len(sets), int)
        far = root != np.arange(len(own))
        return pd.DataFrame({"a": own[far], "b": own[root[far]]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, node, sets = None, [], []
        for batch in batches:
            for key, n, fp, text in zip(batch["key"].tolist(), batch["node"].tolist(), batch["fp"], batch["t"], strict=True):
                if key != now:
                    yield edges(node, sets)
                    now, node, sets = key, [], []
                own = _own(text, fp)
                if len(own):
                    node.append(n)
                    sets.append(own)
        yield edges(node, sets)

    return rows.select("key", "node", "fp", "t").repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").distinct()


def _asked(texts: DataFrame, named: DataFrame, asks: DataFrame) -> DataFrame:
    """Edges (a, b) from asking texts to the groups, in any chunk of their cluster, that hold a text of the least similarity.

    named(id, node, fp, key, grp) are the texts of the chunks with their groups so far, asks the asking ones among them.  A chunk's own
    texts are in memory, asking ones pass one at a time, and one edge a group is enough, as its texts are joined already."""
    chunks = named.select("cluster", "key").distinct()
    sent = asks.select("id", "node", "fp", "cluster", "grp").join(chunks, "cluster")
    rows = named.select("id", "node", "fp", "key", "grp", F.lit(False).alias("asks")).unionByName(
        sent.select("id", "node", "fp", "key", "grp", F.lit(True).alias("asks"))
    )
    part, whole = LEAST

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, grps, sets, held = None, [], [], None
        for batch in batches:
            a, b = [], []
            for key, n, grp, asking, fp, text in zip(*(batch[c].tolist() for c in ("key", "node", "grp", "asks", "fp", "t")), strict=True):
                if key != now:
                    now, grps, sets, held = key, [], [], None
                own = _own(text, fp)
                if not len(own):
                    continue
                if not asking:
                    grps.append(grp)
                    sets.append(own)
                elif sets:
                    if held is None:  # the chunk's own texts come first
                        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
                        held = sizes, np.concatenate(([0], np.cumsum(sizes)[:-1])), values, flat, np.array(grps, np.int64)
                    sizes, starts, values, flat, of = held
                    seen = np.zeros(len(values), bool)
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    seen[at[values[at] == own]] = True
                    common = np.add.reduceat(seen[flat], starts, dtype=np.int64)
                    near = np.unique(of[(of != grp) & ((part + whole) * common >= part * (sizes + len(own)))])
                    a += [n] * len(near)
                    b += near.tolist()
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    met = texts.join(rows, "id").select("key", "node", "grp", "asks", "fp", "t")
    return met.repartition("key").sortWithinPartitions("key", "asks").mapInPandas(meet, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """(id, fp, component, kept) per row: component is the smallest id whose text is linked, directly or not.

    Texts of equal shingle sets (also those without words) are one node before any join, whatever ids they have; rows of one id
    with different texts are different nodes.  kept marks the rows of the group's smallest (id, fp), fp being the 128-bit name
    of the shingle set.  Null ids take the component of their node (null if no row of it has an id) and are never kept.
    The result is a written table; what it was made from is deleted."""
    made = settle(sketches(docs, id_col, text_col))
    nodes = made.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sim").alias("sim"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    edges = links(docs, nodes, id_col, text_col, cap)
    groups = components(edges)
    named = nodes.select("fp", "id", "node").join(groups, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min(F.struct("id", "fp")).alias("first"))
    named = named.join(firsts, "component").select("fp", "first")
    kept = F.coalesce(F.struct("id", "fp") == F.col("first"), F.lit(False))
    out = made.select("id", "fp").join(named, "fp", "left").select("id", "fp", F.col("first.id").alias("component"), kept.alias("kept"))
    out = settle(out)
    for done in (made, nodes, edges, groups):
        discard(done)
    return out
