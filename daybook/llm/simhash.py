"""Operator 7: near-duplicate groups by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit, settle, words_of
from .components import components
from .near_copies import near_copies, set_name
from .pigeonhole import BITS, _edges, _spanning, blocks_for, links, majority

__all__ = ["BITS", "_edges", "_spanning", "blocks_for", "fingerprint", "fingerprints", "links", "near_duplicates", "op7", "stage"]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the ASCII-lower-cased words' shingles, repeats included; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words).lower()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row; null and word-less texts get 0.  Extra columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["t"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(
        scan, f"id {kind}, fp long"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4
) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id whose fingerprint is linked, directly or not.

    Equal fingerprints are one node before any join, so groups of copies cost one row each.  Null ids keep
    their fingerprint and take the component of their node (null if no row of it has an id); an
    empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = settle(fps.groupBy("fp").agg(F.min("id").alias("node")))
    groups = components(links(nodes.where("node is not null"), distance))
    named = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(named, "fp", "left")


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.  Groups are linked by five-word shingle sets
    with a Jaccard similarity of 0.8 or more, checked exactly; SimHash fingerprints of the sets and their pigeonhole blocks propose
    links, and MinHash bands those that such near fingerprints do not reach.

    A document without an id cannot be compared by it and stays.  Rows of one id with different texts are different
    documents, each with its own group; only rows of such ids are looked at again, and of equal ones one stays."""
    groups = near_copies(docs)
    often = settle(groups.where("id is not null").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id"))
    gone = groups.where("id is not null and not kept").select(F.col("id").alias("doc_id")).union(often).distinct()
    named = docs.where("doc_id is not null")
    out = named.join(fit(settle(gone)), "doc_id", "left_anti")
    if not often.isEmpty():
        keep = groups.where("kept").select(F.col("id").alias("doc_id"), "fp").distinct()
        rows = named.join(fit(often), "doc_id", "left_semi").select("doc_id", set_name("text").alias("fp"), F.struct(*named.columns).alias("row"))
        rows = rows.join(keep, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"])
        out = out.unionByName(rows.select("row.*"))
    return out.unionByName(docs.where("doc_id is null")).select(*docs.columns)
