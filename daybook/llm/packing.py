"""Operator 3: sum-of-squares packing of tokenised documents into sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

CAPACITY = 1024
END = 2
#: Pieces in one packing task; open bins are left over once a task, so larger tasks waste less.
SHARD = 32_000
#: The added token of byte_bpe_50k.json; the rank file does not list it.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: tiktoken's regular expression overflows its stack on white-space runs between 300,000 and 2,000,000 characters; shorter ones are safe.
RUN = 10_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{RUN}}}")


def encoder(path: str):
    """Text -> ids of the byte-level BPE whose ranks lie at path.

    These are the ranks of byte_bpe_50k.json; this library gives that file's ids at a quarter of the CPU
    time (tests hold the two against each other).  Texts with a very long white-space run take tokenizers itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    safe = []

    def encode(text: str) -> list[int]:
        if ADDED in text:
            first, *rest = text.split(ADDED)
            ids = list(encode(first))
            for part in rest:
                ids.append(ADDED_ID)
                ids += encode(part)
            return ids
        if len(text) <= RUN or not _LONG_RUN.search(text):
            return own.encode_ordinary(text)
        if not safe:
            safe.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        return safe[0].encode(text, add_special_tokens=False).ids

    return encode


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids with the end id, cut only if over capacity.

    All pieces but the first are full, so each document leaves one remainder to fit.  Null text is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for lo in range(0, len(texts), 256):
                rows = []
                for doc, text in zip(batch["doc_id"].iloc[lo : lo + 256], texts[lo : lo + 256], strict=True):
                    ids = np.array([*encode(text), end], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(
        scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per item, in the given order.

    With N[g] open bins of residual gap g, putting an item of length s in a gap g changes the sum of
    squares by 2 (N[g - s] - N[g]) + 2, and filling it up by 1 - 2 N[s]; gap 0 is full and not counted.
    The smallest change wins, ties go to the smallest gap; a new bin is opened only where no open one has room, which on
    descending lengths leaves far fewer open ends.  Bins of one gap are interchangeable: the last is used.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    big = 1 << 60
    for i, s in enumerate(lengths.tolist()):
        n = count[s:]
        cost = np.where(n > 0, 2 * (count[: capacity + 1 - s] - n) + 2, big)  # index k: gap s + k, then k is left
        if n[0]:
            cost[0] = 1 - 2 * n[0]
        k = int(cost.argmin())
        if cost[k] < big:
            gap, b = s + k, open_bins[s + k].pop()
            count[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Pieces of full length are sequences already and skip packing.  The rest are dealt by a hash to tasks of about
    shard pieces, a number that follows the count, and each task packs its own from the longest
    down; a group of copies spreads over all tasks.  Empty input gives no rows.
    """
    part = rows.where(F.col("length") < capacity)
    n = max(1, -(-part.count() // shard))
    part = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)).cast("int"))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(own["length"].to_numpy(), capacity)
        return own.drop(columns="shard").assign(sequence_id=bins * n + own["shard"].iloc[0], offset=offsets)

    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return part.groupBy("shard").applyInPandas(fill, schema).unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def op3(docs: DataFrame) -> DataFrame:
    return pack(settle(pieces(docs, tokenizer_path())))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3(docs)
