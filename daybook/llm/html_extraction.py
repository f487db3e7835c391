"""Operator 4: the main text of HTML pages, every block labelled by a bidirectional LSTM over the whole page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import Net, label, learn
from .html_blocks import blocks, vectors

#: Pages, chosen by a hash of their id, that the labeller is fitted on: a bound that does not follow the table.
SAMPLE = 240
#: Characters of html labelled together.
CHUNK = 2 << 20


def fit(pages: DataFrame, sample: int = SAMPLE, html_col: str = "html") -> Net:
    """A labeller fitted, in one task, on at most sample pages, whole, and on layouts of their texts."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = learn([h for batch in batches for h in batch["h"]])
        yield pd.DataFrame({"name": list(net.w), "shape": [list(v.shape) for v in net.w.values()], "data": [v.tobytes() for v in net.w.values()]})

    rows = pages.select("page_id", F.col(html_col).alias("h"))
    taken = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).coalesce(1)
    found = taken.mapInPandas(one, "name string, shape array<int>, data binary").collect()
    return Net({r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in found}) if found else learn([])


def extract(pages: DataFrame, net: Net, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys, text and n_chars for every page: its main blocks joined by newlines, in page order.

    Whole pages, no shuffle.  Null or empty html, and pages without a main block, give an empty text; repeated
    rows repeat; other columns are ignored."""
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["__html"].map(lambda h: len(h) if h is not None else 0).cumsum() // CHUNK
            for _, part in batch.groupby(size.to_numpy(), sort=False):
                found = [blocks(h) for h in part["__html"]]
                shares = label(net, [vectors(b) for b in found])
                texts = ["\n".join(b.text for b, p in zip(own, share, strict=True) if p >= 0.5) for own, share in zip(found, shares, strict=True)]
                yield part[keys].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select(*keys, F.col(html_col).alias("__html")).mapInPandas(scan, f"{kinds}, text string, n_chars long")


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages), ["page_id", "url"])
