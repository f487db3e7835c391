"""Operator 6: repeated word windows found through recompression symbols and verified window by window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, words_of

WINDOW = 20
#: Pair rounds after the run round, and the most words under one symbol.
ROUNDS = 5
SPAN = 9
#: Words parsed together.
CHUNK = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))
EMPTY = hashlib.sha256(b"").digest()


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A name for a pair of names: the same for the same pair in every task."""
    h = (a ^ (a >> np.uint64(31))) * _A + b
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def levels(names: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, lo, hi, words) of every round's symbols over a row of word names, 0 being an end of a text.

    Round 0 names runs of one word, the later rounds name pairs whose left half falls on the left side and right
    half on the right side, sides drawn from the names.  lo..hi are the words that decided the symbol: it
    appears wherever these words stand, so equal windows hold the same symbols between their ends.
    """
    n = len(names)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    words = np.diff(np.append(first, n))
    name = names[first]
    run = (words > 1) & (name != 0)
    name = np.where(run, mix(name, words.astype(np.uint64)), name)
    lo, hi = np.maximum(first - 1, 0), np.minimum(first + words, n - 1)
    yield name, lo, hi, words
    for r in range(ROUNDS):
        left = (mix(name, np.uint64(r + 1)) >> np.uint64(40)) & np.uint64(1) == 0
        ends = name == 0
        pair = left[:-1] & ~left[1:] & ~ends[:-1] & ~ends[1:] & (words[:-1] + words[1:] <= SPAN)
        head, tail = np.append(pair, False), np.concatenate(([False], pair))
        new_lo = np.where(left | tail, lo, np.concatenate((lo[:1], lo[:-1])))
        new_hi = np.where(left, np.append(hi[1:], hi[-1:]), hi)
        joined = mix(name[:-1], mix(name[1:], np.uint64(r + 77)))
        name = np.where(head, np.append(joined, np.uint64(0)), name)[~tail]
        words = np.where(head, words + np.append(words[1:], 0), words)[~tail]
        lo, hi = np.where(head, lo, new_lo)[~tail], new_hi[~tail]
        yield name, lo, hi, words


def anchors(names: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) for each window start: the window's strongest interior symbol, from the highest round that
    has one (longest first, then by name), named together with all the words that decided it, and the first of these
    words; key 0 where there is none."""
    n = len(names) - window + 1
    powers, back = _powers(_A, len(names)), _powers(_INVERSE, len(names))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * powers, dtype=np.uint64)))
    key, place = np.zeros(max(n, 0), np.uint64), np.full(max(n, 0), -1)
    if n <= 0:
        return key, place
    todo = np.arange(n)
    for level, (name, lo, hi, words) in reversed(list(enumerate(levels(names, window)))):
        first = np.cumsum(np.bincount(lo + 1, minlength=n + 1))[:n][todo]
        last = np.cumsum(np.bincount(hi, minlength=n + window))[window - 1 : n + window - 1][todo] - 1
        some = last >= first
        ask, a, b = todo[some], first[some], last[some]
        weight = (words.astype(np.uint64) << np.uint64(58)) | (mix(name, np.uint64(level)) >> np.uint64(6))
        best = np.arange(len(name))
        size, width = b - a + 1, 1
        won = np.empty(len(ask), np.int64)
        while len(ask):
            now = (size >= width) & (size < 2 * width)
            if now.any():
                x, y = best[a[now]], best[b[now] - width + 1]
                won[now] = np.where(weight[x] >= weight[y], x, y)
            if not (size >= 2 * width).any():
                break
            x, y = best[:-width], best[width:]
            best = np.concatenate((np.where(weight[x] >= weight[y], x, y), best[len(best) - width :]))
            width *= 2
        decided = (sums[hi[won] + 1] - sums[lo[won]]) * back[lo[won]]
        key[ask] = mix(decided, weight[won]) | np.uint64(1)
        place[ask] = lo[won]
        todo = todo[~some]
    return key, place


def window_names(a: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A name for each window, by doubling."""
    n = len(a) - window + 1
    out, at, width, now = None, 0, 1, a
    while width <= window:
        if window & width:
            part = now[at : at + n]
            out = part if out is None else mix(out, part + np.uint64(width))
            at += width
        now = mix(now[:-width], now[width:]) if 2 * width <= window else now
        width *= 2
    return out


class Chunk:
    """Texts laid in one row of word names with a 0 before, between and after them."""

    def __init__(self, words: list[list[bytes]]) -> None:
        self.count = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.count + 1)))[:-1] + 1
        total = int(self.count.sum())
        flat = b"".join(map(xxhash.xxh3_128_digest, (w for own in words for w in own)))
        two = np.frombuffer(flat, "<u8").reshape(total, 2)
        self.real = np.ones(total + len(words) + 1, bool)
        self.real[0] = self.real[self.begin + self.count] = False
        self.names, self.other = np.zeros(len(self.real), np.uint64), np.zeros(len(self.real), np.uint64)
        self.names[self.real] = two[:, 0] | np.uint64(1)
        self.other[self.real] = two[:, 1]
        self.text = np.concatenate(([0], np.repeat(np.arange(len(words)), self.count + 1)))
        ends = np.concatenate(([0], np.cumsum(~self.real)))
        n = max(0, len(self.real) - WINDOW + 1)
        self.starts = np.flatnonzero(ends[WINDOW : WINDOW + n] == ends[:n])  # windows inside one text


def chunks(batches: Iterator[pd.DataFrame], col: str, size: int) -> Iterator[pd.DataFrame]:
    """Slices of the batches with about size characters (or bytes) in col."""
    for batch in batches:
        lengths = batch[col].map(lambda t: len(t) if t is not None else 0).to_numpy()
        for _, part in batch.groupby(np.cumsum(lengths) // size, sort=False):
            yield part


def text_id(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def scan_anchors(docs: DataFrame) -> DataFrame:
    """(route, doc, key, mark): the anchors of every text of at least WINDOW words.

    mark 0: one text's anchor, to meet others at route = its key (key is 0).  mark 1: the anchor at route is known to repeat
    (twice in one text, or in two texts of one chunk), to be told to others.  mark 2: a text's key known to repeat,
    which goes to a route of its own: however common a key is, only one row a chunk travels to it.  Of
    copies in one chunk only the smallest doc_id counts; copies in two chunks do meet, which only adds windows to verify.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches, "text", 6 * CHUNK):
            part = part[part["doc_id"].notna()].sort_values("doc_id")
            words = {text_id(w): (d, w) for d, w in zip(part["doc_id"][::-1], map(words_of, part["text"][::-1])) if len(w) >= WINDOW}
            if not words:
                continue
            ids = np.array([d for d, _ in words.values()], np.int64)
            chunk = Chunk([w for _, w in words.values()])
            key, place = anchors(chunk.names)
            key, place, text = key[chunk.starts], place[chunk.starts], chunk.text[chunk.starts]
            own = pd.DataFrame({"key": key, "place": place, "text": text}).drop_duplicates()
            told = (own.duplicated("key", keep=False) | (own["key"] == 0)).to_numpy()
            own = own.assign(told=told).drop_duplicates(["text", "key"])
            told, doc, keys = own["told"].to_numpy(), ids[own["text"]], own["key"].to_numpy().view(np.int64)
            home = mix(doc.view(np.uint64), np.uint64(5)).view(np.int64)
            yield pd.DataFrame(
                {"route": np.where(told, home, keys), "doc": doc, "key": np.where(told, keys, 0), "mark": np.where(told, 2, 0)}
            )
            marks = np.unique(keys[told & (keys != 0)])
            yield pd.DataFrame({"route": marks, "doc": 0, "key": 0, "mark": 1})

    return docs.select("doc_id", "text").mapInPandas(scan, "route long, doc long, key long, mark int")


def carried(batches: Iterator[pd.DataFrame], col: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that rows equal in col, which they are sorted by, stay together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[col].to_numpy()
        cut = int(np.flatnonzero(values != values[-1])[-1] + 1) if values[0] != values[-1] else 0
        if cut or (held and held[-1][col].iloc[-1] != values[0]):
            ready = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
            yield ready
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(doc_id, keys): per document its anchors that another place or text has too."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in carried(batches, "route"):
            route, key, mark = part["route"].to_numpy(), part["key"].to_numpy(), part["mark"].to_numpy()
            group = np.cumsum(np.concatenate(([True], route[1:] != route[:-1]))) - 1
            several = np.bincount(group, (mark < 2) + (mark == 1)) > 1
            good = several[group] & (mark == 0) | (mark == 2)
            yield pd.DataFrame({"doc_id": part["doc"].to_numpy()[good], "key": np.where(mark == 2, key, route)[good]})

    met = rows.repartition("route").sortWithinPartitions("route").mapInPandas(meet, "doc_id long, key long")
    return met.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, ranges of (start, count)): the windows of texts(doc_id, z, keys) that start earlier elsewhere."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in chunks(batches, "z", CHUNK):
            chunk = Chunk([unpack(z).split() for z in part["z"]])
            key, _ = anchors(chunk.names)
            key, text = key[chunk.starts].view(np.int64), chunk.text[chunk.starts]
            wanted = np.concatenate([np.asarray(k, np.int64) for k in part["keys"]])
            owner = np.repeat(np.arange(len(part)), part["keys"].map(len))
            pairs = np.sort(mix(wanted.view(np.uint64), owner.astype(np.uint64)))
            mine = mix(key.view(np.uint64), text.astype(np.uint64))
            at = np.searchsorted(pairs, mine)
            at[at == len(pairs)] = 0
            good = pairs[at] == mine
            starts, text = chunk.starts[good], text[good]
            n1, n2 = (window_names(x)[starts].view(np.int64) for x in (chunk.names, chunk.other))
            doc, pos = part["doc_id"].to_numpy()[text], starts - chunk.begin[text]
            order = np.lexsort((pos, doc, n2, n1))
            n1, n2, doc, pos = n1[order], n2[order], doc[order], pos[order]
            new = np.ones(len(n1), bool)
            new[1:] = (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])
            yield pd.DataFrame({"route": n1[new], "n2": n2[new], "doc": doc[new], "pos": pos[new], "count": 0})
            yield _ranges(doc[~new], pos[~new])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in carried(batches, "route"):
            n1, n2, count = (part[c].to_numpy() for c in ("route", "n2", "count"))
            later = count > 0
            later[1:] |= (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1]) & (count[:-1] == 0)
            out = part[later]
            yield pd.DataFrame({"doc_id": out["doc"], "start": out["pos"], "count": np.maximum(out["count"], 1)})

    rows = texts.mapInPandas(scan, "route long, n2 long, doc long, pos int, count int")
    met = rows.repartition("route").sortWithinPartitions("route", "count", "n2", "doc", "pos")
    met = met.mapInPandas(meet, "doc_id long, start int, count int")
    return met.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))


def _ranges(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """Known repeats as ranges of starts, on routes of their documents."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    route = mix(doc[first].astype(np.int64).view(np.uint64), np.uint64(9)).view(np.int64)
    return pd.DataFrame({"route": route, "n2": 0, "doc": doc[first], "pos": pos[first], "count": np.diff(np.append(first, len(doc)))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 binary, z): every word outside windows that start earlier.

    z holds the kept words, joined by spaces and compressed, of texts that lost some but not all words.

    Exact copies are settled by their hash: all but the smallest doc_id lose everything (from WINDOW words on).
    Recompression then tells which windows of the others can repeat at all; those are named by 128 bits
    and sorted, and each but the first of a name is covered.  Null text has no words.  Rows without doc_id keep
    their words and are no source; rows that repeat a doc_id are one document (the text with the smallest hash).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches, "text", 6 * CHUNK):
            words = [words_of(t) for t in part["text"]]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"].astype("Int64"), "n": [len(w) for w in words], "sha": [text_id(w) for w in words]}
            )

    def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3).compress
        for part in chunks(batches, "text", 6 * CHUNK):
            words = [words_of(t) for t in part["text"]]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "own": [text_id(w) for w in words], "z": [pack(b" ".join(w)) for w in words]}
            )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        for part in chunks(batches, "z", CHUNK):
            out = []
            for doc, z, ranges in zip(part["doc_id"], part["z"], part["ranges"], strict=True):
                words = unpack(z).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    gone[r["start"]] += 1
                    gone[r["start"] + r["count"] + WINDOW - 1] -= 1
                kept = b" ".join([w for w, g in zip(words, np.cumsum(gone[:-1])) if g == 0])
                out.append((doc, int((np.cumsum(gone[:-1]) > 0).sum()), hashlib.sha256(kept).digest(), pack(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_cut", "cut_sha", "cut_z"])

    read_rows = docs.select("doc_id", "text").mapInPandas(read, "doc_id long, n long, sha binary")
    base = settle(read_rows)
    one = base.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sha", "n")).alias("t")).select("doc_id", "t.*")
    first = one.where(F.col("n") >= WINDOW).groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    keys = shared_anchors(scan_anchors(docs)).join(first, "doc_id")
    pressed = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(press, "doc_id long, own binary, z binary")
    pressed = pressed.groupBy("doc_id").agg(F.min_by("z", "own").alias("z"))
    texts = settle(pressed.join(keys.drop("sha"), "doc_id"))
    ranges = repeated_windows(texts)
    lost = texts.select("doc_id", "z").join(ranges, "doc_id").mapInPandas(
        cut, "doc_id long, n_cut long, cut_sha binary, cut_z binary"
    )
    long = (F.col("n") >= WINDOW) & F.col("doc_id").isNotNull()
    heads = first.select(F.col("doc_id"), F.lit(True).alias("head"))
    alone = base.where("doc_id is null").select("doc_id", "sha", "n")
    out = one.unionByName(alone).join(heads, "doc_id", "left").join(lost, "doc_id", "left")
    copy = long & F.col("head").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.col("cut_z").alias("z"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + {WINDOW - 1}), ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS p)),
late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM late, LATERAL (SELECT unnest(range(p, p + {WINDOW})) AS q)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
