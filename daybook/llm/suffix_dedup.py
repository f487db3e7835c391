"""Operator 8: bytes of 400-byte strings that occur twice or more, by suffix arrays over shards of candidate regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .recompression import EMPTY, carried, chunks, mix
from .suffix_array import common_prefixes, leftmost, smaller_types, suffix_array

LENGTH = 400
#: Levels of leftmost-smaller substrings; each has about a third of the places of the one below.
LEVELS = 4
#: Bytes read together, and bytes of regions in one shard array.
CHUNK = 4 << 20
SHARD = 2 << 20
#: An anchor with so many rows in one chunk, or in all, is common: its windows meet by name instead of in a shard.
COMMON = 64
COMMON_ALL = 2_000
#: Windows named together.
NAMED = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def levels(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, lo, hi) of the leftmost-smaller substrings of each level over a row of bytes, 0 being an end of a text.

    lo..hi are the bytes that decided a substring: it appears wherever these bytes stand."""
    lo = hi = None  # of single bytes: their own places
    for _ in range(LEVELS):
        s, at = smaller_types(x)
        k = leftmost(s)
        if len(k) < 2:
            return
        after = np.minimum(at[k] + 1, len(x) - 1).astype(np.int64)
        first, last = (k - 1, after) if lo is None else (lo[k - 1], hi[after])
        # the sum over a substring of symbol * power, moved to power 0; wraps around, as any 64-bit name
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(x)), dtype=np.uint64)))
        back = _powers(_INV, len(x))
        a, b = k[:-1], k[1:]
        name = mix((sums[b] - sums[a]) * back[a], (b - a).astype(np.uint64)) | np.uint64(1)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(x == 0)))
        name = np.where(ends[b] > ends[a], np.uint64(0), name)
        x, lo, hi = name, first[:-1], last[1:]
        yield name, lo, hi


def anchors(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int = LENGTH):
    """(first, end, key, place): runs of window starts first..end-1 with one anchor each.

    A window's anchor is the strongest substring decided inside it, of the highest level that has one there, the
    leftmost of equals; key 0 where no level has one.  Equal windows so have equal keys, at equal places."""
    long = sizes >= length
    todo_a, todo_b = begins[long], begins[long] + sizes[long] - length + 1
    out = []
    for level, (name, lo, hi) in reversed(list(enumerate(levels(x)))):
        if not len(todo_a):
            break
        cuts = np.sort(np.concatenate((lo + 1, hi - length + 1, todo_a, todo_b)))
        cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))]
        inside = np.searchsorted(todo_a, cuts[:-1], "right") - 1
        good = (inside >= 0) & (cuts[:-1] < todo_b[np.maximum(inside, 0)])
        start, end = cuts[:-1][good], cuts[1:][good]
        a, b = np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + length, "left") - 1
        some = b >= a
        weight = np.where(name == 0, np.uint64(0), mix(name, np.uint64(level + 1)))
        won = _strongest(weight, a[some], b[some])
        out.append((start[some], end[some], weight[won], lo[won]))
        todo_a, todo_b = start[~some], end[~some]
    out.append((todo_a, todo_b, np.zeros(len(todo_a), np.uint64), todo_a))
    first, end, key, place = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(first, kind="stable")
    first, end, key, place = first[order], end[order], key[order], place[order]
    new = np.ones(len(first), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (first[1:] != end[:-1])
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(first)) - 1] if len(at) else end, key[at], place[at]


def _strongest(weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best, width, size = np.arange(len(weight)), 1, b - a + 1
    won = np.zeros(len(a), np.int64)
    while len(a):
        now = (size >= width) & (size < 2 * width)
        if now.any():
            p, q = best[a[now]], best[b[now] - width + 1]
            won[now] = np.where(weight[p] >= weight[q], p, q)
        if not (size >= 2 * width).any():
            break
        p, q = best[:-width], best[width:]
        best = np.concatenate((np.where(weight[p] >= weight[q], p, q), best[len(best) - width :]))
        width *= 2
    return won


def lay(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One row of the texts, an end before, between and after them; bytes are moved up by one, so 0 is an end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"\xff" + b"\xff".join(texts) + b"\xff"  # 0xff is in no UTF-8 text
    x = np.frombuffer(raw, np.uint8) + np.uint8(1)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    return raw, x, begins, sizes


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


SCHEMA = "route long, kind int, key long, rh long, doc long, start int, count int, tid long"
#: Kinds of rows: an anchor's run; news that an anchor is common; a common anchor's run; a run known to repeat.
RUN, NEWS, COMMON_RUN, KNOWN = 1, 0, 2, 3


def scan_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The window runs of all texts as rows for meeting by anchor.

    Equal runs of one chunk become one RUN row and KNOWN rows that travel to their own documents; an anchor with
    over COMMON runs in a chunk sends one NEWS row and its runs as COMMON_RUN rows to their documents.  So a
    chunk sends no more than COMMON rows to any anchor, whatever its share of the corpus."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches, "text", CHUNK):
            part = part[part["doc_id"].notna()]
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            ids = part["doc_id"].to_numpy().astype(np.int64)
            shas = [hashlib.sha256(t).digest()[:8] for t in texts]
            best: dict[bytes, int] = {}
            for i, (t, sha) in enumerate(zip(texts, shas, strict=True)):
                if len(t) >= length and (sha not in best or ids[i] < ids[best[sha]]):
                    best[sha] = i
            at = list(best.values())
            if not at:
                continue
            raw, x, begins, sizes = lay([texts[i] for i in at])
            first, end, key, place = anchors(x, begins, sizes, length)
            text = np.searchsorted(begins, first, "right") - 1
            rh = [
                xxhash.xxh3_64_intdigest(raw[a : b + length - 1], p)
                for a, b, p in zip(first.tolist(), end.tolist(), (first - place + (1 << 20)).tolist(), strict=True)
            ]
            own = pd.DataFrame(
                {
                    "key": key.view(np.int64), "rh": _signed(rh), "doc": ids[at][text],
                    "start": first - begins[text], "count": end - first,
                    "tid": np.array([int.from_bytes(shas[i], "little", signed=True) for i in at], np.int64)[text],
                }
            )
            many = own.groupby("key")["rh"].transform("nunique").to_numpy() > COMMON
            common = many | (own["key"] == 0).to_numpy()
            again = own.duplicated(["key", "rh"], keep=False).to_numpy() & ~common
            lead = ~own.duplicated(["key", "rh"]).to_numpy() & ~common
            home = mix(own["doc"].to_numpy().view(np.uint64), np.uint64(3)).view(np.int64)
            yield own[lead].assign(route=own["key"], kind=RUN)[list(_columns())]
            yield own[again].assign(route=home[again], kind=KNOWN)[list(_columns())]
            # a run that repeats here also lets others elsewhere know by a second row of another text
            twice = own[~own.duplicated(["key", "rh"], keep="first") & again]
            yield twice.assign(route=twice["key"], kind=RUN, count=0)[list(_columns())]
            yield own[common].assign(route=home[common], kind=COMMON_RUN)[list(_columns())]
            news = np.unique(own["key"].to_numpy()[many])
            if len(news):
                yield pd.DataFrame({c: news if c in ("route", "key") else 0 for c in _columns()}).assign(kind=NEWS)

    return docs.select("doc_id", "text").mapInPandas(scan, SCHEMA)


def _columns() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def meet_runs(rows: DataFrame) -> DataFrame:
    """(kind, key, doc, start, count): what is left of the runs after meeting by anchor.

    KNOWN: equal to a run elsewhere.  RUN: its anchor has other runs, so its windows go to a shard; one run of
    each group of equal ones goes too.  COMMON_RUN: its windows meet by name.  Runs alone under their anchor end here."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in carried(batches, "route"):
            kind, key, rh, tid, count = (part[c].to_numpy() for c in ("kind", "key", "rh", "tid", "count"))
            asks = kind <= RUN
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])
            group = np.cumsum(new) - 1
            n = group[-1] + 1
            run = kind == RUN
            news = np.bincount(group, kind == NEWS, minlength=n) > 0
            many = np.bincount(group, run & (count > 0), minlength=n) > COMMON_ALL
            same = np.ones(len(key), bool)
            same[1:] = new[1:] | (rh[1:] != rh[:-1]) | (kind[1:] != kind[:-1])
            equal = np.cumsum(same) - 1
            lead = np.flatnonzero(same)
            other = (tid != tid[lead][equal]) | (count == 0)
            repeats = (np.bincount(equal, other, minlength=len(lead)) > 0)[equal]
            within = part.duplicated(["key", "rh", "doc", "kind"], keep=False).to_numpy() & (count > 0) & run
            starts = part[within].groupby(["key", "rh", "doc"])["start"].transform("nunique")
            twice = np.zeros(len(key), bool)
            twice[np.flatnonzero(within)[starts.to_numpy() > 1]] = True
            repeats |= (np.bincount(equal, twice, minlength=len(lead)) > 0)[equal]
            kinds = np.bincount(group, same & run, minlength=n)[group]
            common = (news | many)[group] & run & (count > 0)
            known = (kind == KNOWN) | (run & (count > 0) & repeats & ~common)
            one = np.zeros(len(key), bool)  # the first real run of each group of equal ones
            real = np.flatnonzero(run & (count > 0))
            one[real[np.unique(equal[real], return_index=True)[1]]] = True
            shard = one & (kinds > 1) & ~common
            for mask, value in ((known, KNOWN), (shard, RUN), (common | (kind == COMMON_RUN), COMMON_RUN)):
                if mask.any():
                    out = part[mask]
                    yield pd.DataFrame({"kind": value, "key": out["key"], "doc": out["doc"], "start": out["start"], "count": out["count"]})

    met = rows.repartition("route").sortWithinPartitions("route", F.col("kind") > 1, "key", "kind", "rh", "tid", "doc")
    return met.mapInPandas(meet, "kind int, key long, doc long, start int, count int")


def shard_repeats(regions: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, count): window starts of regions(key, doc, start, count, z) whose window occurs at another
    place too, from one suffix array for each shard of whole anchors."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        raw, x, begins, sizes = lay(list(own["z"]))
        # the raw row's ends must not join suffixes: a window start has length bytes before the next end
        sa = suffix_array(x, length)
        lcp = common_prefixes(x, sa)
        owner = np.searchsorted(begins, sa, "right") - 1
        offset = sa - begins[np.maximum(owner, 0)]
        is_start = (owner >= 0) & (offset < own["count"].to_numpy()[np.maximum(owner, 0)]) & (offset >= 0)
        klass = np.cumsum(lcp[sa] < length)
        sa_ok = np.flatnonzero(is_start)
        klass, owner, offset = klass[sa_ok], owner[sa_ok], offset[sa_ok]
        doc, pos = own["doc"].to_numpy()[owner], own["start"].to_numpy()[owner] + offset
        if not len(doc):
            return pd.DataFrame({"doc_id": doc, "start": pos, "count": pos})
        first = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
        place = np.searchsorted(first, np.arange(len(klass)), "right") - 1
        differs = (doc != doc[first][place]) | (pos != pos[first][place])
        found = (np.bincount(place, differs, minlength=len(first)) > 0)[place]
        return ranges(doc[found], pos[found])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in carried(batches, "key"):
            key, size = part["key"].to_numpy(), np.cumsum(part["z"].map(len).to_numpy())
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            at, start = 0, 0
            while start < len(key):  # as many whole anchors as fit, at least one
                full = (size[start - 1] if start else 0) + SHARD
                at = max(at + 1, int(np.searchsorted(size[ends - 1], full, "right")))
                yield one(part.iloc[start : ends[at - 1]])
                start = int(ends[at - 1])

    return regions.repartition("key").sortWithinPartitions("key").mapInPandas(scan, "doc_id long, start int, count int")


def ranges(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return pd.DataFrame({"doc_id": doc[at], "start": pos[at], "count": pos[last] - pos[at] + 1})


def named_repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, count) for the windows of common anchors: each has a 128-bit name, equal names are counted with a
    map-side sum, and NAMED windows at a time send a name once, so memory follows neither the text nor its repeats."""

    def told(names: list[bytes], doc: list[int], pos: list[int]) -> Iterator[pd.DataFrame]:
        two = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        own = pd.DataFrame({"n1": two[:, 0], "n2": two[:, 1], "doc": np.array(doc, np.int64), "pos": np.array(pos, np.int64)})
        own = own.drop_duplicates()
        size = own.groupby(["n1", "n2"])["pos"].transform("size").to_numpy()
        once = ~own.duplicated(["n1", "n2"]).to_numpy()
        known = ranges(own["doc"].to_numpy()[size > 1], own["pos"].to_numpy()[size > 1])
        yield own[once].assign(size=np.minimum(size[once], 2), count=1)
        yield pd.DataFrame({"n1": 0, "n2": 0, "doc": known["doc_id"], "pos": known["start"], "size": 0, "count": known["count"]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        names, doc, pos = [], [], []
        for part in chunks(batches, "z", CHUNK // 2):
            for d, z, runs in zip(part["doc"], part["z"], part["runs"], strict=True):
                text = unpack(z)
                for r in runs:
                    end = r["start"] + r["count"] if r["kind"] == COMMON_RUN else r["start"]
                    for a in range(r["start"], end, NAMED):
                        b = min(end, a + NAMED)
                        names += [xxhash.xxh3_128_digest(text[i : i + length]) for i in range(a, b)]
                        doc += [d] * (b - a)
                        pos += range(a, b)
                        if len(names) >= NAMED:
                            yield from told(names, doc, pos)
                            names, doc, pos = [], [], []
        if names:
            yield from told(names, doc, pos)

    rows = settle(texts.mapInPandas(scan, "n1 long, n2 long, doc long, pos int, size int, count int"))
    open_rows = rows.where("size > 0")
    shared = open_rows.groupBy("n1", "n2").agg(F.sum("size").alias("total")).where("total > 1").drop("total")
    later = open_rows.where("size = 1").join(shared, ["n1", "n2"], "left_semi")
    return later.unionByName(rows.where("size = 0")).select(F.col("doc").alias("doc_id"), F.col("pos").alias("start"), "count")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 binary, spans): bytes of strings of length bytes that start twice.

    Texts with an exact copy lose everything by their hash; one of each such group stays as a source for others.
    Of the other texts, leftmost-smaller substrings tell where repeats are possible; runs equal as a whole are
    settled by their names, the rest by suffix arrays over shards, and the windows under very common anchors by
    128-bit names.  Null text is empty.  Rows without doc_id stay whole and are no source; rows that repeat a doc_id
    are one document (the text with the smallest hash).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches, "text", CHUNK):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"].astype("Int64"), "n": [len(t) for t in texts], "sha": [hashlib.sha256(t).digest() for t in texts]}
            )

    def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3).compress
        for part in chunks(batches, "text", CHUNK):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            yield pd.DataFrame(
                {"doc": part["doc_id"], "own": [hashlib.sha256(t).digest() for t in texts], "z": [pack(t) for t in texts]}
            )

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in chunks(batches, "z", CHUNK // 2):
            rows = []
            for d, z, runs in zip(part["doc"], part["z"], part["runs"], strict=True):
                text = None
                for r in runs:
                    if r["kind"] == RUN:
                        text = unpack(z) if text is None else text
                        rows.append((r["key"], d, r["start"], r["count"], text[r["start"] : r["start"] + r["count"] + length - 1]))
            yield pd.DataFrame(rows, columns=["key", "doc", "start", "count", "z"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in chunks(batches, "z", CHUNK // 2):
            out = []
            for doc, z, found in zip(part["doc"], part["z"], part["found"], strict=True):
                text, spans, end = unpack(z), [], -1
                for a, b in sorted((r["start"], r["start"] + r["count"] + length - 1) for r in found):
                    if a <= end:
                        spans[-1][1] = end = max(end, b)
                    else:
                        spans.append([a, b])
                        end = b
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                sha = hashlib.sha256(b"".join([*kept, text[at:]])).digest()
                out.append((doc, sum(b - a for a, b in spans), sha, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "n_cut", "cut_sha", "cut"])

    base = settle(docs.select("doc_id", "text").mapInPandas(read, "doc_id long, n long, sha binary"))
    one = base.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sha", "n")).alias("t")).select("doc_id", "t.*")
    copies = one.where(F.col("n") >= length).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    heads = settle(copies)
    met = meet_runs(scan_runs(docs, length))
    runs = met.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "start", "count")).alias("runs"))
    single = heads.where("copies = 1").select("doc_id", F.lit(True).alias("single"))
    runs = runs.join(one.join(single, "doc_id", "left").select(F.col("doc_id").alias("doc"), "sha", "single"), "doc")
    pressed = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(press, "doc long, own binary, z binary")
    pressed = pressed.groupBy("doc").agg(F.min_by("z", "own").alias("z"))
    texts = settle(pressed.join(runs.drop("sha"), "doc"))
    regions = texts.select("doc", "z", "runs").mapInPandas(slices, "key long, doc long, start int, count int, z binary")
    known = texts.select("doc", F.inline("runs")).where(F.col("kind") == KNOWN)
    found = (
        shard_repeats(regions, length)
        .unionByName(named_repeats(texts.select("doc", "z", "runs"), length))
        .unionByName(known.select(F.col("doc").alias("doc_id"), "start", "count"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "count")).alias("found"))
    )
    lost = (
        texts.where("single").select("doc", "z").join(found.withColumnRenamed("doc_id", "doc"), "doc")
        .mapInPandas(cut, "doc_id long, n_cut long, cut_sha binary, cut array<struct<start:int,end:int>>")
    )
    alone = base.where("doc_id is null").select("doc_id", "sha", "n")
    out = one.unionByName(alone).join(single, "doc_id", "left").join(lost, "doc_id", "left")
    copy = (F.col("n") >= length) & F.col("doc_id").isNotNull() & F.col("single").isNull()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    spans = F.when(copy, whole).otherwise(F.coalesce("cut", F.array().cast("array<struct<start:int,end:int>>")))
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept_sha256")).alias("kept_sha256")
    )
