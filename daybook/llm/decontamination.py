"""Operator 9: benchmark passages in documents, found by the q-gram lemma in overlapping diagonal bands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

#: Edits allowed per character of an item, and the q-gram length: RATE * Q < 1 keeps the lemma's bound positive.
RATE = 0.1
Q = 8
#: Normalised items shorter than this say too little for edits: they match as whole words, without one.
EXACT_BELOW = 24
#: Characters of documents looked at together, and of benchmark items in one index.
CHUNK = 1 << 20
BLOCK = 4 << 20
#: Shared grams laid out at once; cells of one table of alignments.
HITS = 4 << 20
CELLS = 8 << 20
#: A gram with so many shared places in one document and item is counted by band instead of being laid out.
DENSE = 1 << 16

_GAPS = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case; whatever is neither letter nor digit becomes one space."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each of the len - Q + 1 grams (Q a power of two), by doubling."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    while width < Q and len(h) > width:
        h = (h[:-width] * _P) ^ (h[width:] + (h[width:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))
        h ^= h >> np.uint64(32)
        width *= 2
    return h if width == Q else h[:0]


class Index:
    """The q-grams of a block of benchmark items, with the lemma's numbers for each item."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        plain = [(i, normal(t)) for i, t in items]
        kept = [(i, t) for i, t in plain if len(t) >= EXACT_BELOW]
        self.short: dict[int, dict[str, list[int]]] = {}  # number of words -> text -> items
        for i, t in plain:
            if 0 < len(t) < EXACT_BELOW:
                self.short.setdefault(t.count(" ") + 1, {}).setdefault(t, []).append(i)
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [_codes(t) for _, t in kept]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.minimum((self.m * RATE).astype(np.int64), (self.m - Q) // Q)
        self.least = self.m - Q + 1 - self.k * Q
        grams = [_grams(c) for c in self.codes]
        names = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(names, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, int)])[order]
        self.names, self.first, self.count = np.unique(names[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.names >> np.uint64(42)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the gram) for every gram of codes that an item has."""
        grams = _grams(codes)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)]) if len(self.names) else np.zeros(0, int)
        found = np.searchsorted(self.names, grams[at])
        found[found == len(self.names)] = 0
        same = self.names[found] == grams[at]
        return at[same], found[same]

    def whole_words(self, plain: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the first place of each short item that stands in plain as whole words."""
        words, done = plain.split(" ") if self.short else [], set()
        begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
        for n, texts in self.short.items():
            for a in range(len(words) - n + 1):
                text = plain[begins[a] : begins[a + n] - 1]
                if text in texts and text not in done:
                    done.add(text)
                    for item in texts[text]:
                        yield item, begins[a], begins[a + n] - 1


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return found, np.bincount(where, np.concatenate([np.zeros(0), *counts]), minlength=len(found)).astype(np.int64)


def _bands(index: Index, codes: np.ndarray, doc: np.ndarray, begins: np.ndarray, shift: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count): the grams shared in each band, key = (document * items + item) * bands + band.

    Shared places are laid out HITS at a time, so memory does not follow their number.  A gram that repeats both
    in a document and in an item has the product of its places; such pairs are counted from the running number of the gram's
    places in the document, a look-up for each band and place in the item."""
    at, gram = index.shared(codes)
    occurs = np.bincount(gram, minlength=len(index.names))
    heavy = np.flatnonzero(occurs * index.count > HITS)
    keys, counts = [], []

    def lay(at: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        one = (doc[at] * len(index.ids) + item) * bands + (at - place + shift) // (index.k[item] + 1)
        k, n = np.unique(one, return_counts=True)
        keys.append(k)
        counts.append(n)
        if sum(map(len, keys)) > 2 * HITS:
            keys[:], counts[:] = ([x] for x in _summed(keys, counts))

    light = ~np.isin(gram, heavy)
    p, first, n = at[light], index.first[gram[light]], index.count[gram[light]]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
        own = n[lo:hi]
        take = np.repeat(first[lo:hi] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())
        lay(np.repeat(p[lo:hi], own), index.item[take], index.at[take])
        lo = hi
    for g in heavy.tolist():
        p = at[gram == g]
        entries = slice(index.first[g], index.first[g] + index.count[g])
        items, places = index.item[entries], index.at[entries]
        often = np.bincount(items)[items]
        docs = doc[p]
        cuts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, d = p[a:b], int(docs[a])
            dense = often * (b - a) > DENSE
            step = max(1, HITS // max(1, int((~dense).sum())))
            for lo in range(0, len(own) if (~dense).any() else 0, step):
                part = own[lo : lo + step]
                few = int((~dense).sum())
                lay(np.repeat(part, few), np.tile(items[~dense], len(part)), np.tile(places[~dense], len(part)))
            before = np.zeros(begins[d + 1] - begins[d] + 1, np.int64)
            before[own - begins[d] + 1] = 1
            before = np.cumsum(before)
            for i in np.unique(items[dense]).tolist():
                mine, width = places[items == i], int(index.k[i]) + 1
                low, high = (int(own[0] - mine.max()) + shift) // width, (int(own[-1] - mine.min()) + shift) // width
                edges = np.arange(low, high + 2) * width - shift - begins[d]
                total = np.zeros(len(edges) - 1, np.int64)
                for place in mine.tolist():
                    total += np.diff(before[np.clip(edges + place, 0, len(before) - 1)])
                some = np.flatnonzero(total)
                keys.append((d * len(index.ids) + i) * bands + low + some)
                counts.append(total[some])
    return _summed(keys, counts)


def _regions(index: Index, codes: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, item, first diagonal, shared grams) of the bands that reach the lemma's bound.

    An occurrence with k edits has all its grams on k + 1 neighbouring diagonals.  Bands are 2 (k + 1) wide and
    start every k + 1, so one of the two bands over a diagonal holds them all."""
    shift = int(index.m.max(initial=0)) * 2  # keeps diagonals positive
    bands = int(len(codes) + 2 * shift) + 2
    keys, counts = _bands(index, codes, doc, begins, shift, bands)
    if not len(keys):
        return (np.zeros(0, np.int64),) * 4
    follow = np.searchsorted(keys, keys + 1)
    follow[follow == len(keys)] = 0
    total = counts + np.where(keys[follow] == keys + 1, counts[follow], 0)  # this band's own half and the next
    before = np.searchsorted(keys, keys - 1)
    before[before == len(keys)] = 0
    alone = ~(keys[before] == keys - 1)
    keys, total = np.concatenate((keys, keys[alone] - 1)), np.concatenate((total, counts[alone]))
    item = keys // bands % max(1, len(index.ids))
    good = total >= index.least[item]
    keys, total, item = keys[good], total[good], item[good]
    return keys // bands // max(1, len(index.ids)), item, keys % bands * (index.k[item] + 1) - shift, total


def _align(index: Index, codes: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edits, start, end) of the best banded alignment of each item near its diagonals, all regions at once.

    A cell holds edits * unit + the start's column, so the least cell carries the start along.  Regions whose
    every cell is over the budget leave the table; their edits are reported as one over the budget."""
    m, k = index.m[item], index.k[item]
    base, width = diagonal - k, 4 * k + 3
    wide, long = int(width.max()), int(m.max())
    unit = 1 << int(wide).bit_length()
    cols = np.arange(wide, dtype=np.int64)
    pattern, text = np.zeros((len(item), long), codes.dtype), np.zeros((len(item), long + wide), codes.dtype)
    for i, x in enumerate(item):
        pattern[i, : m[i]] = index.codes[x]
        lo, hi = max(0, int(base[i])), min(len(codes), int(base[i]) + long + wide)
        text[i, lo - base[i] : hi - base[i]] = codes[lo:hi]
    far = np.int64(1) << 50
    edits, starts, ends = k + 1, base.copy(), base.copy()
    live, ramp = np.arange(len(item)), cols * unit
    row = np.where(cols[None, :] < width[:, None], cols[None, :], far)
    for j in range(long):
        cross = row + (text[:, j : j + wide] != pattern[:, j : j + 1]) * np.int64(unit)
        cross[:, :-1] = np.minimum(cross[:, :-1], row[:, 1:] + unit)
        row = np.minimum.accumulate(cross - ramp, axis=1) + ramp
        done = np.flatnonzero(m[live] == j + 1)
        if len(done):
            at, own = row[done].argmin(axis=1), live[done]
            low = row[done, at]
            edits[own], starts[own], ends[own] = low // unit, base[own] + low % unit, base[own] + j + 1 + at
        if j % 16 == 15:
            keep = (row.min(axis=1) // unit <= k[live]) & (m[live] > j + 1)
            live, row, text, pattern = live[keep], row[keep], text[keep], pattern[keep]
            if not len(live):
                break
    return edits, starts, ends


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text itself, whose letters may grow when lower-cased."""
    lower, places = text.lower(), []
    grown = None if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    for token in _TOKEN.finditer(lower):
        places += [token.start()] * bool(places)  # the gap before a token
        places += range(token.start(), token.end())
    if grown:
        places = [grown[i] for i in places]
    last = len(places) - 1
    return [(places[max(0, min(a, last))], places[max(0, min(b - 1, last))] + 1) for a, b in spans]


def matches(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(place in texts, item, edits, shared grams, start, end), the best region for each text and item."""
    lo = 0
    while lo < len(texts):
        plain, size, hi = [], 0, lo
        while hi < len(texts) and (hi == lo or size < CHUNK):
            plain.append(normal(texts[hi]))
            size += len(plain[-1]) + 1
            hi += 1
        joined = "\x00".join(plain) + "\x00"
        codes = _codes(joined)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in plain])))
        doc = np.repeat(np.arange(len(plain)), np.diff(begins))
        found: dict[tuple[int, int], tuple] = {}
        for n, text in enumerate(plain):
            spans = [(item, a, b) for item, a, b in index.whole_words(text)]
            for (item, a, b), (x, y) in zip(spans, _original(texts[lo + n], [(a, b) for _, a, b in spans]) if spans else (), strict=True):
                yield lo + n, item, 0, max(0, b - a - Q + 1), x, y

        def note(d: int, item: int, edits: int, shared: int, start: int, end: int) -> None:
            own = (edits, start - begins[d], end - begins[d], -shared)
            if edits <= index.k[item] and ((d, item) not in found or own < found[d, item]):
                found[d, item] = own

        regions = _regions(index, codes, doc, begins)
        inexact = np.ones(len(regions[0]), bool)
        for n, (d, item, diagonal, shared) in enumerate(zip(*(x.tolist() for x in regions), strict=True)):
            at = joined.find(index.texts[item], max(0, diagonal), diagonal + 2 * int(index.k[item]) + 2 + int(index.m[item]))
            if at >= 0:  # the alignment without an edit
                inexact[n] = False
                note(d, item, 0, shared, at, at + len(index.texts[item]))
        d, item, diagonal, shared = (x[inexact] for x in regions)
        step = max(1, min(512, CELLS // (int(index.m[item].max(initial=1)) * 2)))
        for at in range(0, len(d), step):
            part = slice(at, at + step)
            edits, start, end = _align(index, codes, item[part], diagonal[part])
            for x in zip(*(v.tolist() for v in (d[part], item[part], edits, shared[part], start, end)), strict=True):
                note(*x)
        for (n, i), (edits, a, b, shared_n) in sorted(found.items()):
            (a, b), = _original(texts[lo + n], [(int(a), int(b))])
            yield lo + n, index.ids[i], edits, -shared_n, a, b
        lo = hi


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """(index, whether others follow or came before) for each block of about BLOCK characters of the benchmark
    (item_id, text).  The driver holds one block at a time; null texts and items without an id are left out."""
    rows = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        yield Index([(r.item_id, r.text) for r in part.collect()]), n > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, edits, shared_grams, start, end): documents with a passage within the edit budget of an item.

    One scan of the documents for each benchmark block, no shuffle; with several blocks each one's result is written before
    the next block is read.  Spans count characters of the text.  Items under EXACT_BELOW normalised characters match as whole
    words only.  Null and empty texts match nothing; repeated rows and repeated items each report; ids may be null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id {item_kind}, edits long, shared_grams long, start long, end long"
    out = None
    for index, several in indexes(benchmark):
        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = list(matches(index, batch.column(1).to_pylist()))
                if found:
                    at, *rest = zip(*found, strict=True)
                    cols = [pa.array([ids[i] for i in at], batch.column(0).type), *(pa.array(x, pa.int64()) for x in rest)]
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "item_id", "edits", "shared_grams", "start", "end"])

        part = docs.select(id_col, text_col).mapInArrow(scan, schema)
        part = settle(part) if several else part
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark passage; decided in the row, so there is no join."""
    place = docs.columns.index(text_col)
    for index, several in indexes(benchmark):
        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(index, batch.column(place).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
        docs = settle(docs) if several else docs
    return docs


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).withColumnsRenamed({"start": "span_start", "end": "span_end"})


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark; null and blank texts stay, as do all columns."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
