"""Operator 11: periodic runs of words, found by recursive frequency splitting and a lag scan of what survives."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: A run has at least so many words, and its period fits into it at least so many times.
LEAST, TIMES = 6, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)

OUT = (
    "id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "starts array<long>, lengths array<long>, periods array<long>, runs_sha256 string, collapsed_sha256 string, collapsed string"
)


def segments(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """The stretches (from, to) of a row of word ids in which every word occurs times or more, by recursive splitting.

    A run holds each of its words at least times times, so a word that is rarer within its segment is in no run there and
    splits it; the parts are judged again by their own counts until no word is too rare.  Only what is cut off from
    the largest part is counted again, so a row of n words costs n log n whatever the depth of the splits.
    """
    n = len(ids)
    if n < least:
        return []
    counts = np.zeros(int(ids.max()) + 1, np.int64)
    at = None  # (word, position) in order, made when a largest part is first kept
    out, stack = [], [(0, n)]
    while stack:
        lo, hi = stack.pop()
        own = ids[lo:hi]
        np.add.at(counts, own, 1)
        rare = lo + np.flatnonzero(counts[own] < times)
        while len(rare):
            edges = np.concatenate(([lo - 1], rare, [hi]))
            long = np.flatnonzero(np.diff(edges) > least)
            parts = list(zip((edges[long] + 1).tolist(), edges[long + 1].tolist(), strict=True))
            most = max(parts, key=lambda p: p[1] - p[0], default=(lo, lo))
            if 2 * (most[1] - most[0]) <= hi - lo:
                stack += parts
                break
            stack += [p for p in parts if p != most]
            gone = np.concatenate((ids[lo : most[0]], ids[most[1] : hi]))
            np.subtract.at(counts, gone, 1)
            lo, hi = most
            fewer = np.unique(gone)
            fewer = fewer[(counts[fewer] > 0) & (counts[fewer] < times)]
            if at is None:
                at = np.sort(ids.astype(np.int64) * n + np.arange(n))
            low = np.searchsorted(at, fewer * n + lo)
            found = [at[low[counts[fewer] > k] + k] % n for k in range(times - 1)]
            rare = np.sort(np.concatenate(found))
        else:
            out.append((lo, hi))
        counts[ids[lo:hi]] = 0
    return sorted(out)


def _reach(left: np.ndarray, right: np.ndarray) -> int:
    """How many of the first words of two rows agree, in steps that double."""
    done, step, most = 0, 32, min(len(left), len(right))
    left, right = left[:most], right[:most]
    while done < most:
        same = left[done : done + step] == right[done : done + step]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + len(same), 2 * step
    return done


def lag_scan(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of a row of word ids: period is the smallest one, length >= max(least, times * period),
    and no neighbouring word keeps the period; times is 3 or more.

    A run of times periods q holds times - 1 whole blocks of the row cut at multiples of q, and they are equal.  So lag q compares
    only the hashes of its n / q blocks with the next ones, n log n for all lags, and the words where blocks agree.  Blocks inside
    a run found at a smaller lag repeat that run (its period divides q) and are passed over.
    """
    n, found = len(ids), []
    head, power = np.zeros(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, _BASE), out=power[1:])
    # a word counts BASE ** place, so blocks k * q apart agree after a turn by BASE ** (k * q)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[:-1], out=head[1:])
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q in range(1, n // times + 1):
        cuts = head[::q]
        blocks = cuts[1:] - cuts[:-1]
        same = blocks[:-1] * power[q] == blocks[1:]
        for _ in range(times - 3):  # neighbouring agreements: times - 1 equal blocks
            same = same[:-1] & same[1:]
        firsts = np.flatnonzero(same) * q
        if len(starts) and len(firsts):
            before = np.searchsorted(starts, firsts, "right") - 1
            firsts = firsts[(before < 0) | (reach[np.maximum(before, 0)] < firsts + (times - 1) * q)]
        new, done = [], -1
        for first in firsts.tolist():
            if first + (times - 1) * q <= done:
                continue
            after = _reach(ids[first:], ids[first + q :])
            back = _reach(ids[:first][::-1], ids[: first + q][::-1])
            start, length = first - back, back + after + q
            done = start + length
            if length >= max(least, times * q):
                new.append((start, length, q))
        if new:
            found = sorted(set(found + new))
            starts = np.array([r[0] for r in found])
            reach = np.maximum.accumulate([r[0] + r[1] for r in found])
    return found


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a row of word ids, by start, then period."""
    return sorted((lo + s, n, q) for lo, hi in segments(ids, least, times) for s, n, q in lag_scan(ids[lo:hi], least, times))


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
    texts: bool = True,
) -> DataFrame:
    """One row per row of docs: id, n_words, its runs (starts, lengths, periods, by start, then period), their number, the
    greatest one (ties: smallest start, then period) and the text collapsed to one period a run.

    A row is judged alone, in one pass without a shuffle, whatever copies it has; repeated rows give repeated rows.  Null and
    blank texts have no words and no runs, and collapse to ''.  Null ids stay.  change(id, words) may alter the words first.
    Extra columns are ignored; an empty table gives an empty result; texts=False leaves collapsed null.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["t"], strict=True):
                words = words_of(text)
                if change:
                    words = change(None if pd.isna(doc) else doc, words)
                runs = runs_of(numbered(words), least, times)
                if runs:
                    depth = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        depth[s + q] += 1
                        depth[s + n] -= 1
                    kept = b" ".join([w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d])
                else:
                    kept = b" ".join(words)
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append(
                    (doc, len(words), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     *(zip(*runs, strict=True) if runs else ((),) * 3), hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)
                )
            frame = pd.DataFrame(out, columns=NAMES)
            yield frame.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")} | {"id": batch["id"].dtype})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(scan, OUT.format(kind=kind))


NAMES = [c.split()[0] for c in OUT.split(", ")]


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its id repeats a stretch to its end, as op11's contract has it; none without an id."""
    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(str(int(doc)).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return (words[:a] + turn * (-(-(n - a) // len(turn))))[:n]


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, change=planted, texts=False).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
