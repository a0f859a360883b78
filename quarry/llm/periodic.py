"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words that are the same ``q`` words apart, q
being the least such distance, of at least ``least`` words and ``times`` periods,
which no neighbouring word extends.

Method: every word of a run stands in it ``times`` times or more. A word that
occurs more rarely within a segment can thus be in none of its runs and splits
it; the parts are split by their own counts in turn until nothing is rare.
What survives is scanned at each lag that can be a period.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches

WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def segments(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of ``least`` words or more in which every word stands ``times`` times or more; all runs lie in them.

    The larger part of a split keeps its counts, less those of the rest, so a
    word is counted anew only in a part of at most half the size: the work is
    about n log n however deep the splits go.
    """
    often = np.bincount(ids)[ids] >= times
    at = np.flatnonzero(np.diff(np.concatenate(([False], often, [False]))))
    fresh = lambda lo, hi: (lo, hi, Counter(words[lo:hi]))
    todo = [(lo, hi) for lo, hi in at.reshape(-1, 2).tolist() if hi - lo >= least]
    if not todo:
        return []
    words, places, out = ids.tolist(), {}, []
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], np.arange(ids.max() + 2))
    open_ = [(*x, [w for w, n in x[2].items() if n < times]) for x in (fresh(lo, hi) for lo, hi in todo)]
    while open_:
        lo, hi, counts, rare = open_.pop()
        if not rare:
            out.append((lo, hi))
            continue
        cuts = []
        for w in rare:
            if w not in places:
                places[w] = order[first[w] : first[w + 1]]
            a, b = np.searchsorted(places[w], (lo, hi))
            cuts += places[w][a:b].tolist()
        edges = [lo - 1, *sorted(cuts), hi]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a - 1 >= least]
        if not parts:
            continue
        big = max(parts, key=lambda p: p[1] - p[0])
        if 2 * (big[1] - big[0]) > hi - lo:
            gone = Counter(words[lo : big[0]] + words[big[1] : hi])
            for w, n in gone.items():
                counts[w] -= n
            open_.append((*big, counts, [w for w in gone if 0 < counts[w] < times]))
            parts.remove(big)
        for part in parts:
            part = fresh(*part)
            open_.append((*part, [w for w, n in part[2].items() if n < times]))
    return sorted(out)


def lags(x: np.ndarray, most: int) -> list[int]:
    """Lags up to ``most`` that can be the least period of a run of three periods or more.

    A block of p words that is no power of a shorter one has, among its cyclic
    grams of k > p / 2 words, one that stands there once. In a run of three
    periods this gram and its next occurrence, p words on, lie whole. So p is a
    distance of neighbouring equal grams of k words, k the power of two with
    k <= p < 2 k. Grams of 2 k words are named by pairs of those of k.
    """
    found: set[int] = set()
    rank, k = x.astype(np.int64), 1
    while k <= most:
        order = np.argsort(rank, kind="stable")
        same = np.diff(rank[order]) == 0
        gaps = np.diff(order)[same]
        found.update(gaps[(gaps >= k) & (gaps < 2 * k)].tolist())
        if not same.any() or len(rank) <= k:
            break
        name = np.empty(len(rank), np.int64)
        name[order] = np.concatenate(([0], np.cumsum(~same)))
        rank = name[:-k] * len(rank) + name[k:]
        k *= 2
    return sorted(p for p in found if p <= most)


def scan(x: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a segment."""
    found: dict[tuple[int, int], int] = {}
    for p in lags(x, len(x) // times):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], x[:-p] == x[p:], [False])))).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] + p >= max(least, times * p)]
        for s, e in edge.tolist():
            found.setdefault((s, e + p), p)  # a multiple of the least period has the same stretch
    return [(s, e - s, p) for (s, e), p in found.items()]


def find_runs(words: list[str], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a list of words, by start and period."""
    if len(words) < least:
        return []
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    return sorted((lo + s, n, p) for lo, hi in segments(ids, least, times) for s, n, p in scan(ids[lo:hi], least, times))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()]


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 24, times: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_words, runs, strongest, collapsed.

    ``runs`` has (start, length, period) of every run by start, then period, in
    words from 0; ``strongest`` is the one of the greatest length / period (ties:
    smallest start, then period; null where there is none); ``collapsed`` is the
    text's words joined by one space, without those that any run holds after its
    first period. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``; texts of any length are taken whole, as one value of a task;
    repeated rows each get a row; an empty table gives none; only the two columns
    are read. ``times`` is 3 at least.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have three periods at least")
    bounded_batches(docs.sparkSession)

    @pandas_udf(f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = re.compile(WORD).findall
        as_run = lambda r: dict(zip(("start", "length", "period"), r))
        for texts in batches:
            out = []
            for t in texts:
                words = find(t) if t else []
                own = find_runs(words, least, times)
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                out.append((len(words), [as_run(r) for r in own], best and as_run(best), " ".join(kept_words(words, own))))
            yield pd.DataFrame(out, columns=["n_words", "runs", "strongest", "collapsed"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(text).alias("r")).select("doc_id", "r.*")
