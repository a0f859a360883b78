"""Toxicity scores by a factorization machine over hashed terms.

Method: terms are a text's distinct words and their beginnings, hashed; the
machine adds a weight for each term and the inner product of the terms' factors
for each pair, so that two words together can say what neither says alone. It
has the terms that tell the sample's classes apart alone or together with some
other term; those that do neither would only add noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000


def terms(word: str) -> list[int]:
    """Hashed terms of one word: itself and its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n))]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def alone(counts: np.ndarray, toxic: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Chi-square of each term's presence against the label; 0 where it stands in fewer than five rows."""
    expect = counts * (pos / max(n, 1))
    spread = np.maximum(expect * (1 - pos / max(n, 1)) * (1 - counts / max(n, 1)), 1e-9)
    return np.where(counts >= 5, (toxic - expect) ** 2 / spread, 0.0)


def together(rows: list[np.ndarray], y: np.ndarray, counts: np.ndarray, toxic: np.ndarray, tile: int = 512, least_rows: int = 20, least_share: float = 1 / 200) -> np.ndarray:
    """For each term the greatest chi-square of an interaction with another: what both say beyond what each adds.

    Every two terms are asked whose four cells (both, either, none) have
    ``least_rows`` and ``least_share`` of the rows or more, fewer would say nothing, by products of tiles
    of the sample's matrix. Terms of the same rows, as a word and its beginning
    often are, are asked as one.
    """
    n, pos = len(y), int(y.sum())
    cell = max(least_rows, int(n * least_share + 1e-9))
    best, marks = np.zeros(len(counts)), np.zeros(len(counts), np.uint64)
    for r, mark in zip(rows, np.random.default_rng(3).integers(1, 1 << 63, n, dtype=np.uint64)):
        marks[r] += mark
    able = np.flatnonzero((counts >= 2 * cell) & (counts <= n - 2 * cell))
    asked, first = able[(of_mark := np.unique(marks[able], return_index=True, return_inverse=True))[1]], of_mark[2]
    place = np.full(len(counts), -1, np.int32)
    place[asked] = np.arange(len(asked))
    order = np.argsort(-y, kind="stable")  # toxic rows first: their part of a product is its head
    at = [p[p >= 0] for p in (place[rows[i]] for i in order)]
    row, col = np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in at]), np.concatenate(at) if n else np.zeros(0, np.int32)
    del at
    by = np.argsort((col // tile).astype(np.int16), kind="stable")  # BUCKETS / tile numbers at most
    row, col = row[by], col[by]
    del by
    ends = np.searchsorted(col // tile, np.arange(-(-len(asked) // tile) + 1))

    def matrix(k):
        part = slice(ends[k], ends[k + 1])
        out = np.zeros((n, min(tile, len(asked) - k * tile)), np.float32)
        out[row[part], col[part] - k * tile] = 1
        return out

    rate = pos / max(n, 1)
    for i in range(len(ends) - 1):
        a, ia = matrix(i), asked[i * tile : (i + 1) * tile]
        for j in range(i, len(ends) - 1):
            b, ib = (a, ia) if i == j else (matrix(j), asked[j * tile : (j + 1) * tile])
            n11 = a.T @ b
            x, y11 = np.nonzero(n11 >= cell), a[:pos].T @ b[:pos]
            ka, kb, c, p = ia[x[0]], ib[x[1]], n11[x].astype(np.float64), y11[x].astype(np.float64)
            of = np.array([c, counts[ka] - c, counts[kb] - c, n - counts[ka] - counts[kb] + c])  # both, the one, the other, none
            bad = np.array([p, toxic[ka] - p, toxic[kb] - p, pos - toxic[ka] - toxic[kb] + p])
            fit = of.min(0, initial=n) >= cell
            of, bad, ka, kb = of[:, fit], bad[:, fit], ka[fit], kb[fit]
            share = bad / of
            chi = (share[0] - share[1] - share[2] + share[3]) ** 2 / (max(rate * (1 - rate), 1e-9) * (1 / of).sum(0))
            np.maximum.at(best, ka, chi)
            np.maximum.at(best, kb, chi)
    best[able] = best[asked][first]
    return best


class Machine:
    """Factorization machine with a logistic loss over the terms that tell the classes apart, alone or with another."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, share: float, rank: int = 4, least: float = 15.0, least_pair: float = 40.0, least_rows: int = 20, least_share: float = 1 / 200, rounds: int = 12):
        n, pos = len(y), int(y.sum())
        has = np.zeros((2, BUCKETS), np.int32)
        for r, c in zip(rows, y):
            has[int(c), r] += 1
        total = has.sum(0)
        chosen = np.flatnonzero((alone(total, has[1], n, pos) >= least) | (together(rows, y, total, has[1], least_rows=least_rows, least_share=least_share) >= least_pair))
        self.index = {int(b): k for k, b in enumerate(chosen)}
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        xs = [p[p >= 0] for p in (place[r] for r in rows)]
        rng = np.random.default_rng(11)
        w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank)), 0.0
        gw, gv, gb = np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6), 1e-6
        for _ in range(rounds if len(chosen) else 0):
            for i in rng.permutation(n):
                x = xs[i]
                vx = v[x]
                s = vx.sum(0)
                z = b + w[x].sum() + 0.5 * ((s * s).sum() - (vx * vx).sum())
                g = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - y[i]
                gb += g * g
                b -= 0.1 * g / np.sqrt(gb)
                if len(x):
                    dw, dv = g + 1e-4 * w[x], g * (s - vx) + 1e-3 * vx
                    gw[x] += dw * dw
                    gv[x] += dv * dv
                    w[x] -= 0.1 * dw / np.sqrt(gw[x])
                    v[x] -= 0.05 * dv / np.sqrt(gv[x])
        # the sample holds more of the rare class than the rows do: back to their odds
        fitted = min(max(pos / max(n, 1), 1e-6), 1 - 1e-6)
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.bias = (b if len(chosen) else np.log(fitted / (1 - fitted))) + np.log(share / (1 - share)) - np.log(fitted / (1 - fitted))
        self.weights, self.factors = w, v

    def score(self, found: list[int]) -> float:
        """The probability of toxicity of a text with these terms (numbers of chosen ones, each once)."""
        x = np.array(found, dtype=np.int64)
        vx = self.factors[x]
        s = vx.sum(0)
        z = self.bias + self.weights[x].sum() + 0.5 * ((s * s).sum() - (vx * vx).sum())
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def _terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: np.unique(np.fromiter((b for w in words_of(t) for b in terms(w)), np.int32)))


def held_out(doc_id: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = 4000, least: float = 15.0, least_pair: float = 40.0, least_rows: int = 20, least_share: float = 1 / 200) -> Machine | None:
    """Fit on about ``per_class`` labelled rows of either class that aren't held out.

    The ids are chosen by a hash (of repeated labels the highest counts). Their
    hashed terms come to the driver; the sample's size bounds them. None where
    no row is labelled.

    The model has the terms whose chi-square against the label is ``least`` or
    more, or in an interaction with another term ``least_pair`` or more; an
    interaction is asked where each of its four cells has ``least_rows`` rows of
    the sample and ``least_share`` of them.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for c, n in counts.items():
        chosen = chosen | ((F.col("y") == c) & (unit < int(min(1.0, per_class / n) * (1 << 20)) + 1))
    # about 2 * per_class ids: a bound that does not grow with the input
    sample = F.broadcast(known.where(chosen).withColumnRenamed("doc_id", "id"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sample, "id")
    got = rows.select("y", "id", pandas_udf(_terms, "array<int>")("text").alias("t")).sort("id", "t").limit(8 * per_class).toPandas()
    if not len(got):
        return None
    n, pos = sum(counts.values()), counts.get(1, 0)
    sampled, y = got.t.to_list(), got.y.to_numpy(dtype=float)
    del got
    return Machine(sampled, y, pos / n, least=least, least_pair=least_pair, least_rows=least_rows, least_share=least_share)


def score(docs: DataFrame, machine: Machine | None, text: str = "text", doc_id: str = "doc_id", limit: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no terms and score as the bias says; texts of any
    length are read whole, each term counts once; all rows score 0 where nothing
    was learned. Rows without an id are not held out;
    repeated rows each get a row; an empty table gives none; only id and text are read.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        memory: dict[str, tuple] = {}

        def one(text):
            if m is None:
                return 0.0
            found: set[int] = set()
            for w in words_of(text):
                t = memory.get(w)
                if t is None:
                    t = tuple(m.index[b] for b in terms(w) if b in m.index)
                    if len(memory) < REMEMBERED and len(w) <= 40:
                        memory[w] = t
                found.update(t)
            return m.score(sorted(found))

        for texts in batches:
            yield texts.map(one, na_action=None).astype(float)

    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), run(text).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= limit, 1).otherwise(0))
