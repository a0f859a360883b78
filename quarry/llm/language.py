"""Language identification by hierarchical discrimination.

Method: a linear support vector machine for each family picks the language
family; within it, one-versus-one linear support vector machines vote on the
language. Features are hashed runs of one to four characters of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches

BUCKETS = 4096
#: Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "mr", "ur"),
}
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def grams(text: str, step: int = 1 << 20) -> np.ndarray:
    """Unit vector of the square roots of the counts of hashed character runs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.zeros(BUCKETS)
    for at in range(0, len(codes), step):  # in blocks: very long texts need no more memory
        part = codes[max(0, at - 3) : at + step]
        own = at - max(0, at - 3)  # codes that the last block has counted as ends of runs
        h = np.zeros(len(part), np.uint32)
        for k in range(4):
            if len(part) <= k:
                break
            h = (h[1:] if k else h) * np.uint32(31) + part[k:] * _MULT[k]
            new = h[max(0, own - k) :]
            count += np.bincount(((new ^ (new >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=BUCKETS)
    v = np.sqrt(count)
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def row_costs(y: np.ndarray, c: float = 10.0) -> np.ndarray:
    """What a row's hinge loss costs: ``c`` on average, and as much for all rows of one side as for the other."""
    return np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM, y in (-1, 1), by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cost = row_costs(y, c)
    w, alpha, norm = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), (x.astype(np.float64) ** 2).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w


class Model:
    """Family machines, and one machine for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, families=FAMILIES):
        of = {lang: f for f, ls in families.items() for lang in ls}
        self.langs = sorted(set(langs.tolist()))
        family = np.array([of.get(x, "=" + x) for x in langs], dtype=object)
        self.families = sorted(set(family.tolist()))
        self.members = {f: [x for x in self.langs if of.get(x, "=" + x) == f] for f in self.families}
        self.top = np.array([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f, ls in self.members.items():
            for a, b in combinations(ls, 2):
                rows = (langs == a) | (langs == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        v = np.append(v, np.float32(1))
        sure = lambda m: float(1 / (1 + np.exp(-min(max(2 * m, -50.0), 50.0))))
        f, score = self.families[0], 1.0
        if self.top is not None:
            margins = self.top @ v
            k = int(np.argmax(margins))
            f, score = self.families[k], sure(margins[k])
        ls = self.members[f]
        if len(ls) == 1:
            return ls[0], score
        votes, margin = dict.fromkeys(ls, 0), dict.fromkeys(ls, 0.0)
        for a, b in combinations(ls, 2):
            m = float(self.pairs[a, b] @ v)
            votes[a if m > 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(ls, key=lambda x: (votes[x], margin[x]))
        return best, score * sure(margin[best] / (len(ls) - 1))


def _grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: grams(t).astype(np.float16).tobytes())


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is of a letter category; digits, superscripts and fractions are not."""
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 500, most_languages: int = 200) -> Model | None:
    """Fit on about ``per_language`` labelled rows of each language that aren't held out.

    The rows are chosen by a hash of the id; their vectors (8 KB each) come to
    the driver, at most 2 * per_language a language. None where no row is labelled.
    ``most_languages`` bounds what the driver gathers and fits; a table with more
    values of lang is refused, as none of them can be left out.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.coalesce(~held_out("id"), F.lit(True)) & F.rlike("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages or map the labels first")
    if not counts:
        return None
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for x, n in counts.items():
        chosen = chosen | ((F.col("lang") == x) & (unit < int(min(1.0, per_language / n) * (1 << 20)) + 1))
    got = known.where(chosen).select("lang", pandas_udf(_grams, "binary")("text").alias("v")).sort("lang", "v").limit(2 * per_language * len(counts)).toPandas()
    if not len(got):
        return None
    return Model(np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in got.v]), got.lang.to_numpy(dtype=object))


def held_out(doc_id: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The family of the greatest margin, its first by name among equals; in it the
    language with most votes of the pairs' machines, then the greatest sum of
    margins, then the first by name. ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned; an empty table gives no rows; texts of any length are read whole. Rows without an id are not held out; repeated rows each
    get a row; only id and text are read.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            yield pd.DataFrame([m.predict(grams(t)) if m is not None and has_letter(t) else ("und", 0.0) for t in texts], columns=["lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), run(text).alias("r")).select("doc_id", "held_out", "r.*")
