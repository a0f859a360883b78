"""Quality rules judged per document and per host.

Method: count each rule's failures by host (the document's ``source``), shrink
the failure rates with a beta prior fitted to all hosts (method of moments) and
join the hosts' verdicts back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches, materialize

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rule name -> SQL over the features. The first two are the base rules.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    d = len(known)
    pairs = ids[:-1] * d + ids[1:]
    if d > 1 << 20:  # the product of three would pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
        d = int(pairs.max()) + 1
        keys = pairs[:-1] * d + pairs[1:]
    else:
        keys = pairs[:-1] * d + ids[2:]
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(keys)] |= hit
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of FEATURES for one whole text; a null text counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), _repeat_words(words)


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_features(x) for x in texts], columns=list(FEATURES))


def features(text: str | Column = "text") -> Column:
    """Struct of the text's counts."""
    bounded_batches(SparkSession.getActiveSession())
    return pandas_udf(_features, ", ".join(f"{x} long" for x in FEATURES))(F.col(text) if isinstance(text, str) else text)


def host_verdicts(
    judged: DataFrame, max_rate: float = 0.5, z: float = 2.0, strength: tuple[float, float] = (2.0, 1000.0)
) -> DataFrame:
    """Hosts and whether they fail a rule too often: (host, host_bound, host_rejected).

    ``judged`` has host and the features. For each rule a beta prior is fitted
    to the hosts' rates: mean m of all rows, variance v of the rates weighted
    by rows, strength m(1-m)/v - 1 held within ``strength``. A host is rejected
    when host_bound, the greatest of the rules' posterior means less ``z``
    posterior deviations, is above ``max_rate``. Null hosts have no verdict. One row of moments comes to
    the driver, whatever the number of hosts.
    """
    counts = judged.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(r) for r, e in RULES.items())
    )
    counts = materialize(counts, "hosts")
    total = counts.agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES)).first()
    n = total["n"] or 1
    mean = {r: (total[r] or 0) / n for r in RULES}
    spread = counts.agg(
        *(F.sum(F.col("n") * (F.col(r) / F.col("n") - F.lit(mean[r])) * (F.col(r) / F.col("n") - F.lit(mean[r]))).alias(r) for r in RULES)
    ).first()
    bounds = []
    for r in RULES:
        m, v = mean[r], (spread[r] or 0.0) / n
        s = min(max(m * (1 - m) / v - 1, strength[0]), strength[1]) if v > 0 else strength[1]
        post = (F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s))
        bounds.append(post - z * F.sqrt(post * (1 - post) / (F.col("n") + F.lit(s + 1))))
    return counts.select("host", F.greatest(*bounds).alias("host_bound")).withColumn("host_rejected", F.col("host_bound") > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, host, FEATURES, base_failed, host_rejected, host_bound (six digits), kept.

    Null or empty texts have no words and fail; rows with a null host are judged
    by their own rules alone; repeated rows each get a row; other columns of the
    input are left out, so their names cannot clash; an empty table gives none.
    """
    judged = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), features(text).alias("f"))
    judged = materialize(judged.select("doc_id", "host", "f.*"), "quality")
    out = judged.join(host_verdicts(judged), "host", "left")
    failed, rejected = F.expr(BASE_FAILED), F.coalesce("host_rejected", F.lit(False))
    return out.select(
        "doc_id", "host", *FEATURES, failed.alias("base_failed"), rejected.alias("host_rejected"), F.round("host_bound", 6).alias("host_bound"), (~failed & ~rejected).alias("kept")
    )


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and nothing else.

    Null and empty texts fail; texts of any length are read whole; rows with a
    null host are judged by their own rules alone; repeated rows pass or fail
    alike; extra columns of any name stay; an empty table gives none.
    The counts are computed once for the hosts and once for the filter, so the
    text itself never goes through a shuffle unless the table of rejected hosts
    is larger than Spark's broadcast limit.
    """
    row = docs.select(F.struct("*").alias("row"), features(text).alias("f"))
    judged = materialize(row.select(F.col(f"row.{host}").alias("host"), "f.*"), "quality")
    bad = host_verdicts(judged).where("host_rejected").select("host")
    passed = row.where(~F.expr(BASE_FAILED.replace("n_", "f.n_")))
    return passed.join(bad, passed[f"row.{host}"] == bad["host"], "left_anti").select("row.*")
