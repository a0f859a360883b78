"""Secret scan: fixed patterns, and credentials whose parts are linked by place.

Method: access identifiers, secrets and endpoints of a text are intervals; each
identifier opens a scope around it, and an interval join of scopes and parts
reports weak candidates only when complementary parts meet in one scope.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches

#: The kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: alone they are ordinary text.
WEAK_ID = re.compile(r"(?:access_key_id|client_id|user(?:name)?|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", re.A | re.I)
WEAK_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}")
CLASSES = tuple(map(re.compile, ("[0-9]", "[A-Z]", "[a-z]")))
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]{2,}|postgres(?:ql)?|mysql|mongodb|redis|s3)://[^\s\"'<>]{4,}|(?:endpoint|host|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.:-]{4,})", re.A | re.I)
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
HINTS = ("akia", "access_key_id", "client_id", "user", "account")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = 200) -> list[tuple[int, int, str]]:
    """Weak parts that reach within ``scope`` characters of an identifier together with a complementary part.

    Parts: identifiers (access, weak ids), secrets (assign, hex, weak secrets),
    endpoints. A scope needs its identifier and a secret; endpoints and weak
    identifiers are reported with them, never alone. A part is in a scope when the
    two overlap; it is left out when a base span covers its whole value.
    """
    low = text.lower()
    if not any(k in low for k in HINTS):
        return []
    strong = [(s, e) for s, e, k in base if k == "access"]
    covered = [sorted((s, e) for s, e, k in base if k == kind) for kind in KINDS[:3]]

    def free(m):  # of a kind, which does not overlap itself, only the last one that starts no later can cover the value
        s, e = m.span(m.lastindex or 0)
        return not any((k := bisect_left(of_kind, (s + 1,))) and of_kind[k - 1][1] >= e for of_kind in covered)

    ids = sorted([(s, e, True) for s, e in strong] + [(*m.span(), False) for m in WEAK_ID.finditer(text) if free(m)])
    if not ids:
        return []
    weak = [m.span() for m in WEAK_RUN.finditer(text) if all(c.search(m[0]) for c in CLASSES) and free(m)]
    secrets = sorted([(s, e) for s, e, k in base if k != "access"] + weak)
    begins, ends = [s for s, _ in secrets], list(accumulate((e for _, e in secrets), max))
    near = lambda lo, hi: (b := bisect_left(begins, hi)) > 0 and ends[b - 1] > lo
    scopes = [(s, e, known) for s, e, known in ids if near(s - scope, e + scope)]
    opens, closes = [s - scope for s, _, _ in scopes], list(accumulate((e + scope for _, e, _ in scopes), max))
    within = lambda x, y: (b := bisect_left(opens, y)) > 0 and closes[b - 1] > x
    return (
        [(s, e, "linked_id") for s, e, known in scopes if not known]
        + [(x, y, "linked_secret") for x, y in weak if within(x, y)]
        + [(*m.span(), "linked_endpoint") for m in ENDPOINT.finditer(text) if free(m) and within(*m.span())]
    )


def find(text: str | None, scope: int = 200) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if not text:
        return [], []
    by = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=by)
    return base, sorted(base + linked_spans(text, base, scope), key=by)


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            base, every = find(text)
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(mask)


def mask(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced by ``mark`` (overlapping spans by one); null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s, e, _ in find(text)[1]:
        if s >= at:
            out += (text[at:s], mark)
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, of the whole
    match. Null and empty texts have none (the digest of an empty string);
    texts of any length are scanned whole; repeated rows each get a row; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), pandas_udf(_report, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(text).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span of the text masked, and ``length`` set anew where it is a column.

    Null and empty texts stay as they are; repeated rows and extra columns of any
    name stay; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), pandas_udf(_masked, "string")(F.col(text)).alias("masked"))
    new = {text: F.col("masked")}
    if length in docs.columns:
        new[length] = F.when(F.col(f"row.{length}").isNotNull(), F.length("masked")).cast(docs.schema[length].dataType)
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
