"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Method: the distinct pieces of a batch of texts form one corpus. An inverted index
holds, for each mergeable pair, the places where it stands; the pairs are taken
in rank order, each merge is applied at all its places, and only the touched
neighbours get new entries. Pieces that a worker has met before are remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches

#: Pieces that a worker remembers at most, and the longest such piece; others are encoded again.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of text that are replayed together at most; a batch of Arrow has about as many.
TOGETHER = 2_000_000
_known: dict[str, tuple[dict[str, str], dict[str, bytes]]] = {}


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line. The driver reads the file, whose size is fixed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word: lowest rank first, leftmost first among equals, as if each were encoded alone."""
    out: list = [[ranks[w]] if w in ranks else None for w in words]
    tok: list[bytes] = []
    nxt: list[int] = []
    prv: list[int] = []
    first: list[int] = []
    places: dict[int, list[int]] = {}
    rank = ranks.get
    for k, w in enumerate(words):
        if out[k] is not None:
            first.append(-1)
            continue
        a, n = len(tok), len(w)
        first.append(a if n else -1)
        if not n:
            out[k] = []
            continue
        tok += [w[i : i + 1] for i in range(n)]
        prv += [-1, *range(a, a + n - 1)]
        nxt += [*range(a + 1, a + n), -1]
        for i in range(n - 1):
            r = rank(w[i : i + 2])
            if r is not None:
                places.setdefault(r, []).append(a + i)
    heap = sorted(places)
    while heap:
        r = heappop(heap)
        todo = places.pop(r, None)
        if todo is None:
            continue
        todo.sort()
        for n, i in enumerate(todo):
            j = nxt[i]
            if j < 0 or tok[i] is None:
                continue
            both = tok[i] + tok[j]
            if rank(both) != r:
                continue
            tok[i], tok[j] = both, None
            k = nxt[i] = nxt[j]
            earlier = False
            if k >= 0:
                prv[k] = i
                x = rank(both + tok[k])
                if x is not None:
                    if x not in places:
                        places[x] = [i]
                        heappush(heap, x)
                    else:
                        places[x].append(i)
                    earlier = x < r
            p = prv[i]
            if p >= 0:
                x = rank(tok[p] + both)
                if x is not None:
                    if x not in places:
                        places[x] = [p]
                        heappush(heap, x)
                    else:
                        places[x].append(p)
                    earlier = earlier or x < r
            if earlier:  # a lower rank has come up: it goes first, the rest of this one later
                if n + 1 < len(todo):
                    places[r] = todo[n + 1 :]
                    heappush(heap, r)
                break
    for k, a in enumerate(first):
        if a >= 0:
            ids, i = [], a
            while i >= 0:
                ids.append(ranks[tok[i]])
                i = nxt[i]
            out[k] = ids
    return out


def encode_texts(texts: list[str], ranks: dict[bytes, int], find, memory: dict[str, str]) -> Iterator[str]:
    """The ids of each text, written with commas; ``memory`` holds those of pieces."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        split = [find(t) for t in texts[start:end]]
        fresh = list({w for ws in split for w in ws if w not in memory})
        own: dict[str, str] = {}
        for w, ids in zip(fresh, replay([w.encode() for w in fresh], ranks)):
            (memory if len(memory) < REMEMBERED and len(w) <= LONGEST else own)[w] = ",".join(map(str, ids))
        for ws in split:
            yield ",".join([memory.get(w) or own[w] for w in ws])
        start = end


def _worker(sent, pattern: str):
    import regex

    name, ranks = sent.value
    if name not in _known:  # another vocabulary's ids are of no use
        _known.clear()
        _known[name] = {}, {str(i): b for b, i in ranks.items()}
    return ranks, regex.compile(pattern).findall, *_known[name]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the token ids.

    Digests are of the decimal ids joined by commas, and of the bytes that the
    ids decode to. Null and empty texts have no tokens; lone surrogates cannot
    come from Spark strings; texts of any length are encoded whole; repeated rows
    each get a row; an empty table gives none; other columns are not read. The vocabulary is sent to each executor once: its size is fixed.
    """
    spark = docs.sparkSession
    ranks = load_ranks(spark, path)
    bounded_batches(spark)
    name = hashlib.blake2b(repr(sorted(ranks.items())).encode(), digest_size=16).hexdigest()
    sent = spark.sparkContext.broadcast((name, ranks))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, find, memory, back = _worker(sent, pattern)
        for texts in batches:
            rows = []
            for written in encode_texts(["" if x is None else x for x in texts], table, find, memory):
                own = written.split(",") if written else []
                row = (len(own), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(b"".join([back[i] for i in own])).hexdigest())
                rows.append((*row, np.array(own, np.int32)) if ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return docs.select(F.col(doc_id).alias("doc_id"), run(text).alias("r")).select("doc_id", "r.*")


def decode(ids, ranks: dict[bytes, int]) -> bytes:
    """The bytes of a list of ids."""
    back = {i: b for b, i in ranks.items()}
    return b"".join(back[i] for i in ids)
