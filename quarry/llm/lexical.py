"""Ranked lexical search by Block-Max MaxScore over shards of documents.

Method: the corpus counts (documents, terms, documents a term) come first, so a
posting's whole impact is known. Tasks gather their documents into shards, whose
postings lie by term in blocks of neighbouring documents, compressed to two bytes,
with each block's greatest impact. For a query, the lists' bounds over the whole
shard part them: those that together cannot reach the threshold are non-essential.
Documents of essential lists are candidates; non-essential lists follow by falling
bound, and the maxima of the candidate's blocks reject it, or spare the block,
before the block is decompressed. A task has one heap a query over all its
shards; the heaps are merged in a tree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import bounded_batches, materialize

#: Documents of a block; those of a window, in which candidates are gathered; postings of a shard at most (one document apart).
BLOCK, SPAN, SHARD = 128, 4096, 4_000_000
#: Queries that are searched at once; more are searched block after block.
QUERIES = 1024
#: Terms are runs of ASCII letters and digits and of all beyond ASCII; only A-Z is lower-cased. In UTF-8 that is a table of bytes.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; none of null."""
    return text.encode().translate(BYTES).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Shard:
    """Postings of some documents, by term and block: the place in the block and the frequency as bytes, greater frequencies aside."""

    def __init__(self, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """``m`` of each document; ``doc``, ``term`` and ``tf`` of each posting, documents rising."""
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        self.m, self.n_docs = m, len(m)
        self.place, self.tf = (doc % BLOCK).astype(np.uint8), np.minimum(tf, 255).astype(np.uint8)
        self.far = np.flatnonzero(tf >= 255)
        self.far_tf = tf[self.far]
        block = doc // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0)))) if len(doc) else np.zeros(0, np.int64)
        self.block, self.start, self.end = block[new], new, np.append(new[1:], len(doc)).astype(np.int64)
        self.most = np.maximum.reduceat(impact(tf, m[doc]), new) if len(new) else np.zeros(0, np.int64)
        owner = term[new]
        lists = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0))) if len(new) else np.zeros(0, np.int64)
        ends = np.append(lists[1:], len(new))
        bounds = np.maximum.reduceat(self.most, lists) if len(lists) else []
        #: Of each term: its range in the block arrays and its bound over the shard.
        self.lists = {t: (a, b, u) for t, a, b, u in zip(owner[lists].tolist(), lists.tolist(), ends.tolist(), map(int, bounds))}

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks of a list, decompressed."""
        n = self.end[blocks] - self.start[blocks]
        at = np.repeat(self.start[blocks] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        doc = np.repeat(self.block[blocks] * BLOCK, n) + self.place[at]
        tf = self.tf[at].astype(np.int64)
        big = np.flatnonzero(tf == 255)
        if len(big):
            tf[big] = self.far_tf[np.searchsorted(self.far, at[big])]
        return doc, impact(tf, self.m[doc])


class Heap:
    """The k best (score, document) of a query: greater scores first, then smaller ids, ids that are null last."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.absent, self.id = np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """The least score that can enter."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, absent: np.ndarray, doc_id: np.ndarray) -> None:
        score, absent, doc_id = np.concatenate((self.score, score)), np.concatenate((self.absent, absent)), np.concatenate((self.id, doc_id))
        if len(score) > 4 * self.k:  # only those at the k-th score or above are sorted
            fit = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, absent, doc_id = score[fit], absent[fit], doc_id[fit]
        best = np.lexsort((doc_id, absent, -score))[: self.k]
        self.score, self.absent, self.id = score[best], absent[best], doc_id[best]


def search_shard(shard: Shard, query: list[tuple[int, int]], heap: Heap, absent: np.ndarray, ids: np.ndarray) -> int:
    """Adds a query's best documents of a shard to its heap; ``query`` has (term, weight). Returns how many postings were decompressed."""
    lists = sorted(((w * shard.lists[t][2], w, *shard.lists[t][:2]) for t, w in query if w > 0 and t in shard.lists), reverse=True)
    opened = 0
    if not lists:
        return opened
    rest = np.cumsum([x[0] for x in lists[::-1]])[::-1].tolist() + [0]  # what the lists from the i-th on can add
    for low in range(0, shard.n_docs, SPAN):
        least = heap.threshold
        if rest[0] < least:
            return opened
        essential = next((i for i in range(len(lists)) if rest[i] < least), len(lists))
        first, n = low // BLOCK, -(-min(SPAN, shard.n_docs - low) // BLOCK)
        inside = [np.arange(a + s, a + e) for _, _, a, b in lists for s, e in [np.searchsorted(shard.block[a:b], (first, first + n))]]
        most = np.zeros((len(lists) + 1, n), np.int64)
        for i, blocks in enumerate(inside):
            most[i, shard.block[blocks] - first] = lists[i][1] * shard.most[blocks]
        after = np.cumsum(most[::-1], axis=0)[::-1]  # what the lists from the i-th on can add in each block
        live = after[0] >= least
        if not live.any():
            continue
        score, found = np.zeros(n * BLOCK, np.int64), np.zeros(n * BLOCK, bool)
        for i in range(essential):
            blocks = inside[i][live[shard.block[inside[i]] - first]]
            if len(blocks):
                doc, got = shard.postings(blocks)
                opened += len(doc)
                score[doc - low] += lists[i][1] * got
                found[doc - low] = True
        alive = np.flatnonzero(found)
        for i in range(essential, len(lists)):
            alive = alive[score[alive] + after[i][alive // BLOCK] >= least]
            if not len(alive):
                break
            wanted = np.zeros(n, bool)
            wanted[alive // BLOCK] = True
            blocks = inside[i][wanted[shard.block[inside[i]] - first]]
            if len(blocks):
                doc, got = shard.postings(blocks)
                opened += len(doc)
                score[doc - low] += lists[i][1] * got
        alive = alive[score[alive] >= least]
        if len(alive):
            heap.add(score[alive], absent[low + alive], ids[low + alive])
    return opened


def postings(docs: DataFrame, words: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, term, tf) of each row: its number of terms, and the numbers and frequencies of those in ``words``."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    @pandas_udf("n long, term array<int>, tf array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = sent.value.get
        for texts in batches:
            out = []
            for t in texts:
                own = terms(t)
                got = [(k, c) for w, c in Counter(own).items() if (k := number(w)) is not None]
                out.append((len(own), np.array([k for k, _ in got], np.int32), np.array([c for _, c in got], np.int32)))
            yield pd.DataFrame(out, columns=["n", "term", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), run(text).alias("r")).select("doc_id", "r.*")


def _heaps(rows: DataFrame, sent, n_all: int, l_all: int, k: int, shard: int) -> DataFrame:
    """(query, doc_id, score) of each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        heaps = [Heap(k) for _ in queries]
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            absent, ids, n, counts, term, tf = (np.concatenate(x) for x in zip(*held))
            s = Shard(50 + (50 * n * n_all) // l_all, np.repeat(np.arange(len(n)), counts), term, tf)
            for q, h in zip(queries, heaps):
                search_shard(s, q, h, absent, ids)

        for b in batches:
            # only documents with one of the terms can score
            b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("term")), 0))
            if not b.num_rows:
                continue
            ids, lists, tf = b.column("doc_id"), b.column("term"), b.column("tf")
            counts = np.diff(lists.offsets.to_numpy())
            held.append((ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), b.column("n").to_numpy(), counts, lists.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)))
            size += int(counts.sum())
            if size >= shard:
                flush()
                held, size = [], 0
        if held:
            flush()
        for q, h in enumerate(heaps):
            if len(h.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h.score), q, np.int32)), pa.array(h.id, pa.int64(), mask=h.absent), pa.array(h.score)], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", at_once: int = QUERIES, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item, all with a score above 0 if there are fewer.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums
    weight * (10^9 tf div (1000 tf + 20 m)) over the item's terms, once each, with
    m = 50 + 50 n N div L. Equal scores rank by ascending doc_id. Null and empty
    texts have no terms: such items have no rows, such documents none and do not
    count in N. Texts of any length count whole; repeated rows of documents, and
    rows without an id (last among equals), are documents each; rows that repeat
    an item_id, null too, are one item with the terms of all; empty tables give
    no rows; other columns are not read.

    ``at_once`` items are searched together: their terms and counts go to every
    task, and documents are read once for each such block of items. A task holds
    ``shard`` postings and one more batch, and k rows for each item.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = pandas_udf(lambda s: s.map(lambda t: [w.decode() for w in set(terms(t))]), "array<string>")
    asked = items.select(F.col(item_id).alias("item_id"), F.explode(own(item_text)).alias("word")).distinct()
    asked = materialize(asked, "items")
    n_items = asked.select("item_id").distinct().count()
    blocks = max(-(-n_items // at_once), 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        wanted: dict = {}
        for r in asked.where(F.col("block") == block).collect():  # at_once items on average
            wanted.setdefault(r["item_id"], []).append(r["word"].encode())
        if not wanted and block:
            continue
        words = {w: i for i, w in enumerate(sorted({w for ws in wanted.values() for w in ws}))}
        rows = materialize(postings(docs, words, text, doc_id), "postings")
        n_all, l_all = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(map(tuple, rows.select(F.explode("term").alias("t")).groupBy("t").count().collect()))  # one row for each of the block's terms
        weight = {t: int(np.floor(1000 * np.log((2 * n_all + 2) / (2 * d + 1)))) for t, d in df.items()}
        queries = [sorted((words[w], weight[words[w]]) for w in ws if words[w] in weight) for ws in wanted.values()]
        sent = spark.sparkContext.broadcast(queries)
        lists = _heaps(rows, sent, n_all, max(l_all, 1), k, shard).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        # lists of tasks meet in 64 groups a query, then the groups' lists
        best = _best(_best(lists, ["query", "part"], k).drop("rank"), ["query"], k)
        names = spark.createDataFrame(list(enumerate(wanted)), _named(asked))
        best = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def _named(asked: DataFrame) -> str:
    return f"query int, item_id {asked.schema['item_id'].dataType.simpleString()}"
