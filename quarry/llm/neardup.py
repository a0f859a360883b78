"""Near-duplicate classes of documents.

Method: a text's five-word shingles are weighted by TF-IDF; improved consistent
weighted sampling draws 64 samples of the weighted set, 16 bands of four make
candidates, and a candidate link stands when the weighted Jaccard similarity of
the whole texts is 0.8 or more. Classes are the links' connected components.

Exact copies are one node from the start, and a bucket's members are compared
with the bucket's hub first, so a group of copies costs links in proportion to
its members, not pairs. Where a large bucket then still holds more than one
component, other members of it become hubs in turn and meet the members of the
other components. What the hubs leave is compared in full: a bucket's members of
different components whose weights can reach the similarity meet in tiles of
bounded size, and a tile gives only links that join components. So every two
texts that share a bucket are compared or already in one class, but for pairs
with under 39 of 64 equal samples (by calculation one of 7,900 at 0.8), which
hubs and tiles leave out before their texts are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.shared import materialize

WORDS, BANDS, PER_BAND, SIMILAR = 5, 16, 4, 0.8
HASHES = BANDS * PER_BAND
#: Rounds of further hubs at most, and hubs of a bucket in each; a hub costs links in proportion to the bucket's members.
TURNS, HUBS = 2, 4
#: Members of a tile's side: what a task holds of one bucket at a time.
TILE = 512
TILE_KEY = ["h", "k", "i", "j"]
#: Pairs of one hub that meet in a task, and parts that one label is dealt into.
PART, SALTS = 2000, 32
#: Only larger buckets get further hubs: in others a member of plain length comes to no more tiles of a weight class than it would meet hubs.
LARGE = TILE * TURNS * HUBS
#: Texts of more than this weight (about a thousand words) count as several of a tile's members.
PLAIN = 4000
#: Document frequencies are kept in a count sketch of this depth and width; terms in less than one of LIGHT documents weigh alike.
DEPTH, WIDTH, LIGHT = 2, 1 << 17, 100
#: Rows of the table that the samples' random numbers come from.
TABLE = 1 << 15
BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
_LETTERS = np.array([c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 0 for c in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (letters and digits, in lower case), in order."""
    raw = _LETTERS[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    out, at = [], 0
    while at < len(raw):  # in blocks that end between words: very long texts need no larger tables
        end = min(at + BLOCK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(raw[at:end] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(raw[end:] == 0)
                end = end + int(gaps[0]) + 1 if len(gaps) else len(raw)
        b = raw[at:end]
        up, down = _powers(1 << max(int(len(b) - 1).bit_length(), 12))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (b > 0).view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        total = np.concatenate(([_U(0)], np.cumsum(b * up[: len(b)], dtype=np.uint64)))
        out.append(_mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs. Texts of fewer words are one shingle."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _U(0x9E3779B97F4A7C15) + words[k : k + m]
    return np.unique(_mix(h), return_counts=True)


def fingerprint(words: np.ndarray) -> bytes | None:
    """128 bits of the sequence of words; None if there are none."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> _U(d * 17)).astype(np.int64) & (WIDTH - 1) for d in range(DEPTH)]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents with words, and the sketch of their shingles' document frequencies.

    Every shingle of every document counts. Counts below 1/LIGHT of the
    documents weigh alike and stay on the cluster; the sketch's size is fixed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for batch in batches:
            for t in batch["t"]:
                h, _ = shingles(word_hashes(t or ""))
                n += bool(len(h))
                for d, cell in enumerate(_cells(h)):
                    sums[d] += np.bincount(cell, minlength=WIDTH)
        flat = sums.ravel()
        used = np.flatnonzero(flat)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pd.DataFrame({"cell": part.astype(np.int32), "n": flat[part]})
        yield pd.DataFrame({"cell": np.array([-1], np.int32), "n": np.array([n], np.int64)})

    sums = materialize(docs.select(F.col(text).alias("t")).mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "sketch")
    n = (sums.where("cell = -1").first() or [0, 0])[1]
    # what a cell holds of other terms is about the mean: it is taken off
    mean = (sums.where(f"cell >= 0 and cell < {WIDTH}").agg(F.sum("n")).first()[0] or 0) / WIDTH
    least = n / LIGHT
    heavy = sums.where("cell >= 0").where(F.col("n") - mean > least).toPandas()
    sketch = np.zeros(DEPTH * WIDTH, np.float32)
    sketch[heavy.cell.to_numpy(dtype=np.int64)] = heavy.n.to_numpy() - mean
    return n, np.maximum(sketch, least).reshape(DEPTH, WIDTH)


class Sampler:
    """TF-IDF weights and consistent weighted samples under one corpus's frequencies."""

    def __init__(self, n: int, sketch: np.ndarray):
        self.idf = np.log1p(max(n, 1) / np.maximum(sketch, max(n, 1) / LIGHT)).astype(np.float32)
        self.plain = np.float32(self.idf.max())
        rng = np.random.default_rng(5)
        u = lambda: 1 - rng.random((TABLE, HASHES), np.float32)
        self.r = -np.log(u() * u())  # gamma(2, 1)
        self.c = np.log(-np.log(u() * u()))
        self.beta = rng.random((TABLE, HASHES), np.float32)
        self.a, self.t = self._draw(slice(None), np.log(self.plain))
        self.seeds = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019))

    def _draw(self, rows, log_weight):
        t = np.floor(log_weight / self.r[rows] + self.beta[rows])
        return self.c[rows] - self.r[rows] * (t - self.beta[rows]) - self.r[rows], t

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        cells = _cells(h)
        # the least of the counts is nearest the truth, so the greatest idf
        return tf * np.max([self.idf[d][c] for d, c in enumerate(cells)], axis=0)

    def sample(self, h: np.ndarray, w: np.ndarray, step: int = 4096) -> np.ndarray:
        """64 hashes (element and level), alike in two sets with the probability of their weighted Jaccard similarity."""
        best, elem, level = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.uint64), np.zeros(HASHES, np.float32)
        at = np.arange(HASHES)
        for k in range(0, len(h), step):
            hs, ws = h[k : k + step], w[k : k + step]
            rows = (hs >> _U(40)).astype(np.int64) & (TABLE - 1)
            a = self.a[rows]
            odd = np.flatnonzero(np.abs(ws - self.plain) > 1e-6)
            if len(odd):
                own, t_own = self._draw(rows[odd], np.log(ws[odd])[:, None].astype(np.float32))
                a[odd] = own
            i = a.argmin(0)
            low = a[i, at]
            t = self.t[rows[i], at]
            if len(odd):
                where = np.full(len(hs), -1)
                where[odd] = np.arange(len(odd))
                mine = where[i] >= 0
                t[mine] = t_own[where[i][mine], at[mine]]
            # equal values: the hashes are sorted, so the first and least one stays
            new = low < best
            best[new], elem[new], level[new] = low[new], hs[i][new], t[new]
        return _mix(elem + level.astype(np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93) + self.seeds)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / ((float(a[1].sum()) + float(b[1].sum()) - both) or 1.0)


def jaccard_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The same of sets whose hashes are sorted, by look-ups of the shorter in the longer."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = float(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())
    return both / ((float(a[1].sum()) + float(b[1].sum()) - both) or 1.0)


_samplers: dict = {}


def _sampler(sent) -> Sampler:
    name, n, sketch = sent.value
    if name not in _samplers:
        _samplers.clear()
        _samplers[name] = Sampler(n, sketch)
    return _samplers[name]


def signatures(docs: DataFrame, sent, text: str, doc_id: str) -> DataFrame:
    """(doc_id, fp, bands, sig, weight) of each row; the last four null for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _sampler(sent)
        order = _U(0x9E3779B97F4A7C15) ** np.arange(PER_BAND, dtype=np.uint64)
        for batch in batches:
            fps, bands, sigs, weights = [], [], [], []
            for t in batch["t"]:
                words = word_hashes(t or "")
                fp, sig, band, weight = fingerprint(words), None, None, None
                if fp is not None:
                    h, tf = shingles(words)
                    w = s.weights(h, tf)
                    drawn, weight = s.sample(h, w), float(w.sum())
                    sig = (drawn >> _U(48)).astype(np.uint16).tobytes()
                    band = _mix((drawn.reshape(BANDS, PER_BAND) * order).sum(1, dtype=np.uint64)).view(np.int64)
                fps.append(fp)
                sigs.append(sig)
                bands.append(band)
                weights.append(weight)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps, "bands": bands, "sig": sigs, "weight": weights})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, fp binary, bands array<long>, sig binary, weight double")


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean()) for x, y in zip(a, b)], dtype=float)


@dataclass
class Corpus:
    """What the comparisons need: the documents, one node for each distinct text, and the sampler's frequencies."""

    docs: DataFrame
    nodes: DataFrame
    sent: object
    text: str
    doc_id: str
    at_least: float
    nameless: bool  # some node has only rows without an id
    ambiguous: bool  # some id has rows of different texts

    def with_text(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (rep, fp and more) without rep and with the text of each fingerprint.

        Whole texts are shuffled once, by id. Where ids repeat with other texts the
        fingerprint decides; rows of an id that repeat a text are taken once where
        they come one after the other. Nodes without an id are found by their
        fingerprint among the documents without an id.
        """
        ambiguous = self.ambiguous
        given = self.docs.select(F.col(self.doc_id).alias("rep"), F.col(self.text).alias("text"))
        found = wanted.join(given, "rep")
        names = [c for c in wanted.columns if c != "rep"]
        keys = [c for c in names if wanted.schema[c].dataType.typeName() != "array"]

        def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, seen = None, set()
            for batch in batches:
                keep = []
                for rep, text, key in zip(batch["rep"], batch["text"], zip(*(batch[c] for c in keys))):
                    if rep != last:
                        last, seen = rep, set()
                    new = key not in seen and (not ambiguous or fingerprint(word_hashes(text or "")) == key[keys.index("fp")])
                    keep.append(new)
                    if new:
                        seen.add(key)
                yield batch[keep][[*names, "text"]]

        kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names)
        out = found.mapInPandas(only, f"{kinds}, text string")
        if self.nameless:

            def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield pd.DataFrame({"fp": [fingerprint(word_hashes(t or "")) for t in batch["text"]], "text": batch["text"]})

            loose = given.where("rep is null").select("text").mapInPandas(marked, "fp binary, text string").where("fp is not null").dropDuplicates(["fp"])
            out = out.unionByName(wanted.where("rep is null").drop("rep").join(loose, "fp"))
        return out


def verified(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """Of the pairs (a, b) of fingerprints, those whose texts are similar enough.

    The share of equal samples has a deviation of 0.05 there, so pairs with less
    than ``at_least`` - 0.2 of them are not worth their texts. The others meet at
    a, a bounded number at a time: a's text goes to each of its parts, b's to one.
    """
    nodes, sent, at_least = corpus.nodes, corpus.sent, corpus.at_least
    end = lambda x: nodes.select(F.col("fp").alias(x), F.col("sig").alias(f"s{x}"), F.col("rep").alias(f"r{x}"))
    pairs = pairs.join(end("b"), "b").join(end("a"), "a")
    pairs = materialize(pairs.where(pandas_udf(_alike, "double")("sa", "sb") >= at_least - 0.2).select("a", "b", "ra", "rb"), "pairs")
    parts = pairs.groupBy("a").agg(F.first("ra").alias("ra"), F.ceil(F.count("*") / PART).alias("parts"))
    others = pairs.drop("ra").join(parts.drop("ra"), "a").select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.col("rb").alias("rep"), F.pmod(F.xxhash64("b"), "parts").alias("part"))
    hubs = parts.select(F.col("a").alias("hub"), F.col("a").alias("fp"), F.col("ra").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = others.unionByName(hubs)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _sampler(sent)

        def weighted(t):
            h, tf = shingles(word_hashes(t))
            return h, s.weights(h, tf)

        at, hub = None, None
        for batch in batches:
            good = []
            for a, b, t in zip(batch["hub"], batch["fp"], batch["text"]):
                if a == b:
                    at, hub = a, weighted(t)
                good.append(a != b and at == a and jaccard(hub, weighted(t)) >= at_least)
            yield batch[good][["hub", "fp"]].set_axis(["a", "b"], axis=1)

    met = corpus.with_text(wanted).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("fp") != F.col("hub"))
    return materialize(met.mapInPandas(compare, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(fp, label) of all ends of the links; the label is the least fingerprint of the component.

    Each round takes the least label among a node and its neighbours, then the
    label of that label; rounds end when none changes. Only labels that have
    moved are looked up again, in SALTS parts each, as one label may be that of
    a third of all nodes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("v", "u")
    labels = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("l")), "labels")
    near = both.union(labels.select("v", F.col("v").alias("u")))  # a node is its own neighbour
    while True:
        x = near.join(labels.select(F.col("v").alias("u"), F.col("l").alias("x")), "u")
        step = materialize(x.groupBy("v").agg(F.max(F.when(F.col("u") == F.col("v"), F.col("x"))).alias("l"), F.min("x").alias("x")), "labels")
        if not step.where("x <> l").take(1):
            return labels.select(F.col("v").alias("fp"), F.col("l").alias("label"))
        moved = step.select("x").distinct().join(step.select(F.col("v").alias("x"), F.col("x").alias("y")), "x").where("y < x")
        moved = moved.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = step.select("v", "x", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
        labels = materialize(salted.join(moved, ["x", "salt"], "left").select("v", F.coalesce("y", "x").alias("l")), "labels")


def unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, fp, label, n) of the buckets that hold more than one component; n is the number of the bucket's members."""
    known = shared.join(labels, "fp", "left").select("h", "fp", F.coalesce("label", "fp").alias("label"))
    mixed = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    return materialize(known.join(mixed, "h"), "unsettled")


def tiled(rest: DataFrame, corpus: Corpus) -> DataFrame:
    """Links (a, b) of labels: components with similar members, unsettled ones of one bucket, by their whole texts.

    Two sets are as similar only if the lesser weight is that part of the greater,
    so a member meets those of its own weight class and of the one below. Larger
    groups are dealt into parts, and each two parts meet in a tile. Samples meet
    first; only members with a partner there come to the tile again with their
    text. Two texts are compared in the first bucket that they share, and a tile
    gives one link for each two components that it joins, never its pairs.
    """
    nodes, sent, at_least = corpus.nodes, corpus.sent, corpus.at_least
    width = max(-math.log(max(at_least, 1e-3)), 1e-3) * 1.001
    rows = rest.join(nodes.select("fp", "weight"), "fp").select("h", "fp", "label", F.xxhash64("label").alias("l"), "weight", F.floor(F.log("weight") / width).alias("c"))
    rows = rows.select("h", "fp", "label", "l", "weight", "c", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("k")).withColumn("own", F.col("k") == F.col("c"))
    mixed = rows.groupBy("h", "k").agg(F.count("*").alias("n"), F.max("own").alias("any"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("any and lo <> hi")
    heavy = F.greatest(F.lit(1.0), F.exp(F.col("k") * width) / PLAIN)
    parts = mixed.select("h", "k", F.least("n", F.ceil(F.col("n") * heavy / TILE)).cast("long").alias("parts"))
    rows = materialize(rows.join(parts, ["h", "k"]).drop("c"), "mixed")
    bands = F.transform("bands", lambda x, i: F.xxhash64(i, x))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp", "h"), "parts")).join(nodes.select("fp", "rep", "sig", bands.alias("bands")), "fp")
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("h", "k", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "fp", "rep", "label", "l", "weight", "own", "part", "sig", "bands")

    def partners(tile: pd.DataFrame, l: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with later ones of other components (``l`` as it is then) that its samples resemble."""
        weight, own, part, h = (tile[x].to_numpy() for x in ("weight", "own", "part", "h"))
        sig = np.frombuffer(b"".join(tile["sig"]), np.uint16).reshape(-1, HASHES)
        buckets = np.stack(tile["bands"].to_list())
        before = int(np.flatnonzero(buckets[0] == h[0])[0])
        across = tile["i"].iloc[0] != tile["j"].iloc[0]
        for r in range(len(tile) - 1):
            near = slice(r + 1, r + 1 + int(np.searchsorted(weight[r + 1 :], weight[r] / at_least * 1.000001, "right")))
            ok = (l[near] != l[r]) & (own[near] | own[r])
            if across:
                ok &= part[near] != part[r]
            at = np.flatnonzero(ok) + r + 1
            if len(at):
                at = at[(sig[at] == sig[r]).mean(1) >= at_least - 0.2]
            if len(at) and before:
                at = at[~(buckets[at, :before] == buckets[r, :before]).any(1)]
            yield r, at

    def mixes(tile: pd.DataFrame) -> bool:
        return len(tile) > 1 and (tile["l"] != tile["l"].iloc[0]).any()

    def resemble(tile: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(tile), bool)
        if mixes(tile):
            for r, at in partners(tile, tile["l"].to_numpy()):
                hit[at] = True
                hit[r] |= len(at) > 0
        return tile[hit]

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        a, b, s, sets = [], [], _sampler(sent), {}
        label, l = tile["label"].to_numpy(), tile["l"].to_numpy().copy()

        def terms(x: int):
            if x not in sets:
                hashes, tf = shingles(word_hashes(tile["text"].iat[x]))
                sets[x] = hashes, s.weights(hashes, tf)
            return sets[x]

        for r, at in partners(tile, l) if mixes(tile) else ():
            for x in at:
                if l[x] != l[r] and jaccard_sorted(terms(r), terms(x)) >= at_least:
                    a.append(label[r])
                    b.append(label[x])
                    l[l == l[x]] = l[r]
            sets.pop(r, None)  # later rows don't meet it again
        return pd.DataFrame({"a": a, "b": b})

    def by_tile(f):
        """``f`` of each tile; the batches hold tiles one after the other."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            last = None
            for batch in batches:
                key, out = batch[TILE_KEY].to_numpy(), []
                ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(batch)]
                for x, y in zip(ends, ends[1:]):
                    if x == y:
                        continue
                    if held and (key[x] != last).any():
                        out.append(f(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                        held = []
                    held.append(batch.iloc[x:y])
                    last = key[x]
                if out:
                    yield pd.concat(out, ignore_index=True)
            if held:
                yield f(pd.concat(held, ignore_index=True))

        return run

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "weight", "fp")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    alike = materialize(dealt(rows).mapInPandas(by_tile(resemble), kinds), "alike")
    return materialize(dealt(corpus.with_text(alike)).mapInPandas(by_tile(link), "a binary, b binary"), "links")


def _labelled(docs: DataFrame, text: str, doc_id: str, similar: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, label, class_id, class_size) of each distinct text."""
    spark = docs.sparkSession
    n, sketch = document_frequencies(docs, text)
    name = hashlib.blake2b(sketch.tobytes() + n.to_bytes(8, "little"), digest_size=16).hexdigest()
    sent = spark.sparkContext.broadcast((name, n, sketch))
    rows = materialize(signatures(docs, sent, text, doc_id), "signatures")
    nodes = materialize(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("weight").alias("weight")), "nodes")
    texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("fp", F.lit(b""))).alias("lo"), F.max(F.coalesce("fp", F.lit(b""))).alias("hi"))
    corpus = Corpus(docs, nodes, sent, text, doc_id, similar, bool(nodes.where("rep is null").take(1)), bool(texts.where("lo <> hi").take(1)))
    members = materialize(nodes.select("fp", F.posexplode("bands").alias("band", "h")).select("fp", F.xxhash64("band", "h").alias("h")), "members")
    hubs = members.groupBy("h").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "a")
    shared = materialize(members.join(hubs, "h"), "shared")
    links = verified(shared.where("fp <> a").select("a", F.col("fp").alias("b")).distinct(), corpus)
    labels = components(links)
    rest = unsettled(shared, labels)
    for turn in range(TURNS):
        # other members of each large bucket are its hubs in turn, and the members of other components meet them
        large = rest.where(F.col("n") > LARGE)
        if not large.take(1):
            break
        pivots = large.groupBy("h").agg(F.array(*(F.min_by(F.struct("fp", "label"), F.xxhash64("fp", F.lit(turn * HUBS + k))) for k in range(HUBS))).alias("ps"))
        met = large.join(pivots, "h").select("fp", "label", F.explode(F.array_distinct("ps")).alias("p")).where("label <> p.label")
        met = met.select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")).distinct()
        more = verified(met, corpus)
        if not more.take(1):
            break
        links = links.union(more)
        labels = components(links)
        rest = unsettled(shared, labels)
    more = tiled(rest, corpus)
    whole = nodes.select("fp", "rep", "n").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    if more.take(1):
        joined = components(more).toDF("label", "to")
        whole = whole.join(joined, "label", "left").select("fp", "rep", "n", F.coalesce("to", "label").alias("label"))
    whole = materialize(whole, "labelled")
    named = whole.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    return rows.select("doc_id", "fp"), materialize(whole.join(named, "label").select("fp", "label", "class_id", "class_size"), "classes")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size.

    class_id is the least doc_id of the class, class_size its number of rows.
    Rows without an id are members like others; a class of such rows alone has a
    null class_id. Null and empty texts, and texts without a letter or digit, are
    classes of their own (size 1); texts that differ only in case, spaces and
    punctuation are copies; texts of fewer than five words match their copies
    only; texts of any length are compared whole; repeated rows are copies; an
    empty table gives none. Only id and text are read.
    """
    rows, of = _labelled(docs, text, doc_id, similar)
    out = rows.join(of, "fp", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with one document of each class, the one of the least id, and no other change.

    Of rows that repeat a kept id one stays. Of a class of rows without an id one
    stays, and none of those in a class with an id. Null and empty texts, and
    texts without a letter or digit, all stay; an empty table gives none.
    """
    rows, of = _labelled(docs, text, doc_id, similar)
    out = rows.join(of.select("fp", "class_id"), "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    kept = materialize(out.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"))
    out = row.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").select("row")
    if kept.where("n > 1").take(1):
        again = row.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("row")
        out = out.unionByName(again)
    if not rows.where("doc_id is null").take(1):
        return out.select("row.*")

    @pandas_udf("binary")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(word_hashes(t or "")), na_action=None)

    loose = row.where("doc_id is null").select("row", marked(F.col(f"row.`{text}`")).alias("fp"))
    alone = loose.join(of.where("class_id is null").select("fp", "label"), "fp").dropDuplicates(["label"])
    return out.unionByName(loose.where("fp is null").select("row")).unionByName(alone.select("row")).select("row.*")
