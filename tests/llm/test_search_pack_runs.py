"""Lexical search, packing and periodic runs against brute force, and their defined results on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import lexical, packing, periodic, registry

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- lexical search


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    split = lambda t: TERM.findall((t or "").translate(ASCII_LOWER))
    counts = [(i, Counter(split(t))) for i, t in docs]
    n_all, l_all = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(split(t))
    out = []
    for item, words in asked.items():
        got = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n_all // l_all if l_all else 50
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                got.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(got)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_by_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)  # the tasks' kernels keep their own sizes, those called here do not
    monkeypatch.setattr(lexical, "SPAN", 16)
    rng = random.Random(11)
    for _ in range(40):
        n, v = rng.randint(1, 120), rng.choice([3, 12, 60])
        counts = [Counter(min(int(rng.expovariate(4 / v)), v - 1) for _ in range(rng.choice([0, 1, 5, 40, 600]))) for _ in range(n)]
        m = np.array([50 + sum(c.values()) for c in counts])
        doc, term, tf = (np.array(x, np.int64) for x in zip(*[(d, t, f) for d, c in enumerate(counts) for t, f in c.items()])) if any(counts) else [np.zeros(0, np.int64)] * 3
        shard, ids = lexical.Shard(m, doc, term, tf), np.array([rng.randint(0, n) for _ in range(n)])
        absent = np.array([rng.random() < 0.1 for _ in range(n)])
        query, k = [(t, rng.randint(0, 9)) for t in rng.sample(range(v + 3), 3)], rng.choice([1, 3, 200])
        heap = lexical.Heap(k)
        lexical.search_shard(shard, query, heap, absent, ids)
        score = [sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * int(m[d]))) for t, w in query if c[t]) for d, c in enumerate(counts)]
        want = sorted((-s, a, i) for s, a, i in zip(score, absent.tolist(), ids.tolist()) if s > 0)[:k]
        assert [(-s, a, i) for s, a, i in zip(heap.score.tolist(), heap.absent.tolist(), heap.id.tolist())] == want


def test_bounds_spare_blocks():
    n, rng = 20_000, np.random.default_rng(5)
    common, rare = np.arange(n), np.sort(rng.choice(n, 20, replace=False))
    doc, term = np.concatenate((common, rare)), np.repeat([0, 1], (n, len(rare)))
    order = np.argsort(doc, kind="stable")
    shard = lexical.Shard(np.full(n, 100), doc[order], term[order], np.ones(n + 20, np.int64))
    heap = lexical.Heap(2)
    opened = lexical.search_shard(shard, [(0, 5), (1, 9000)], heap, np.zeros(n, bool), np.arange(n))
    assert heap.id.tolist() == rare[:2].tolist() and opened < 0.4 * n


def test_search_odd_rows(spark):
    long = " ".join(f"w{i} common" for i in range(50_000))
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " .,! \n"), (None, "A B C"), (5, "a b c"), (6, long), (7, "É é éA \U0001f600x 12"), (8, "common " * 300), (9, "b" + "\x7f" + "c{d}")]
    items = [(1, "a c zzz"), (2, None), (3, "common w49999"), (4, "É"), (4, "12 ea é"), (None, "b"), (5, "nothing here"), (6, " "), (7, "d")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, term string")
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    want = ranked(rows, items, 4)
    assert found(lexical.search(docs, asked, 4)) == want
    assert found(lexical.search(docs.repartition(5), asked, 4, at_once=2, shard=3)) == want
    none = docs.limit(0), asked.limit(0)
    assert lexical.search(none[0], asked).count() == lexical.search(docs, none[1]).count() == lexical.search(*none).count() == 0


# --- packing


def test_encoder_equals_tokenizers(docs):
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    texts = [r["text"] or "" for r in docs.collect()] + ["", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "it's  We'LL\t\n\n x\u0085y z \U0001f600" * 3, "é" * 5000, " " * 1_000_000]
    assert len(fast(" " * 1_000_000)) > 0 and fast.slow is not None
    for t in texts:
        assert fast(t).tolist() == own.encode(t, add_special_tokens=False).ids


def squares(count, size, window):
    """The level after which the sum of squares is least, the greatest among equals, a new window last."""
    best = None
    for h in range(window - size + 1):
        if h and not count.get(h):
            continue
        c = Counter(count)
        c[h] -= h > 0
        if h + size < window:
            c[h + size] += 1
        s = sum(x * x for x in c.values())
        if best is None or s <= best[0]:
            best = s, h
    return best[1]


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_levels_by_brute_force(window):
    rng = random.Random(window)
    levels = packing.Levels(window, 10**9)
    for _ in range(500):
        size = rng.randint(1, window - 1)
        assert levels.level_for(size) == squares({h: int(levels.count[h]) for h in range(1, window)}, size, window)
        list(levels.put((0, 0, np.zeros(size), size)))
        assert levels.open == levels.count.sum() == sum(map(len, levels.at.values()))
    for most_open in (1, 5, 1000):
        ids = [np.arange(rng.randint(1, 3 * window)) for _ in range(100)]
        seen, held = {}, packing.windows(enumerate(ids), window, most_open)
        for w in held:
            size = sum(len(p[2]) for p in w)
            assert size == window or size < window and size & (size - 1) == 0
            for doc, start, part, total in w:
                assert total == len(ids[doc]) and len(part)
                seen.setdefault(doc, []).append((start, part))
        for doc, whole in enumerate(ids):
            parts = sorted(seen[doc], key=lambda x: x[0])
            assert np.array_equal(np.concatenate([p for _, p in parts]), whole)
            assert [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts[:-1])]).tolist()


def unpacked(rows):
    """Pieces by document, after a look at every sequence."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    return docs


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    pieces = unpacked(registry.queries()["op12_packing"](spark, SF).collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(pieces) == set(texts)
    for doc, rows in pieces.items():
        ids, at = [*own.encode(texts[doc] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_packing_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "no id"), (None, "none"), (2**60 + 1, "<|endoftext|>"), (5, " " * 1_000_000)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start int, tokens string").repartition(3)
    out = packing.pack(docs, VOCABULARY, public_tokenizers.PATTERN, most_open=2).collect()
    pieces = unpacked(out)
    assert {k: sum(r["length"] for r in v) for k, v in pieces.items() if k != 3 and k != 5} == {1: 1, 2: 1, None: 5, 2**60 + 1: 2}
    assert sum(r["length"] for r in pieces[3]) == 2 * pieces[3][0]["doc_tokens"] and sum(r["length"] for r in pieces[5]) == 1_000_001
    assert [bytes(r["tokens"]) for r in pieces[1]] == [b"\x01\0\0\0"]
    assert packing.pack(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


# --- periodic runs


def all_runs(words, least=24, times=3):
    """Runs by a look at every lag."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - p:
            s = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                found.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_by_brute_force():
    rng, got = random.Random(13), 0
    for _ in range(2500):
        n, v = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 30, 200])
        words = [str(rng.randint(1, v)) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            block = [str(rng.randint(1, v)) for _ in range(rng.randint(1, 40))]
            words[(a := rng.randint(0, n)) : a] = (block * 5)[: rng.randint(0, 4 * len(block))]
        least, times = rng.choice([24, 24, 6, 9]), rng.choice([3, 3, 4])
        want = all_runs(words, least, times)
        assert periodic.find_runs(words, least, times) == want
        assert periodic.kept_words(words, want) == [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in want)]
        got += len(want)
    assert got > 1000


def test_segments_hold_no_rare_word_and_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        ids = np.array([rng.randint(0, 25) for _ in range(rng.randint(1, 250))])
        parts = periodic.segments(ids, 6, 3)
        assert all(b - a >= 6 and min(Counter(ids[a:b].tolist()).values()) >= 3 for a, b in parts)
        for start, length, _ in all_runs(ids.tolist(), 6, 3):
            assert any(a <= start and start + length <= b for a, b in parts)


def test_deep_splits_stay_fast():
    # each word that goes makes the next one rare
    words = [str(abs(i)) for i in range(-20_000, 20_000)] + [str(i) for i in range(20_000)]
    assert periodic.find_runs(words) == []
    block = [str(i) for i in range(3_000)]
    assert periodic.find_runs(words + block * 5 + ["end"]) == [(60_000, 15_000, 3_000)]


def test_runs_query(spark, docs):
    got = {r["doc_id"]: r for r in registry.queries()["op13_periodic_runs"](spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows, with_runs = docs.select("doc_id", "text").collect(), 0
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = all_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        out = got[r["doc_id"]]
        assert (out["n_runs"], out["runs_sha256"]) == (len(runs), sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)))
        assert (out["start"], out["length"], out["period"]) == (best or (None,) * 3) and out["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert out["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)))
        with_runs += bool(runs)
    assert with_runs > 5


def test_runs_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x " * 30), (4, "a b c d e f g h " * 20_000), (4, "x " * 30), (5, "x " * 23), (6, "Ü ö " * 24)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"].split(" "))) for r in periodic.runs(docs).collect())
    assert got == [(0, 30, [(0, 30, 1)], 1), (1, 0, [], 1), (2, 0, [], 1), (3, 0, [], 1), (4, 30, [(0, 30, 1)], 1), (4, 160_000, [(0, 160_000, 8)], 8), (5, 23, [], 23), (6, 24, [(0, 24, 1)], 1)]
    assert periodic.runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(docs, times=2)
    assert periodic.runs(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).select("doc_id").dtypes == [("doc_id", "string")]
