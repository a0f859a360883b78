"""Packing documents into windows by sum-of-squares online packing.

Method: a level array counts the open windows at each fill level. A document goes
to the level, or to a new window, after which the sum of the squared counts is
least. Documents longer than a window fill whole windows first; only their rest
is placed. Full windows leave at once, so a task holds its open windows alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.functions.shared import bounded_batches

#: Each task numbers its windows from its own multiple of this.
TASK = 2**33
OUT = "start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
#: Bytes of tokens after which a batch of pieces is sent on.
SEND = 4 << 20


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabulary files are written: printable Latin-1 stands for itself, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level tokenizer file, special strings of the file included, none added.

    The file's vocabulary runs in tiktoken, which is several times as fast and
    gives the ids of the tokenizers library (a test compares them); texts that
    its pattern engine refuses, such as a million blanks, go to that library.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Levels:
    """Open windows by fill level; gives windows away when they are full.

    A piece is (document, start, ids, document's tokens) of any form whose third
    value can be cut. At most ``most_open`` windows are open: beyond that they
    are merged as at the end, by cutting, and the last one stays open.
    """

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open, self.open = window, most_open, 0
        self.count = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, at which the sum of squared counts grows least; the fullest among equals."""
        top = self.window - size
        grown = 2 * self.count[size:] + 1
        grown[-1] = 0  # a full window is not counted
        grown += 1 - 2 * self.count[: top + 1]
        grown[0] -= 1
        there = np.flatnonzero(self.count[: top + 1])
        if not len(there):
            return 0
        cost = grown[there]
        best = len(there) - 1 - int(np.argmin(cost[::-1]))
        return int(there[best]) if cost[best] <= grown[0] else 0

    def put(self, piece: tuple) -> Iterator[list[tuple]]:
        """Places a piece shorter than a window; yields windows that are done."""
        size = len(piece[2])
        level = self.level_for(size)
        held = self.take(level) if level else []
        held.append(piece)
        if level + size == self.window:
            yield held
        else:
            self.keep(level + size, held)
            if self.open > self.most_open:
                *full, last = self.merged()
                yield from full
                if (size := sum(len(p[2]) for p in last)) == self.window:
                    yield last
                else:
                    self.keep(size, last)

    def keep(self, level: int, held: list[tuple]) -> None:
        self.at.setdefault(level, []).append(held)
        self.count[level] += 1
        self.open += 1

    def take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def merged(self) -> list[list[tuple]]:
        """All open windows, emptied, their pieces cut into full windows; the last may be partly filled."""
        held = [p for level in sorted(self.at, reverse=True) for w in self.at[level] for p in w]
        self.at.clear()
        self.count[:] = 0
        self.open = 0
        return cut(held, [self.window])

    def finish(self) -> Iterator[list[tuple]]:
        """The last windows: those at a power of two as they are, all else merged by cutting and the rest cut at powers of two, so none needs padding."""
        for level in [x for x in self.at if x & (x - 1) == 0]:
            while self.count[level]:
                yield self.take(level)
        merged = self.merged()
        for w in merged:
            size = sum(len(p[2]) for p in w)
            if size == self.window:
                yield w
            elif size:
                yield from cut(w, [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1])


def cut(pieces: list[tuple], sizes: list[int]) -> list[list[tuple]]:
    """The pieces in their order, cut into windows of ``sizes``, the last of which repeats."""
    out: list[list[tuple]] = [[]]
    room = sizes[0]
    for doc, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = sizes[min(len(out), len(sizes) - 1)]
                out.append([])
            part, ids = ids[:room], ids[room:]
            out[-1].append((doc, start, part, total))
            start, room = start + len(part), room - len(part)
    return out


def windows(docs: Iterator[tuple], window: int, most_open: int) -> Iterator[list[tuple]]:
    """Windows of (document, start, ids, document's tokens) from (document, ids)."""
    levels = Levels(window, most_open)
    for doc, ids in docs:
        whole = len(ids) - len(ids) % window
        for at in range(0, whole, window):
            yield [(doc, at, ids[at : at + window], len(ids))]
        if whole < len(ids):
            yield from levels.put((doc, whole, ids[whole:], len(ids)))
    yield from levels.finish()


def pack(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", window: int = 2048, end_id: int = 1, most_open: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; ``tokens`` holds a piece's ids as
    little-endian unsigned 32-bit numbers; ``start`` counts the document's ids
    before it, ``offset`` those before it in its sequence. Null and empty texts
    are the ``end_id`` alone; texts of any length are encoded whole; repeated
    rows and rows without an id are documents like others; an empty table gives
    no pieces; other columns are not read.

    Every partition is packed by its own task without a shuffle and numbers its
    sequences apart. A task holds ``most_open`` windows of tokens at most; what
    is open at its end is merged by cutting, so only sequences at a power of two
    are shorter than ``window``. Rows of one partition must come in the same
    order again for the same result, as they do from stored tables.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, pattern)
        names, out, size, number = [f.name for f in kind.fields], [], 0, TASK * TaskContext.get().partitionId()
        types = None

        def encoded():
            nonlocal types
            for b in batches:
                types = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    yield doc, np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

        for w in windows(encoded(), window, most_open):
            at = 0
            for doc, start, ids, total in w:
                out.append((doc, start, len(ids), ids.tobytes(), total, number, at))
                at += len(ids)
            number += 1
            size += 4 * at
            if size >= SEND:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, kind)
