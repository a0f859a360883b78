"""Licence scan with a positional rare-token index, in built-in expressions only.

Method: the licence templates' words form a fixed vocabulary whose document
frequencies are counted over the whole corpus. Each template has lookups of its
own, its words of the highest inverse document frequency, some of its mandatory
phrases always among them; a file looks up those of every template whose
mandatory words it has, in the postings; places of the template (word position
in the file minus position in the template) that several lookups agree on are
candidates; a candidate stands when all mandatory phrases of the template are at
their places. As mandatory words are always looked up, no template that stands
is left out, whatever else is in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are counted, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Template text and label; [..] marks a mandatory phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("gpl-3.0", "this work is licensed under the [gnu general public license version 3]"),
    ("gpl-2.0", "under the terms of the [gnu general public license] as published by the free software foundation either [version 2] of the license"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the [mit license]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("all-rights-reserved", "copyright [all rights reserved]"),
)
#: Too common in prose to be looked up.
STOP = ("the", "of", "and", "to", "a", "in", "or", "is", "this", "that", "with", "by", "as", "for", "any", "are", "use", "under", "on", "an", "at", "be", "from", "was")


def parse(templates=TEMPLATES) -> list[tuple[str, list[str], list[tuple[int, list[str]]]]]:
    """(label, words, mandatory phrases with their start) of each template."""
    out = []
    for label, text in templates:
        words, phrases = [], []
        for k, part in enumerate(text.replace("]", "[").split("[")):
            got = part.split()
            if k % 2:
                phrases.append((len(words), got))
            words += got
        out.append((label, words, phrases))
    return out


def words_of(text: str | Column = "text") -> Column:
    """Words of the whole text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def idf_order(words: DataFrame, templates=TEMPLATES) -> list[str]:
    """The vocabulary from the rarest word of the corpus to the most common.

    ``words`` has ws. One count a vocabulary word reaches the driver; the
    vocabulary is fixed, whatever the corpus.
    """
    vocabulary = sorted({w for _, ws, _ in parse(templates) for w in ws if w not in STOP})
    hits = words.select(F.explode(F.array_intersect("ws", _strings(vocabulary))).alias("w"))
    found = {r["w"]: r["df"] for r in hits.groupBy("w").agg(F.count("*").alias("df")).collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def template_lookups(rank: list[str], parsed, lookups: int, agree: int) -> tuple[list[tuple[list[str], list[str]]], int]:
    """(mandatory words, words looked up) of each template, and how many must agree at a place.

    The ``agree`` rarest mandatory words are always looked up, however few the lookups.
    """
    out, need = [], agree
    for _, ws, phrases in parsed:
        inside = [w for _, p in phrases for w in p]
        must = [w for w in rank if w in inside]
        sure = must[:agree]
        need = min(need, sum(w in sure for w in inside))
        out.append((must, sure + [w for w in rank if w in ws and w not in sure][: max(lookups - len(sure), 0)]))
    return out, need


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts (from 0) of the phrase's words standing consecutively."""
    last = len(phrase) - 1
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == phrase[0])

    def then(k):
        return lambda i: F.coalesce(F.get(words, i + k), F.lit("")) == phrase[k]

    for k in range(1, last + 1):
        starts = F.filter(starts, then(k))
    return starts


def _of_template(t: int):
    """Of votes and places as one long, those of template t."""
    return lambda v: F.shiftright(v, 40) == t


def _stands(phrases):
    """Whether all mandatory phrases are where a template that starts at o has them."""

    def ok(o):
        out = o + phrases[0][0] >= 0
        for p, words in phrases:
            out = out & (F.slice("ws", F.greatest(o + p + 1, F.lit(1)), len(words)) == _strings(words))
        return out

    return ok


def _share(words):
    """Share of a template's words that stand where a template that starts at o has them."""
    return lambda o: F.size(F.filter(F.transform(_strings(words), lambda w, j: F.coalesce(F.get("ws", o + j) == w, F.lit(False))), lambda x: x)) / F.lit(len(words))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, lookups: int = 8, agree: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A template is a candidate at a place that ``agree`` of its own ``lookups``
    rarest words point to. score is the share of a found
    template's words that stand at its place (the best of them), at least 0.5
    where a phrase stands, else 0. Null and empty texts have no words and no
    labels; texts of any length are scanned whole; repeated rows each get a row;
    an empty table gives none; other columns are not read.
    """
    parsed = parse(templates)
    base = docs.select(F.col(doc_id).alias("doc_id"), words_of(text).alias("ws"))
    rank = idf_order(base.select("ws"), templates)
    of_template, agree = template_lookups(rank, parsed, lookups, agree)
    postings = {w: [(t, p) for t, (_, ws, _) in enumerate(parsed) if w in of_template[t][1] for p, x in enumerate(ws) if x == w] for w in rank}
    postings = {w: ps for w, ps in postings.items() if ps}
    rows = base.select("doc_id", "ws", F.size("ws").cast("long").alias("n_words"), F.array_intersect(_strings(rank), "ws").alias("present"))
    # 'rare' is empty for most rows: everything behind it then costs nothing
    own = [F.when(F.size(F.array_intersect("present", _strings(must))) == len(must), _strings(found)).otherwise(_strings([]).cast("array<string>")) for must, found in of_template]
    rows = rows.withColumn("rare", F.array_intersect("present", F.flatten(F.array(*own)))).drop("present")
    some = F.size("rare") > 0
    empty_hits = F.array().cast("array<struct<w:string,i:int>>")
    hits = F.when(some, F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains("rare", h["w"]))).otherwise(empty_hits)
    rows = rows.withColumn("hits", hits)
    # (template, place) as one long: the place may be negative, hence the shift
    index = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*(F.lit((t << 40) + (1 << 32) - p) for t, p in ps)))]) if postings else None
    votes = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h["w"]), lambda v: v + h["i"]))))
    rows = rows.withColumn("votes", votes)
    n = F.size("votes")
    same = lambda i, x: F.get("votes", i) == x
    agreed = F.filter("votes", lambda x, i: (i >= agree - 1) & F.coalesce(same(i - (agree - 1), x), F.lit(False)) & ((i + 1 >= n) | ~F.coalesce(same(i + 1, x), F.lit(False))))
    rows = rows.withColumn("agreed", agreed)
    found, best = [], []
    for t, (label, ws, phrases) in enumerate(parsed):
        places = F.transform(F.filter("agreed", _of_template(t)), lambda v: (v.bitwiseAND(F.lit((1 << 40) - 1)) - F.lit(1 << 32)).cast("int"))
        places = F.filter(places, _stands(phrases))
        rows = rows.withColumn(f"t{t}", F.when(F.size("agreed") > 0, F.transform(places, _share(ws))))
        found.append(F.when(F.size(f"t{t}") > 0, label))
        best.append(F.array_max(f"t{t}"))
    any_word = {p.split()[0] for p, _ in PHRASES}
    for k, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"p{k}", F.when(F.arrays_overlap(F.array_intersect("ws", _strings(sorted(any_word))), _strings(sorted(any_word))), _places(F.col("ws"), phrase.split())))
    starts = [F.coalesce(f"p{k}", F.array().cast("array<int>")) for k in range(len(PHRASES))]
    every = F.concat(*starts)
    labels = F.array_compact(F.array(*(F.when(F.size(s) > 0, label) for s, (_, label) in zip(starts, PHRASES))))
    rows = rows.withColumn("every", every).withColumn("base", labels)
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.lit(0.0), F.when(F.size("every") > 0, 0.5), *best)
    return rows.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"), join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.array_compact(F.array(*found)))).alias("labels"), score.alias("score"),
    )
