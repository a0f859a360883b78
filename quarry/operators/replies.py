"""Model replies as tables: replies(repo_id, prompt_id, text)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import constants as C

KEY = ("repo_id", "prompt_id")
FENCE = r"(?s)```(mermaid|yaml|json)[ \t]*\n(.*?)```"


def reply_fences(replies: DataFrame) -> DataFrame:
    """Bodies of the fenced blocks in order, and the length of the text without diagrams."""
    rows = replies.withColumn("rest", F.length(F.regexp_replace("text", r"(?s)```mermaid[ \t]*\n.*?```", "")))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(FENCE), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(FENCE), F.lit(2)).alias("body"))
    rows = rows.select(*KEY, "rest", F.posexplode(pairs).alias("pos", "f"))
    return rows.select(*KEY, "pos", F.col("f.kind").alias("kind"), F.trim(F.regexp_replace("f.body", r"^\s+|\s+$", "")).alias("body"), "rest")


JSON = re.compile(r"```json[ \t]*\n")
YAML = re.compile(r"(?s)```yaml\s*\n(.*?)```")


def _plain(x):
    """The YAML value as JSON has it: names, dates and the like as strings, sets as lists."""
    if isinstance(x, dict):
        return {k if k is None or isinstance(k, (str, int, float)) else str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    return x if x is None or isinstance(x, (str, int, float)) else str(x)


def _values(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    read = json.JSONDecoder()

    def one(text):
        text = text or ""
        mark = JSON.search(text)
        fence = None if mark else YAML.search(text)
        if fence:
            try:
                return json.dumps(_plain(yaml.safe_load(fence[1]))), None
            except (yaml.YAMLError, ValueError, TypeError, AttributeError, KeyError, RecursionError):
                return None, "no decodable value"
        text = text[mark.end() :] if mark else text
        k = min((x for x in (text.find("{"), text.find("[")) if x >= 0), default=-1)
        while k >= 0:
            try:
                return json.dumps(read.raw_decode(text, k)[0]), None
            except (ValueError, RecursionError):
                k = min((x for x in (text.find("{", k + 1), text.find("[", k + 1)) if x >= 0), default=-1)
        return None, "no decodable value"

    for texts in batches:
        yield pd.DataFrame([one(t) for t in texts], columns=["value", "reason"])


def reply_values(replies: DataFrame) -> DataFrame:
    """The first decodable JSON value of each reply, or its YAML fence's value as JSON where no JSON fence stands, or the reason there is none."""
    return replies.select(*KEY, pandas_udf(_values, "value string, reason string")("text").alias("v")).select(*KEY, "v.value", "v.reason")


def _sections(replies: DataFrame, mark: str) -> DataFrame:
    rows = replies.select(*KEY, F.posexplode(F.split("text", rf"(?m)(?=^{mark}[ \t])")).alias("pos", "part")).where(F.col("part").rlike(rf"^{mark}[ \t]"))
    title = F.regexp_replace(F.regexp_extract("part", rf"^{mark}([^\n]*)", 1), r"^\s+|\s+$", "")
    return rows.select(*KEY, "pos", title.alias("title"), F.regexp_replace(F.regexp_extract("part", r"(?s)^[^\n]*\n?(.*)$", 1), r"^\s+|\s+$", "").alias("body"))


def split_cards(replies: DataFrame) -> DataFrame:
    """Title and body of each ### card; what stands before the first is left out."""
    rows = _sections(replies, "###")
    return rows.withColumn("card", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).drop("pos")


def split_sections(replies: DataFrame) -> DataFrame:
    """Body of each ## section by lower-case title, the last one of a title; a reply without any is its own gist."""
    rows = _sections(replies, "##").where("title <> ''").groupBy(*KEY, F.lower("title").alias("section")).agg(F.max_by("body", "pos").alias("body"))
    gist = replies.where(~F.col("text").rlike(r"(?m)^##[ \t]")).select(*KEY, F.lit("gist").alias("section"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("body"))
    return rows.unionByName(gist)


def heading_tree(replies: DataFrame) -> DataFrame:
    """(repo_id, prompt_id, n, level, title, parent_n, parent, body): every heading of a reply, numbered, under the nearest one before it of a lower level.

    body is what stands between a heading and the next of any level.
    """
    head = r"(?m)(?=^#{1,6}[ \t]+\S)"
    rows = replies.select(*KEY, F.posexplode(F.split("text", head)).alias("pos", "part")).where(F.col("part").rlike(r"^#{1,6}[ \t]+\S"))
    line = F.regexp_extract("part", r"^[^\n]*", 0)
    rows = rows.select(*KEY, "pos", F.length(F.regexp_extract(line, "^#+", 0)).alias("level"), F.regexp_replace(line, r"^#+\s+|\s+$", "").alias("title"), F.regexp_replace(F.expr("substring(part, length(regexp_extract(part, '^[^\\n]*', 0)) + 1)"), r"^\s+|\s+$", "").alias("body"))
    w = Window.partitionBy(*KEY).orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.struct("n", "title"))).over(before) for k in range(1, 6)}
    rows = rows.select("*", *(x.alias(f"l{k}") for k, x in last.items()))
    above = F.array_max(F.array_compact(F.array(*(F.when(F.col("level") > k, F.col(f"l{k}")) for k in last))))
    return rows.withColumn("above", above).select(*KEY, "n", "level", "title", F.col("above.n").alias("parent_n"), F.col("above.title").alias("parent"), "body")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def menu_parts(text: str | Column) -> Column:
    """Struct of a menu's opener, its groups from the first ### card on, and its tour, which is what follows the first ## heading that names one."""
    text = F.col(text) if isinstance(text, str) else text
    cut = F.split(text, r"(?imd)^##[ \t]+[^\n]*tour[^\n]*$", 2)
    head = F.get(cut, F.lit(0))
    starts = head.rlike(r"^###\s")
    parts = F.split(head, r"(?md)(?=^###\s)", 2)
    return F.struct(
        F.when(starts, "").otherwise(_trimmed(F.get(parts, F.lit(0)))).alias("opener"), _trimmed(F.when(starts, head).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).alias("groups"), _trimmed(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).alias("tour"))


def first_card(text: str | Column) -> Column:
    """The first ### card with its heading, 2,500 characters at most; without one the first 1,500 of the text."""
    text = F.col(text) if isinstance(text, str) else text
    card = F.regexp_extract(text, r"(?smd)^###(?=\s).*?(?=^###\s|\z)", 0)
    return F.when(card == "", F.substring(text, 1, 1500)).otherwise(F.substring(card, 1, 2500))


def labelled_field(text: str | Column, label: str) -> Column:
    """The first line with any text after **label:**, '' where there is none."""
    return F.regexp_replace(F.regexp_extract(text, rf"\*\*{label}:\*\*\s*([^\n]+)", 1), r"^\s+|\s+$", "")


def feature_group_sizes(cards: DataFrame) -> DataFrame:
    """Name and size of each group card, whose title is a name, an opening bracket and a number; the total and the share of the biggest, 7 at least."""
    rule = r"^(.+?)\s*\(([0-9]+)"
    n = F.regexp_extract("title", rule, 2).try_cast("long")
    rows = cards.select(*KEY, F.regexp_replace(F.regexp_extract("title", rule, 1), r"^\s+|\s+$", "").alias("name"), n.alias("n")).where("n is not null")
    w = Window.partitionBy(*KEY)
    return rows.select(*KEY, "name", "n", F.sum("n").over(w).alias("total"), F.greatest(F.lit(7), F.bround(F.col("n") * 100 / F.greatest(F.max("n").over(w), F.lit(1))).cast("int")).alias("width"))


def profile_shares(shares: DataFrame) -> DataFrame:
    """Numeric shares of contributors and patterns, clamped to 0 to 100; null where they are no numbers."""
    n = F.expr("try_cast(rtrim('% ', pct) as double)")
    rows = shares.withColumn("n", n)
    return rows.select("repo_id", "era_index", "label", F.when(F.col("n").isNull() | F.isnan("n"), None).otherwise(F.least(F.greatest("n", F.lit(0.0)), F.lit(100.0))).alias("share"))


def validate_reply(parsed: DataFrame, selected: DataFrame, dimensions: int | None = None) -> DataFrame:
    """(repo_id, prompt_id, rule) for each rule that a parsed reply (names, chapters, files, month) fails.

    With ``dimensions`` each of the reply's ``cells`` must have one cell for each
    dimension. Named files are looked up one by one, so a repository's paths
    never come together.
    """
    names, chapters = F.col("names"), F.col("chapters")
    rules = {
        "empty": F.coalesce(F.size(names), F.lit(0)) <= 0,
        "not_unique": F.size(F.array_distinct(names)) < F.size(names),
        "names_differ": (F.size(F.array_except(names, chapters)) > 0) | (F.size(F.array_except(chapters, names)) > 0),
        "bad_month": ~F.coalesce("month", F.lit("")).rlike(r"^\d{4}-\d{2}$"),
    }
    if dimensions is not None:
        rules["cells"] = F.coalesce(F.exists("cells", lambda c: F.coalesce(F.size(c), F.lit(0)) != dimensions), F.lit(True))
    failed = F.array_compact(F.array(*(F.when(c, r) for r, c in rules.items())))
    named = parsed.select(*KEY, F.explode("files").alias("path")).distinct()
    unknown = named.join(selected.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").select(*KEY, F.lit("unknown_file").alias("rule")).distinct()
    return parsed.select(*KEY, F.explode(failed).alias("rule")).unionByName(unknown)


def chapter_context(chapters: DataFrame, w: int = 3) -> DataFrame:
    """The bodies of the previous chapters, in order, for each chapter; the first one gets a fixed text."""
    before = Window.partitionBy(*KEY).orderBy("card").rowsBetween(-w, -1)
    bodies = F.collect_list("body").over(before)
    return chapters.select(*KEY, "card", F.when(F.size(bodies) == 0, C.FIRST_CHAPTER).otherwise(F.array_join(bodies, "\n\n---\n\n")).alias("context"))
