"""Mixing sources to target weights along a time-varying curriculum.

Method: each source has a weight schedule over the training run, linear from
``1 - slope`` to ``1 + slope`` of its mean weight. Its integral is the source's
cumulative token demand; inverting that at the tokens which stand before a
document gives the document's training position, and the documents are
range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.running import numbered
from quarry.functions.shared import materialize

#: Copies of a row that one value lists at most.
STEP = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: str | Column = "text") -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, per_bucket: int = 20_000) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows before this one in ``order``.

    ``order[0]`` is a hexadecimal digest, whose first digits deal each key's rows
    into ranges of about ``per_bucket`` rows or fewer: only range totals are
    summed across ranges, so no task holds a whole key. Digests must not repeat
    without bound. ``df`` must be a stored table: it is read twice.
    """
    rows = df.count()
    digits = 2
    while 16**digits * per_bucket < rows:
        digits += 1
    bucket = F.substring(order[0], 1, digits)
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(totals, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_b", "_before", "_inside")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3, tilt: float = 0.5) -> DataFrame:
    """(key, turn, source_size, target, slope) of each source of ``sizes`` (key, size); turn numbers them from 0.

    Sources take the weights in turn, by code point and null last, and share the
    words of all; a target stops at ``most`` times its source's words and the
    excess goes to the others by weight. Each round is one small aggregate over
    the sources; rounds end when no further source is above.

    The schedules of even turns rise by ``slope`` and the others fall, by ``tilt``
    on the side of fewer words and by less on the other, so that the demands of
    all sources at x sum to x times the total.
    """
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    dealt = materialize(sources.repartitionByRange("key").withColumn("_p", F.spark_partition_id()), "sources")
    before = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one count a partition
    starts, at = {}, 0
    for p in sorted(before):
        starts[p], at = at, at + before[p]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_p")) if starts else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("key")) - 1 + start
    turn = F.array(*map(F.lit, weights))
    dealt = materialize(dealt.select("key", rank.cast("long").alias("turn"), "source_size", F.element_at(turn, (rank % len(weights) + 1).cast("int")).alias("weight")), "weights")
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, None, -1
    while True:
        above = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        got = dealt.agg(F.sum(F.when(above, cap).otherwise(0)).alias("c"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w"), F.count_if(above).alias("n")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (total - got["c"]) / got["w"]
    share = cap.cast("double") if level is None else F.when(cap <= F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    rows = dealt.select("key", "turn", "source_size", share.alias("target"))
    even = F.col("turn") % 2 == 0
    sides = rows.agg(F.sum(F.when(even, F.col("target"))).alias("e"), F.sum(F.when(~even, F.col("target"))).alias("o")).first()
    e, o = sides["e"] or 0.0, sides["o"] or 0.0
    up, down = (tilt * min(1.0, o / e) if e else 0.0), (tilt * min(1.0, e / o) if o else 0.0)
    return rows.withColumn("slope", F.when(even, F.lit(up)).otherwise(F.lit(-down)))


def _key(source: str | Column) -> Column:
    """Sorts as the source's code points, null last (UTF-8 keeps the order of code points)."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def identity(doc_id: str, text: str | Column) -> Column:
    """A digest of a row's id and text, by which the rows of a source are put in order."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def plan(rows: DataFrame, weights=(1, 2, 3), most: int = 3, tilt: float = 0.5) -> DataFrame:
    """(id, size, key, digest, n, nth, source_size, target, taken, copies, start, position) for rows of (id, size, key, digest).

    A source's words are taken in the order of the digest, round after round until
    the target is met. ``taken`` counts the words up to there, ``copies`` whole
    documents: one stands in the last, partial round when its middle is before
    the round's end. ``position``
    (0 to 1) is where its first copy comes in training; the schedules of every
    other source rise and the others fall, so the mix changes over time while
    totals stay. The ``n`` rows that are alike in all four columns are one node
    until their places are known, so no copies of any number meet in a task;
    ``nth`` counts them from 0.
    """
    nodes = materialize(rows.groupBy("id", "size", "key", "digest").agg(F.count("*").alias("n")), "sizes")
    words = F.col("size") * F.col("n")
    targets = materialize(source_targets(nodes.select("key", words.alias("size")), weights, most, tilt), "targets")
    nodes = running_total(nodes, ["key"], ["digest", "id", "size"], words, "start").join(targets, "key", "left")
    # copies come out of their node again in steps, as no value may hold all of them
    steps = nodes.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STEP).cast("long"))))
    rows = steps.withColumn("nth", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + STEP, F.col("n")) - 1))).drop("step").withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - whole * F.col("source_size")
    part = (F.col("size") > 0) & (2 * F.col("start") + F.col("size") < 2 * rest)
    last = F.least(F.greatest(F.floor(rest) - F.col("start"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("taken", (F.col("size") * whole + last).cast("long"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, whole + part.cast("long")).otherwise(0))
    return rows.withColumn("position", position(F.col("start"), F.col("target"), F.col("slope")))


def position(tokens: Column, target: Column, slope: Column) -> Column:
    """Training position at which the source's cumulative demand reaches ``tokens``.

    Demand at x is target * (x + slope (x^2 - x)), the integral of the schedule
    1 + slope (2x - 1).
    """
    y = F.least(F.coalesce(tokens / F.when(target > 0, target), F.lit(0.0)), F.lit(1.0))
    b = 1 - slope
    return F.round(2 * y / (b + F.sqrt(b * b + 4 * slope * y)), 9)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(1, 2, 3), most: int = 3, tilt: float = 0.5) -> DataFrame:
    """One row per input row in training order: doc_id, size, source_size, target, taken, position.

    Null texts have size 0 and are never taken; null sources are one source, the
    last; texts of any length count whole; rows alike in doc_id and text are
    told apart by nothing, so which of them is taken does not show; rows without
    an id are ordered by their texts; an empty table gives none. Only the three
    columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), text_size(text).alias("size"), _key(source).alias("key"), identity(doc_id, F.col(text)).alias("digest"))
    out = plan(rows, weights, most, tilt)
    out = out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")
    return materialize(out, "mix").orderBy("position", "doc_id")


def apply(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(1, 2, 3), most: int = 3, tilt: float = 0.5) -> DataFrame:
    """The mixed documents: each row as often as it is taken, in training order, with the input's columns.

    Null texts are of size 0 and never taken; null sources are one source; texts
    of any length count whole; an empty table gives none; extra columns stay.
    The plan is joined on id, size, source and the digest of id and text; rows
    that repeat these are numbered, in ranges if they are many, and the k-th
    gets the copies of the k-th.
    """
    alike = ["id", "size", "key", "digest"]
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), text_size(text).alias("size"), _key(source).alias("key"), identity(doc_id, F.col(text)).alias("digest"))
    planned = materialize(plan(rows.select(*alike), weights, most, tilt).where("copies > 0").select(*alike, "n", "nth", "copies", "start", "target", "slope", "source_size"), "plan")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    cols = ["row", "copies", "start", "target", "slope", "source_size"]
    out = rows.alias("r").join(planned.where("n = 1").alias("p"), same("r", "p")).select("r.row", *(f"p.{c}" for c in cols[1:]))
    repeated = planned.where("n > 1")
    if repeated.take(1):
        again = rows.alias("r").join(repeated.select(*alike).distinct().alias("p"), same("r", "p"), "left_semi").select("r.*")
        again = numbered(again, alike, [F.xxhash64("row")], "k")
        out = out.unionByName(again.alias("r").join(repeated.alias("p"), same("r", "p") & (F.col("r.k") == F.col("p.nth") + 1)).select("r.row", *(f"p.{c}" for c in cols[1:])))
    copy = out.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    at = position(F.col("start") + F.col("copy") * F.col("source_size"), F.col("target"), F.col("slope"))
    placed = materialize(copy.select("row", at.alias("_at"), "copy"), "placed")
    return placed.orderBy("_at", f"row.{doc_id}", "copy").select("row.*")
