"""Character budgets and bundles. Budgets see order and lengths only; text is joined back for chosen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions.running import numbered, running
from quarry.functions.shared import materialize
from quarry.operators.classify import backend_kept, backend_layer
from quarry.operators.files import basename, is_credential_named, under_skip_dir, walk_key, with_real_paths
from quarry.operators.imports import normalize

#: Characters that a bundle puts around a file's path and text: of a selection, of a whole repository with the line end that joins blocks, of routes.
SELECTED, WHOLE, ROUTES = 129, 131, 130


def block(chrome: int) -> Column:
    """Characters of a file as a block of a bundle."""
    return F.col("len") + F.length("path") + chrome


def walked(files: DataFrame) -> DataFrame:
    """(repo_id, path, len, ord) in walk order; unreadable files have a null length."""
    return numbered(files.select("repo_id", "path", F.length("content").cast("long").alias("len")), ["repo_id"], [walk_key("path")], "ord")


def preview_manifest(files: DataFrame, budget: int = 1_000_000, head: int = 800) -> DataFrame:
    """Counts, selection target and text of the files whose first characters fit the budget."""
    n = max(1, budget // head)
    rows = walked(files)
    total = rows.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("ord") <= n).alias("previewed"))
    chosen = rows.where(F.col("ord") <= n).join(files.select("repo_id", "path", F.coalesce(F.substring("content", 1, head), F.lit("")).alias("head")), ["repo_id", "path"])
    line = F.concat(F.lit("  ["), F.col("ord") - 1, F.lit("] "), "path", F.lit("\n"), "head", F.lit("\n"))
    text = chosen.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("ls")).select("repo_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    target = F.least(F.lit(50), F.greatest(F.lit(20), F.floor(F.col("previewed") / 20)))
    return total.join(text, "repo_id").select("repo_id", "previewed", (F.col("n") - F.col("previewed")).alias("dropped"), target.alias("target"), F.length("text").alias("text_chars"), F.md5("text").alias("text_md5"))


def budget_prefix(rows: DataFrame, budget: int, chrome: int = SELECTED) -> DataFrame:
    """Rows while the blocks before them are under the budget, so the last may overrun; unreadable ones don't count."""
    rows = running(rows.where("len is not null"), ["repo_id"], ["ord"], before=block(chrome)).drop("before_all")
    return rows.where(F.col("before") < budget)


def budget_prefix_min1(rows: DataFrame, budget: int, max_files: int = 40, chrome: int = 14 + len("--")) -> DataFrame:
    """Rows while their blocks are within the budget, the first one always, at most ``max_files``; a block's heading starts with a comment mark."""
    rows = running(rows.where("len is not null"), ["repo_id"], ["ord"], r=F.lit(1), before=block(chrome))
    return rows.where(((F.col("before") + block(chrome) <= budget) | (F.col("r") == 0)) & (F.col("r") < max_files)).drop("r", "r_all", "before", "before_all")


def first_fit(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows that first fit takes: each in turn that what is left of its repository's budget holds.

    ``rows`` has repo_id, cost, left (the repository's budget), cls and room (how
    many rows of a class may be taken, null for any number); those of a full
    class are passed over. In each round all rows up to the first that does not
    fit are taken at once, by a running sum, and every later row that is longer
    than what is then left goes: what is left only shrinks, so it could never be
    taken. The rounds end when no row is left; no task holds a repository.
    """
    names, free = rows.columns, (F.col("cost") <= F.col("left")) & (F.col("room").isNull() | (F.col("room") > 0))
    todo = rows.where(free)
    most, out = todo.count(), todo.limit(0)
    while most:
        nth = running(todo, ["repo_id", "cls"], order, at_most=most, nth=F.lit(1))
        due = F.col("room").isNull() | (F.col("nth") < F.col("room"))
        sums = running(nth.withColumn("due", due), ["repo_id"], order, at_most=most, before=F.when(due, F.col("cost")).otherwise(0))
        past = F.col("before") + F.when(F.col("due"), F.col("cost")).otherwise(0) > F.col("left")
        judged = materialize(sums.select(*names, "due", past.alias("past")), "fit")
        got = judged.where("due and not past").select(*names)
        out = out.unionByName(got)
        spent = got.groupBy("repo_id").agg(F.sum("cost").alias("spent"))
        full = got.groupBy("repo_id", "cls").agg(F.count("*").alias("had"))
        rest = judged.where("past").join(spent, "repo_id", "left").join(full, ["repo_id", "cls"], "left")
        rest = rest.withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0))).withColumn("room", F.col("room") - F.coalesce("had", F.lit(0))).select(*names)
        todo = rest.where(free)
        if todo.isEmpty():
            break
    return out


def budget_greedy(rows: DataFrame, budget: int, chrome: int = WHOLE) -> DataFrame:
    """First fit in order: a block that does not fit is skipped and later ones may still fit."""
    one = rows.where("len is not null").select("repo_id", "path", "len", "ord", block(chrome).alias("cost"), F.lit(budget).cast("long").alias("left"), F.lit(0).alias("cls"), F.lit(None).cast("long").alias("room"))
    return first_fit(one, ["ord"]).select("repo_id", "path", "len", "ord")


def layer_queue(files: DataFrame) -> DataFrame:
    """Backend files that the walk keeps, with their length and place in their layer's queue."""
    base = F.lower(basename("path"))
    sampled = F.col("layer").isin(*C.SAMPLED_LAYERS)
    hint = base.rlike("|".join(C.CORE_HINTS))
    first = F.when(sampled, F.when(hint, 0).otherwise(1)).otherwise(F.when(F.col("path").endswith("main.go"), 1).otherwise(0))
    rows = with_real_paths(files).where(backend_kept()).select("repo_id", "path", backend_layer("path").alias("layer"), F.length("content").cast("long").alias("len"), (~F.coalesce("content", F.lit("")).rlike(r"\S")).alias("blank")).where("layer is not null")
    return numbered(rows, ["repo_id", "layer"], [first, "path"], "ord")


def counts_header(counts: DataFrame) -> DataFrame:
    """(repo_id, header): the text with which a backend bundle starts, from the layer counts."""
    lines = [F.concat(F.lit(f"{x}: "), F.col(x).cast("string"), F.lit(" files\n")) for x in C.LAYERS]
    return counts.select("repo_id", F.concat(F.lit("===== LAYER FILE COUNTS (whole repo) =====\n"), *lines).alias("header"))


def budget_fair_share(queue: DataFrame, budget: int = 650_000, sample: int = 18, headers: DataFrame | None = None) -> DataFrame:
    """Each layer gets an even share of what is left; then the set-aside files take turns.

    A queue row costs its length and its heading, and the text of ``headers``
    comes first. Blank and unreadable rows cost nothing and are not taken, but
    their layer counts in the sharing; a row that no budget can hold still uses
    up its turn. A layer is first fit within its share, and so are the turns: the
    k-th row that any layer has set aside comes before the k+1-th of all.
    """
    heading = F.length(F.concat(F.lit("\n===== LAYER "), F.upper("layer"), F.lit(": "), "path", F.lit(" =====\n\n")))
    turn = (F.array_position(F.array(*map(F.lit, C.BUNDLE_ORDER)), F.col("layer")) - 1).cast("int")
    names = ["repo_id", "layer", "path", "len", "ord", "turn", "cost"]
    queue = materialize(queue.withColumn("turn", turn).withColumn("cost", F.col("len") + heading), "queue")
    rows = queue.where("len is not null and not blank").select(*names)
    left = queue.groupBy("repo_id").agg(F.sort_array(F.collect_set("turn")).alias("turns"))  # six layers at most
    if headers is None:
        left = left.withColumn("left", F.lit(budget).cast("long"))
    else:
        left = left.join(headers.select("repo_id", F.length("header").alias("h")), "repo_id", "left").select("repo_id", "turns", (F.lit(budget).cast("long") - F.coalesce("h", F.lit(0))).alias("left"))
    taken, left = None, materialize(left, "left")
    for t, layer in enumerate(C.BUNDLE_ORDER):
        share = F.floor(F.col("left") / (F.size("turns") - F.array_position("turns", F.lit(t)) + 1))
        room = F.lit(sample if layer in C.SAMPLED_LAYERS else None).cast("long")
        own = rows.where(F.col("turn") == t).join(left.where(F.array_contains("turns", t)).select("repo_id", share.alias("left")), "repo_id")
        got = first_fit(own.withColumn("cls", F.lit(t)).withColumn("room", room), ["ord"]).select(*names)
        taken = got if taken is None else taken.unionByName(got)
        spent = got.groupBy("repo_id").agg(F.sum("cost").alias("spent"))
        left = materialize(left.join(spent, "repo_id", "left").select("repo_id", "turns", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")), "left")
    had = taken.groupBy("repo_id", "turn").agg(F.count("*").alias("had"))
    sampled = F.col("layer").isin(*C.SAMPLED_LAYERS)
    aside = rows.join(taken.select("repo_id", "path"), ["repo_id", "path"], "left_anti").join(had, ["repo_id", "turn"], "left")
    # a layer whose sample is full takes no more, now or later
    aside = aside.where(~sampled | (F.coalesce("had", F.lit(0)) < sample))
    aside = aside.withColumn("room", F.when(sampled, sample - F.coalesce("had", F.lit(0))).cast("long")).drop("had").join(left.select("repo_id", "left"), "repo_id")
    later = first_fit(numbered(aside, ["repo_id", "turn"], ["ord"], "round").withColumn("cls", F.col("turn")), ["round", "turn"])
    return taken.unionByName(later.select(*names)).select("repo_id", "layer", "path", "len", "ord")


def budget_slice(sections: DataFrame, max_chars: int) -> DataFrame:
    """Sections that start before the cut of their concatenation, and whether the cut truncates."""
    rows = running(sections, ["repo_id"], ["ord"], start=F.col("len") + 1)
    rows = rows.withColumn("truncated", F.col("start_all") - 1 > max_chars)
    return rows.where(F.col("start") < max_chars).select("repo_id", "path", "start", F.least("len", max_chars - F.col("start")).alias("kept_chars"), "truncated")


def whole_lines(kept: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of each kept section that lie inside of the cut to their end: (repo_id, path, line, text)."""
    rows = kept.select("repo_id", "path", "kept_chars").join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    rows = rows.select("repo_id", "path", F.length("content").alias("len"), F.col("kept_chars").cast("int").alias("kept"), F.split(F.substr("content", F.lit(1), F.col("kept_chars").cast("int")), "\n").alias("ls"))
    # the last line is whole where nothing is cut
    whole = F.when(F.col("kept") < F.col("len"), F.slice("ls", 1, F.size("ls") - 1)).otherwise(F.col("ls"))
    return rows.select("repo_id", "path", F.posexplode(whole).alias("pos", "text")).select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")


def bundle_text(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """The chosen files' texts under their headings, in order, as one text."""
    rows = chosen.select("repo_id", "path", "ord").join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    bar = F.lit("=" * 60)
    block = F.concat(bar, F.lit("\nFile: "), "path", F.lit("\n"), bar, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    per = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("t")))).alias("ts"))
    return per.select("repo_id", F.size("ts").alias("n_files"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("bundle"))


def included_dropped(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    return candidates.join(kept.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def resolve_named_paths(named: DataFrame, files: DataFrame, max_files: int = 8, max_chars: int = 120_000, cut: int = 40_000) -> DataFrame:
    """(repo_id, ord, name, path, chars, skipped): the files that a reply's names mean, in the order named.

    A name, without blanks and backticks around it and slashes before it, is an
    exact path, else the first file of the walk, outside of the skipped
    directories, that ends with it after a slash. A name is skipped if it leaves
    the repository, means a credential, no file or a blank one, comes after
    ``max_files`` names, found or not, or after a block of heading and ``cut``
    characters has overrun ``max_chars``.

    Files and names meet by repository and last segment, and then by the
    reversed path, of which the reversed name must be a beginning: each file
    stands once in the join, whatever its depth.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    name = F.regexp_replace(F.regexp_replace(strip(F.col("name")), "^`+|`+$", ""), "^/+", "")
    asked = numbered(named.select("repo_id", "ord", name.alias("name")), ["repo_id"], ["ord"], "n")
    back = lambda p: F.concat(F.array_join(F.reverse(F.split(p, "/")), "/"), F.lit("/"))
    first = asked.where(F.col("n") <= max_files).select("repo_id", "n", "name", F.coalesce(normalize(F.col("name")), F.lit("")).alias("exact"))
    first = first.select("*", basename("name").alias("last"), back("name").alias("back")).where("last <> ''")
    rows = files.select("repo_id", "path", basename("path").alias("last"), F.length("content").alias("len"), F.coalesce("content", F.lit("")).rlike(r"\S").alias("full"), under_skip_dir("path", C.INTERFACES_SKIP_DIRS).alias("aside"))
    exact, fits = F.col("path") == F.col("exact"), back("path").startswith(F.col("back")) & ~F.col("aside")
    met = first.join(rows, ["repo_id", "last"]).where(exact | fits)
    hit = met.groupBy("repo_id", "n").agg(F.min_by(F.struct("path", "len", "full"), F.struct((~exact).alias("d"), walk_key("path").alias("k"))).alias("f"))
    hit = hit.where(F.col("f.full") & ~is_credential_named("f.path"))
    chars = F.least(F.col("f.len"), F.lit(cut)).cast("long")
    read = running(hit.select("repo_id", "n", "f.path", chars.alias("chars")), ["repo_id"], ["n"], before=F.length("path") + F.col("chars") + ROUTES)
    read = read.where(F.col("before") + F.length("path") + F.col("chars") + ROUTES <= max_chars).select("repo_id", "n", "path", "chars")
    return asked.join(read, ["repo_id", "n"], "left").select("repo_id", "ord", "name", "path", "chars", F.col("path").isNull().alias("skipped"))


def largest_file(files: DataFrame) -> DataFrame:
    """The largest file of each repository, among API handlers where there are any."""
    pref = F.concat(F.lit("/"), "path").contains("/pages/api/").cast("int")
    return files.groupBy("repo_id").agg(F.max_by(F.struct("path", "size"), F.struct(pref.alias("p"), "size", "path")).alias("f")).select("repo_id", "f.path", "f.size")
