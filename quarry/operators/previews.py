"""Previews of the seven analyses: what each would send of every repository, before any model call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions.running import numbered
from quarry.functions.shared import materialize
from quarry.operators import arch, budget, classify, history, schemas
from quarry.operators.files import list_files, walk_key


@dataclass
class Preview:
    """One analysis: counts (repo_id and a column for each), its lists (repo_id, label, path), the characters it assembles, notes (repo_id, place, note).

    Lists and characters are None where an analysis has no such thing, which is
    not the same as an empty one. A list is a table with a row for each path: a
    repository's paths are of any number.
    """

    counts: DataFrame
    lists: DataFrame | None = None
    chars: DataFrame | None = None
    notes: DataFrame | None = None


def _states(rows: DataFrame, included: Column) -> DataFrame:
    return rows.select("repo_id", F.when(included, "included").otherwise("dropped").alias("label"), "path")


def _said(rows: DataFrame, when: Column, note: Column, place: int = 0) -> DataFrame:
    return rows.where(when).select("repo_id", F.lit(place).alias("place"), note.alias("note"))


def tour(files: DataFrame, preview_budget: int = 1_000_000, head: int = 800) -> Preview:
    """Kept files in walk order: the heads of the first ones go into the selection, the model never sees the others."""
    most = max(1, preview_budget // head)
    rows = list_files(files).select("repo_id", "path", "walk_rank").join(files.select("repo_id", "path", F.least(F.coalesce(F.length("content"), F.lit(0)), F.lit(head)).alias("shown")), ["repo_id", "path"])
    rows = materialize(rows, "tour")
    first = F.col("walk_rank") <= most
    line = F.length(F.concat(F.lit("  ["), (F.col("walk_rank") - 1).cast("string"), F.lit("] "), "path", F.lit("\n\n"))) + F.col("shown")
    per = rows.groupBy("repo_id").agg(F.count("*").alias("source files found"), F.count_if(first).alias("read into the selection pass"), F.count_if(~first).alias("dropped before the model saw them"), (F.sum(F.when(first, line + 1)) - 1).alias("assembled_chars"))
    number = lambda c: F.format_number(c, 0)
    note = F.concat(number("dropped before the model saw them"), F.lit(" of "), number("source files found"), F.lit(" source files never reach the file-selection prompt: it holds "), number("read into the selection pass"), F.lit(f" at {head:,} chars each. The model cannot pick a file it never saw."))
    return Preview(per.drop("assembled_chars"), _states(rows, first), per.select("repo_id", "assembled_chars"), _said(per, F.col("dropped before the model saw them") > 0, note))


def backend(files: DataFrame, max_chars: int = 650_000) -> Preview:
    """Files matched to layers; those in the bundle, and those that are empty, unreadable, past the budget or past their layer's sample."""
    counts, queue = materialize(classify.layer_counts(files), "layers"), materialize(budget.layer_queue(files), "queue")
    headers = budget.counts_header(counts)
    taken = materialize(budget.budget_fair_share(queue, max_chars, headers=headers), "taken")
    rows = queue.join(taken.select("repo_id", "path", F.lit(True).alias("in")), ["repo_id", "path"], "left")
    cost = F.col("len") + F.length(F.concat(F.lit("\n===== LAYER "), "layer", F.lit(": "), "path", F.lit(" =====\n\n")))
    per = taken.groupBy("repo_id").agg(F.count("*").alias("files in the bundle"), F.sum(cost).alias("chars"))
    chars = per.join(headers, "repo_id").select("repo_id", (F.col("chars") + F.length("header")).alias("assembled_chars"))
    named = counts.select("repo_id", *(F.col(x).alias(f"matched as {x}") for x in C.LAYERS))
    return Preview(named.join(per.drop("chars"), "repo_id", "left"), _states(rows, F.coalesce("in", F.lit(False))), chars)


def architecture(files: DataFrame, max_chars: int = 500_000) -> Preview:
    """Files that the evidence bundle discloses, those of sections past the cut, and what was counted."""
    evidence = arch.gather(files)
    placed = arch.placed_sections(arch.evidence_sections(evidence))
    stats = materialize(arch.arch_stats(files, max_chars, evidence, placed), "stats")
    lists = materialize(arch.evidence_files(evidence, placed, max_chars), "disclosed")
    bundle = arch.evidence_bundle(placed, max_chars)
    inside = lists.where("state = 'included'").groupBy("repo_id").agg(F.count("*").alias("files in the bundle"))
    names = {
        "included": "config files in the bundle", "configs": "config files found", "unreadable": "config files unreadable", "cut": "config files truncated", "env_unreadable": "env files unreadable", "env_cut": "env files truncated",
        "env_vars": "env var names", "deps": "dependencies declared", "integrations": "integration directories", "sdk_lines": "SDK import lines",
    }
    counts = stats.select("repo_id", *(F.col(c).alias(n) for c, n in names.items())).join(inside, "repo_id", "left")
    problems = arch.manifest_problems(files).where("note <> ''")
    order = F.array_position(F.array(*map(F.lit, C.MANIFEST_LABELS)), F.col("kind")).cast("int")
    notes = problems.select("repo_id", order.alias("place"), "note")
    notes = notes.unionByName(_said(stats, F.col("truncated"), F.lit(f"The bundle was truncated at the {max_chars:,}-char budget; the model sees less than the counts above describe."), 10))
    notes = notes.unionByName(_said(stats, F.col("sdk_capped"), F.lit("SDK import evidence was capped; more imports may exist than are counted."), 11))
    return Preview(counts, lists.select("repo_id", F.col("state").alias("label"), "path"), bundle.select("repo_id", F.length("bundle").alias("assembled_chars")), notes)


def interfaces(files: DataFrame, max_chars: int = 900_000) -> Preview:
    """Surface files in their rank, first fit into the budget; blank ones are found but not read."""
    found = materialize(classify.surface_files(files).select("repo_id", "path", F.col("surface_rank").alias("ord")), "surface")
    text = files.select("repo_id", "path", F.length("content").alias("len"), F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)).alias("full"))
    rows = found.join(text, ["repo_id", "path"])
    read = materialize(budget.budget_greedy(rows.where("full").drop("full"), max_chars, budget.ROUTES), "read")
    joined = found.join(read.select("repo_id", "path", F.lit(True).alias("in")), ["repo_id", "path"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    per = joined.groupBy("repo_id").agg(F.count("*").alias("surface files found"), F.count_if("in").alias("surface files read"))
    chars = read.groupBy("repo_id").agg((F.sum(budget.block(budget.ROUTES) + 1) - 1).alias("assembled_chars"))
    out = F.col("surface files found") - F.col("surface files read")
    note = F.concat(out.cast("string"), F.lit(" of "), F.col("surface files found").cast("string"), F.lit(" surface files did not reach the bundle: empty, or past the budget."))
    return Preview(per, _states(joined, F.col("in")), chars, _said(per, out > 0, note))


def schema(files: DataFrame, max_chars: int = schemas.BUDGET, floor: int = 4) -> Preview:
    """The schema's files, the candidates that a schema of several files left out, and the migrations."""
    rows = materialize(schemas.find_schema(files, max_chars), "schema")
    several = F.col("kind").isin("models", "embedded-sql")
    lists = rows.where((F.col("state") == "kept") | several).select("repo_id", F.when(F.col("state") == "kept", "included").otherwise("dropped").alias("label"), "path")
    migrations = schemas.find_migrations(files).select("repo_id", F.col("n").cast("long").alias("migrations found"))
    read = rows.where("state = 'kept'").groupBy("repo_id").agg(F.count("*").alias("schema files read"), F.min("kind").alias("kind"), F.min("path").alias("path"), F.max("cut").alias("cut"))
    counts = read.select("repo_id", "schema files read").join(migrations, "repo_id", "full")
    notes = _said(read, F.col("cut"), F.lit(f"The schema was truncated at the {max_chars:,}-char budget; the model reads less than the whole file."), 0)
    notes = notes.unionByName(_said(migrations, F.col("migrations found") < floor, F.concat(F.col("migrations found").cast("string"), F.lit(f" migrations is below the floor of {floor}; a real run skips the migration pass entirely.")), 3))
    return Preview(counts, lists, read.select("repo_id", F.col("schema files read").alias("assembled_chars")), notes)


def git_history(commits: DataFrame, additions: DataFrame, deletions: DataFrame) -> Preview:
    """Commits and bulk changes; no files are read and no text is assembled."""
    per = history.history_preview(commits, additions, deletions)
    return Preview(per.select("repo_id", "commits", F.col("bulk_additions").alias("bulk additions"), F.col("bulk_deletions").alias("bulk deletions")))


def product_intent(files: DataFrame, max_chars: int = 650_000) -> Preview:
    """Kept files in walk order, first fit into the budget as whole blocks; unreadable ones are counted, not named."""
    listed = list_files(files).select("repo_id", "path", F.col("walk_rank").alias("ord"))
    rows = materialize(listed.join(files.select("repo_id", "path", F.length("content").alias("len")), ["repo_id", "path"]), "kept")
    taken = materialize(budget.budget_greedy(rows, max_chars), "taken")
    joined = rows.join(taken.select("repo_id", "path", F.lit(True).alias("in")), ["repo_id", "path"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    per = joined.groupBy("repo_id").agg(F.count_if("in").alias("files in the bundle"), F.count_if(~F.col("in") & F.col("len").isNotNull()).alias("dropped by the budget"), F.count_if(F.col("len").isNull()).alias("unreadable"))
    chars = taken.groupBy("repo_id").agg((F.sum(budget.block(budget.WHOLE)) - 1).alias("assembled_chars"))
    return Preview(per, _states(joined.where("len is not null"), F.col("in")), chars)


def preview_files(parts: dict[str, Preview]) -> DataFrame:
    """(repo_id, analysis, label, n, path): the lists behind the previews, a row for each path, numbered in walk order."""
    out = None
    for analysis, part in parts.items():
        if part.lists is not None:
            rows = part.lists.select("repo_id", F.lit(analysis).alias("analysis"), "label", "path")
            out = rows if out is None else out.unionByName(rows)
    return numbered(out, ["repo_id", "analysis", "label"], [walk_key("path"), "path"], "n")


def preview_rollup(repos: DataFrame, parts: dict[str, Preview], reasons: dict[str, str] = C.ABORT_REASONS) -> DataFrame:
    """One row for each repository and analysis: counts, included, dropped, assembled_chars, notes.

    included and dropped are the lengths of the lists and null where an analysis
    has none, as are characters; a repository without any has zeros. A crawl with
    nothing to send, no characters or no commits, ends with a note that a real
    run stops there.
    """
    out, all_repos = None, repos.select("repo_id").distinct()
    for analysis, part in parts.items():
        names = [c for c in part.counts.columns if c != "repo_id"]
        counts = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long") for c in names)))
        rows = all_repos.join(part.counts, "repo_id", "left").select("repo_id", counts.alias("counts"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        null = F.lit(None).cast("long")
        if part.lists is None:
            rows = rows.withColumn("included", null).withColumn("dropped", null)
        else:
            per = part.lists.groupBy("repo_id").agg(F.count_if(F.col("label") == "included").alias("included"), F.count_if(F.col("label") == "dropped").alias("dropped"))
            rows = rows.join(per, "repo_id", "left").withColumn("included", zero("included")).withColumn("dropped", zero("dropped"))
        rows = rows.withColumn("assembled_chars", null) if part.chars is None else rows.join(part.chars, "repo_id", "left").withColumn("assembled_chars", zero("assembled_chars"))
        sent = F.col("assembled_chars") if part.chars is not None else F.element_at("counts", "commits")
        stop = F.when(sent == 0, F.lit(C.ABORT_PREFIX + reasons[analysis]))
        rows = rows.withColumn("stop", stop)
        if part.notes is None:
            rows = rows.withColumn("notes", F.array().cast("array<string>"))
        else:
            said = part.notes.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("place", "note"))).alias("ns")).select("repo_id", F.transform("ns", lambda x: x["note"]).alias("notes"))
            rows = rows.join(said, "repo_id", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
        rows = rows.select("repo_id", F.lit(analysis).alias("analysis"), "counts", "included", "dropped", "assembled_chars", F.array_compact(F.concat("notes", F.array("stop"))).alias("notes"))
        out = rows if out is None else out.unionByName(rows)
    return out
