"""Commit history: commits(repo_id, hash, ts, author, subject, month, n_parents) and commit_changes(repo_id, hash, path, status, old_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions.running import running
from quarry.operators.files import is_credential_named

FOREVER = "9999-99"


def explode_changes(commits: DataFrame) -> DataFrame:
    return commits.select("repo_id", "hash", F.explode("files").alias("path"))


def directory(path, depth: int = 2) -> Column:
    """The first ``depth`` directories of a path, '' for root files."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")


def _directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def scope_between(lo: Column, hi: Column, depth: int = 2) -> Column:
    """The common beginning of two lists of directories, cut to ``depth``: of the least and the greatest it is that of all."""
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    return F.array_join(F.slice(lo, 1, F.least(n, F.lit(depth))), "/")


def scope_of(files: Column, depth: int = 2) -> Column:
    """Longest common directory of the paths, cut to ``depth`` segments."""
    dirs = F.transform(files, _directories)
    return scope_between(F.array_min(dirs), F.array_max(dirs), depth)


def commit_scopes(changes: DataFrame, depth: int = 2) -> DataFrame:
    """(repo_id, hash, scope, n_files) of each commit, from the least and the greatest directory alone."""
    dirs = _directories(F.col("path"))
    per = changes.groupBy("repo_id", "hash").agg(F.min(dirs).alias("lo"), F.max(dirs).alias("hi"), F.count("*").alias("n_files"))
    return per.select("repo_id", "hash", scope_between(F.col("lo"), F.col("hi"), depth).alias("scope"), "n_files")


def dir_month_counts(changes: DataFrame, commits: DataFrame, depth: int = 2) -> DataFrame:
    """Commits of each directory and month; a commit counts once in a directory, root files do not.

    Changes are dealt by commit once: finding a commit's distinct directories
    and its month then need no further exchange.
    """
    dirs = changes.select("repo_id", "hash", directory("path", depth).alias("dir")).where("dir <> ''").repartition("repo_id", "hash").dropDuplicates(["repo_id", "hash", "dir"])
    return dirs.join(commits.select("repo_id", "hash", "month"), ["repo_id", "hash"]).groupBy("repo_id", "dir", "month").agg(F.count("*").alias("n"))


def top_dirs(counts: DataFrame, k: int = 25) -> DataFrame:
    totals = counts.groupBy("repo_id", "dir").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("total"), "dir"))
    return totals.withColumn("dir_rank", rank).where(F.col("dir_rank") <= k)


def dir_activity(counts: DataFrame, commits: DataFrame, k: int = 25) -> DataFrame:
    """What both summaries say of the top directories: one aggregate, and a window over its few columns.

    A directory is silent if the repository has any later commit, in a counted directory or not.
    """
    agg = counts.groupBy("repo_id", "dir").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.max_by("month", F.struct("n", "month")).alias("peak_month"),
        F.max("n").alias("peak_n"), F.sum("n").alias("total"),
    )
    rows = agg.withColumn("dir_rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("total"), "dir"))).where(F.col("dir_rank") <= k)
    rows = rows.join(commits.groupBy("repo_id").agg(F.max("month").alias("repo_last")), "repo_id")
    return rows.select("*", F.col("first_month").alias("born"), F.col("last_month").alias("last_active"), (F.col("last_month") < F.col("repo_last")).alias("silent")).drop("repo_last")


def heatmap_summary(counts: DataFrame, commits: DataFrame, k: int = 25) -> DataFrame:
    """First, last and peak month of each top directory; of equal peaks the newest."""
    return dir_activity(counts, commits, k).drop("born", "last_active", "silent")


def pivots_summary(counts: DataFrame, commits: DataFrame, k: int = 25) -> DataFrame:
    """When each top directory began and was last active, and whether it has gone silent."""
    return dir_activity(counts, commits, k).select("repo_id", "dir", "born", "last_active", "silent")


def unrenamed(changes: DataFrame) -> DataFrame:
    """Changes with renames off: a rename is its old path deleted and its new path added; ``pure`` marks both halves."""
    plain = changes.where("status in ('A', 'D')").select("repo_id", "hash", "path", "status", F.lit(False).alias("pure"))
    halves = changes.where("status = 'R'").select("repo_id", "hash", F.inline(F.array(
        F.struct(F.col("old_path").alias("path"), F.lit("D").alias("status"), F.lit(True).alias("pure")), F.struct("path", F.lit("A").alias("status"), F.lit(True).alias("pure")))))
    return plain.unionByName(halves)


def bulk_changes(changes: DataFrame, commits: DataFrame, status: str, min_files: int) -> DataFrame:
    """Commits that add (A) or delete (D) many paths; merges are left out. ``renames_only`` marks pure moves, ``n_noise`` counts paths with a segment in the skip set.

    A commit's paths are counted, not gathered: they can be of any number. ``bulk_files`` has them.
    """
    dirs = _directories(F.col("path"))
    noisy = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, C.SKIP_DIRS)))
    per = unrenamed(changes).where(F.col("status") == status).groupBy("repo_id", "hash").agg(
        F.min(dirs).alias("lo"), F.max(dirs).alias("hi"), F.count("*").alias("n_files"), F.count_if(noisy).alias("n_noise"), F.every("pure").alias("renames_only"))
    per = per.where(F.col("n_files") >= min_files)
    return per.join(commits.where("n_parents < 2"), ["repo_id", "hash"]).select("repo_id", "hash", "ts", "month", "author", "subject", "n_files", "n_noise", "renames_only", scope_between(F.col("lo"), F.col("hi")).alias("scope"))


def bulk_files(changes: DataFrame, bulk: DataFrame, status: str) -> DataFrame:
    """(repo_id, hash, path): the paths of the bulk changes, a row for each."""
    rows = unrenamed(changes).where(F.col("status") == status).select("repo_id", "hash", "path")
    return rows.join(bulk.select("repo_id", "hash"), ["repo_id", "hash"], "left_semi")


def top_changes(bulk: DataFrame, k: int = 20) -> DataFrame:
    """The biggest changes; of equal ones the newest first."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n_files"), F.desc("ts"), "hash"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")).cast("string")  # in UTC, whatever the session's zone
    line = F.concat_ws("  ", "hash", day, F.concat("n_files", F.lit(" files")), F.concat(F.col("scope"), F.lit("/")), "subject")
    return bulk.withColumn("change_rank", rank).where(F.col("change_rank") <= k).select("repo_id", "hash", "n_files", "change_rank", line.alias("line"))


def exclude_pure_renames(bulk: DataFrame) -> DataFrame:
    return bulk.where("not renames_only")


def is_noise_deletion() -> Column:
    """Whether more than half of a bulk change's files have a segment in the skip set, the base name included."""
    return F.col("n_noise") > F.col("n_files") * 0.5


def pick_graves(bulk: DataFrame, min_files: int = 8, k: int = 6) -> DataFrame:
    """Large deletions that are neither noise nor moves, one of each scope, the biggest k."""
    rows = bulk.where((F.col("n_files") >= min_files) & ~F.col("renames_only") & ~is_noise_deletion())
    order = [F.desc("n_files"), F.desc("ts"), F.col("hash")]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "scope").orderBy(*order))).where("r = 1")
    rows = rows.withColumn("grave_rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where(F.col("grave_rank") <= k)
    return rows.select("repo_id", "hash", "scope", "n_files", "month", "grave_rank")


#: Rows of an era table that are sent to every task; a larger one is joined by repository.
ERAS = 100_000


def measured(df: DataFrame, most: int = ERAS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _in_era(commits: DataFrame, eras: DataFrame, how: str) -> DataFrame:
    c, e = commits.alias("c"), measured(eras.select("repo_id", "era_index", "name", "start_month", "end_month")).alias("e")
    on = (F.col("c.repo_id") == F.col("e.repo_id")) & (F.col("c.month") >= F.col("e.start_month")) & (F.col("c.month") <= F.coalesce("e.end_month", F.lit(FOREVER)))
    return c.join(e, on, how).select("c.*", "e.era_index", "e.name")


def era_commits(commits: DataFrame, eras: DataFrame) -> DataFrame:
    """A row for each commit and era whose months hold it; eras may overlap."""
    return _in_era(commits, eras, "inner")


def era_for(commits: DataFrame, eras: DataFrame) -> DataFrame:
    """The first era in list order that holds each commit's month; null in a gap."""
    return _in_era(commits, eras, "left").groupBy("repo_id", "hash", "month").agg(F.min("era_index").alias("era_index"), F.min_by("name", "era_index").alias("era"))


def sample_commits(commits: DataFrame, max_n: int = 400, key: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """An even stride of the commits of a repository (or another key), oldest first, that keeps the first and the last."""
    rows = running(commits.select(*key, "hash", "ts"), [*key], ["ts", "hash"], i=F.lit(1)).withColumnRenamed("i_all", "n")
    step = F.col("n") / F.lit(float(max_n))
    k = F.ceil(F.col("i") / step)
    hit = (F.floor(k * step) == F.col("i")) | (F.floor((k - 1) * step) == F.col("i")) | (F.floor((k + 1) * step) == F.col("i"))
    keep = (F.col("n") <= max_n) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | hit
    return rows.where(keep).select(*key, "hash", F.col("i").alias("seq"), (F.col("n") > max_n).alias("sampled"))


def landmarks(era_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Five commits of each era: opening, closing, and of each third the biggest of its busiest month; ties go to the earliest."""
    key = ["repo_id", "era_index"]
    rows = era_rows.join(sizes, ["repo_id", "hash"], "left").select(*key, "hash", "ts", "month", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    rows = running(rows, key, ["ts", "hash"], r=F.lit(1)).withColumnRenamed("r_all", "n")
    t, t2 = F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3)
    ends = rows.groupBy(*key).agg(F.min_by("hash", "r").alias("opening"), F.max_by("hash", "r").alias("closing")).select(*key, F.inline(F.array(
        F.struct(F.lit("opening").alias("slot"), F.col("opening").alias("hash")), F.struct(F.lit("closing").alias("slot"), F.col("closing").alias("hash")))))
    r = F.col("r")
    third = F.array_compact(F.array(F.when(r < F.greatest(t, F.lit(1)), "early"), F.when(((r >= t) & (r < t2)) | (t == t2), "mid"), F.when(r >= t2, "late")))
    rows = rows.withColumn("slot", F.explode(third))
    months = rows.groupBy(*key, "slot", "month").agg(F.count("*").alias("m"), F.min("r").alias("seen"), F.max_by("hash", F.struct("n_files", -F.col("r"))).alias("hash"))
    best = months.groupBy(*key, "slot").agg(F.max_by("hash", F.struct("m", -F.col("seen"))).alias("hash"))
    return ends.unionByName(best)


def commit_stream(era_rows: DataFrame, scopes: DataFrame, max_n: int = 400) -> DataFrame:
    """One text line for each sampled commit, joined in order within its era: at most ``max_n`` and the last one."""
    key = ("repo_id", "era_index")
    picked = sample_commits(era_rows, max_n, key).select(*key, "hash", "seq")
    rows = era_rows.join(picked, [*key, "hash"]).join(scopes, ["repo_id", "hash"], "left")
    line = F.concat_ws(" | ", "month", "author", F.concat(F.coalesce("scope", F.lit("")), F.lit("/")), "subject")
    per = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("ls"))
    return per.select(*key, F.size("ls").alias("n_lines"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("stream"))


def era_volume(commits: DataFrame, eras: DataFrame) -> DataFrame:
    """Commits of each era, eras without any too, and the share of all."""
    per = era_commits(commits, eras).groupBy("repo_id", "era_index").agg(F.count("*").alias("c"))
    rows = eras.join(per, ["repo_id", "era_index"], "left").select("repo_id", "era_index", "name", F.coalesce("c", F.lit(0)).alias("commits"))
    total = F.sum("commits").over(Window.partitionBy("repo_id"))
    return rows.select("*", F.greatest("commits", F.lit(1)).alias("width"), (F.col("commits") / F.greatest(total, F.lit(1))).alias("share"))


def era_cast(commits: DataFrame, eras: DataFrame, k: int = 5) -> DataFrame:
    """Each era's busiest authors and their share of its commits."""
    per = era_commits(commits, eras).groupBy("repo_id", "era_index", "author").agg(F.count("*").alias("commits"))
    w = Window.partitionBy("repo_id", "era_index")
    rows = per.withColumn("pct", F.floor(F.col("commits") * 100 / F.sum("commits").over(w))).withColumn("cast_rank", F.row_number().over(w.orderBy(F.desc("commits"), "author")))
    return rows.where(F.col("cast_rank") <= k)


def history_preview(commits: DataFrame, additions: DataFrame, deletions: DataFrame) -> DataFrame:
    base = commits.groupBy("repo_id").agg(F.count("*").alias("commits"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    for name, bulk in (("bulk_additions", additions), ("bulk_deletions", deletions)):
        base = base.join(bulk.groupBy("repo_id").agg(F.count("*").alias(name)), "repo_id", "left")
    return base.na.fill(0, ["bulk_additions", "bulk_deletions"])


def sent_commits(listed: DataFrame, used: DataFrame) -> DataFrame:
    """The distinct hashes that were listed, and those whose diff was used; both are samples of bounded size."""
    rows = listed.select("repo_id", "hash", F.lit("listed").alias("kind")).unionByName(used.select("repo_id", "hash", F.lit("diff").alias("kind")))
    return rows.groupBy("repo_id", "kind").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


HEADER = r"(?m)(?=^diff --(?:git|cc|combined) )"


def _plain(token: Column) -> Column:
    """A path of a header without the quotes around it and one prefix of each side."""
    return F.regexp_replace(F.regexp_replace(token, r'^"+|"+$', ""), "^(a/)?(b/)?", "")


def split_diff(diffs: DataFrame) -> DataFrame:
    """One row for each file of a diff, with all the paths that its header may name.

    Both sides where the header has the prefixes a/ and b/, the one path of a
    combined header, and each word: prefixes may be others or none, and names
    may hold blanks.
    """
    rows = diffs.select("repo_id", "hash", F.posexplode(F.split("diff", HEADER)).alias("pos", "hunk"))
    rows = rows.withColumn("head", F.regexp_extract("hunk", r"^diff --(?:git|cc|combined) ([^\n]*)", 1))
    side = lambda k: F.regexp_extract("head", r"^(.*) b/(.*)$", k)
    whole = F.when(~F.col("hunk").startswith("diff --git "), F.array("head")).when(F.col("head").contains(" b/"), F.array(side(1), side(2))).otherwise(F.array().cast("array<string>"))
    paths = F.transform(F.concat(whole, F.split("head", r"\s+")), _plain)
    return rows.select("repo_id", "hash", "pos", "hunk", F.array_distinct(F.filter(paths, lambda p: p != "")).alias("paths"))


def redact_diff(diffs: DataFrame, max_chars: int) -> DataFrame:
    """Diffs without the body of any file with a credential name, then cut to ``max_chars``."""
    rows = split_diff(diffs)
    secret = F.exists("paths", lambda p: is_credential_named(p))
    head = F.concat(F.regexp_extract("hunk", r"^[^\n]*", 0), F.lit("\n[contents omitted: credential-bearing file]\n"))
    rows = rows.select("repo_id", "hash", "pos", F.when(secret, head).otherwise(F.col("hunk")).alias("part"))
    whole = rows.groupBy("repo_id", "hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("diff"))
    cut = F.when(F.length("diff") > max_chars, F.concat(F.substring("diff", 1, max_chars), F.lit("\n... [diff truncated]"))).otherwise(F.col("diff"))
    return whole.select("repo_id", "hash", cut.alias("diff"))
