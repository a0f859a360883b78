"""File predicates and the walk: repo_files(repo_id, path, size, link_target, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions.running import numbered
from quarry.functions.shared import materialize


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def ends_any(c: Column, suffixes) -> Column:
    return any_of(c.endswith(s) for s in suffixes)


def is_credential_named(path) -> Column:
    """By the base name in lower case: dotenv files but their templates, fixed names and suffixes."""
    base = F.lower(basename(path))
    return F.when(base.startswith(".env"), ~base.isin(*C.DOTENV_TEMPLATES)).otherwise(base.isin(*C.CREDENTIAL_NAMES) | ends_any(base, C.CREDENTIAL_SUFFIXES))


def is_wanted(path, keep_ext=C.KEEP_EXT, keep_names=C.KEEP_NAMES) -> Column:
    """Not credential-named, and of a kept name or last extension (a leading dot starts none)."""
    base = basename(path)
    ext = F.regexp_extract(F.lower(base), r"^\.*[^.].*?(\.[^.]*)$", 1)
    return ~is_credential_named(path) & (base.isin(*keep_names) | ext.isin(*keep_ext))


def under_skip_dir(path, skip=C.SKIP_DIRS) -> Column:
    """Whether a directory of the path is in the skip set; the base name is not asked."""
    parts = F.split(_col(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skip)))


def within_size(size="size", cap: int = C.MAX_FILE_BYTES) -> Column:
    return F.lit(True) if not cap else _col(size) <= cap


def is_test_file(path) -> Column:
    base = F.lower(basename(path))
    go = base.endswith(".go") & any_of(base.startswith(p) for p in C.GO_TEST_PREFIXES)
    return any_of(base.contains(m) for m in C.TEST_MARKERS) | base.endswith("_spec.rb") | go


def directory_of(path) -> Column:
    """The directories of a path, '' for root files."""
    return F.regexp_replace(_col(path), "/?[^/]*$", "")


#: A path that goes through more links than this cannot be opened; so says the kernel, and with it the walk.
MOST_LINKS = 40


def _steps(base: Column, rest: Column) -> Column:
    """Where ``base`` and the first 1, 2, ... segments of ``rest`` lead, without links; null from where they leave the root."""

    def step(done: Column, part: Column) -> Column:
        at = F.coalesce(F.element_at(done, -1), F.array(F.lit("..")))
        gone = F.array_contains(at, "..")
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1)).otherwise(F.array(F.lit("..")))
        return F.concat(done, F.array(F.when(gone | part.isin("", "."), at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))))

    start = F.array(F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, "/")))
    places = F.slice(F.aggregate(rest, start, step), 2, F.greatest(F.size(rest), F.lit(1)))
    return F.transform(places, lambda at: F.when(~F.array_contains(at, ".."), F.array_join(at, "/")))


def real_paths(files: DataFrame) -> DataFrame:
    """(repo_id, path, real_path) of the links: the file that each leads to.

    A target is read from the link's own directory, segment by segment, through
    links to files and to directories, each hop a join with the table of links.
    Null where it is absolute or leaves the repository, runs in a circle, takes
    more hops than a system follows, or leads to no file of the table. ``files``
    has links to directories as rows too; null and empty targets are no links.
    """
    links = materialize(files.where("link_target <> ''").select("repo_id", "path", "link_target"), "links")
    hop = links.select("repo_id", F.col("path").alias("at"), "link_target")
    todo = links.select("repo_id", "path", directory_of("path").alias("base"), F.split("link_target", "/").alias("rest"), F.array().cast("array<string>").alias("seen"))
    todo, found, names = todo.where("link_target not like '/%'"), None, ["repo_id", "path", "base", "rest", "seen"]
    for _ in range(MOST_LINKS):
        places = todo.select(*names, F.posexplode(_steps(F.col("base"), F.col("rest"))).alias("k", "at"))
        # the first place that is a link decides; without one the last place is the answer
        met = F.min(F.when(F.col("link_target").isNotNull(), F.struct("k", "at", "link_target")))
        per = places.join(hop, ["repo_id", "at"], "left").groupBy("repo_id", "path").agg(met.alias("m"), F.max(F.struct("k", "at")).alias("last"), F.first("rest").alias("rest"), F.first("seen").alias("seen"))
        per = materialize(per, "hops")
        done = per.where("m is null").select("repo_id", "path", F.col("last.at").alias("real_path"))
        found = done if found is None else found.unionByName(done)
        left = F.slice(F.col("rest"), F.col("m.k") + 2, F.size("rest"))
        state = F.concat(F.col("m.at"), F.lit("\n"), F.array_join(left, "/"))
        on = per.where("m is not null and m.link_target not like '/%'").where(~F.array_contains("seen", state))
        todo = on.select("repo_id", "path", directory_of(F.col("m.at")).alias("base"), F.concat(F.split("m.link_target", "/"), left).alias("rest"), F.concat("seen", F.array(state)).alias("seen"))
        if todo.isEmpty():
            break
    there = files.where("link_target is null or link_target = ''").select("repo_id", F.col("path").alias("real_path")).distinct()
    hit = found.where("real_path is not null").join(there, ["repo_id", "real_path"], "left_semi")
    return links.select("repo_id", "path").join(hit, ["repo_id", "path"], "left").select("repo_id", "path", "real_path")


def with_real_paths(files: DataFrame) -> DataFrame:
    """Files with ``real_path``: their own path, for a link that of the file it leads to, or null. Only links are joined."""
    if "link_target" not in files.columns:
        return files.withColumn("link_target", F.lit(None).cast("string")).withColumn("real_path", F.col("path"))
    linked = F.coalesce(F.col("link_target") != "", F.lit(False))
    if files.where(linked).isEmpty():
        return files.withColumn("real_path", F.when(~linked, F.col("path")))
    links = files.where(linked).join(real_paths(files), ["repo_id", "path"], "left").select(*files.columns, "real_path")
    return files.where(~linked).withColumn("real_path", F.col("path")).unionByName(links)


def link_contained(real_path="real_path", link_target="link_target", keep_ext=C.KEEP_EXT, keep_names=C.KEEP_NAMES) -> Column:
    """A link is refused if it leads to no file of the repository or to one of an unwanted name; null is no link."""
    t = _col(link_target)
    return t.isNull() | (t == "") | F.coalesce(is_wanted(real_path, keep_ext, keep_names), F.lit(False))


def follow_links(files: DataFrame) -> DataFrame:
    """Files with links that are not refused as files: size and content are those of the file a link leads to. Refused links go."""
    rows = with_real_paths(files)
    links = rows.where("link_target <> ''").where(link_contained()).alias("l")
    there = files.where("link_target is null or link_target = ''").alias("t")
    on = (F.col("l.repo_id") == F.col("t.repo_id")) & (F.col("l.real_path") == F.col("t.path"))
    own = ("size", "content")
    taken = links.join(there, on).select(*(F.col(f"t.{c}" if c in own else f"l.{c}") for c in files.columns))
    return files.where("link_target is null or link_target = ''").unionByName(taken)


#: What a gitignore pattern means by each part; a class and a quoted character are read on their own.
GLOB = re.compile(r"\\(.)|\[(!|\^)?(\]?[^\]]*)\]|\*\*/|\*+|\?|[^\\\[*?]+|.", re.S)


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(Java regex of a whole path, for directories only, negated) of one line of a gitignore list; null for blank lines and comments."""
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[negated:]
    only_dirs = body.endswith("/")
    body = body.rstrip("/") if only_dirs else body
    rooted = "/" in body
    body = body.lstrip("/")
    if not body:
        return None
    out, at = "", 0
    while at < len(body):
        m = GLOB.match(body, at)
        part, start, end = m[0], at == 0 or body[at - 1] == "/", m.end() == len(body)
        if m[1]:
            out += re.escape(m[1])
        elif part.startswith("[") and part.endswith("]") and len(part) > 2:
            members = re.sub(r"[\[\]&^\\]", r"\\\g<0>", re.sub(r"\\(.)", r"\1", m[3]))
            out += f"[^/{members}]" if m[2] else f"(?!/)[{members}]"
        elif part == "**/" and start:
            out += "(?:.*/)?"
        elif part == "**" and start and end:
            out += ".+"
        elif part.startswith("*"):
            out += "[^/]*" + "/" * part.endswith("/")
        else:
            out += "[^/]" if part == "?" else re.escape(part)
        at = m.end()
    return ("^" if rooted else "^(?:.*/)?") + out + "$", only_dirs, negated


def matches_list(path, patterns) -> Column:
    """Whether a gitignore list names the path: the last pattern that fits decides, for each directory from the top and then for the file.

    What lies below a directory that is named is named, whatever later patterns
    say of it; ! takes back what earlier patterns said of the same path.
    """
    rules = [r for r in map(ignore_rule, patterns) if r]
    if not rules:
        return F.lit(False)
    parts = F.split(_col(path), "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("p"), (n < F.size(parts)).alias("d")))

    def named(place: Column) -> Column:
        out = F.lit(False)
        for regex, only_dirs, negated in rules:
            fits = place["p"].rlike(regex)
            out = F.when(fits & place["d"] if only_dirs else fits, F.lit(not negated)).otherwise(out)
        return out

    return F.exists(places, named)


def path_match(path, include=(), exclude=()) -> Column:
    """Named by ``include``, if that has any pattern, and not by ``exclude``: two gitignore lists."""
    some = any(map(ignore_rule, include))
    return (matches_list(path, include) if some else F.lit(True)) & ~matches_list(path, exclude)


def walk_key(path) -> Column:
    """Orders as a walk does: a directory's files before its sub-directories, each sorted."""
    parts = F.split(_col(path), "/")
    return F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).alias("d"), x.alias("x")))


def kept(include=(), exclude=(), cap: int = C.MAX_FILE_BYTES, keep_ext=C.KEEP_EXT, keep_names=C.KEEP_NAMES, skip=C.SKIP_DIRS) -> Column:
    """The walk's filters over files with ``real_path``."""
    return is_wanted("path", keep_ext, keep_names) & ~under_skip_dir("path", skip) & within_size("size", cap) & link_contained(keep_ext=keep_ext, keep_names=keep_names) & path_match("path", include, exclude)


def list_files(files: DataFrame, include=(), exclude=(), cap: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Kept files with their place in the walk, on the narrow columns only."""
    rows = with_real_paths(files).where(kept(include, exclude, cap)).select("repo_id", "path", "size")
    return numbered(rows, ["repo_id"], [walk_key("path")], "walk_rank")


def count_files(files: DataFrame) -> DataFrame:
    """Found, kept, dropped and unreadable files of each repository."""
    k = kept()
    return with_real_paths(files).groupBy("repo_id").agg(F.count("*").alias("found"), F.count_if(k).alias("kept"), F.count_if(~k).alias("dropped"), F.count_if(k & F.col("content").isNull()).alias("unreadable"))
