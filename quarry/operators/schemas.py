"""Schema documents, the tables they declare, migrations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import constants as C
from quarry.operators.classify import go_strings
from quarry.operators.files import basename, is_test_file, under_skip_dir, walk_key, within_size

BUDGET = 600_000


def _ddl(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    rule = re.compile(C.DDL_STATEMENT)
    for texts in batches:
        yield texts.map(lambda t: [s for s in go_strings(t or "") if rule.search(s)], na_action=None)


def embedded_ddl(files: DataFrame) -> DataFrame:
    """Go files with string literals that begin with a schema statement, by the tables they create."""
    hint = F.upper("content").rlike("CREATE TABLE|ALTER TABLE|CREATE INDEX|CREATE UNIQUE INDEX")
    rows = files.where(F.col("path").endswith(".go") & hint).select("repo_id", "path", pandas_udf(_ddl, "array<string>")("content").alias("ddl")).where("size(ddl) > 0")
    rows = rows.withColumn("tables", F.regexp_count(F.array_join("ddl", "\n"), F.lit(r"(?i)\bCREATE\s+TABLE\b")))
    return rows.withColumn("ddl_rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("tables"), "path")))


def schema_kind(path="path"):
    base = basename(path)
    p = F.concat(F.lit("/"), F.col(path))
    return F.when(base == "schema.prisma", 0).when(p.endswith("/db/schema.rb"), 1).when(base == "schema.sql", 2).when(base == "models.py", 3)


KINDS = ("prisma", "rails", "sql", "models")


def _embedded_schema(files: DataFrame, budget: int, max_files: int) -> DataFrame:
    """Go files by the tables that their string literals create; as many whole blocks of statements as the budget holds, the first one always."""
    rows = embedded_ddl(files.where(~under_skip_dir("path") & ~is_test_file("path") & within_size()))
    text = F.array_join(F.transform("ddl", lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "\n")
    block = F.length(F.concat(F.lit("-- ===== "), "path", F.lit(" =====\n"), text))
    w = Window.partitionBy("repo_id").orderBy("ddl_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(block).over(w))
    kept = (F.col("ddl_rank") == 1) | ((F.col("upto") <= budget) & (F.col("ddl_rank") <= max_files))
    return rows.select("repo_id", F.lit("embedded-sql").alias("kind"), "path", F.when(kept, "kept").otherwise("dropped").alias("state"), F.lit(False).alias("cut"))


def find_schema(files: DataFrame, budget: int = BUDGET, max_files: int = 40, embedded: bool = True, overrides: DataFrame | None = None) -> DataFrame:
    """The files of the first kind that a repository has: the largest one, Rails' first in walk order, or models by size within the budget; Go files with SQL in strings where there is no other kind.

    A repository of ``overrides`` (repo_id, path) has the file that is named
    there and no other, of any name; one that is not there is named all the same.
    """
    if overrides is not None:
        own = overrides.select("repo_id", "path").join(files.select("repo_id", "path", F.length("content").alias("len")), ["repo_id", "path"], "left")
        forced = own.select("repo_id", F.lit("override").alias("kind"), "path", F.lit("kept").alias("state"), F.coalesce(F.col("len") > budget, F.lit(False)).alias("cut"))
        return find_schema(files.join(overrides.select("repo_id").distinct(), "repo_id", "left_anti"), budget, max_files, embedded).unionByName(forced)
    rows = files.where(~under_skip_dir("path")).select("repo_id", "path", "size", F.length("content").cast("long").alias("len"), schema_kind().alias("k")).where("k is not null")
    rows = rows.withColumn("first_kind", F.min("k").over(Window.partitionBy("repo_id"))).where("k = first_kind")
    w = Window.partitionBy("repo_id").orderBy(F.when(F.col("k") == 1, F.lit(0)).otherwise(-F.col("size")), F.when(F.col("k") == 1, walk_key("path")), "path")
    # a block is a heading and the file, which is cut at the budget with a mark
    mark = len(f"\n\n{C.TRUNCATION_MARK} at {budget:,} chars =====\n")
    block = F.length(F.concat(F.lit("# ===== "), "path", F.lit(" =====\n"))) + F.when(F.col("len") > budget, budget + mark).otherwise(F.coalesce("len", F.lit(0)))
    rows = rows.withColumn("r", F.row_number().over(w)).withColumn("upto", F.sum(block).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = (F.col("r") == 1) | ((F.col("k") == 3) & (F.col("upto") <= budget) & (F.col("r") <= max_files))
    names = F.array(*map(F.lit, KINDS))
    found = rows.select("repo_id", F.get(names, F.col("k")).alias("kind"), "path", F.when(kept, "kept").otherwise("dropped").alias("state"), (F.col("len") > budget).alias("cut"))
    if not embedded:
        return found
    has = files.where(~under_skip_dir("path") & schema_kind().isNotNull()).select("repo_id").distinct()
    return found.unionByName(_embedded_schema(files.join(has, "repo_id", "left_anti"), budget, max_files))


def schema_tables(docs: DataFrame) -> DataFrame:
    """Distinct lower-case names of the tables and models that the texts declare."""
    found = [F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)) for p in C.TABLE_PATTERNS]
    return docs.select("repo_id", F.explode(F.concat(*found)).alias("name")).select("repo_id", F.lower("name").alias("name")).distinct()


def reply_tables(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, prompt_id, name, pos): known tables that a reply names, in order of first appearance.

    Ends of the relationship lines of its first erDiagram, else every name in
    backticks of its ### headings; a name keeps the reply's own spelling.
    """
    erd = F.regexp_extract("text", r"(?s)```mermaid[ \t]*\n(\s*erDiagram\b.*?)```", 1)
    both = [F.regexp_extract_all(erd, F.lit(C.ERD_LINE), F.lit(k)) for k in (1, 2)]
    ends = F.flatten(F.zip_with(*both, lambda x, y: F.array(x, y)))
    heads = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^###.*$"), F.lit(0)), lambda x: F.regexp_extract_all(x, F.lit(r"`(\w+)`"), F.lit(1))))
    key = ["repo_id", "prompt_id"]
    names = known.select("repo_id", F.lower("name").alias("low")).distinct()

    def only_known(array):
        rows = replies.select(*key, F.posexplode(array).alias("at", "name")).withColumn("low", F.lower("name"))
        per = rows.join(names, ["repo_id", "low"], "left_semi").groupBy(*key, "low").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
        return per.select(*key, "name", F.row_number().over(Window.partitionBy(*key).orderBy("at")).alias("pos"))

    first = only_known(ends)
    return first.unionByName(only_known(heads).join(first.select(*key).distinct(), key, "left_anti"))


def find_migrations(files: DataFrame, floor: int = 4) -> DataFrame:
    """Migrations of the migrations directory that holds most, of equal ones the first in walk order, with a flag where they are few.

    An entry of the directory, file or directory, is a migration; two entries may have one name.
    """
    found = F.col("path")
    d = F.regexp_extract(found, r"^((?:.*/)?(?:migrations|migrate))/([^/]+)", 1)
    child = F.regexp_extract(found, r"^(?:.*/)?(?:migrations|migrate)/([^/]+)", 1)
    name = F.regexp_replace(F.regexp_replace(child, r"\.[^.]*$", ""), r"\.up$", "")
    rows = files.where(~under_skip_dir("path")).select("repo_id", d.alias("dir"), child.alias("child"), name.alias("name")).where(F.col("child").rlike(r"^\d{4,}[_-]") & ~F.col("name").endswith(".down")).distinct()
    entries = F.sort_array(F.collect_list(F.struct("child", "name")))
    per = rows.groupBy("repo_id", "dir").agg(F.count("*").alias("n"), F.transform(entries, lambda e: e["name"]).alias("names"))
    walk = F.transform(F.split("dir", "/"), lambda x: x)  # a directory comes before its sub-directories, each level sorted
    best = per.groupBy("repo_id").agg(F.min_by(F.struct("dir", "n", "names"), F.struct((-F.col("n")).alias("n"), walk.alias("walk"))).alias("b"))
    return best.select("repo_id", "b.dir", "b.n", F.array_join("b.names", ",").alias("names"), (F.col("b.n") < floor).alias("too_few"))


def table_batches(tables: DataFrame, size: int = 4) -> DataFrame:
    """Consecutive batches of the tables in order."""
    rows = tables.withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("name")) - 1)
    per = rows.groupBy("repo_id", F.floor(F.col("r") / size).alias("batch")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return per.select("repo_id", "batch", F.array_join("names", ",").alias("names"))
