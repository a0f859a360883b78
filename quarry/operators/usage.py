"""Usage of language models: prices, costs, estimates and the prompt cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.operators.files import list_files

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
FIELDS = ("input", "output", "cache_read", "cache_write")


def price_table(spark: SparkSession) -> DataFrame:
    """Built-in prices, in $ a token, and input ceilings: a table of a few rows."""
    rows = [(p, m, *(x / 1e6 for x in ps), c) for p, m, *ps, c in C.PRICES]
    return spark.createDataFrame(rows, "provider string, model string, input double, output double, cache_read double, cache_write double, max_input long")


def override_table(spark: SparkSession, text: str) -> DataFrame:
    """Prices of a JSON text {"provider:model": {field: $ per million}}; a missing or empty field is 0, an entry that is no object or has a field that is no number is left out, the last of one name wins."""
    parsed = F.from_json(F.lit(text), "map<string,string>")  # entries of any kind: a wrong one must not spoil the others
    last = spark.range(1).select(F.posexplode(F.map_entries(parsed)).alias("at", "e")).groupBy("e.key").agg(F.max_by("e.value", "at").alias("v"))
    one = last.select(F.col("key").alias("k"), F.from_json("v", "map<string,string>").alias("v")).where("k like '%:%' and v is not null")
    last_of = lambda f: F.try_element_at(F.filter(F.map_entries("v"), lambda e: e["key"] == f)["value"], F.lit(-1))
    field = {f: F.nullif(last_of(f), F.lit("")) for f in FIELDS}
    for raw in field.values():
        one = one.where(raw.isNull() | raw.try_cast("double").isNotNull())
    price = [F.coalesce(raw.try_cast("double"), F.lit(0.0)) / 1e6 for raw in field.values()]
    return one.select(F.substring_index("k", ":", 1).alias("provider"), F.expr("substring(k, instr(k, ':') + 1)").alias("model"), *(p.alias(f) for p, f in zip(price, FIELDS)))


def price_for(usage: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Usage with its price: the override, else the built-in one, else null. Spark sends a price table to all tasks where it is small."""
    key = ["provider", "model"]
    out = usage.join((prices.select(*key, *(F.col(f).alias(f"b_{f}") for f in FIELDS))), key, "left")
    if overrides is None:
        return out.select(*usage.columns, *(F.col(f"b_{f}").alias(f"p_{f}") for f in FIELDS))
    out = out.join((overrides.select(*key, *(F.col(f).alias(f"o_{f}") for f in FIELDS))), key, "left")
    return out.select(*usage.columns, *(F.coalesce(f"o_{f}", f"b_{f}").alias(f"p_{f}") for f in FIELDS))


def usage_cost(priced: DataFrame) -> DataFrame:
    """Cost of each record; null where it has no price."""
    cost = sum((F.col(t) * F.col(f"p_{f}") for t, f in zip(TOKENS, FIELDS)), F.lit(0.0))
    return priced.withColumn("cost", cost)


def session_summary(costed: DataFrame) -> DataFrame:
    """Sums of a run; its cost is unknown if any record has no price."""
    total = F.when(F.count("*") == F.count("cost"), F.sum("cost"))
    return costed.groupBy("run_id").agg(*(F.sum(t).alias(t) for t in TOKENS), F.sum("duration_s").alias("api_seconds"), F.round(total, 9).alias("cost"))


def cost_rollup(costed: DataFrame, *levels: str) -> DataFrame:
    """Tokens and cost by provider, model and day (or other columns), with sub-totals."""
    return costed.rollup(*(levels or ("provider", "model", "day"))).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("records"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def estimate_run(plan: DataFrame, prices: DataFrame, provider: str, model: str, cap: int = 16_384) -> DataFrame:
    """Low and high input tokens, worst-case output, costs and the largest prompt of each repository's plan.

    Only the largest prompt takes the most that a body can be. ``notes`` are
    those of the plan, which say what its figures leave out.
    """
    chars, largest = F.col("shell_chars") + F.col("body_chars"), F.col("shell_chars") + F.coalesce("body_max_chars", "body_chars")
    per = plan.groupBy("repo_id").agg(
        F.floor(F.sum(chars * F.col("calls_low")) / 4).alias("input_low"), F.floor(F.sum(chars * F.col("calls_high")) / 4).alias("input_high"),
        (F.sum("calls_high") * cap).alias("output_high"), F.max(F.floor(largest / 2.5)).alias("largest_prompt"),
        F.array_sort(F.collect_set(F.when(F.col("note") != "", F.concat_ws(": ", "template", "note")))).alias("notes"))  # a prompt's note once
    price = prices.where((F.col("provider") == provider) & (F.col("model") == model)).select(F.lit(provider).alias("provider"), "input", "output", "max_input")
    rows = per.withColumn("provider", F.lit(provider)).join(F.broadcast(price.limit(1)), "provider", "left")  # one row
    return rows.select("repo_id", "input_low", "input_high", "output_high", "largest_prompt", F.round(F.col("input_low") * F.col("input"), 6).alias("cost_low"), F.round(F.col("input_high") * F.col("input") + F.col("output_high") * F.col("output"), 6).alias("cost_high"), (F.col("largest_prompt") > F.col("max_input")).alias("over_ceiling"), "notes")


#: A slot of a template; braces around anything else are text.
SLOT = r"\{([a-z_][a-z0-9_]*)\}"


def shell_chars(text: str | Column, house: Column) -> Column:
    """A template's own characters: its text with the house style in its place, without each of the other slots once."""
    filled = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("{house_style}"), house)
    slots = F.array_distinct(F.regexp_extract_all(filled, F.lit(SLOT), F.lit(1)))
    return F.length(filled) - F.aggregate(slots, F.lit(0), lambda n, s: n + F.length(s) + 2)


def prompt_plan(preview: DataFrame, templates: DataFrame, house: str = "", evidence: str = "") -> DataFrame:
    """A row for each repository and prompt: fixed and filled characters, calls low and high, what the figures leave out.

    ``preview`` has repo_id, analysis, part, body_chars, body_max_chars and
    migrations (their number, null where an analysis has none). ``templates`` has
    analysis, template, text, part (null for a prompt that no repository's text
    fills, such as a shared overview), calls_low, calls_high and note; its fixed
    characters come from the texts. ``house`` is filled in for {house_style},
    with the rules of ``evidence`` after it where a prompt is given sources.
    """
    whole = F.when(F.col("part").isNull(), F.lit(house)).otherwise(F.lit(f"{house}\n\n{evidence}" if evidence else house))
    table = templates.select("analysis", "template", shell_chars("text", whole).alias("shell_chars"), "part", "calls_low", "calls_high", "note")
    given = preview.join(table.where("part is not null"), ["analysis", "part"])
    shared = preview.select("repo_id", "analysis").distinct().join(table.where("part is null"), "analysis").withColumn("body_chars", F.lit(0).cast("long")).withColumn("body_max_chars", F.lit(None).cast("long")).withColumn("migrations", F.lit(None).cast("long"))
    names = ["repo_id", "analysis", "template", "shell_chars", "body_chars", "body_max_chars", "migrations", "calls_low", "calls_high", "note"]
    out = given.select(names).unionByName(shared.select(names))
    few = (F.col("template") == "migration-acts.md") & (F.coalesce("migrations", F.lit(0)) < 4)
    calls = [F.when(few, 0).otherwise(F.col(c)).alias(c) for c in ("calls_low", "calls_high")]
    return out.select("repo_id", "analysis", "template", "shell_chars", "body_chars", "body_max_chars", *calls, "note")


def codebase_size_estimate(files: DataFrame, budget: int = 1_000_000, preview_budget: int = 1_000_000, target: int | None = None, overhead: int = 131, skew: float = 2.0) -> DataFrame:
    """(repo_id, previewed, readable, likely, most): what a selection's bundle will probably have, and the most it can.

    Of the kept files, those whose heads the preview holds; a block is the text,
    the path and what stands around them. A selection takes ``target`` of the
    readable ones, heavier than the mean where it leaves any out; the last one
    may overrun the budget. Repositories without a kept file have no row.
    """
    rows = list_files(files).where(F.col("walk_rank") <= max(1, preview_budget // 800)).select("repo_id", "path")
    rows = rows.join(files.select("repo_id", "path", F.length("content").alias("len")), ["repo_id", "path"])
    block = F.col("len") + F.length("path") + overhead
    per = rows.groupBy("repo_id").agg(F.count("*").alias("previewed"), F.count("len").alias("readable"), F.sum(block).alias("whole"), F.avg(block).alias("mean"), F.max(block).alias("largest"))
    asked = F.lit(target) if target is not None else F.least(F.lit(50), F.greatest(F.lit(20), F.floor(F.col("previewed") / 20)))
    asked = F.least(asked, F.col("readable"))
    factor = F.when(asked < F.col("readable"), F.lit(skew)).otherwise(F.lit(1.0))
    likely = F.least(F.lit(float(budget)), F.col("whole").cast("double"), asked * F.col("mean") * factor)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per.select("repo_id", "previewed", "readable", zero(F.floor(likely)).alias("likely"), zero(F.least("whole", budget + F.col("largest"))).alias("most"))


def cache_key(prompt: str = "prompt"):
    """Key of a call: the digest of provider, model, output cap and the prompt without the breakpoint mark."""
    return F.sha2(F.concat_ws("|", "provider", "model", F.col("max_out").cast("string"), F.replace(F.col(prompt), F.lit("<<<CACHE_BREAKPOINT>>>"), F.lit(""))), 256)


def answered(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """The calls, prompt apart, as the cache leaves them: those whose key has a stored response cost no tokens and are ``cached``.

    ``calls`` has provider, model, max_out, prompt and the token counts. The
    prompt is dropped before the join.
    """
    keyed = calls.withColumn("key", cache_key()).drop("prompt", "cached")
    hit = keyed.join(responses.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
    return hit.select(*(F.when(F.col("hit"), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) if c in TOKENS else c for c in keyed.columns), F.coalesce("hit", F.lit(False)).alias("cached"))


def cache_hits(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """Hit rate of each run, and the input tokens that are left to pay."""
    rows = answered(calls, responses)
    return rows.groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if("cached").alias("hits"), (F.count_if("cached") / F.count("*")).alias("hit_rate"), F.sum("input_tokens").alias("input_tokens"))


def run_manifest(usage: DataFrame, sent: DataFrame) -> DataFrame:
    """One record a run: analysis, repository and time, its distinct live models, the number of cached calls, what it sent.

    ``sent`` has run_id, analysis, repo_id, sent_at, and one row for each file or
    commit (kind, name). Names are a run's own selection, bounded by its budget.
    """
    live = F.sort_array(F.collect_set(F.when(~F.col("cached"), F.concat_ws(":", "provider", "model"))))
    calls = usage.groupBy("run_id").agg(F.array_join(live, ",").alias("models"), F.count_if("cached").alias("cached_calls"), F.count("*").alias("calls"))
    names = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    what = sent.groupBy("run_id").agg(F.min("analysis").alias("analysis"), F.min("repo_id").alias("repo_id"), F.min("sent_at").alias("sent_at"), names("file").alias("files"), names("commit").alias("commits"))
    return calls.join(what, "run_id", "left")
