"""Architecture evidence: environment names, dependencies, SDK imports and redacted configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import constants as C
from quarry.functions.running import running
from quarry.functions.shared import materialize
from quarry.operators.classify import arch_source_kind, integration_dirs
from quarry.operators.files import is_credential_named, under_skip_dir, walk_key, with_real_paths
from quarry.operators.imports import go_module

READ_LIMIT, ENV_LIMIT = 200_000, 40_000


def of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    return files.where(arch_source_kind("path").isin(*kinds) & ~under_skip_dir("path", C.ARCH_SKIP_DIRS))


def env_names(files: DataFrame) -> DataFrame:
    """Names of the variables that environment files set, never their values."""
    text = F.substring("content", 1, ENV_LIMIT)
    return of_kind(files, "env").select("repo_id", F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Z][A-Z0-9_]+)[ \t]*="), F.lit(1))).alias("name")).distinct()


def _strip(text: str | Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pep508(spec: Column) -> tuple[Column, Column]:
    """(name, constraint) of a requirement; null for URLs, paths and direct references."""
    spec = _strip(spec)
    name = F.regexp_extract(spec, r"^[A-Za-z0-9][A-Za-z0-9._-]*", 0)
    rest = F.substr(spec, F.length(name) + 1)
    ok = (name != "") & rest.rlike(r"^($|[ \t\[<>=!~;])") & ~rest.rlike(r"^\s*@") & ~rest.rlike(r"^\[[^\]]*$")
    constraint = _strip(F.regexp_extract(F.regexp_replace(rest, r"^\[[^\]]*\]", ""), r"^[^;]*", 0))
    return F.when(ok, name), F.when(ok, constraint)


def _last_of_name(rows: DataFrame, kind: str) -> DataFrame:
    """One version of each name of a manifest, from (repo_id, path, at, name, version): the last in the text wins."""
    per = rows.where("name is not null").groupBy("repo_id", "path", "name").agg(F.max_by("version", "at").alias("version"))
    return per.select("repo_id", F.col("path").alias("manifest_path"), F.lit(kind).alias("kind"), "name", "version")


def deps_package_json(files: DataFrame) -> DataFrame:
    """Runtime, then development dependencies of package.json; the last of one name wins, also where a key is repeated."""
    parsed = F.from_json(F.substring("content", 1, READ_LIMIT), "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    # entries, not maps: a map of repeated keys is an error
    both = F.concat(F.coalesce(F.map_entries("p.dependencies"), empty), F.coalesce(F.map_entries("p.devDependencies"), empty))
    rows = of_kind(files, "package").select("repo_id", "path", parsed.alias("p")).select("repo_id", "path", F.posexplode(both).alias("at", "e"))
    return _last_of_name(rows.select("repo_id", "path", "at", F.col("e.key").alias("name"), F.col("e.value").alias("version")), "package")


def deps_go_mod(files: DataFrame) -> DataFrame:
    """Direct requirements of go.mod, in blocks and alone; those whose comment is exactly ``indirect`` are left out.

    Only a require block opens; what closes blocks of other kinds changes nothing.
    """
    lines = of_kind(files, "go_mod").select("repo_id", "path", F.posexplode(F.split(F.substring("content", 1, READ_LIMIT), "\n")).alias("at", "raw"))
    lines = lines.select("repo_id", "path", "at", _strip(F.regexp_replace("raw", r"//.*$", "")).alias("line"), _strip(F.regexp_extract("raw", r"//(.*)$", 1)).alias("note"))
    opened, closed = F.col("line").rlike(r"^require\s*\($"), F.col("line") == ")"
    w = Window.partitionBy("repo_id", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("inside", F.coalesce(F.last(F.when(opened, True).when(closed, False), ignorenulls=True).over(w), F.lit(False)))
    one, block = r"^require\s+(?!\()(\S+)\s+(\S+)$", r"^(\S+)\s+(\S+)$"
    pick = lambda k: F.when(F.col("inside"), F.regexp_extract("line", block, k)).otherwise(F.regexp_extract("line", one, k))
    rows = lines.where(~opened & (F.col("note") != "indirect")).select("repo_id", "path", "at", pick(1).alias("name"), pick(2).alias("version"))
    return _last_of_name(rows.where("name <> ''"), "go_mod")


def deps_requirements(files: DataFrame) -> DataFrame:
    """Requirements with comments stripped, continued lines joined, options and references left out."""
    text = F.regexp_replace(F.regexp_replace(F.substring("content", 1, READ_LIMIT), r"#[^\r\n]*", ""), r"\\[ \t]*\r?\n", "")
    lines = of_kind(files, "requirements").select("repo_id", "path", F.posexplode(F.split(text, r"\r?\n|\r")).alias("at", "line"))
    lines = lines.withColumn("line", _strip("line")).where("line <> ''").where(~F.col("line").rlike(r"^(-r|-e|-c|--|\.|/)"))
    name, version = pep508(F.regexp_replace("line", r"\s+-.*$", ""))
    return _last_of_name(lines.select("repo_id", "path", "at", name.alias("name"), version.alias("version")), "requirements")


def _toml_specs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import tomllib

    def one(text):
        try:
            project = tomllib.loads(text or "").get("project", {})
            groups = [project.get("dependencies", []), *project.get("optional-dependencies", {}).values()]
            return [x for g in groups if isinstance(g, list) for x in g if isinstance(x, str)]
        except (tomllib.TOMLDecodeError, AttributeError):
            return None

    for texts in batches:
        yield texts.map(one, na_action=None)


def deps_pyproject(files: DataFrame) -> DataFrame:
    """Requirements of [project] and its optional groups; unparsable files give none."""
    specs = pandas_udf(_toml_specs, "array<string>")(F.substring("content", 1, READ_LIMIT))
    name, version = pep508(F.col("spec"))
    rows = of_kind(files, "pyproject").select("repo_id", "path", F.posexplode(specs).alias("at", "spec"))
    return _last_of_name(rows.select("repo_id", "path", "at", name.alias("name"), version.alias("version")), "pyproject")


def all_deps(files: DataFrame) -> DataFrame:
    """Dependencies of every kind of manifest."""
    return deps_package_json(files).unionByName(deps_go_mod(files)).unionByName(deps_requirements(files)).unionByName(deps_pyproject(files))


def dependency_union(deps: DataFrame) -> DataFrame:
    """One version of each name and repository: the last manifest in walk order wins."""
    return deps.groupBy("repo_id", "name").agg(F.max_by("version", F.struct(walk_key("manifest_path").alias("k"), "version")).alias("version"))


def dependency_usage(deps: DataFrame, k: int = 50) -> DataFrame:
    """The dependencies that most repositories have."""
    per = deps.groupBy("name").agg(F.count_distinct("repo_id").alias("repos"))
    return per.orderBy(F.desc("repos"), "name").limit(k)


PROBLEMS = ("unreadable", "malformed", "truncated", "truncated_unparsable")


def _bad_toml(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import tomllib

    def one(text):
        try:
            tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return True
        return False

    for texts in batches:
        yield texts.map(one, na_action=None).astype(bool)


def manifest_problems(files: DataFrame) -> DataFrame:
    """(repo_id, kind, manifests, each of PROBLEMS, note): manifests that could not be read, parsed or read whole.

    A manifest longer than the read limit is judged by what fits: cut JSON and
    TOML that no longer parse are truncated_unparsable, not malformed.
    """
    rows = files.where(~under_skip_dir("path", C.ARCH_SKIP_DIRS)).select("repo_id", arch_source_kind("path").alias("kind"), "content").where("kind in ('package', 'go_mod', 'pyproject', 'requirements')")
    rows = rows.select("repo_id", "kind", F.col("content").isNull().alias("unreadable"), F.coalesce(F.length("content") > READ_LIMIT, F.lit(False)).alias("long"), F.coalesce(F.substring("content", 1, READ_LIMIT), F.lit("")).alias("cut"))
    toml = rows.where("kind = 'pyproject'").withColumn("bad", pandas_udf(_bad_toml, "boolean")("cut"))
    rest = rows.where("kind <> 'pyproject'").withColumn("bad", (F.col("kind") == "package") & F.get_json_object("cut", "$").isNull())
    rows = rest.unionByName(toml).withColumn("bad", F.col("bad") & ~F.col("unreadable"))
    per = rows.groupBy("repo_id", "kind").agg(
        F.count("*").alias("manifests"), F.count_if("unreadable").alias("unreadable"), F.count_if(F.col("bad") & ~F.col("long")).alias("malformed"),
        F.count_if(F.col("long") & ~F.col("bad")).alias("truncated"), F.count_if(F.col("long") & F.col("bad")).alias("truncated_unparsable"))
    label, verb = (F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("kind")) for named in (C.MANIFEST_LABELS, C.MANIFEST_VERBS))
    said = {"unreadable": F.lit("{be} unreadable or refused"), "malformed": verb, "truncated": F.lit("{be} truncated by the read limit; only what fit was parsed"),
            "truncated_unparsable": F.concat(F.lit("{be} truncated by the read limit; the cut text "), verb, F.lit(", so no dependencies were parsed"))}
    clauses = []
    for name in PROBLEMS:
        n, one = F.col(name), F.col(name) == 1
        text = F.concat(n.cast("string"), F.lit(" "), label, F.when(one, " file ").otherwise(" files "), F.replace(said[name], F.lit("{be}"), F.when(one, "was").otherwise("were")))
        clauses.append(F.when(n > 0, text))
    return per.withColumn("note", F.array_join(F.array_compact(F.array(*clauses)), "; "))


#: A key with its separator, also as a list item and with a quote before it; the head of a block of text; the password of a URL; a plain name.
_KEYED = re.compile(r'[ \t]*-?[ \t]*"?([A-Za-z_][\w.-]{0,127})"?\s*[:=]\s*')
_BLOCK_HEAD = re.compile(r"[|>][-+\d]*\s*(?:#.*)?")
_USERINFO = re.compile(r"(?<=[\w+.-])(://[^\s:/@]{0,255}:)[^\s/@]{1,255}(?=@)")
_NAMED = re.compile(r"[\"']?[A-Za-z_][\w.-]*[\"']?\s*")


def _keyed(line: str) -> tuple[str, str, str] | None:
    """(head, key, value) of a line that sets a key; a bare key has an empty value and a colon."""
    m = _KEYED.match(line)
    if m is None:
        return None
    value = line[m.end() :]
    return None if not value and m[0].rstrip()[-1] != ":" else (m[0] if value else m[0].rstrip(), m[1], value)


class _Scopes:
    """The open keys above a line of one YAML document, and the secret name that waits for its value."""

    def __init__(self, secret: bool):
        self.secret, self.above, self.waiting, self.hidden = secret, [], None, 0

    def enter(self, depth: int, item: bool) -> str:
        """Leaves the keys that end before this line; 'gone' or 'data' where the line stands under such a key."""
        # a list may stand as deep as its key
        self.above = [x for x in self.above if x[0] < depth or (item and x[0] == depth and not x[2] and x[1] == "gone")]
        kinds = {kind for _, kind, _ in self.above}
        return "gone" if "gone" in kinds else "data" if "data" in kinds else ""

    def due(self, depth: int, key: str) -> bool:
        """Whether this line's value belongs to a secret name; the wait ends at any value, and where the item of the name ends."""
        hit = key == "value" and self.waiting is not None and depth >= self.waiting
        if key == "value" or (self.waiting is not None and depth <= self.waiting):
            self.waiting = None
        return hit

    def hide(self, head: str, value: str, depth: int, item: bool, rest: bool) -> str:
        """The line without its value; ``rest``: nor what is nested under it."""
        self.hidden += 1
        if rest:
            self.above.append((depth, "gone", item))
        quote = value[-1:] if value[-1:] in ("'", '"') and head.count(value[-1:]) % 2 else ""
        return head + C.REDACTED + quote


def _rewritten(scopes: _Scopes, line: str, below: str | None) -> str | None:
    """One line without secrets, None where it is part of one; ``below`` is the next line with text if it is deeper."""
    depth, item = len(line) - len(line.lstrip()), line.lstrip().startswith("-")
    under = scopes.enter(depth, item)
    if under == "gone":
        return None
    head, key, value = _keyed(line) or ("", "", "")
    if key == "name" and not under and _NAMED.fullmatch(value):
        scopes.waiting = depth if re.search(C.SECRET_KEY, value) else None
        return line
    due = scopes.due(depth, key if value else "")
    secret = bool(under) or bool(key and re.search(C.SECRET_KEY, key))
    if key and not value:
        if scopes.secret and not under and key in ("data", "stringData"):
            scopes.above.append((depth, "data", item))
        elif under or (secret and not (below and _keyed(below))):
            return scopes.hide(head + " ", "", depth, item, True)
        return line
    if due or (key and secret):
        return scopes.hide(head, value, depth, item, not due and _BLOCK_HEAD.fullmatch(value) is not None)
    masked, n = _USERINFO.subn(r"\1" + C.REDACTED, line)
    scopes.hidden += n
    return masked


def redact_text(text: str) -> tuple[str, int]:
    """Configuration without the values of secret keys, Kubernetes Secret data and URL passwords; and their number.

    A nested mapping under a secret key stays and its own keys decide; a list or
    a block of text there is the value.
    """
    out, hidden = [], 0
    for doc in re.split(r"(?m)^(?=(?:---|\.\.\.)\s*$)", text):
        lines = doc.split("\n")
        scopes, below, deeper = _Scopes(re.search(C.SECRET_KIND, doc) is not None), None, [None] * len(lines)
        for k in range(len(lines) - 1, -1, -1):
            deeper[k] = below
            if lines[k].strip():
                below = lines[k]
        kept = []
        for line, nxt in zip(lines, deeper):
            if nxt is not None and len(nxt) - len(nxt.lstrip()) <= len(line) - len(line.lstrip()):
                nxt = None
            new = _rewritten(scopes, line, nxt) if line.strip() else line
            if new is not None:
                kept.append(new)
        out.append("\n".join(kept))
        hidden += scopes.hidden
    return "".join(out), hidden


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([redact_text(t or "") for t in texts], columns=["text", "n"])


def redact_config(files: DataFrame) -> DataFrame:
    """Configuration files with secrets masked and the number of masked values."""
    rows = of_kind(files, "compose", "gateway", "k8s", "iac").where("content is not null")
    return rows.select("repo_id", "path", pandas_udf(_redacted, "text string, n int")("content").alias("r")).select("repo_id", "path", "r.text", F.col("r.n").alias("redactions"))


JS_LINE = r"import .*from ['\"]" + C.SDK + r"|require\(['\"]" + C.SDK + r"|new (?:Stripe|Twilio|Redis|S3Client)"
def go_sdk_name(path: Column) -> Column:
    """The client that a Go module path names; version segments never do."""
    s = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^v\d+$"))
    at = lambda k: F.get(s, k)
    single = at(0).isin("google.golang.org", "modernc.org", "gorm.io", "entgo.io", "gopkg.in", "golang.org") & (F.size(s) >= 2)
    generic = at(2).isin("clients", "sdk-go", "go-sdk", "sdk") | F.coalesce(at(3).isin("sdk-go", "go-sdk"), F.lit(False))
    return (
        F.when((at(0) == "cloud.google.com") & (F.size(s) >= 3), at(2)).when(single, F.when(at(0) == "gopkg.in", F.regexp_replace(at(1), r"\.v[^.]*$", "")).otherwise(at(1)))
        .when(F.size(s) >= 3, F.when(generic, at(1)).otherwise(at(2))).otherwise(F.element_at(s, -1))
    )


def sdk_imports(files: DataFrame, cap: int = 400) -> DataFrame:
    """(repo_id, part, path, line, sdk, capped): where a known SDK is imported, never the line itself; Go comes after the others."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    js = files.where(ext.isin("ts", "tsx", "js", "py") & F.col("content").rlike(JS_LINE)).select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    js = js.where(F.col("text").rlike(JS_LINE))
    built = F.regexp_extract("text", r"new (Stripe|Twilio|Redis|S3Client)", 1)
    known = F.regexp_extract("text", C.SDK, 1)
    name = F.regexp_replace(F.when(known != "", known).when(built != "", built).otherwise("sdk"), "['\"@]", "")
    js = js.select("repo_id", "path", (F.col("pos") + 1).alias("line"), name.alias("sdk"), F.lit(0).alias("part"))
    go = files.where((ext == "go") & ~F.col("path").rlike(r"(^|/)vendor/") & F.col("content").rlike("(?m)" + C.GO_PATH)).select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    go = go.withColumn("module", F.regexp_extract("text", C.GO_PATH, 1)).where("module <> ''")
    own = files.where("path = 'go.mod'").select("repo_id", go_module("content").alias("own")).where("own is not null").dropDuplicates(["repo_id"])
    go = go.join(own, "repo_id", "left").where("own is null or not (module = own or startswith(module, own || '/'))").where(go_sdk_name(F.col("module")).rlike(r"^[A-Za-z0-9._-]+$"))
    go = go.select("repo_id", "path", (F.col("pos") + 1).alias("line"), go_sdk_name(F.col("module")).alias("sdk"), F.lit(1).alias("part"))
    rows = js.unionByName(go).dropDuplicates(["repo_id", "path", "line", "sdk"])
    w = Window.partitionBy("repo_id")
    # one more than the cap tells that there are more, and keeps a repository's window small
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("part", "path", "line", "sdk"))).where(F.col("r") <= cap + 1).withColumn("capped", F.max("r").over(w) > cap)
    return rows.where(F.col("r") <= cap).select("repo_id", "part", "path", "line", "sdk", "capped")


def config_texts(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, read, cut, text) of configuration files: whether it may and can be read, whether it is longer than the read limit, its redacted text.

    Links that lead out and credential names other than variable files are
    refused, as are links to any credential name.
    """
    rows = with_real_paths(files).withColumn("kind", arch_source_kind("path")).where(F.col("kind").isin(*C.CONFIG_LABELS) & ~under_skip_dir("path", C.ARCH_SKIP_DIRS))
    linked = F.coalesce(F.col("link_target") != "", F.lit(False))
    refused = F.when(linked, F.coalesce(is_credential_named("real_path"), F.lit(True))).otherwise(is_credential_named("path") & ~F.lower("path").endswith(".tfvars"))
    rows = rows.select("repo_id", "path", "kind", (F.col("content").isNotNull() & ~refused).alias("read"), F.coalesce(F.length("content") > READ_LIMIT, F.lit(False)).alias("cut"), F.substring("content", 1, READ_LIMIT).alias("content"))
    rows = rows.withColumn("text", pandas_udf(_redacted, "text string, n int")(F.when(F.col("read"), F.col("content")))["text"])
    return rows.select("repo_id", "path", "kind", "read", (F.col("cut") & F.col("read")).alias("cut"), "text")


def env_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, read, cut, n_names) of environment files: ``cut`` where only the first characters are read."""
    name = r"(?m)^[ \t]*(?:export[ \t]+)?([A-Z][A-Z0-9_]+)[ \t]*="
    names = F.size(F.regexp_extract_all(F.substring("content", 1, ENV_LIMIT), F.lit(name), F.lit(1)))
    return of_kind(files, "env").select("repo_id", "path", F.col("content").isNotNull().alias("read"), F.coalesce(F.length("content") > ENV_LIMIT, F.lit(False)).alias("cut"), F.greatest(F.coalesce(names, F.lit(0)), F.lit(0)).alias("n_names"))


@dataclass
class Evidence:
    """What the evidence of repositories rests on, each a narrow stored table, so files are read once for each."""

    configs: DataFrame
    env: DataFrame
    names: DataFrame
    deps: DataFrame
    sdk: DataFrame
    dirs: DataFrame


def gather(files: DataFrame) -> Evidence:
    """Configuration texts, environment files and names, dependencies, SDK lines and integration directories of the files."""
    parts = {"configs": config_texts(files), "env": env_files(files), "names": env_names(files), "deps": all_deps(files), "sdk": sdk_imports(files), "dirs": integration_dirs(files)}
    return Evidence(**{name: materialize(rows, name) for name, rows in parts.items()})


def evidence_sections(evidence: Evidence, unavailable: DataFrame | None = None) -> DataFrame:
    """(repo_id, rank, key, path, text): the sections of each repository's evidence bundle, in the order of rank and key.

    Configuration files by kind and walk, the names of variables, dependencies,
    directories of integrations and SDK lines, each with a heading. A repository
    of ``unavailable`` (repo_id, reason) that has sections but no SDK lines
    starts with a section that says so.
    """
    none = F.lit(None).cast("string")
    own = evidence.configs.where(F.col("read") & F.col("text").rlike(r"\S"))
    rank = F.array_position(F.array(*map(F.lit, C.CONFIG_LABELS)), F.col("kind")).cast("int")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in C.CONFIG_LABELS.items() for x in pair]), F.col("kind"))
    out = own.select("repo_id", rank.alias("rank"), walk_key("path").alias("key"), "path", F.concat(F.lit("===== "), label, F.lit(": "), "path", F.lit(" =====\n"), "text", F.lit("\n")).alias("text"))
    key = F.expr("array(struct(false as d, '' as x))")  # one section a repository

    def lists(rows: DataFrame, at: int, line: Column, order: list, head: Column, joint: str = "\n") -> DataFrame:
        """One section of the lines of a repository, which are its own sorted names."""
        per = rows.select("repo_id", F.struct(*order, line.alias("line")).alias("l")).groupBy("repo_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
        body = F.array_join(F.transform("ls", lambda x: x["line"]), joint)
        return per.select("repo_id", F.lit(at).alias("rank"), key.alias("key"), none.alias("path"), F.concat(head, body, F.lit("\n")).alias("text"))

    out = out.unionByName(lists(evidence.names, 5, F.col("name"), [], F.lit("===== ENVIRONMENT VARIABLE NAMES (values omitted) =====\n")))
    deps = dependency_union(evidence.deps)
    out = out.unionByName(lists(deps, 6, F.concat("name", F.lit(" @ "), F.coalesce("version", F.lit("None"))), ["name"], F.lit("===== DEPENDENCY MANIFESTS (name @ version) =====\n")))
    head = F.concat(F.lit("===== INTEGRATION DIRECTORIES ("), "dir", F.lit(", "), F.size(F.split("names", ",")).cast("string"), F.lit(" total) =====\n"))
    out = out.unionByName(evidence.dirs.select("repo_id", F.lit(7).alias("rank"), key.alias("key"), none.alias("path"), F.concat(head, F.replace(F.col("names"), F.lit(","), F.lit(", ")), F.lit("\n")).alias("text")))
    sdk = evidence.sdk
    capped = sdk.groupBy("repo_id").agg(F.max("capped").alias("capped"))
    line = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "sdk")
    found = lists(sdk.select("repo_id", "part", "path", "line", "sdk"), 8, line, ["part", "path", F.col("line").alias("n"), "sdk"], F.lit("")).join(capped, "repo_id")
    head = F.when(F.col("capped"), SDK_HEAD_CAPPED).otherwise(SDK_HEAD)
    out = out.unionByName(found.withColumn("text", F.concat(head, "text")).drop("capped"))
    if unavailable is not None:
        has = out.select("repo_id").distinct().join(sdk.select("repo_id").distinct(), "repo_id", "left_anti").join(unavailable, "repo_id")
        said = F.concat(F.lit("===== SDK IMPORTS unavailable: "), "reason", F.lit(" =====\nNo import evidence could be gathered, so every connection below is configured, not proven live.\n"))
        out = out.unionByName(has.select("repo_id", F.lit(0).alias("rank"), key.alias("key"), none.alias("path"), said.alias("text")))
    return out


SDK_HEAD = "===== SDK IMPORTS (git grep \u2014 file:line: sdk) =====\n"
SDK_HEAD_CAPPED = "===== SDK IMPORTS (git grep \u2014 file:line: sdk; capped at 400 lines, more may exist and are not shown) =====\n"


def placed_sections(sections: DataFrame) -> DataFrame:
    """Sections with ``start``, the characters before each in the whole bundle, and ``whole``, the bundle's length; stored, so their texts are made once."""
    stored = materialize(sections, "sections")
    narrow = stored.select("repo_id", "rank", "key", "path", (F.length("text") + 1).cast("long").alias("len"))
    at = running(narrow, ["repo_id"], ["rank", "key"], start=F.col("len"))
    at = at.select("repo_id", "rank", F.coalesce("path", F.lit("")).alias("at"), "start", (F.col("start_all") - 1).alias("whole"))
    return stored.withColumn("at", F.coalesce("path", F.lit(""))).join(at, ["repo_id", "rank", "at"]).drop("at")


def evidence_bundle(placed: DataFrame, max_chars: int = 500_000) -> DataFrame:
    """(repo_id, bundle, truncated): the sections in order, cut at the character, with a notice where something is cut."""
    near = placed.where(F.col("start") < max_chars)  # at most the budget and one section of bounded length
    per = near.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("ts"), F.max("whole").alias("whole"))
    text = F.substring(F.array_join(F.transform("ts", lambda x: x["text"]), "\n"), 1, max_chars)
    notice = F.concat(F.lit(f"\n\n===== BUNDLE TRUNCATED at {max_chars:,} of "), F.format_number("whole", 0), F.lit(" chars -- the sources above are incomplete =====\n"))
    cut = F.col("whole") > max_chars
    return per.select("repo_id", F.concat(text, F.when(cut, notice).otherwise("")).alias("bundle"), cut.alias("truncated"))


def evidence_files(evidence: Evidence, placed: DataFrame, max_chars: int = 500_000) -> DataFrame:
    """(repo_id, path, state): the files that each section discloses, ``included`` where the section starts before the cut, else ``dropped``."""
    own = placed.where("path is not null").select("repo_id", "path", "start")
    at = lambda k: placed.where(F.col("rank") == k).select("repo_id", "start")
    env = evidence.env.where("n_names > 0").select("repo_id", "path").join(at(5), "repo_id")
    manifests = evidence.deps.select("repo_id", F.col("manifest_path").alias("path")).distinct().join(at(6), "repo_id")
    rows = own.unionByName(env).unionByName(manifests)
    return rows.select("repo_id", "path", F.when(F.col("start") < max_chars, "included").otherwise("dropped").alias("state"))


def sdk_in_bundle(placed: DataFrame, max_chars: int = 500_000) -> DataFrame:
    """(repo_id, text): the SDK lines that stand whole before the cut."""
    rows = placed.where("rank = 8").select("repo_id", "start", F.explode(F.array(F.regexp_extract("text", r"^[^\n]*\n", 0))).alias("head"), "text")
    room = F.lit(max_chars) - F.col("start") - F.length("head")
    lines = rows.select("repo_id", room.alias("room"), F.posexplode(F.split(F.expr("substring(text, length(head) + 1, length(text) - length(head) - 1)"), "\n")).alias("n", "text"))
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("repo_id").orderBy("n")) - 1  # 400 lines at most
    return lines.withColumn("upto", upto).where("upto <= room").select("repo_id", "n", "text")


def arch_stats(files: DataFrame, max_chars: int = 500_000, evidence: Evidence | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Counts of each repository's evidence: configuration files found, included, unreadable and cut, environment files unreadable and cut, variables, dependencies, integrations, SDK lines inside the cut.

    Only the four kinds of configuration count as such. ``included`` are those
    with text, ``truncated`` says whether the bundle is cut.
    """
    evidence = gather(files) if evidence is None else evidence
    placed = placed_sections(evidence_sections(evidence)) if placed is None else placed
    found = evidence.configs.groupBy("repo_id").agg(
        F.count_if("read").alias("configs"), F.count_if(F.col("read") & F.col("text").rlike(r"\S")).alias("included"), F.count_if(~F.col("read")).alias("unreadable"), F.count_if("cut").alias("cut"))
    env = evidence.env.groupBy("repo_id").agg(F.count_if(~F.col("read")).alias("env_unreadable"), F.count_if(F.col("read") & F.col("cut")).alias("env_cut"))
    base = files.select("repo_id").distinct().join(found, "repo_id", "left").join(env, "repo_id", "left")
    capped = placed.where("rank = 8").select("repo_id", F.col("text").contains("; capped at ").alias("all_capped"))
    parts = {"env_vars": evidence.names, "deps": dependency_union(evidence.deps), "sdk_lines": sdk_in_bundle(placed, max_chars)}
    for name, rows in parts.items():
        base = base.join(rows.groupBy("repo_id").agg(F.count("*").alias(name)), "repo_id", "left")
    listed = evidence.dirs.select("repo_id", F.size(F.split("names", ",")).cast("long").alias("integrations"))
    whole = placed.groupBy("repo_id").agg((F.max("whole") > max_chars).alias("truncated"))
    base = base.join(listed, "repo_id", "left").join(whole, "repo_id", "left").join(capped, "repo_id", "left")
    base = base.na.fill(0, ["configs", "included", "unreadable", "cut", "env_unreadable", "env_cut", *parts, "integrations"]).na.fill(False, ["truncated"])
    return base.withColumn("sdk_capped", F.coalesce("all_capped", F.lit(False)) & (F.col("sdk_lines") > 0)).drop("all_capped")
