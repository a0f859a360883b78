"""Path and content classifiers, and their grouped counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import constants as C
from quarry.functions.running import numbered
from quarry.operators.files import _col, any_of, basename, ends_any, is_test_file, kept, under_skip_dir, with_real_paths


def backend_layer(path) -> Column:
    """The first of six layers whose rules fit the lower-case path; null for tests and other extensions."""
    p = F.concat(F.lit("/"), F.regexp_replace(F.lower(_col(path)), "^/+", ""))
    base = basename(p)
    go = p.endswith(".go")
    has = lambda *xs: any_of(p.contains(x) for x in xs)
    route = base.isin("urls.py", "routes.rb", "routes.ts", "router.ts", "routes.js", "router.js") | base.endswith("_router.ts") | has("/pages/api/", "/routes/", "/urls/")
    route = route | (go & (base.isin("server.go", "router.go", "routes.go", "mux.go") | ((base == "main.go") & has("/cmd/"))))
    middleware = has("middleware") | ends_any(base, ("decorator.py", "decorators.py")) | (base == "computed_settings.py")
    handler = has("/views/", "/controllers/", "/handlers/") | (base == "views.py") | ends_any(base, ("view.py", "_views.py", "controller.rb"))
    handler = handler | (go & (base.isin("handler.go", "handlers.go") | ends_any(base, ("_api.go", "_handler.go", "_handlers.go")) | has("/handler/")))
    service = has("/actions/", "/services/", "/domain/") | (has("/use") & has("case")) | (go & ((base == "service.go") | base.endswith("_service.go") | has("/service/")))
    database = has("/models/", "/repositories/", "/repository/") | base.isin("models.py", "schema.rb")
    database = database | (go & (base.isin("db.go", "database.go", "store.go", "queries.go") | ends_any(base, ("_store.go", ".sql.go", "_repository.go")) | has("/store/", "/db/", "/database/", "/sqlc/")))
    response = has("serializer") | (base.startswith("response") & base.endswith(".py")) | (go & ((base == "response.go") | base.endswith("_response.go") | has("/dto/")))
    out = F.when(~ends_any(p, C.SOURCE_EXT) | is_test_file(base), None)
    for name, rule in zip(C.LAYERS, (route, middleware, handler, service, database, response)):
        out = out.when(rule, name)
    return out


def backend_kept() -> Column:
    """Of files with ``real_path``: source files that the walk keeps, links by what they lead to."""
    return kept(keep_ext=C.SOURCE_EXT, keep_names=(), skip=C.BACKEND_SKIP_DIRS)


def layer_counts(files: DataFrame) -> DataFrame:
    """Kept source files of each layer and repository; every layer is a column."""
    rows = with_real_paths(files).select("repo_id", F.when(backend_kept(), backend_layer("path")).alias("layer"))
    return rows.groupBy("repo_id").agg(*(F.count_if(F.col("layer") == x).alias(x) for x in C.LAYERS))


def arch_source_kind(path) -> Column:
    p = F.concat(F.lit("/"), F.regexp_replace(_col(path), "^/+", ""))
    raw = basename(p)
    base = F.lower(raw)
    return (
        F.when(base.startswith("docker-compose") | base.isin("compose.yaml", "compose.yml"), "compose").when(raw == "Procfile", "gateway").when(base.startswith(".env"), "env")
        .when(ends_any(base, (".tf", ".tfvars")), "iac").when(raw.isin(*C.GATEWAY_NAMES), "gateway").when(base == "package.json", "package").when(base == "go.mod", "go_mod")
        .when(base == "pyproject.toml", "pyproject").when(base.startswith("requirements") & base.endswith(".txt"), "requirements")
        .when(ends_any(base, (".yaml", ".yml")) & any_of(p.contains(x) for x in C.K8S_DIRS), "k8s")
    )


def is_manifest_name(base: Column) -> Column:
    return base.isin(*C.ROUTE_NAMES) | ends_any(base, ("_router.ts", ".proto", ".graphql"))


def is_route_file(path) -> Column:
    p = F.concat(F.lit("/"), F.regexp_replace(_col(path), "^/+", ""))
    base = basename(p)
    pages = p.contains("/pages/api/") & ends_any(p, (".ts", ".js", ".tsx"))
    app = p.contains("/app/") & base.isin("route.ts", "route.js", "route.tsx")
    return ~is_test_file(base) & (is_manifest_name(base) | pages | app)


#: One token of Go source: comment, raw string, string or rune.
GO_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)", re.S | re.M)


def go_without_comments(text: str) -> str:
    return GO_TOKEN.sub(lambda m: "" if m[0].startswith("/") else m[0], text)


def go_strings(text: str) -> list[str]:
    """Contents of the string literals, with the common escapes resolved."""
    out = []
    for m in GO_TOKEN.finditer(text):
        t = m[0]
        if t[0] == "`":
            out.append(t[1:].removesuffix("`"))
        elif t[0] == '"':
            out.append(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), t[1:].removesuffix('"')))
    return out


def _registrations(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    rule, server = re.compile(C.GO_REGISTRATION), re.compile(C.GO_BUILDS_SERVER)
    for texts in batches:
        rows = []
        for t in texts:
            t = go_without_comments(t or "")
            rows.append((len(rule.findall(t)), bool(server.search(t))))
        yield pd.DataFrame(rows, columns=["n", "builds"])


def go_route_registrations(content) -> Column:
    """Struct of the count of registration-shaped calls outside comments, and whether a server is built."""
    return pandas_udf(_registrations, "n int, builds boolean")(content)


def surface_files(files: DataFrame) -> DataFrame:
    """Files that declare entry points, ranked: named manifests, Go manifests by registrations, handlers.

    A named file is a surface file at any size. Other Go files are scanned up to
    the size cap, and only where a cheap pattern of the text says a call may be
    there. Repositories without a Go hit get their serving cmd main.go.
    """
    base = basename("path")
    seen = files.where(~under_skip_dir("path", C.INTERFACES_SKIP_DIRS) & ~is_test_file("path"))
    named = seen.where(is_route_file("path")).select("repo_id", "path", F.when(is_manifest_name(base), 0).otherwise(2).alias("tier"), F.lit(0).alias("weight"))
    scanned = seen.where(base.endswith(".go") & ~is_route_file("path") & (F.col("size") <= C.MAX_FILE_BYTES))
    go = scanned.where(F.col("content").rlike(C.GO_REGISTRATION)).select("repo_id", "path", go_route_registrations("content").alias("g"))
    go = go.where("g.n > 0").select("repo_id", "path", F.when((F.col("g.n") >= 5) & F.col("g.builds"), 1).otherwise(2).alias("tier"), F.col("g.n").alias("weight"))
    mains = scanned.where(F.col("path").rlike(r"(^|/)cmd/(.*/)?main\.go$") & F.col("content").rlike(C.GO_SERVES)).select("repo_id", "path", F.lit(2).alias("tier"), F.lit(0).alias("weight"))
    out = named.unionByName(go).unionByName(mains.join(go.select("repo_id").distinct(), "repo_id", "left_anti"))
    return numbered(out, ["repo_id"], ["tier", F.when(F.col("tier") == 1, -F.col("weight")).otherwise(0), "path"], "surface_rank")


def integration_dirs(files: DataFrame, candidates=C.INTEGRATION_DIRS) -> DataFrame:
    """Sub-directories of the first candidate directory that has any, sorted."""
    rows = None
    for k, d in enumerate(candidates):
        child = F.regexp_extract("path", "^" + re.escape(d) + "/([^/]+)/", 1)
        part = files.select("repo_id", F.lit(k).alias("k"), F.lit(d).alias("dir"), child.alias("name")).where("name <> '' and not startswith(name, '_') and not startswith(name, '.')")
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("repo_id", "k", "dir").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return per.groupBy("repo_id").agg(F.min_by("dir", "k").alias("dir"), F.min_by("names", "k").alias("names")).select("repo_id", "dir", F.array_join("names", ",").alias("names"))
