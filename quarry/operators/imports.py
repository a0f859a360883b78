"""The import graph: specifiers, their resolution to files, and tagged relationships."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.operators.classify import GO_TOKEN
from quarry.operators.files import is_test_file
from quarry.operators.history import directory

#: Of Python: comments, strings (one that is not closed ends with its line or the text), and joined lines.
_PY = re.compile(r"(?s)#[^\n]*|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\\\r?\n")
_PY_CUT = re.compile(r"[()\[\]{}\n;:]")
_PY_FROM = re.compile(r"\s*from\s+([^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*)\s+import\b")
_PY_IMPORT = re.compile(r"\s*import\s+(.*)", re.S)
_PY_NAME = re.compile(r"\s*([^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*)\s*")
#: Of JavaScript and TypeScript: blanks with their comments, strings, names, anything else.
_JS_BLANK = re.compile(r"(?s)(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+")
_JS_STRING = re.compile(r"(?s)\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?")
_JS_NAME = re.compile(r"[\w$]+")
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_JS_TEMPLATE = re.compile(r"(?s)(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)")
#: What may stand before a regular expression; after anything else a slash divides.
_JS_BEFORE = frozenset("( , = : [ ! & | ? { ; + - * % > ~ ^ return typeof case in of delete void throw new else do yield await".split()) | {""}
_GO_IMPORT = re.compile(r"(?m)(?:^|;)[ \t]*import\b\s*(?:\(([^)]*)\)|([^\n;(]*))")
_GO_SPEC = re.compile(r"(?:^|[\n;])\s*(?:[^\W\d]\w*\s*|\.\s*)?\"(\d+)\"")


def _python_statements(text: str) -> Iterator[str]:
    """Statements without comments and strings; brackets and joined lines go on, a colon outside of brackets starts the next."""
    bare = _PY.sub(lambda m: " " if m[0][0] in "#\\" else '""', text)
    depth = at = 0
    for m in _PY_CUT.finditer(bare):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(depth - 1, 0)
        elif not depth:
            yield bare[at : m.start()]
            at = m.end()
    yield bare[at:]


def python_imports(text: str) -> set[str]:
    """Modules of import and from statements; aliased names, relative modules and __future__ are not read."""
    out = set()
    for statement in _python_statements(text):
        if "import" not in statement:
            continue
        if m := _PY_FROM.match(statement):
            out.add(re.sub(r"\s", "", m[1]))
        elif m := _PY_IMPORT.match(statement):
            out |= {re.sub(r"\s", "", n[1]) for part in m[1].split(",") if (n := _PY_NAME.fullmatch(part))}
    return out - {"__future__"}


def js_tokens(text: str) -> Iterator[str]:
    """Tokens of JavaScript or TypeScript without blanks and comments: strings, templates and regular expressions as '``', names, single other characters."""
    at, before, nested = 0, "", []  # nested: the depth of braces within each open ${ of a template
    while at < len(text):
        if m := _JS_BLANK.match(text, at):
            at = m.end()
            continue
        c, template = text[at], False
        if c in "\"'":
            token = _JS_STRING.match(text, at)[0]
        elif c == "`":
            token, template = c, True
        elif c == "/" and before in _JS_BEFORE and (m := _JS_REGEX.match(text, at)):
            token = m[0]
        elif m := _JS_NAME.match(text, at):
            token = m[0]
        elif text.startswith(("++", "--"), at):
            token = c + c
        else:
            token = c
            if nested and c == "{":
                nested[-1] += 1
            elif nested and c == "}":
                if nested[-1] == 0:  # back in the template
                    nested.pop()
                    template = True
                else:
                    nested[-1] -= 1
        at += len(token)
        if template:
            m = _JS_TEMPLATE.match(text, at)
            at = m.end()
            if m[1] == "${":
                nested.append(0)
                yield "``"
                before = "{"
                continue
            token = "``"
        elif token[0] == "/" and len(token) > 1:
            token = "``"
        yield token
        before = token


def js_imports(text: str) -> set[str]:
    """Specifiers of static import statements, several on a line too; dynamic imports, require and re-exports are not read."""
    out, state = set(), None
    before, last = "", ""  # the two tokens before this one
    for t in js_tokens(text):
        quoted = t[0] in "\"'"
        if state == "import":  # the token after the word
            if quoted:
                out.add(t)
            state = "clause" if t in ("{", "*") or t.isidentifier() or "$" in t else None
        elif state == "clause":
            if quoted:
                if last == "from":
                    out.add(t)
                state = None
            elif not (t in ("{", "}", "*", ",") or t.isidentifier() or "$" in t):
                state = None
        if t == "import" and last != "." and state is None:
            state = "import"
        before, last = last, t
    found = set()
    for t in out:
        body = t[1:-1] if len(t) > 1 and t[-1] == t[0] else ""
        found |= {x for x in re.split(r"\\(?:x[0-9A-Fa-f]{2}|u\{[^}]*\}|u[0-9A-Fa-f]{4}|.)", body) if x}  # the grammar has a fragment on either side of an escape
    return found


def go_imports(text: str) -> set[str]:
    """Paths of the specs of import declarations, in either form of string, several on a line too; each literal is a number meanwhile."""
    found: list[str] = []

    def number(m):
        if m[0][0] == "/":
            return ""
        found.append(m[0][1:].rstrip(m[0][0]))
        return f'"{len(found) - 1}"' if m[0][0] != "'" else "''"

    bare = GO_TOKEN.sub(number, text)
    # what an import says stands before any other declaration
    return {found[int(k)] for many, one in _GO_IMPORT.findall(bare) for k in _GO_SPEC.findall(many or one)} - {""}


RULES = {"py": python_imports, "js": js_imports, "ts": js_imports, "go": go_imports}


def language(path="path") -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext == "py", "py").when(ext.isin("js", "mjs", "cjs", "jsx"), "js").when(ext.isin("ts", "tsx"), "ts").when(ext == "go", "go")


def _specifiers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for langs, texts in batches:
        yield pd.Series([sorted(RULES[x](t or "")) for x, t in zip(langs, texts)], dtype=object)


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, lang, spec): static import specifiers; aliased, relative Python and dynamic imports are not read."""
    rows = files.select("repo_id", "path", language().alias("lang"), "content").where(F.col("lang").isNotNull() & F.col("content").contains("import"))
    specs = pandas_udf(_specifiers, "array<string>")("lang", "content")
    return rows.select("repo_id", "path", "lang", F.explode(specs).alias("spec"))


def _unique(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Edges to the file of ``exact``, else to the only one of ``cands`` that exists; with more than one the import is ambiguous and gives none."""
    hit = rows.select("repo_id", "path", "spec", "exact", F.explode(F.array_union(F.array("exact"), "cands")).alias("to_path")).where("to_path is not null").distinct()
    hit = hit.join(files.select("repo_id", F.col("path").alias("to_path")).distinct(), ["repo_id", "to_path"])
    own = F.max(F.when(F.col("to_path") == F.col("exact"), F.col("to_path")))
    per = hit.groupBy("repo_id", "path", "spec").agg(F.count("*").alias("n"), F.min("to_path").alias("one"), own.alias("own")).where("n = 1 or own is not null")
    return per.select("repo_id", F.col("path").alias("from_path"), F.coalesce("own", "one").alias("to_path")).distinct()


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    slashed = F.replace(F.col("spec"), F.lit("."), F.lit("/"))
    return _unique(imports.where("lang = 'py'").withColumn("exact", F.lit(None).cast("string")).withColumn("cands", F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")))), files)


def normalize(path: Column) -> Column:
    """The path without . and .. segments; null where it leaves the root."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(F.array(F.lit("..")))).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def resolve_relative_js(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative specifiers: the exact file, else the extensions and index files of the language."""
    rows = imports.where("lang in ('js', 'ts') and startswith(spec, '.')")
    target = normalize(F.concat_ws("/", directory("path", 1000), F.col("spec")))
    exts = lambda xs, pre="": [F.concat("exact", F.lit(pre + x)) for x in xs]
    js = F.array(*exts((".js", ".mjs", ".cjs", ".jsx")), *exts((".js", ".jsx"), "/index"))
    ts = F.array(*exts((".ts", ".tsx")), *exts((".ts", ".tsx"), "/index"))
    named = F.regexp_extract("exact", r"(?:^|/)\.*[^./][^/]*(\.[^./]*)$", 1) != ""
    none = F.array().cast("array<string>")
    return _unique(rows.withColumn("exact", target).withColumn("cands", F.when(named, none).when(F.col("lang") == "js", js).otherwise(ts)), files)


def go_module(content) -> Column:
    """The module path that a go.mod declares, bare, quoted or in a block, comments apart; null without one."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"//.*$", ""), r"^\s+|\s+$", ""))
    fields = F.transform(lines, lambda x: F.split(x, r"\s+"))
    at = F.array_position(F.transform(fields, lambda f: F.coalesce(F.get(f, F.lit(0)) == "module", F.lit(False))), True).cast("int")
    own = F.get(F.get(fields, at - 1), F.lit(1))
    below = F.get(F.filter(F.slice(fields, at + 1, F.size(fields)), lambda f: ~F.get(f, F.lit(0)).isin("", ")")), F.lit(0))
    found = F.when(own.isNotNull() & (own != "("), own).otherwise(F.get(below, F.lit(0)))
    return F.when(at > 0, F.nullif(F.regexp_replace(found, r'^"+|"+$', ""), F.lit("")))


def resolve_go_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every Go file, tests apart, of the directory that a path of the own module names."""
    module = files.where("path = 'go.mod'").select("repo_id", go_module("content").alias("module")).where("module is not null").dropDuplicates(["repo_id"])
    rows = imports.where("lang = 'go'").join(module, "repo_id").where("spec = module or startswith(spec, module || '/')")
    rows = rows.select("repo_id", F.col("path").alias("from_path"), F.expr("substring(spec, length(module) + 2)").alias("dir")).where(directory("from_path", 1000) != F.col("dir"))
    go = files.where(F.col("path").endswith(".go") & ~is_test_file("path")).select("repo_id", F.col("path").alias("to_path"), directory("path", 1000).alias("dir"))
    return rows.join(go, ["repo_id", "dir"]).select("repo_id", "from_path", "to_path").distinct()


def import_edges(files: DataFrame) -> DataFrame:
    specs = extract_imports(files)
    edges = resolve_python(specs, files).unionByName(resolve_relative_js(specs, files)).unionByName(resolve_go_packages(specs, files))
    return edges.dropDuplicates().withColumn("kind", F.lit("imports"))


def import_coverage(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count_if(language().isNotNull() & F.col("content").isNotNull()).alias("covered"), F.count("*").alias("total"))


def tag_relationships(rels: DataFrame, abstractions: DataFrame, edges: DataFrame) -> DataFrame:
    """EXTRACTED where an import goes from a file of the first to a file of the second, else INFERRED.

    ``abstractions`` has repo_id, name and files, or a row for each file (path).
    """
    of = abstractions.select("repo_id", "name", F.explode("files").alias("path") if "files" in abstractions.columns else "path")
    src = of.select("repo_id", F.col("name").alias("from_name"), F.col("path").alias("from_path"))
    dst = of.select("repo_id", F.col("name").alias("to_name"), F.col("path").alias("to_path"))
    proven = edges.join(src, ["repo_id", "from_path"]).join(dst, ["repo_id", "to_path"]).select("repo_id", "from_name", "to_name").distinct().withColumn("hit", F.lit(True))
    return rels.join(proven, ["repo_id", "from_name", "to_name"], "left").select("repo_id", "from_name", "to_name", F.when(F.col("hit"), "EXTRACTED").otherwise("INFERRED").alias("source"))


def related_links(rels: DataFrame, chapters: DataFrame) -> DataFrame:
    """Links of each chapter in both directions, to chapters that exist; a loop is listed once."""
    out = rels.select("repo_id", F.col("from_name").alias("name"), F.col("to_name").alias("other"), F.lit("to").alias("direction"))
    back = rels.where("from_name <> to_name").select("repo_id", F.col("to_name").alias("name"), F.col("from_name").alias("other"), F.lit("from").alias("direction"))
    known = chapters.select("repo_id", "name").distinct()
    return out.unionByName(back).join(known, ["repo_id", "name"], "left_semi").join(known.withColumnRenamed("name", "other"), ["repo_id", "other"], "left_semi").select("repo_id", "name", "other", "direction")
