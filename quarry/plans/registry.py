"""All queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.operators import arch, budget, classify, history, imports, previews, replies, schemas, usage
from quarry.operators import files as fs
from quarry.plans import standins as v
from quarry.sources import readers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = v.with_views(sql.strip())
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _in(values) -> str:
    return "(" + ", ".join(map(v._lit, values)) + ")"


# ---- history

_COUNTS = """WITH dirs AS (SELECT DISTINCT repo_id, hash, array_to_string(string_split(path, '/')[:least(len(string_split(path, '/')) - 1, 2)], '/') AS dir FROM changes_v),
counts AS (SELECT d.repo_id, d.dir, c.month, count(*) AS n FROM dirs d JOIN commits_v c USING (repo_id, hash) WHERE dir <> '' GROUP BY ALL)"""
_PER = ", per AS (SELECT repo_id, dir, min(month) AS first_month, max(month) AS last_month, arg_max(month, (n, month)) AS peak_month, max(n) AS peak_n, sum(n)::bigint AS total FROM counts GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY total DESC, dir) AS dir_rank FROM per QUALIFY dir_rank <= 25)"


def _counts(spark, d):
    return history.dir_month_counts(v.changes(spark, d), v.commits(spark, d))


@query(_COUNTS + " SELECT * FROM counts")
def dir_month_counts(spark, d):
    return _counts(spark, d)


@query(_COUNTS + _PER + " SELECT repo_id, dir, total, dir_rank FROM top")
def top_dirs(spark, d):
    return history.top_dirs(_counts(spark, d))


@query(_COUNTS + _PER + " SELECT * FROM top")
def heatmap_summary(spark, d):
    return history.heatmap_summary(_counts(spark, d), v.commits(spark, d))


_PIVOTS = ", last AS (SELECT repo_id, max(month) AS repo_last FROM commits_v GROUP BY 1), pivots AS (SELECT repo_id, dir, first_month AS born, last_month AS last_active, last_month < repo_last AS silent FROM top JOIN last USING (repo_id))"


@query(_COUNTS + _PER + _PIVOTS + " SELECT * FROM pivots")
def pivots_summary(spark, d):
    return history.pivots_summary(_counts(spark, d), v.commits(spark, d))


@query(_COUNTS + _PER + _PIVOTS + " SELECT top.*, born, last_active, silent FROM top JOIN pivots USING (repo_id, dir)")
def heatmap_pivots(spark, d):
    return history.dir_activity(_counts(spark, d), v.commits(spark, d))


_SCOPE = """list_aggregate(list_transform(range(1, 3), lambda k: CASE WHEN len(lo) >= k AND len(hi) >= k AND lo[:k] = hi[:k] THEN lo[k] END), 'string_agg', '/')"""


def _bulk_sql(status: str, floor: int) -> str:
    return f"""un AS (SELECT repo_id, hash, path, status, false AS pure FROM changes_v WHERE status IN ('A', 'D') UNION ALL SELECT repo_id, hash, old_path, 'D', true FROM changes_v WHERE status = 'R' UNION ALL SELECT repo_id, hash, path, 'A', true FROM changes_v WHERE status = 'R'),
per AS (SELECT repo_id, hash, list_sort(list(path)) AS files, count(*) AS n_files, bool_and(pure) AS renames_only, min(string_split(path, '/')[:-2]) AS lo, max(string_split(path, '/')[:-2]) AS hi FROM un WHERE status = '{status}' GROUP BY 1, 2 HAVING count(*) >= {floor}),
bulk AS (SELECT repo_id, hash, ts, month, author, subject, files, n_files, renames_only, coalesce({_SCOPE}, '') AS scope FROM per JOIN commits_v USING (repo_id, hash))"""


def _bulk(spark, d, status="D", floor=3):
    return history.bulk_changes(v.changes(spark, d), v.commits(spark, d), status, floor)


_BULK_COLS = "repo_id, hash, month, author, n_files, renames_only, scope"


@query("WITH " + _bulk_sql("A", 4) + f" SELECT {_BULK_COLS} FROM bulk")
def bulk_additions(spark, d):
    return _bulk(spark, d, "A", 4).select(*_BULK_COLS.split(", "))


@query("WITH " + _bulk_sql("D", 3) + f" SELECT {_BULK_COLS} FROM bulk")
def bulk_changes(spark, d):
    return _bulk(spark, d).select(*_BULK_COLS.split(", "))


@query("WITH " + _bulk_sql("D", 3) + " SELECT repo_id, hash, scope FROM bulk")
def scope_of(spark, d):
    nested = history.bulk_files(v.changes(spark, d), _bulk(spark, d), "D").groupBy("repo_id", "hash").agg(F.collect_list("path").alias("files"))
    return nested.select("repo_id", "hash", history.scope_of(F.col("files")).alias("scope"))


@query("WITH " + _bulk_sql("D", 3) + " SELECT repo_id, hash, n_files, row_number() OVER (PARTITION BY repo_id ORDER BY n_files DESC, ts DESC, hash) AS change_rank, concat_ws('  ', hash, (DATE '1970-01-01' + (ts // 86400)::int)::varchar, n_files || ' files', scope || '/', subject) AS line FROM bulk QUALIFY change_rank <= 20")
def top_changes(spark, d):
    return history.top_changes(_bulk(spark, d))


@query("WITH " + _bulk_sql("D", 3) + " SELECT repo_id, hash, n_files FROM bulk WHERE NOT renames_only")
def exclude_pure_renames(spark, d):
    return history.exclude_pure_renames(_bulk(spark, d)).select("repo_id", "hash", "n_files")


_NOISE = f"len(list_filter(files, lambda f: list_has_any(string_split(f, '/'), {v._list(C.SKIP_DIRS)}))) > len(files) * 0.5"


@query("WITH " + _bulk_sql("D", 3) + " SELECT repo_id, hash, unnest(files) AS path FROM bulk")
def bulk_files(spark, d):
    return history.bulk_files(v.changes(spark, d), _bulk(spark, d), "D")


@query("WITH " + _bulk_sql("D", 3) + f" SELECT repo_id, hash, {_NOISE} AS noise FROM bulk")
def is_noise_deletion(spark, d):
    return _bulk(spark, d).select("repo_id", "hash", history.is_noise_deletion().alias("noise"))


_GRAVES = f", one AS (SELECT *, row_number() OVER (PARTITION BY repo_id, scope ORDER BY n_files DESC, ts DESC, hash) AS r FROM bulk WHERE n_files >= 4 AND NOT renames_only AND NOT ({_NOISE}) QUALIFY r = 1), graves AS (SELECT repo_id, hash, scope, n_files, month, row_number() OVER (PARTITION BY repo_id ORDER BY n_files DESC, ts DESC, hash) AS grave_rank FROM one QUALIFY grave_rank <= 6)"


@query("WITH " + _bulk_sql("D", 3) + _GRAVES + " SELECT * FROM graves")
def pick_graves(spark, d):
    return history.pick_graves(_bulk(spark, d), 4)


_IN_ERA = "c.repo_id = e.repo_id AND c.month BETWEEN e.start_month AND coalesce(e.end_month, '9999-99')"


@query(f"SELECT c.repo_id, c.hash, e.era_index, e.name FROM commits_v c JOIN eras_v e ON {_IN_ERA}")
def era_commits(spark, d):
    return history.era_commits(v.commits(spark, d), v.eras(spark)).select("repo_id", "hash", "era_index", "name")


@query(f"SELECT c.repo_id, c.hash, c.month, min(e.era_index) AS era_index, arg_min(e.name, e.era_index) AS era FROM commits_v c LEFT JOIN eras_v e ON {_IN_ERA} GROUP BY 1, 2, 3")
def era_for(spark, d):
    return history.era_for(v.commits(spark, d), v.eras(spark))


_SAMPLE = """, num AS (SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY ts, hash) - 1 AS seq, count(*) OVER (PARTITION BY repo_id) AS n FROM commits_v),
sizes AS (SELECT DISTINCT repo_id, n FROM num), picks AS (SELECT repo_id, floor(i * (n / 400.0::double))::bigint AS seq FROM sizes, range(400) t(i) UNION SELECT repo_id, n - 1 FROM sizes UNION SELECT repo_id, 0 FROM sizes),
sample AS (SELECT num.repo_id, hash, seq, n > 400 AS sampled FROM num WHERE n <= 400 OR EXISTS (SELECT 1 FROM picks p WHERE p.repo_id = num.repo_id AND p.seq = num.seq))"""


@query("WITH " + _SAMPLE[2:] + " SELECT * FROM sample")
def sample_commits(spark, d):
    return history.sample_commits(v.commits(spark, d)).select("repo_id", "hash", F.col("seq").cast("long").alias("seq"), "sampled")


def _sizes(spark, d):
    return v.changes(spark, d).groupBy("repo_id", "hash").agg(F.count("*").alias("n_files"))


@query(f"""WITH sizes AS (SELECT repo_id, hash, count(*) AS n_files FROM changes_v GROUP BY 1, 2),
r AS (SELECT e.repo_id, e.era_index, c.hash, c.month, coalesce(n_files, 0) AS n_files, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY e.repo_id, e.era_index) AS n FROM commits_v c JOIN eras_v e ON {_IN_ERA} LEFT JOIN sizes s ON s.repo_id = c.repo_id AND s.hash = c.hash WINDOW w AS (PARTITION BY e.repo_id, e.era_index ORDER BY ts, c.hash)),
thirds AS (SELECT *, 'early' AS slot FROM r WHERE r < greatest(n // 3, 1) UNION ALL SELECT *, 'mid' FROM r WHERE (r >= n // 3 AND r < 2 * n // 3) OR n // 3 = 2 * n // 3 UNION ALL SELECT *, 'late' FROM r WHERE r >= 2 * n // 3),
months AS (SELECT repo_id, era_index, slot, month, count(*) AS m, min(r) AS seen, arg_max(hash, (n_files, -r)) AS hash FROM thirds GROUP BY 1, 2, 3, 4)
SELECT repo_id, era_index, slot, arg_max(hash, (m, -seen)) AS hash FROM months GROUP BY 1, 2, 3
UNION ALL SELECT repo_id, era_index, 'opening', arg_min(hash, r) FROM r GROUP BY 1, 2 UNION ALL SELECT repo_id, era_index, 'closing', arg_max(hash, r) FROM r GROUP BY 1, 2""")
def landmarks(spark, d):
    return history.landmarks(history.era_commits(v.commits(spark, d), v.eras(spark)), _sizes(spark, d))


@query(f"""WITH per AS (SELECT repo_id, hash, min(string_split(path, '/')[:-2]) AS lo, max(string_split(path, '/')[:-2]) AS hi FROM changes_v GROUP BY 1, 2),
num AS (SELECT c.*, e.era_index, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY c.repo_id, e.era_index) AS n FROM commits_v c JOIN eras_v e ON {_IN_ERA} WINDOW w AS (PARTITION BY c.repo_id, e.era_index ORDER BY ts, hash)),
sizes AS (SELECT DISTINCT repo_id, era_index, n FROM num), picks AS (SELECT repo_id, era_index, floor(i * (n / 400.0::double))::bigint AS seq FROM sizes, range(400) t(i) UNION SELECT repo_id, era_index, n - 1 FROM sizes UNION SELECT repo_id, era_index, 0 FROM sizes),
l AS (SELECT c.repo_id, c.era_index, c.ts, c.hash, concat_ws(' | ', c.month, c.author, coalesce({_SCOPE}, '') || '/', c.subject) AS line FROM num c LEFT JOIN per ON per.repo_id = c.repo_id AND per.hash = c.hash WHERE n <= 400 OR EXISTS (SELECT 1 FROM picks p WHERE p.repo_id = c.repo_id AND p.era_index = c.era_index AND p.seq = c.seq))
SELECT repo_id, era_index, count(*)::int AS n_lines, md5(string_agg(line, chr(10) ORDER BY ts, hash)) AS stream_md5 FROM l GROUP BY 1, 2""")
def commit_stream(spark, d):
    return history.commit_stream(history.era_commits(v.commits(spark, d), v.eras(spark)), history.commit_scopes(v.changes(spark, d))).select("repo_id", "era_index", "n_lines", F.md5("stream").alias("stream_md5"))


@query(f"""WITH per AS (SELECT e.repo_id, e.era_index, count(*) AS c FROM commits_v c JOIN eras_v e ON {_IN_ERA} GROUP BY 1, 2), r AS (SELECT repo_id, era_index, name, coalesce(c, 0) AS commits FROM eras_v LEFT JOIN per USING (repo_id, era_index))
SELECT *, greatest(commits, 1) AS width, commits / greatest(sum(commits) OVER (PARTITION BY repo_id), 1)::double AS share FROM r""")
def era_volume(spark, d):
    return history.era_volume(v.commits(spark, d), v.eras(spark))


@query(f"""WITH per AS (SELECT e.repo_id, e.era_index, c.author, count(*) AS commits FROM commits_v c JOIN eras_v e ON {_IN_ERA} GROUP BY 1, 2, 3)
SELECT *, floor(commits * 100 / (sum(commits) OVER (PARTITION BY repo_id, era_index))::double)::bigint AS pct, row_number() OVER (PARTITION BY repo_id, era_index ORDER BY commits DESC, author) AS cast_rank FROM per QUALIFY cast_rank <= 5""")
def era_cast(spark, d):
    return history.era_cast(v.commits(spark, d), v.eras(spark))


_TWO = "WITH " + _bulk_sql("A", 4).replace("per AS", "per_a AS").replace("bulk AS", "bulk_a AS").replace("FROM per JOIN", "FROM per_a JOIN") + ", " + _bulk_sql("D", 3).split("),\n", 1)[1].replace("per AS", "per AS", 1)


@query(_TWO + """ SELECT c.repo_id, count(*) AS commits, min(month) AS first_month, max(month) AS last_month, (SELECT count(*) FROM bulk_a a WHERE a.repo_id = c.repo_id) AS bulk_additions, (SELECT count(*) FROM bulk b WHERE b.repo_id = c.repo_id) AS bulk_deletions FROM commits_v c GROUP BY c.repo_id""")
def history_preview(spark, d):
    return history.history_preview(v.commits(spark, d), _bulk(spark, d, "A", 4), _bulk(spark, d))


@query("WITH " + _bulk_sql("D", 3) + _GRAVES + _SAMPLE + ", x AS (SELECT repo_id, hash, 'listed' AS kind FROM sample UNION SELECT repo_id, hash, 'diff' FROM graves) SELECT repo_id, kind, string_agg(hash, ',' ORDER BY hash) AS hashes FROM x GROUP BY 1, 2")
def sent_commits(spark, d):
    sent = history.sent_commits(history.sample_commits(v.commits(spark, d)), history.pick_graves(_bulk(spark, d), 4))
    return sent.withColumn("hashes", F.array_join("hashes", ","))


@query("SELECT repo_id, hash, list_sort(list(path))[1] AS path, count(*) AS n FROM changes_v GROUP BY 1, 2")
def explode_changes(spark, d):
    nested = v.changes(spark, d).groupBy("repo_id", "hash").agg(F.collect_list("path").alias("files"))
    return history.explode_changes(nested).groupBy("repo_id", "hash").agg(F.min("path").alias("path"), F.count("*").alias("n"))


@query("SELECT repo_id, hash, ts, author, subject, month, strftime(to_timestamp(ts), '%Y-%m-%d') AS date, 2 AS n_files, row_number() OVER (PARTITION BY repo_id ORDER BY ts, hash) AS seq FROM commits_v")
def read_commit_log(spark, d):
    c = v.commits(spark, d)
    good = F.concat(F.concat_ws("|", "hash", "ts", "author", "subject"), F.lit("\na/x.py\n\nb/y.py\n"))
    bad = F.concat(F.lit("zz"), F.concat_ws("|", "hash", "ts", "author", "subject"))
    return readers.parse_commit_log(c.select("repo_id", good.alias("record")).unionByName(c.select("repo_id", bad.alias("record")))).select("repo_id", "hash", "ts", "author", "subject", "month", "date", F.size("files").alias("n_files"), "seq")


#: Headers of a file with secrets: usual and other prefixes, none, quoted, combined, blanks in names, one side alone.
_HEADERS = ("--git a/.env b/.env", "--git .env .env", "--git i/conf dir/.env w/conf dir/.env", '--git "a/c\\303\\251/key.pem" "b/c\\303\\251/key.pem"', "--cc my conf/.netrc", "--combined id_rsa", "--git a/.env b/settings.py", "--git a/.env.example b/.env.example")


def _diffs(spark, d):
    head = F.get(F.array(*map(F.lit, _HEADERS)), F.length("path") % len(_HEADERS))
    parts = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n+"), "status", F.lit("\ndiff "), head, F.lit("\n-diff --git a/x.py b/x.py\n+SECRET\n"))
    return v.changes(spark, d).groupBy("repo_id", "hash").agg(F.concat(F.lit(" x | 2 +\n\n"), F.array_join(F.array_sort(F.collect_list(parts)), "")).alias("diff"))


_HEAD_OF = f"({v._list(_HEADERS)})[length(path) % {len(_HEADERS)} + 1]"
_DIFFS = f"diffs AS (SELECT repo_id, hash, ' x | 2 +' || chr(10) || chr(10) || string_agg(p, '' ORDER BY p) AS diff FROM (SELECT repo_id, hash, 'diff --git a/' || path || ' b/' || path || chr(10) || '+' || status || chr(10) || 'diff ' || {_HEAD_OF} || chr(10) || '-diff --git a/x.py b/x.py' || chr(10) || '+SECRET' || chr(10) AS p FROM changes_v) GROUP BY 1, 2)"
#: Lines of the diffs, numbered, each with the number of its file's part; the heads of the parts and the paths that they may name.
_HUNKS = rf"""{_DIFFS}, lined AS (SELECT repo_id, hash, line, n, sum(CASE WHEN regexp_matches(line, '^diff --(git|cc|combined) ') THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, hash ORDER BY n) AS pos FROM (SELECT repo_id, hash, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS n FROM diffs)),
heads AS (SELECT repo_id, hash, pos, regexp_extract(line, '^diff --(git|cc|combined) (.*)$', 1) AS kind, regexp_extract(line, '^diff --(git|cc|combined) (.*)$', 2) AS head FROM lined WHERE regexp_matches(line, '^diff --(git|cc|combined) ')),
said AS (SELECT repo_id, hash, pos, unnest(CASE WHEN kind <> 'git' THEN [head] WHEN contains(head, ' b/') THEN [regexp_extract(head, '^(.*) b/', 1), regexp_extract(head, '^.* b/(.*)$', 1)] ELSE [] END || regexp_split_to_array(head, '\s+')) AS word FROM heads),
paths AS (SELECT DISTINCT repo_id, hash, pos, regexp_replace(trim(word, '"'), '^(a/)?(b/)?', '') AS path FROM said)"""


@query(f"WITH {_HUNKS}, x AS (SELECT DISTINCT l.repo_id, l.hash, l.pos, string_agg(DISTINCT p.path, ',' ORDER BY p.path) AS paths FROM lined l LEFT JOIN paths p ON p.repo_id = l.repo_id AND p.hash = l.hash AND p.pos = l.pos AND p.path <> '' GROUP BY l.repo_id, l.hash, l.pos) SELECT repo_id, hash, coalesce(paths, '') AS paths, count(*) AS hunks FROM x GROUP BY 1, 2, 3")
def split_diff(spark, d):
    return history.split_diff(_diffs(spark, d)).groupBy("repo_id", "hash", F.array_join(F.array_sort("paths"), ",").alias("paths")).agg(F.count("*").alias("hunks"))


# ---- files and classes

@query("SELECT coalesce(repo_id, '_') AS repo_id, path, strlen(content)::bigint AS size, NULL::varchar AS link_target, md5(content) AS content_md5 FROM files_v UNION ALL SELECT coalesce(repo_id, '_'), path, 0, link_target, NULL FROM links_v")
def read_repo_files(spark, d):
    """The stand-in trees, written to the shared folder and read back with their links, stage by stage."""
    rows = v.files(spark, d).unionByName(v.links(spark, d)).withColumn("repo_id", F.coalesce("repo_id", F.lit("_")))
    return readers.reread_repo_files(rows, "repo_id", "path", "size", "link_target", F.md5("content").alias("content_md5"))


_BASE = "string_split(path, '/')[-1]"
_LB = f"lower({_BASE})"


def _ends(c, xs):
    return "(" + " OR ".join(f"ends_with({c}, '{x}')" for x in xs) + ")"


def _has(c, xs):
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in xs) + ")"


_CRED = f"CASE WHEN starts_with({_LB}, '.env') THEN {_LB} NOT IN {_in(C.DOTENV_TEMPLATES)} ELSE {_LB} IN {_in(C.CREDENTIAL_NAMES)} OR {_ends(_LB, C.CREDENTIAL_SUFFIXES)} END"
_SECRET_PARTS = f"{_HUNKS}, secret AS (SELECT DISTINCT repo_id, hash, pos FROM paths WHERE {_CRED})"


@query(f"""WITH {_SECRET_PARTS}, last AS (SELECT repo_id, hash, max(pos) AS last FROM lined GROUP BY 1, 2),
part AS (SELECT l.repo_id, l.hash, l.pos, CASE WHEN bool_or(s.pos IS NOT NULL) THEN min(l.line) FILTER (starts_with(l.line, 'diff --')) || chr(10) || '[contents omitted: credential-bearing file]' || chr(10) ELSE string_agg(l.line, chr(10) ORDER BY n) || CASE WHEN l.pos < max(last) THEN chr(10) ELSE '' END END AS part FROM lined l JOIN last ON last.repo_id = l.repo_id AND last.hash = l.hash LEFT JOIN secret s ON s.repo_id = l.repo_id AND s.hash = l.hash AND s.pos = l.pos GROUP BY l.repo_id, l.hash, l.pos),
r AS (SELECT repo_id, hash, string_agg(part, '' ORDER BY pos) AS diff FROM part GROUP BY 1, 2) SELECT repo_id, hash, md5(CASE WHEN length(diff) > 700 THEN substr(diff, 1, 700) || chr(10) || '... [diff truncated]' ELSE diff END) AS diff_md5 FROM r""")
def redact_diff(spark, d):
    return history.redact_diff(_diffs(spark, d), 700).select("repo_id", "hash", F.md5("diff").alias("diff_md5"))


_WANT = f"(NOT ({_CRED}) AND ({_BASE} IN {_in(C.KEEP_NAMES)} OR regexp_extract({_LB}, '^\\.*[^.].*?(\\.[^.]*)$', 1) IN {_in(C.KEEP_EXT)}))"
_SKIP = f"list_has_any(string_split(path, '/')[:-2], {v._list(C.SKIP_DIRS)})"
_TEST = f"({_has(_LB, C.TEST_MARKERS)} OR ends_with({_LB}, '_spec.rb') OR (ends_with({_LB}, '.go') AND ({' OR '.join(f'starts_with({_LB}, {v._lit(p)})' for p in C.GO_TEST_PREFIXES)})))"
_KEPT = f"({_WANT} AND NOT {_SKIP} AND size <= {C.MAX_FILE_BYTES})"


@query(f"SELECT repo_id, path, {_CRED} AS credential, {_WANT} AS wanted, {_SKIP} AS skipped, {_TEST} AS test, size <= 2000 AS small FROM files_v")
def file_predicates(spark, d):
    return v.files(spark, d).select("repo_id", "path", fs.is_credential_named("path").alias("credential"), fs.is_wanted("path").alias("wanted"), fs.under_skip_dir("path").alias("skipped"), fs.is_test_file("path").alias("test"), fs.within_size("size", 2000).alias("small"))


def _flag(name, sql, build):
    """One predicate over every file, under its own name."""

    def run(spark, d):
        return v.files(spark, d).select("repo_id", "path", build().alias(name))

    run.__name__ = name
    query(f"SELECT repo_id, path, {sql} AS {name} FROM files_v")(run)


_flag("is_credential_named", _CRED, lambda: fs.is_credential_named("path"))
_flag("is_wanted", _WANT, lambda: fs.is_wanted("path"))
_flag("within_size", f"size <= {C.MAX_FILE_BYTES}", lambda: fs.within_size())
_flag("is_test_file", _TEST, lambda: fs.is_test_file("path"))


@query(f"SELECT repo_id, path, {_SKIP} AS everywhere, list_has_any(string_split(path, '/')[:-2], {v._list(C.BACKEND_SKIP_DIRS)}) AS backend, list_has_any(string_split(path, '/')[:-2], {v._list(C.ARCH_SKIP_DIRS)}) AS architecture, list_has_any(string_split(path, '/')[:-2], {v._list(C.INTERFACES_SKIP_DIRS)}) AS interfaces FROM files_v")
def under_skip_dir(spark, d):
    sets = {"everywhere": C.SKIP_DIRS, "backend": C.BACKEND_SKIP_DIRS, "architecture": C.ARCH_SKIP_DIRS, "interfaces": C.INTERFACES_SKIP_DIRS}
    return v.files(spark, d).select("repo_id", "path", *(fs.under_skip_dir("path", x).alias(n) for n, x in sets.items()))


@query(f"SELECT repo_id, path, (ends_with(path, '.py') OR starts_with(path, 'web/')) AND NOT (starts_with(path, 'src/app/') OR ({_BASE} = 'models.py' AND NOT regexp_matches(path, '^app1[^/]*/models.py$')) OR regexp_matches(path, '(^|/)m[0-3][0-9]*[.]py$')) AS matched FROM files_v")
def path_match(spark, d):
    include = ("*.py", "# a comment", "", "/web/  ", "!web/pages/**")
    exclude = ("models.py", "!app1*/models.py", "src/app/", "!src/app/views/page1*.py", "m[0-3]*.py", "!\\m9*.p\\y", "**/m[0-3]*.py")
    return v.files(spark, d).select("repo_id", "path", fs.path_match("path", include, exclude).alias("matched"))


_REAL = """steps AS (SELECT repo_id, path, string_split(path, '/')[:-2] AS base, string_split(link_target, '/') AS rest, 1 AS hops FROM links_v WHERE NOT starts_with(link_target, '/') UNION ALL
  SELECT s.repo_id, s.path, CASE WHEN s.rest[1] IN ('', '.') THEN s.base WHEN s.rest[1] = '..' THEN s.base[:len(s.base) - 1] WHEN l.path IS NULL THEN list_append(s.base, s.rest[1]) ELSE s.base END,
    CASE WHEN l.path IS NULL THEN s.rest[2:] ELSE list_concat(string_split(l.link_target, '/'), s.rest[2:]) END, s.hops + (l.path IS NOT NULL)::int
  FROM steps s LEFT JOIN links_v l ON l.repo_id = s.repo_id AND l.path = array_to_string(list_append(s.base, s.rest[1]), '/') AND s.rest[1] NOT IN ('', '.', '..')
  WHERE len(s.rest) > 0 AND NOT (s.rest[1] = '..' AND len(s.base) = 0) AND s.hops <= 40 AND NOT starts_with(coalesce(l.link_target, ''), '/')),
real AS (SELECT DISTINCT s.repo_id, s.path AS link, f.path AS path FROM steps s JOIN files_v f ON f.repo_id = s.repo_id AND f.path = array_to_string(s.base, '/') WHERE len(s.rest) = 0)"""


@query(f"WITH RECURSIVE {_REAL} SELECT l.repo_id, l.path, r.path AS real_path, coalesce(r.wanted, false) AS contained FROM links_v l LEFT JOIN (SELECT repo_id, link, path, {_WANT} AS wanted FROM real) r ON r.repo_id = l.repo_id AND r.link = l.path UNION ALL SELECT repo_id, path, path, true FROM files_v")
def link_contained(spark, d):
    files = v.files(spark, d).unionByName(v.links(spark, d))
    return fs.with_real_paths(files).select("repo_id", "path", "real_path", fs.link_contained().alias("contained"))


@query(f"WITH RECURSIVE {_REAL} SELECT repo_id, path, size, md5(content) AS content_md5 FROM files_v UNION ALL SELECT r.repo_id, link, size, md5(content) FROM (SELECT *, {_WANT} AS wanted FROM real) r JOIN files_v f ON f.repo_id = r.repo_id AND f.path = r.path WHERE wanted")
def follow_links(spark, d):
    files = v.files(spark, d).unionByName(v.links(spark, d))
    return fs.follow_links(files).select("repo_id", "path", "size", F.md5("content").alias("content_md5"))


_WALK = "list_transform(string_split(path, '/'), lambda x, i: (CASE WHEN i < len(string_split(path, '/')) THEN '1' ELSE '0' END) || x)"


@query(f"SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY {_WALK}) AS walk_rank FROM files_v WHERE {_KEPT}")
def list_files(spark, d):
    return fs.list_files(v.files(spark, d))


@query(f"SELECT repo_id, count(*) AS found, count(*) FILTER ({_KEPT}) AS kept, count(*) FILTER (NOT {_KEPT}) AS dropped, count(*) FILTER ({_KEPT} AND content IS NULL) AS unreadable FROM files_v GROUP BY 1")
def count_files(spark, d):
    return fs.count_files(v.files(spark, d))


_P = "('/' || lower(path))"
_GO = f"ends_with({_P}, '.go')"
_LAYER = f"""CASE WHEN NOT {_ends(_P, C.SOURCE_EXT)} OR {_TEST} THEN NULL
WHEN {_LB} IN ('urls.py', 'routes.rb', 'routes.ts', 'router.ts', 'routes.js', 'router.js') OR ends_with({_LB}, '_router.ts') OR {_has(_P, ('/pages/api/', '/routes/', '/urls/'))} OR ({_GO} AND ({_LB} IN ('server.go', 'router.go', 'routes.go', 'mux.go') OR ({_LB} = 'main.go' AND contains({_P}, '/cmd/')))) THEN 'route'
WHEN contains({_P}, 'middleware') OR {_ends(_LB, ('decorator.py', 'decorators.py'))} OR {_LB} = 'computed_settings.py' THEN 'middleware'
WHEN {_has(_P, ('/views/', '/controllers/', '/handlers/'))} OR {_LB} = 'views.py' OR {_ends(_LB, ('view.py', '_views.py', 'controller.rb'))} OR ({_GO} AND ({_LB} IN ('handler.go', 'handlers.go') OR {_ends(_LB, ('_api.go', '_handler.go', '_handlers.go'))} OR contains({_P}, '/handler/'))) THEN 'handler'
WHEN {_has(_P, ('/actions/', '/services/', '/domain/'))} OR (contains({_P}, '/use') AND contains({_P}, 'case')) OR ({_GO} AND ({_LB} = 'service.go' OR ends_with({_LB}, '_service.go') OR contains({_P}, '/service/'))) THEN 'service'
WHEN {_has(_P, ('/models/', '/repositories/', '/repository/'))} OR {_LB} IN ('models.py', 'schema.rb') OR ({_GO} AND ({_LB} IN ('db.go', 'database.go', 'store.go', 'queries.go') OR {_ends(_LB, ('_store.go', '.sql.go', '_repository.go'))} OR {_has(_P, ('/store/', '/db/', '/database/', '/sqlc/'))})) THEN 'database'
WHEN contains({_P}, 'serializer') OR (starts_with({_LB}, 'response') AND ends_with({_LB}, '.py')) OR ({_GO} AND ({_LB} = 'response.go' OR ends_with({_LB}, '_response.go') OR contains({_P}, '/dto/'))) THEN 'response' END"""


@query(f"SELECT repo_id, path, {_LAYER} AS layer FROM files_v")
def backend_layer(spark, d):
    return v.files(spark, d).select("repo_id", "path", classify.backend_layer("path").alias("layer"))


_BACKEND = f"(NOT ({_CRED}) AND regexp_extract({_LB}, '^\\.*[^.].*?(\\.[^.]*)$', 1) IN {_in(C.SOURCE_EXT)} AND NOT list_has_any(string_split(path, '/')[:-2], {v._list(C.BACKEND_SKIP_DIRS)}) AND size <= {C.MAX_FILE_BYTES})"
_LAYER_COUNTS = f"layered AS (SELECT repo_id, path, content, CASE WHEN {_BACKEND} THEN {_LAYER} END AS layer FROM files_v), layer_counts AS (SELECT repo_id, " + ", ".join(f"count(*) FILTER (layer = '{x}') AS {x}" for x in C.LAYERS) + " FROM layered GROUP BY 1)"


@query(f"WITH {_LAYER_COUNTS} SELECT * FROM layer_counts")
def layer_counts(spark, d):
    return classify.layer_counts(v.files(spark, d))


_KIND = f"""CASE WHEN starts_with({_LB}, 'docker-compose') OR {_LB} IN ('compose.yaml', 'compose.yml') THEN 'compose' WHEN {_BASE} = 'Procfile' THEN 'gateway' WHEN starts_with({_LB}, '.env') THEN 'env' WHEN {_ends(_LB, ('.tf', '.tfvars'))} THEN 'iac' WHEN {_BASE} IN {_in(C.GATEWAY_NAMES)} THEN 'gateway'
WHEN {_LB} = 'package.json' THEN 'package' WHEN {_LB} = 'go.mod' THEN 'go_mod' WHEN {_LB} = 'pyproject.toml' THEN 'pyproject' WHEN starts_with({_LB}, 'requirements') AND ends_with({_LB}, '.txt') THEN 'requirements' WHEN {_ends(_LB, ('.yaml', '.yml'))} AND {_has("('/' || path)", C.K8S_DIRS)} THEN 'k8s' END"""


@query(f"SELECT repo_id, path, {_KIND} AS kind FROM files_v")
def arch_source_kind(spark, d):
    return v.files(spark, d).select("repo_id", "path", classify.arch_source_kind("path").alias("kind"))


@query(f"SELECT repo_id, path, NOT {_TEST} AND ({_BASE} IN {_in(C.ROUTE_NAMES)} OR {_ends(_BASE, ('_router.ts', '.proto', '.graphql'))} OR (contains('/' || path, '/pages/api/') AND {_ends('path', ('.ts', '.js', '.tsx'))}) OR (contains('/' || path, '/app/') AND {_BASE} IN ('route.ts', 'route.js', 'route.tsx'))) AS is_route FROM files_v")
def is_route_file(spark, d):
    return v.files(spark, d).select("repo_id", "path", classify.is_route_file("path").alias("is_route"))


_BARE_GO = "regexp_replace(content, '//[^\n]*', '', 'g')"
_N_REG = f"len(regexp_extract_all({_BARE_GO}, {v._lit(C.GO_REGISTRATION)}))"
_BUILDS = f"regexp_matches({_BARE_GO}, {v._lit(C.GO_BUILDS_SERVER)})"


@query(f"SELECT repo_id, path, {_N_REG}::int AS n, {_BUILDS} AS builds FROM files_v WHERE path LIKE '%.go'")
def go_route_registrations(spark, d):
    go = v.files(spark, d).where(F.col("path").endswith(".go"))
    return go.select("repo_id", "path", classify.go_route_registrations("content").alias("g")).select("repo_id", "path", "g.n", "g.builds")


_MANIFEST_NAME = f"({_BASE} IN {_in(C.ROUTE_NAMES)} OR {_ends(_BASE, ('_router.ts', '.proto', '.graphql'))})"
_ROUTE_FILE = f"(NOT {_TEST} AND ({_MANIFEST_NAME} OR (contains('/' || path, '/pages/api/') AND {_ends('path', ('.ts', '.js', '.tsx'))}) OR (contains('/' || path, '/app/') AND {_BASE} IN ('route.ts', 'route.js', 'route.tsx'))))"
_SURFACE = f"""seen AS (SELECT * FROM files_v WHERE NOT list_has_any(string_split(path, '/')[:-2], {v._list(C.INTERFACES_SKIP_DIRS)}) AND NOT {_TEST}),
scanned AS (SELECT * FROM seen WHERE ends_with(path, '.go') AND NOT {_ROUTE_FILE} AND size <= {C.MAX_FILE_BYTES}),
go AS (SELECT repo_id, path, CASE WHEN n >= 5 AND builds THEN 1 ELSE 2 END AS tier, n AS weight FROM (SELECT repo_id, path, {_N_REG} AS n, {_BUILDS} AS builds FROM scanned) WHERE n > 0),
surface AS (SELECT repo_id, path, CASE WHEN {_MANIFEST_NAME} THEN 0 ELSE 2 END AS tier, 0 AS weight FROM seen WHERE {_ROUTE_FILE} UNION ALL SELECT * FROM go
  UNION ALL SELECT repo_id, path, 2, 0 FROM scanned WHERE regexp_matches(path, '(^|/)cmd/(.*/)?main\\.go$') AND regexp_matches(content, {v._lit(C.GO_SERVES)}) AND repo_id NOT IN (SELECT repo_id FROM go))"""


@query(f"WITH {_SURFACE} SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tier, CASE WHEN tier = 1 THEN -weight ELSE 0 END, path) AS surface_rank FROM surface")
def surface_files(spark, d):
    return classify.surface_files(v.files(spark, d))


_DIRS = f"""subs AS (SELECT DISTINCT f.repo_id, k, c AS dir, string_split(substr(path, length(c) + 2), '/')[1] AS name FROM files_v f, (SELECT unnest({v._list(C.INTEGRATION_DIRS)}) AS c, generate_subscripts({v._list(C.INTEGRATION_DIRS)}, 1) AS k) WHERE starts_with(path, c || '/') AND contains(substr(path, length(c) + 2), '/')),
dirs AS (SELECT repo_id, dir, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM subs s WHERE NOT regexp_matches(name, '^[_.]') AND k = (SELECT min(k) FROM subs t WHERE t.repo_id = s.repo_id AND NOT regexp_matches(name, '^[_.]')) GROUP BY 1, 2)"""


@query(f"WITH {_DIRS} SELECT repo_id, dir, names FROM dirs")
def integration_dirs(spark, d):
    return classify.integration_dirs(v.files(spark, d))


# ---- budgets

_BLOCK = {"selected": 129, "whole": 131, "routes": 130}  # characters of a block besides its path and text
_WALKED = f"walked AS (SELECT repo_id, path, length(content) AS len, row_number() OVER (PARTITION BY repo_id ORDER BY {_WALK}) AS ord, content FROM files_v)"


@query(f"""WITH {_WALKED}, t AS (SELECT repo_id, string_agg('  [' || (ord - 1) || '] ' || path || chr(10) || substr(content, 1, 800) || chr(10), chr(10) ORDER BY ord) AS text FROM walked WHERE ord <= 12 GROUP BY 1), n AS (SELECT repo_id, count(*) AS n, count(*) FILTER (ord <= 12) AS previewed FROM walked GROUP BY 1)
SELECT repo_id, previewed, n - previewed AS dropped, least(50, greatest(20, previewed // 20)) AS target, length(text)::int AS text_chars, md5(text) AS text_md5 FROM n JOIN t USING (repo_id)""")
def preview_manifest(spark, d):
    return budget.preview_manifest(v.files(spark, d), 9_600)


_BEFORE = f"b AS (SELECT *, coalesce(sum(len + length(path) + {_BLOCK['selected']}) OVER (PARTITION BY repo_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM walked)"


@query(f"WITH {_WALKED}, {_BEFORE} SELECT repo_id, path, len, ord, before FROM b WHERE before < 20000")
def budget_prefix(spark, d):
    return budget.budget_prefix(budget.walked(v.files(spark, d)), 20_000)


@query(f"WITH {_WALKED}, b AS (SELECT *, sum(length('-- ===== ' || path || ' =====' || chr(10)) + len) OVER (PARTITION BY repo_id ORDER BY ord)::bigint AS upto FROM walked) SELECT repo_id, path, len, ord FROM b WHERE (upto <= 20000 OR ord = 1) AND ord <= 40")
def budget_prefix_min1(spark, d):
    return budget.budget_prefix_min1(budget.walked(v.files(spark, d)), 20_000).select("repo_id", "path", "len", "ord")


@query(f"""WITH RECURSIVE {_WALKED}, fit AS (SELECT repo_id, 0::bigint AS n, 20000::bigint AS rest, false AS taken FROM walked GROUP BY 1 UNION ALL
  SELECT f.repo_id, w.ord, f.rest - CASE WHEN w.len + length(w.path) + {_BLOCK['whole']} <= f.rest THEN w.len + length(w.path) + {_BLOCK['whole']} ELSE 0 END, w.len + length(w.path) + {_BLOCK['whole']} <= f.rest FROM fit f JOIN walked w ON w.repo_id = f.repo_id AND w.ord = f.n + 1)
SELECT w.repo_id, w.path, w.len, w.ord FROM walked w JOIN fit f ON f.repo_id = w.repo_id AND f.n = w.ord WHERE f.taken""")
def budget_greedy(spark, d):
    return budget.budget_greedy(budget.walked(v.files(spark, d)), 20_000)


#: One file after the other, as the rule says: shares first, then the turns of what was set aside.
_FAIR = f"""{_LAYER_COUNTS}, queue AS (SELECT repo_id, layer, path, length(content) AS len, NOT regexp_matches(content, '[^ \\t\\n\\r\\f\\v]') AS blank, list_position({v._list(C.BUNDLE_ORDER)}, layer) AS turn, layer IN {_in(C.SAMPLED_LAYERS)} AS sampled,
  row_number() OVER (PARTITION BY repo_id, layer ORDER BY CASE WHEN layer IN {_in(C.SAMPLED_LAYERS)} THEN CASE WHEN regexp_matches({_LB}, {v._lit('|'.join(C.CORE_HINTS))}) THEN 0 ELSE 1 END WHEN ends_with(path, 'main.go') THEN 1 ELSE 0 END, path) AS ord FROM layered WHERE layer IS NOT NULL),
populated AS (SELECT repo_id, turn, count(*) OVER (PARTITION BY repo_id ORDER BY turn DESC) AS to_come FROM (SELECT DISTINCT repo_id, turn FROM queue)),
todo AS (SELECT repo_id, layer, path, len, ord, turn, sampled, to_come, len + length(chr(10) || '===== LAYER ' || upper(layer) || ': ' || path || ' =====' || chr(10) || chr(10)) AS cost, row_number() OVER (PARTITION BY repo_id ORDER BY turn, ord) AS n FROM queue JOIN populated USING (repo_id, turn) WHERE NOT blank),
start AS (SELECT repo_id, 60000 - length('===== LAYER FILE COUNTS (whole repo) =====' || chr(10) || {" || ".join(f"'{x}: ' || {x} || ' files' || chr(10)" for x in C.LAYERS)}) AS rest FROM layer_counts),
first AS (SELECT repo_id, 0::bigint AS n, 0::bigint AS turn, rest::bigint AS rest, 0::bigint AS room, 0::bigint AS had, '' AS verdict FROM start UNION ALL
  SELECT repo_id, n, turn, rest - CASE WHEN verdict = 'taken' THEN cost ELSE 0 END, room - CASE WHEN verdict = 'taken' THEN cost ELSE 0 END, had + CASE WHEN verdict = 'taken' THEN 1 ELSE 0 END, verdict FROM (
    SELECT *, CASE WHEN sampled AND had >= 18 THEN 'over' WHEN cost <= room THEN 'taken' ELSE 'aside' END AS verdict FROM (
      SELECT t.repo_id, t.n, t.turn::bigint AS turn, t.sampled, t.cost, f.rest, CASE WHEN t.turn = f.turn THEN f.room ELSE floor(f.rest / t.to_come::double)::bigint END AS room, CASE WHEN t.turn = f.turn THEN f.had ELSE 0 END AS had FROM first f JOIN todo t ON t.repo_id = f.repo_id AND t.n = f.n + 1))),
done AS (SELECT repo_id, min(rest) AS rest FROM first GROUP BY 1), filled AS (SELECT repo_id, turn, count(*) AS had FROM first WHERE verdict = 'taken' GROUP BY 1, 2),
turns AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round, turn) AS k FROM (SELECT t.repo_id, t.turn, t.n, t.cost, t.sampled, row_number() OVER (PARTITION BY t.repo_id, t.turn ORDER BY t.ord) AS round FROM todo t JOIN first f ON f.repo_id = t.repo_id AND f.n = t.n WHERE f.verdict = 'aside')),
counted AS (SELECT d.repo_id, d.rest, list(coalesce(c.had, 0)::bigint ORDER BY x) AS had FROM done d CROSS JOIN range(1, 7) r(x) LEFT JOIN filled c ON c.repo_id = d.repo_id AND c.turn = x GROUP BY 1, 2),
later AS (SELECT repo_id, 0::bigint AS k, rest, had, false AS taken FROM counted UNION ALL
  SELECT repo_id, k, rest - CASE WHEN ok THEN cost ELSE 0 END, list_transform(had, lambda x, i: x + CASE WHEN ok AND i = turn THEN 1 ELSE 0 END), ok FROM (
    SELECT l.repo_id, t.k, l.rest, l.had, t.cost, t.turn, t.cost <= l.rest AND NOT (t.sampled AND l.had[t.turn] >= 18) AS ok FROM later l JOIN turns t ON t.repo_id = l.repo_id AND t.k = l.k + 1)),
chosen AS (SELECT repo_id, n FROM first WHERE verdict = 'taken' UNION ALL SELECT t.repo_id, t.n FROM later l JOIN turns t USING (repo_id, k) WHERE taken), fair AS (SELECT repo_id, layer, path, len, ord FROM todo JOIN chosen USING (repo_id, n))"""


@query(f"WITH RECURSIVE {_FAIR} SELECT * FROM fair")
def budget_fair_share(spark, d):
    f = v.files(spark, d)
    return budget.budget_fair_share(budget.layer_queue(f), 60_000, headers=budget.counts_header(classify.layer_counts(f)))


@query(f"""WITH {_WALKED}, b AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY repo_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start, sum(len + 1) OVER (PARTITION BY repo_id) - 1 > 20000 AS truncated FROM walked)
SELECT repo_id, path, start, least(len, 20000 - start) AS kept_chars, truncated FROM b WHERE start < 20000""")
def budget_slice(spark, d):
    return budget.budget_slice(budget.walked(v.files(spark, d)), 20_000)


@query(f"""WITH {_WALKED}, {_BEFORE}
SELECT repo_id, count(*)::int AS n_files, md5(string_agg(repeat('=', 60) || chr(10) || 'File: ' || path || chr(10) || repeat('=', 60) || chr(10) || content || chr(10), chr(10) ORDER BY ord)) AS bundle_md5 FROM b WHERE before < 20000 GROUP BY 1""")
def bundle_text(spark, d):
    f = v.files(spark, d)
    return budget.bundle_text(budget.budget_prefix(budget.walked(f), 20_000), f).select("repo_id", "n_files", F.md5("bundle").alias("bundle_md5"))


@query(f"WITH {_WALKED}, {_BEFORE} SELECT repo_id, path, len, ord FROM b WHERE before >= 20000")
def included_dropped(spark, d):
    rows = budget.walked(v.files(spark, d))
    return budget.included_dropped(rows, budget.budget_prefix(rows, 20_000)).select("repo_id", "path", "len", "ord")


#: Names of a reply: a path's last two segments, also with blanks and backticks around them, slashes before them, as a path with steps, beyond the root, and the last segment alone.
_NAMED = """named AS (SELECT repo_id, doc_id AS ord, CASE doc_id % 7 WHEN 0 THEN ' `' || path || '` ' WHEN 1 THEN '//' || array_to_string(string_split(path, '/')[-2:], '/') WHEN 2 THEN './x/../' || path WHEN 3 THEN '../' || path WHEN 4 THEN string_split(path, '/')[-1] WHEN 5 THEN 'foo..bar.py' ELSE array_to_string(string_split(path, '/')[-2:], '/') END AS raw FROM files_v),
asked AS (SELECT repo_id, ord, ltrim(trim(trim(raw), '`'), '/') AS name, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS n FROM named)"""


@query(f"""WITH {_NAMED}, {_WALKED}, met AS (SELECT a.repo_id, a.n, w.path, w.len, w.content, w.path <> regexp_replace(a.name, '^[.]/x/[.][.]/', '') AS d, w.ord FROM asked a JOIN walked w ON w.repo_id = a.repo_id AND a.n <= 8 AND (w.path = regexp_replace(a.name, '^[.]/x/[.][.]/', '') OR (ends_with('/' || w.path, '/' || a.name) AND NOT list_has_any(string_split(w.path, '/')[:-2], {v._list(C.INTERFACES_SKIP_DIRS)})))),
hit AS (SELECT repo_id, n, path, least(len, 40000) AS chars FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY repo_id, n ORDER BY d, ord) = 1) WHERE regexp_matches(content, '[^ \\t\\n\\r\\f\\v]') AND NOT ({_CRED})),
taken AS (SELECT repo_id, n, path, chars FROM (SELECT *, sum(chars + length(path) + {_BLOCK['routes']}) OVER (PARTITION BY repo_id ORDER BY n) AS upto FROM hit) WHERE upto <= 9000)
SELECT repo_id, ord, name, path, chars, path IS NULL AS skipped FROM asked LEFT JOIN taken USING (repo_id, n)""")
def resolve_named_paths(spark, d):
    f = v.files(spark, d)
    tail = lambda k: F.array_join(F.slice(F.split("path", "/"), -k, k), "/")
    short = F.when(F.size(F.split("path", "/")) > 1, tail(2)).otherwise(F.col("path"))
    kinds = [F.concat(F.lit(" `"), "path", F.lit("` ")), F.concat(F.lit("//"), short), F.concat(F.lit("./x/../"), "path"), F.concat(F.lit("../"), "path"), tail(1), F.lit("foo..bar.py"), short]
    named = f.select("repo_id", F.col("doc_id").alias("ord"), F.get(F.array(*kinds), (F.col("doc_id") % 7).cast("int")).alias("name"))
    return budget.resolve_named_paths(named, f, max_chars=9_000)


@query("SELECT repo_id, arg_max(path, (contains('/' || path, '/pages/api/'), size, path)) AS path, arg_max(size, (contains('/' || path, '/pages/api/'), size, path)) AS size FROM files_v GROUP BY 1")
def largest_file(spark, d):
    return budget.largest_file(v.files(spark, d))


@query(f"""WITH {_WALKED}, b AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY repo_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM walked),
k AS (SELECT *, least(len, 20000 - start) AS kept, string_split(substr(content, 1, least(len, 20000 - start)), chr(10)) AS ls FROM b WHERE start < 20000),
w AS (SELECT repo_id, path, CASE WHEN kept < len THEN ls[:len(ls) - 1] ELSE ls END AS ls FROM k) SELECT repo_id, path, unnest(ls) AS text, generate_subscripts(ls, 1)::int AS line FROM w""")
def whole_lines(spark, d):
    f = v.files(spark, d)
    return budget.whole_lines(budget.budget_slice(budget.walked(f), 20_000), f)


# ---- architecture

@query("SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:export[ \\t]+)?([A-Z][A-Z0-9_]+)[ \\t]*=', 1)) AS name FROM files_v WHERE path LIKE 'deploy%/.env.example'")
def env_names(spark, d):
    return arch.env_names(v.files(spark, d))


@query("SELECT repo_id, path, content IS NOT NULL AS read, length(content) > 40000 AS cut, len(regexp_extract_all(substr(content, 1, 40000), '(?m)^[ \\t]*(?:export[ \\t]+)?[A-Z][A-Z0-9_]+[ \\t]*=')) AS n_names FROM files_v WHERE path LIKE 'deploy%/.env.example'")
def env_files(spark, d):
    return arch.env_files(v.files(spark, d))


_PKG = """SELECT repo_id, path AS manifest_path, 'package' AS kind, name, arg_max(json_extract_string(j, '$.' || g || '."' || name || '"'), g) AS version FROM (SELECT repo_id, path, j, g, unnest(json_keys(j, '$.' || g)) AS name
  FROM (SELECT repo_id, path, CASE WHEN json_valid(content) THEN content::json END AS j, unnest(['dependencies', 'devDependencies']) AS g FROM files_v WHERE path LIKE '%/package.json')) GROUP BY repo_id, path, name"""
_GOM = r"""SELECT repo_id, path AS manifest_path, 'go_mod' AS kind, name, arg_max(version, pos) AS version FROM (SELECT repo_id, path, pos, regexp_extract(line, CASE WHEN inside THEN '^(\S+)\s+(\S+)$' ELSE '^require\s+([^\s(]\S*)\s+(\S+)$' END, 1) AS name, regexp_extract(line, CASE WHEN inside THEN '^(\S+)\s+(\S+)$' ELSE '^require\s+([^\s(]\S*)\s+(\S+)$' END, 2) AS version
  FROM (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^require\s*\($') THEN true WHEN line = ')' THEN false END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside
    FROM (SELECT *, regexp_replace(regexp_replace(raw, '//.*$', ''), '^\s+|\s+$', '', 'g') AS line, trim(regexp_extract(raw, '//(.*)$', 1)) AS note FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM files_v WHERE path LIKE '%/go.mod')))
  WHERE note <> 'indirect' AND NOT regexp_matches(line, '^require\s*\($')) WHERE name <> '' GROUP BY repo_id, path, name"""


def _pep508(kind: str, specs: str) -> str:
    """Names and constraints of ``specs``, SQL for (repo_id, path, spec, pos)."""
    return rf"""SELECT repo_id, path AS manifest_path, '{kind}' AS kind, name, arg_max(trim(regexp_extract(regexp_replace(rest, '^\[[^\]]*\]', ''), '^[^;]*')), pos) AS version
  FROM (SELECT *, substr(spec, length(name) + 1) AS rest FROM (SELECT *, regexp_extract(spec, '^[A-Za-z0-9][A-Za-z0-9._-]*') AS name FROM ({specs})))
  WHERE name <> '' AND regexp_matches(rest, '^($|[ \t\[<>=!~;])') AND NOT regexp_matches(rest, '^\s*@') AND NOT regexp_matches(rest, '^\[[^\]]*$') GROUP BY repo_id, path, name"""


#: The stand-in's arrays of TOML stand on one line each.
_PYP = _pep508("pyproject", r"""SELECT repo_id, path, unnest(ss) AS spec, generate_subscripts(ss, 1) AS pos FROM (SELECT repo_id, path, regexp_extract_all(array_to_string(regexp_extract_all(content, '(?m)^\w+ = \[(.*)\]$', 1), ','), '"([^"]*)"', 1) AS ss FROM files_v WHERE path LIKE '%/pyproject.toml' AND regexp_matches(content, '(?m)^\[project\]$'))""")
_REQ = _pep508("requirements", r"""SELECT repo_id, path, trim(regexp_replace(trim(raw), '\s+-.*$', '')) AS spec, pos FROM (SELECT repo_id, path, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM (SELECT repo_id, path, string_split(regexp_replace(regexp_replace(content, '#[^\n]*', '', 'g'), '\\[ \t]*\n', '', 'g'), chr(10)) AS ls FROM files_v WHERE path LIKE '%/requirements.txt'))
  WHERE NOT regexp_matches(trim(raw), '^(-r|-e|-c|--|\.|/)')""")
_DEPS = f"deps AS ({_PKG} UNION ALL {_GOM} UNION ALL {_REQ} UNION ALL {_PYP})"


@query(_PKG)
def deps_package_json(spark, d):
    return arch.deps_package_json(v.files(spark, d))


@query(_GOM)
def deps_go_mod(spark, d):
    return arch.deps_go_mod(v.files(spark, d))


@query(_REQ)
def deps_requirements(spark, d):
    return arch.deps_requirements(v.files(spark, d))


@query(_PYP)
def deps_pyproject(spark, d):
    return arch.deps_pyproject(v.files(spark, d))


_UNITED = f"{_DEPS}, united AS (SELECT repo_id, name, arg_max(version, (list_transform(string_split(manifest_path, '/'), lambda x, i: (CASE WHEN i < len(string_split(manifest_path, '/')) THEN '1' ELSE '0' END) || x), version)) AS version FROM deps GROUP BY 1, 2)"


@query(f"WITH {_UNITED} SELECT * FROM united")
def dependency_union(spark, d):
    return arch.dependency_union(arch.all_deps(v.files(spark, d)))


@query(f"WITH {_DEPS} SELECT name, count(DISTINCT repo_id) AS repos FROM deps GROUP BY 1 ORDER BY repos DESC, name LIMIT 50")
def dependency_usage(spark, d):
    return arch.dependency_usage(arch.all_deps(v.files(spark, d)))


@query(f"""WITH p AS (SELECT repo_id, {_KIND} AS kind, content IS NULL AS gone, length(content) > 200000 AS long, ({_KIND} = 'package' AND NOT json_valid(content)) OR ({_KIND} = 'pyproject' AND NOT regexp_matches(content, '(?m)^\\[project\\]$')) AS bad FROM files_v WHERE {_KIND} IN ('package', 'go_mod', 'pyproject', 'requirements')),
n AS (SELECT repo_id, kind, count(*) AS manifests, count(*) FILTER (gone) AS unreadable, count(*) FILTER (bad AND NOT long) AS malformed, count(*) FILTER (long AND NOT bad) AS truncated, count(*) FILTER (long AND bad) AS truncated_unparsable FROM p GROUP BY 1, 2)
SELECT *, CASE WHEN malformed > 0 THEN malformed || CASE kind WHEN 'package' THEN ' package.json' ELSE ' pyproject.toml' END || CASE WHEN malformed = 1 THEN ' file ' ELSE ' files ' END || CASE kind WHEN 'package' THEN 'could not be parsed as JSON' ELSE 'could not be parsed as TOML' END ELSE '' END AS note FROM n""")
def manifest_problems(spark, d):
    return arch.manifest_problems(v.files(spark, d))


@query()
def redact_config(spark, d):
    return arch.redact_config(v.files(spark, d))


_JS_LINE = v._lit(arch.JS_LINE)
#: The stand-in's Go clients are named by the third segment of their path.
_SDK = f"""js AS (SELECT repo_id, path, line, text FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::int AS line FROM files_v WHERE regexp_matches(path, '\\.(ts|tsx|js|py)$')) WHERE regexp_matches(text, {_JS_LINE})),
gol AS (SELECT repo_id, path, line, regexp_extract(text, {v._lit(C.GO_PATH)}, 1) AS module FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::int AS line FROM files_v WHERE path LIKE '%.go')),
sdk_all AS (SELECT repo_id, path, line, regexp_replace(CASE WHEN regexp_extract(text, {v._lit(C.SDK)}, 1) <> '' THEN regexp_extract(text, {v._lit(C.SDK)}, 1) WHEN regexp_extract(text, 'new (Stripe|Twilio|Redis|S3Client)', 1) <> '' THEN regexp_extract(text, 'new (Stripe|Twilio|Redis|S3Client)', 1) ELSE 'sdk' END, '[''"@]', '', 'g') AS sdk, 0 AS part FROM js
  UNION ALL SELECT repo_id, path, line, string_split(module, '/')[3], 1 FROM gol WHERE module <> ''),
sdk AS (SELECT repo_id, part, path, line, sdk, count(*) OVER (PARTITION BY repo_id) > 400 AS capped FROM sdk_all QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY part, path, line, sdk) <= 400)"""


@query(f"WITH {_SDK} SELECT * FROM sdk")
def sdk_imports(spark, d):
    return arch.sdk_imports(v.files(spark, d))


_ENV = "env AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:export[ \\t]+)?([A-Z][A-Z0-9_]+)[ \\t]*=', 1)) AS name FROM files_v WHERE path LIKE 'deploy%/.env.example')"
#: The configuration of the stand-in is Secrets with a password and a URL, and the text of each file is read here.
_EVIDENCE = rf"""{_SDK}, {_UNITED}, {_ENV}, {_DIRS}, kinds AS (SELECT repo_id, path, content, {_KIND} AS kind, {_WALK} AS walk FROM files_v WHERE NOT list_has_any(string_split(path, '/')[:-2], {v._list(C.ARCH_SKIP_DIRS)})),
configs AS (SELECT repo_id, path, kind, walk, length(content) > 200000 AS cut, regexp_replace(regexp_replace(content, '(?m)^(  password: ).+$', '\1[REDACTED]', 'g'), '(://[^\s:/@]*:)[^\s/@]+@', '\1[REDACTED]@', 'g') AS text FROM kinds WHERE kind IN ('compose', 'k8s', 'gateway', 'iac')),
parts AS (SELECT repo_id, list_position({v._list(C.CONFIG_LABELS)}, kind) AS rank, walk, path, '===== ' || ({v._list(C.CONFIG_LABELS.values())})[list_position({v._list(C.CONFIG_LABELS)}, kind)] || ': ' || path || ' =====' || chr(10) || text || chr(10) AS text FROM configs WHERE regexp_matches(text, '\S')
  UNION ALL SELECT repo_id, 5, [], NULL, '===== ENVIRONMENT VARIABLE NAMES (values omitted) =====' || chr(10) || string_agg(name, chr(10) ORDER BY name) || chr(10) FROM env GROUP BY 1
  UNION ALL SELECT repo_id, 6, [], NULL, '===== DEPENDENCY MANIFESTS (name @ version) =====' || chr(10) || string_agg(name || ' @ ' || version, chr(10) ORDER BY name) || chr(10) FROM united GROUP BY 1
  UNION ALL SELECT repo_id, 7, [], NULL, '===== INTEGRATION DIRECTORIES (' || dir || ', ' || n || ' total) =====' || chr(10) || replace(names, ',', ', ') || chr(10) FROM dirs
  UNION ALL SELECT repo_id, 8, [], NULL, CASE WHEN bool_or(capped) THEN {v._lit(arch.SDK_HEAD_CAPPED)} ELSE {v._lit(arch.SDK_HEAD)} END || string_agg(path || ':' || line || ': ' || sdk, chr(10) ORDER BY part, path, line, sdk) || chr(10) FROM sdk GROUP BY 1),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY repo_id ORDER BY rank, walk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(text) + 1) OVER (PARTITION BY repo_id) - 1 AS whole FROM parts),
bundle AS (SELECT repo_id, substr(string_agg(text, chr(10) ORDER BY start), 1, 900) || CASE WHEN max(whole) > 900 THEN chr(10) || chr(10) || '===== BUNDLE TRUNCATED at 900 of ' || format('{{:,}}', max(whole)::bigint) || ' chars -- the sources above are incomplete =====' || chr(10) ELSE '' END AS bundle, max(whole) > 900 AS truncated FROM placed GROUP BY 1),
disclosed AS (SELECT repo_id, path, start FROM placed WHERE path IS NOT NULL UNION ALL SELECT f.repo_id, f.path, p.start FROM files_v f JOIN placed p ON p.repo_id = f.repo_id AND p.rank = 5 WHERE f.path LIKE 'deploy%/.env.example' UNION ALL SELECT DISTINCT x.repo_id, x.manifest_path, p.start FROM deps x JOIN placed p ON p.repo_id = x.repo_id AND p.rank = 6),
sdk_cut AS (SELECT p.repo_id, 900 - start - length(string_split(text, chr(10))[1]) - 1 AS room FROM placed p WHERE rank = 8),
sdk_kept AS (SELECT s.repo_id, count(*) AS n FROM (SELECT *, sum(length(path || ':' || line || ': ' || sdk) + 1) OVER (PARTITION BY repo_id ORDER BY part, path, line, sdk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS upto FROM sdk) s JOIN sdk_cut c ON c.repo_id = s.repo_id WHERE upto <= room GROUP BY 1),
stats AS (SELECT r.repo_id, coalesce(n.configs, 0) AS configs, coalesce(n.included, 0) AS included, 0 AS unreadable, coalesce(n.cut, 0) AS cut, 0 AS env_unreadable, 0 AS env_cut, (SELECT count(*) FROM env e WHERE e.repo_id = r.repo_id) AS env_vars, (SELECT count(*) FROM united u WHERE u.repo_id = r.repo_id) AS deps,
  coalesce(k.n, 0) AS sdk_lines, coalesce(i.n, 0) AS integrations, coalesce(b.truncated, false) AS truncated, coalesce(k.n > 0 AND (SELECT bool_or(capped) FROM sdk s WHERE s.repo_id = r.repo_id), false) AS sdk_capped
  FROM (SELECT DISTINCT repo_id FROM files_v) r LEFT JOIN (SELECT repo_id, count(*) AS configs, count(*) FILTER (regexp_matches(text, '\S')) AS included, count(*) FILTER (cut) AS cut FROM configs GROUP BY 1) n ON n.repo_id = r.repo_id LEFT JOIN sdk_kept k ON k.repo_id = r.repo_id LEFT JOIN dirs i ON i.repo_id = r.repo_id LEFT JOIN bundle b ON b.repo_id = r.repo_id)"""


@query(f"WITH {_EVIDENCE} SELECT * FROM stats")
def arch_stats(spark, d):
    return arch.arch_stats(v.files(spark, d), 900)


@query(f"WITH {_EVIDENCE} SELECT b.repo_id, md5(bundle) AS bundle_md5, truncated, coalesce(string_agg(path, ',' ORDER BY path) FILTER (start < 900), '') AS files, coalesce(string_agg(path, ',' ORDER BY path) FILTER (start >= 900), '') AS dropped FROM bundle b LEFT JOIN disclosed x ON x.repo_id = b.repo_id GROUP BY 1, 2, 3")
def evidence_bundle(spark, d):
    found = arch.gather(v.files(spark, d))
    placed = arch.placed_sections(arch.evidence_sections(found))
    of = lambda state: F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") == state, F.col("path")))), ",").alias({"included": "files"}.get(state, state))
    lists = arch.evidence_files(found, placed, 900).groupBy("repo_id").agg(of("included"), of("dropped"))
    return arch.evidence_bundle(placed, 900).join(lists, "repo_id", "left").select("repo_id", F.md5("bundle").alias("bundle_md5"), "truncated", F.coalesce("files", F.lit("")).alias("files"), F.coalesce("dropped", F.lit("")).alias("dropped"))


# ---- imports

#: Specifiers from the texts: joined lines, several statements and names on a line, comments apart.
_SPECS = r"""stmts AS (SELECT repo_id, path, unnest(string_split(replace(replace(regexp_replace(content, '#[^\n]*', '', 'g'), '\' || chr(10), ' '), ';', chr(10)), chr(10))) AS s FROM sources_v WHERE path LIKE '%.py'),
pyspecs AS (SELECT DISTINCT repo_id, path, spec FROM (SELECT repo_id, path, regexp_extract(s, '^\s*from\s+([A-Za-z_][\w.]*)\s+import\b', 1) AS spec FROM stmts UNION ALL SELECT repo_id, path, trim(unnest(string_split(regexp_extract(s, '^\s*import\s+(.*)$', 1), ','))) FROM stmts) WHERE regexp_full_match(spec, '[A-Za-z_][\w.]*')),
jsspecs AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(regexp_replace(content, '//[^\n]*', '', 'g'), '\bimport\s+(?:[\w{}*,\s]+\sfrom\s+)?[''"]([^''"]+)[''"]', 1)) AS spec FROM sources_v WHERE regexp_matches(path, '\.(js|mjs|cjs|jsx|ts|tsx)$')),
gospecs AS (SELECT DISTINCT repo_id, path, unnest(list_concat(regexp_extract_all(content, '(?m)^import\s+"([^"]+)"', 1), regexp_extract_all(regexp_extract(content, '(?m)^import\s*\(([^)]*)\)', 1), '["`]([^"`]+)["`]', 1))) AS spec FROM sources_v WHERE path LIKE '%.go'),
specs AS (SELECT repo_id, path, 'py' AS lang, spec FROM pyspecs UNION ALL SELECT repo_id, path, CASE WHEN regexp_matches(path, '\.tsx?$') THEN 'ts' ELSE 'js' END, spec FROM jsspecs UNION ALL SELECT repo_id, path, 'go', spec FROM gospecs)"""


@query(f"WITH {_SPECS} SELECT * FROM specs")
def extract_imports(spark, d):
    return imports.extract_imports(v.sources(spark, d))


_PYEDGE = "c AS (SELECT repo_id, path, spec, unnest([replace(spec, '.', '/') || '.py', replace(spec, '.', '/') || '/__init__.py']) AS to_path FROM pyspecs), h AS (SELECT DISTINCT c.* FROM c JOIN files_v f ON f.repo_id = c.repo_id AND f.path = c.to_path), pyedge AS (SELECT DISTINCT repo_id, path AS from_path, min(to_path) AS to_path FROM h GROUP BY repo_id, path, spec HAVING count(*) = 1)"


@query(f"WITH {_SPECS}, {_PYEDGE} SELECT * FROM pyedge")
def resolve_python(spark, d):
    f = v.files(spark, d)
    return imports.resolve_python(imports.extract_imports(f), f)


_JSEDGE = r"""jsbase AS (SELECT *, array_to_string(list_append(dirs[:len(dirs) - up], rest), '/') AS base FROM (SELECT *, string_split(path, '/')[:-2] AS dirs, len(regexp_extract_all(spec, '\.\./')) AS up, regexp_replace(spec, '^(\.{1,2}/)+', '') AS rest FROM specs WHERE lang IN ('js', 'ts') AND starts_with(spec, '.'))),
jscand AS (SELECT repo_id, path, spec, base, base AS to_path FROM jsbase UNION ALL SELECT repo_id, path, spec, base, base || unnest(CASE lang WHEN 'js' THEN ['.js', '.mjs', '.cjs', '.jsx', '/index.js', '/index.jsx'] ELSE ['.ts', '.tsx', '/index.ts', '/index.tsx'] END) FROM jsbase WHERE NOT contains(string_split(base, '/')[-1], '.')),
jshit AS (SELECT c.repo_id, path, spec, c.to_path, c.to_path = base AS same, count(*) OVER (PARTITION BY c.repo_id, path, spec) AS n FROM jscand c JOIN (SELECT DISTINCT repo_id, path AS to_path FROM files_v) f ON f.repo_id = c.repo_id AND f.to_path = c.to_path),
jsedge AS (SELECT DISTINCT repo_id, path AS from_path, to_path FROM jshit WHERE same OR n = 1)"""


@query(f"WITH {_SPECS}, {_JSEDGE} SELECT * FROM jsedge")
def resolve_relative_js(spark, d):
    f = v.files(spark, d)
    return imports.resolve_relative_js(imports.extract_imports(f), f)


_GOEDGE = rf"""mods AS (SELECT repo_id, regexp_extract(regexp_replace(replace(content, '"', ''), '//[^\n]*', '', 'g'), 'module\s*\(?\s*([^\s()]+)', 1) AS module FROM sources_v WHERE path = 'go.mod'),
gofile AS (SELECT repo_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files_v WHERE ends_with(path, '.go') AND NOT {_TEST}),
goedge AS (SELECT DISTINCT s.repo_id, s.path AS from_path, g.path AS to_path FROM gospecs s JOIN mods m USING (repo_id) JOIN gofile g ON g.repo_id = s.repo_id AND s.spec || '/' = m.module || '/' || CASE WHEN g.dir = '' THEN '' ELSE g.dir || '/' END WHERE g.dir <> regexp_replace(s.path, '/?[^/]*$', ''))"""


@query(f"WITH {_SPECS}, {_GOEDGE} SELECT * FROM goedge")
def resolve_go_packages(spark, d):
    f = v.sources(spark, d)
    return imports.resolve_go_packages(imports.extract_imports(f), f)


@query(f"WITH {_SPECS}, {_PYEDGE}, {_JSEDGE}, {_GOEDGE} SELECT DISTINCT *, 'imports' AS kind FROM (SELECT * FROM pyedge UNION ALL SELECT * FROM jsedge UNION ALL SELECT * FROM goedge)")
def import_edges(spark, d):
    return imports.import_edges(v.sources(spark, d))


@query(f"SELECT repo_id, count(*) FILTER (regexp_matches(path, '\\.(py|js|mjs|cjs|jsx|ts|tsx|go)$') AND content IS NOT NULL) AS covered, count(*) AS total FROM files_v GROUP BY 1")
def import_coverage(spark, d):
    return imports.import_coverage(v.files(spark, d))


def _abstractions(spark, d):
    """The two outer directories of each file, as its abstraction: a row for each file."""
    return v.sources(spark, d).select("repo_id", history.directory("path").alias("name"), "path").where("name <> ''")


def _relationships(spark, d):
    """Each abstraction with the next one and the one after it, in both directions, with itself and with one that is not there."""
    names = _abstractions(spark, d).select("repo_id", "name").distinct()
    w = W.partitionBy("repo_id").orderBy("name")
    near = names.select("repo_id", "name", *(F.lead("name", k).over(w).alias(f"n{k}") for k in (1, 2, 4)))
    near = near.select("repo_id", "name", F.explode(F.array("n1", "n2", "n4", "name", F.lit("ghost"))).alias("other")).where("other is not null")
    both = F.inline(F.array(F.struct(F.col("name").alias("from_name"), F.col("other").alias("to_name")), F.struct(F.col("other").alias("from_name"), F.col("name").alias("to_name"))))
    return near.select("repo_id", both).distinct()


_RELS = r"""owned AS (SELECT repo_id, array_to_string(string_split(path, '/')[:least(len(string_split(path, '/')) - 1, 2)], '/') AS name, path FROM sources_v WHERE contains(path, '/')), abs AS (SELECT DISTINCT repo_id, name FROM owned),
near AS (SELECT repo_id, name, unnest([lead(name, 1) OVER w, lead(name, 2) OVER w, lead(name, 4) OVER w, name, 'ghost']) AS other FROM abs WINDOW w AS (PARTITION BY repo_id ORDER BY name)),
rels AS (SELECT repo_id, name AS from_name, other AS to_name FROM near WHERE other IS NOT NULL UNION SELECT repo_id, other, name FROM near WHERE other IS NOT NULL)"""


@query(f"WITH {_SPECS}, {_PYEDGE}, {_JSEDGE}, {_GOEDGE}, {_RELS}, edges AS (SELECT * FROM pyedge UNION SELECT * FROM jsedge UNION SELECT * FROM goedge), proven AS (SELECT DISTINCT e.repo_id, a.name AS from_name, b.name AS to_name FROM edges e JOIN owned a ON a.repo_id = e.repo_id AND a.path = e.from_path JOIN owned b ON b.repo_id = e.repo_id AND b.path = e.to_path) SELECT r.*, CASE WHEN p.repo_id IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS source FROM rels r LEFT JOIN proven p ON p.repo_id = r.repo_id AND p.from_name = r.from_name AND p.to_name = r.to_name")
def tag_relationships(spark, d):
    return imports.tag_relationships(_relationships(spark, d), _abstractions(spark, d), imports.import_edges(v.sources(spark, d)))


@query(f"WITH {_RELS}, l AS (SELECT repo_id, from_name AS name, to_name AS other, 'to' AS direction FROM rels UNION ALL SELECT repo_id, to_name, from_name, 'from' FROM rels WHERE from_name <> to_name) SELECT l.* FROM l WHERE EXISTS (SELECT 1 FROM abs a WHERE a.repo_id = l.repo_id AND a.name = l.name) AND EXISTS (SELECT 1 FROM abs a WHERE a.repo_id = l.repo_id AND a.name = l.other)")
def related_links(spark, d):
    return imports.related_links(_relationships(spark, d), _abstractions(spark, d))


# ---- schemas

_SK = f"CASE WHEN {_BASE} = 'schema.prisma' THEN 0 WHEN ends_with('/' || path, '/db/schema.rb') THEN 1 WHEN {_BASE} = 'schema.sql' THEN 2 WHEN {_BASE} = 'models.py' THEN 3 END"


#: Statements of the stand-in's Go files: string literals in double quotes that begin as schema statements do.
_DDL = f"""ddl AS (SELECT repo_id, path, list_filter(regexp_extract_all({_BARE_GO}, '"((?:[^"\\\\\n]|\\\\.)*)"', 1), lambda x: regexp_matches(x, {v._lit(C.DDL_STATEMENT)})) AS ss FROM files_v WHERE path LIKE '%.go'),
embedded AS (SELECT repo_id, path, len(ss)::int AS n_ddl, len(regexp_extract_all(array_to_string(ss, chr(10)), '(?i)\\bCREATE\\s+TABLE\\b'))::int AS tables, ss FROM ddl WHERE len(ss) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tables DESC, path) AS ddl_rank FROM embedded)"""
_CUT = f"\n\n{C.TRUNCATION_MARK} at 600,000 chars =====\n"
_SCHEMA = f"""s AS (SELECT repo_id, path, size, length(content) AS len, {_SK} AS k FROM files_v WHERE NOT {_SKIP} AND {_SK} IS NOT NULL), f AS (SELECT * FROM s QUALIFY k = min(k) OVER (PARTITION BY repo_id)),
r AS (SELECT *, row_number() OVER w AS r, sum(length('# ===== ' || path || ' =====' || chr(10)) + CASE WHEN len > 600000 THEN 600000 + {len(_CUT)} ELSE coalesce(len, 0) END) OVER w AS upto FROM f WINDOW w AS (PARTITION BY repo_id ORDER BY -size, path)), {_DDL},
e AS (SELECT *, sum(length('-- ===== ' || path || ' =====' || chr(10)) + length(array_to_string(list_transform(ss, lambda x: trim(x)), chr(10)))) OVER (PARTITION BY repo_id ORDER BY ddl_rank) AS upto FROM ranked WHERE repo_id NOT IN (SELECT repo_id FROM s)),
schema AS (SELECT repo_id, (['prisma', 'rails', 'sql', 'models'])[k + 1] AS kind, path, CASE WHEN r = 1 OR (k = 3 AND upto <= 600000 AND r <= 40) THEN 'kept' ELSE 'dropped' END AS state, len > 600000 AS cut FROM r
  UNION ALL SELECT repo_id, 'embedded-sql', path, CASE WHEN ddl_rank = 1 OR (upto <= 600000 AND ddl_rank <= 40) THEN 'kept' ELSE 'dropped' END, false FROM e)"""


@query(f"WITH {_SCHEMA} SELECT * FROM schema")
def find_schema(spark, d):
    return schemas.find_schema(v.files(spark, d))


@query(f"WITH {_DDL} SELECT repo_id, path, n_ddl, tables, ddl_rank FROM ranked")
def embedded_ddl(spark, d):
    return schemas.embedded_ddl(v.files(spark, d)).select("repo_id", "path", F.size("ddl").alias("n_ddl"), "tables", "ddl_rank")


#: Declarations of four dialects, read from the texts.
_TABLES = r"""decl AS (SELECT repo_id, content AS t FROM files_v WHERE path LIKE 'db%/schema.sql' OR path LIKE 'db/migrations/%' OR path LIKE 'app%/models.py'),
named AS (SELECT repo_id, unnest(list_concat(regexp_extract_all(t, '(?i)\bmodel\s+(\w+)', 1), regexp_extract_all(t, '(?i)CREATE\s+(?:\w+\s+)*?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[`"\[]?\w+[`"\]]?\s*\.\s*)?[`"\[]?(\w+)[`"\]]?', 1), regexp_extract_all(t, '(?i)\bcreate_table\s+["'':]?(\w+)', 1), regexp_extract_all(t, '(?i)class\s+(\w+)\s*\([^)]*Model', 1))) AS name FROM decl),
tables AS (SELECT DISTINCT repo_id, lower(name) AS name FROM named)"""


def _tables(spark, d):
    heads = v.files(spark, d).where("path LIKE 'db%/schema.sql' or path like 'db/migrations/%' or path like 'app%/models.py'")
    return schemas.schema_tables(heads.select("repo_id", F.col("content").alias("text")))


@query(f"WITH {_TABLES} SELECT * FROM tables")
def schema_tables(spark, d):
    return _tables(spark, d)


_ERD = r"regexp_extract(text, '(?s)```mermaid[ \t]*\n(\s*erDiagram\b.*?)```', 1)"
_ENDS = f"list_zip(regexp_extract_all({_ERD}, {v._lit(C.ERD_LINE)}, 1), regexp_extract_all({_ERD}, {v._lit(C.ERD_LINE)}, 2))"


@query(rf"""WITH {_TABLES}, e AS (SELECT repo_id, prompt_id, flatten(list_transform({_ENDS}, lambda p: [p[1], p[2]])) AS names FROM replies_v), h AS (SELECT repo_id, prompt_id, flatten(list_transform(regexp_extract_all(text, '(?m)^###.*$'), lambda x: regexp_extract_all(x, '`(\w+)`', 1))) AS names FROM replies_v),
n AS (SELECT 0 AS way, repo_id, prompt_id, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM e UNION ALL SELECT 1, repo_id, prompt_id, unnest(names), generate_subscripts(names, 1) FROM h),
k AS (SELECT n.repo_id, n.prompt_id, way, arg_min(n.name, place) AS name, min(place) AS place FROM n JOIN tables t ON t.repo_id = n.repo_id AND t.name = lower(n.name) GROUP BY n.repo_id, n.prompt_id, way, lower(n.name))
SELECT repo_id, prompt_id, name, row_number() OVER (PARTITION BY repo_id, prompt_id, way ORDER BY place) AS pos FROM k QUALIFY way = min(way) OVER (PARTITION BY repo_id, prompt_id)""")
def reply_tables(spark, d):
    return schemas.reply_tables(v.replies(spark, d), _tables(spark, d))


@query("""WITH m AS (SELECT repo_id, 'db/migrations' AS dir, regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '\\.up$', '') AS name FROM files_v WHERE regexp_matches(path, '^db/migrations/\\d{4,}[_-]')) SELECT repo_id, dir, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) < 4 AS too_few FROM m GROUP BY 1, 2""")
def find_migrations(spark, d):
    return schemas.find_migrations(v.files(spark, d))


@query(f"WITH {_TABLES}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) - 1 AS r FROM tables) SELECT repo_id, r // 4 AS batch, string_agg(name, ',' ORDER BY name) AS names FROM r GROUP BY 1, 2")
def table_batches(spark, d):
    return schemas.table_batches(_tables(spark, d))


# ---- replies

_FENCE = r"(?s)```(mermaid|yaml|json)[ \t]*\n(.*?)```"


@query(rf"""WITH p AS (SELECT repo_id, prompt_id, regexp_extract_all(text, '{_FENCE}', 1) AS kinds, regexp_extract_all(text, '{_FENCE}', 2) AS bodies, length(regexp_replace(text, '(?s)```mermaid[ \t]*\n.*?```', '', 'g'))::int AS rest FROM replies_v),
u AS (SELECT repo_id, prompt_id, (generate_subscripts(kinds, 1) - 1)::int AS pos, unnest(kinds) AS kind, unnest(bodies) AS body, rest FROM p) SELECT repo_id, prompt_id, pos, kind, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body, rest FROM u""")
def reply_fences(spark, d):
    return replies.reply_fences(v.replies(spark, d))


@query()
def reply_values(spark, d):
    return replies.reply_values(v.replies(spark, d))


def _parts(mark: str) -> str:
    return f"""parts AS (SELECT repo_id, prompt_id, unnest(ps) AS part, generate_subscripts(ps, 1)::int AS card FROM (SELECT repo_id, prompt_id, string_split(chr(10) || text, chr(10) || '{mark} ')[2:] AS ps FROM replies_v)),
cards AS (SELECT repo_id, prompt_id, card, trim(string_split(part, chr(10))[1]) AS title, regexp_replace(substr(part, length(string_split(part, chr(10))[1]) + 2), '^\\s+|\\s+$', '', 'g') AS body FROM parts)"""


_CARDS = _parts("###")


@query(f"WITH {_CARDS} SELECT repo_id, prompt_id, title, md5(body) AS body_md5, card FROM cards")
def split_cards(spark, d):
    return replies.split_cards(v.replies(spark, d)).select("repo_id", "prompt_id", "title", F.md5("body").alias("body_md5"), "card")


@query(f"WITH {_parts('##')} SELECT repo_id, prompt_id, lower(title) AS section, md5(body) AS body_md5 FROM cards")
def split_sections(spark, d):
    return replies.split_sections(v.replies(spark, d)).select("repo_id", "prompt_id", "section", F.md5("body").alias("body_md5"))


@query(r"""WITH h AS (SELECT repo_id, prompt_id, pos, length(regexp_extract(line, '^(#{1,6})[ \t]+\S', 1)) AS level, trim(regexp_replace(line, '^#{1,6}[ \t]+', '')) AS title FROM (SELECT repo_id, prompt_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM replies_v) WHERE regexp_matches(line, '^#{1,6}[ \t]+\S'))
SELECT repo_id, prompt_id, row_number() OVER (PARTITION BY repo_id, prompt_id ORDER BY pos)::int AS n, level::int AS level, title, (SELECT arg_max(p.title, p.pos) FROM h p WHERE p.prompt_id = h.prompt_id AND p.repo_id = h.repo_id AND p.pos < h.pos AND p.level < h.level) AS parent FROM h""")
def heading_tree(spark, d):
    return replies.heading_tree(v.replies(spark, d)).select("repo_id", "prompt_id", "n", "level", "title", "parent")


_MENU = r"""cut AS (SELECT repo_id, prompt_id, text, regexp_extract(text, '(?im)^##[ \t]+[^\n]*tour[^\n]*$') AS mark FROM replies_v), headed AS (SELECT *, CASE WHEN mark = '' THEN text ELSE substr(text, 1, strpos(text, mark) - 1) END AS head, CASE WHEN mark = '' THEN '' ELSE substr(text, strpos(text, mark) + length(mark)) END AS tour FROM cut),
menu AS (SELECT *, strpos(chr(10) || head, chr(10) || '### ') AS spot, strpos(chr(10) || text, chr(10) || '### ') AS card FROM headed)"""


@query(rf"""WITH {_MENU} SELECT repo_id, prompt_id, md5(trim(CASE WHEN spot = 0 THEN head ELSE substr(head, 1, spot - 1) END, ' ' || chr(10) || chr(9))) AS opener_md5, md5(trim(CASE WHEN spot = 0 THEN '' ELSE substr(head, spot) END, ' ' || chr(10) || chr(9))) AS groups_md5, trim(tour, ' ' || chr(10) || chr(9)) AS tour,
  substr(CASE WHEN card = 0 THEN substr(text, 1, 1500) ELSE substr(text, card, CASE WHEN strpos(substr(text, card + 3), chr(10) || '### ') = 0 THEN length(text) ELSE strpos(substr(text, card + 3), chr(10) || '### ') + 3 END) END, 1, 2500) AS first_card FROM menu""")
def split_menu(spark, d):
    rows = v.replies(spark, d).select("repo_id", "prompt_id", replies.menu_parts("text").alias("m"), replies.first_card("text").alias("first_card"))
    return rows.select("repo_id", "prompt_id", F.md5("m.opener").alias("opener_md5"), F.md5("m.groups").alias("groups_md5"), F.col("m.tour").alias("tour"), "first_card")


@query(r"SELECT repo_id, prompt_id, trim(regexp_extract(text, '\*\*Owner:\*\*\s*([^\n]+)', 1)) AS owner, trim(regexp_extract(text, '\*\*Nobody:\*\*\s*([^\n]+)', 1)) AS missing FROM replies_v")
def labelled_field(spark, d):
    return v.replies(spark, d).select("repo_id", "prompt_id", replies.labelled_field("text", "Owner").alias("owner"), replies.labelled_field("text", "Nobody").alias("missing"))


@query(rf"""WITH {_CARDS}, g AS (SELECT repo_id, prompt_id, trim(regexp_extract(title, '^(.+?)\s*[(][0-9]', 1)) AS name, try_cast(regexp_extract(title, '^.+?\s*[(]([0-9]+)', 1) AS bigint) AS n FROM cards WHERE n IS NOT NULL), w AS (SELECT *, sum(n) OVER (PARTITION BY repo_id, prompt_id)::bigint AS total, greatest(max(n) OVER (PARTITION BY repo_id, prompt_id), 1) AS top FROM g)
SELECT repo_id, prompt_id, name, n, total, greatest(7, round_even(n * 100 / top::double, 0))::int AS width FROM w""")
def feature_group_sizes(spark, d):
    return replies.feature_group_sizes(replies.split_cards(v.replies(spark, d)))


#: Shares as models write them, taken from the texts: plain, beyond the range, no number, a word, with blanks.
_SHARES_OF = "shares AS (SELECT repo_id, doc_id AS era_index, regexp_extract(content, '[A-Za-z]+') AS label, (CASE doc_id % 5 WHEN 0 THEN (length(content) % 100)::varchar WHEN 1 THEN (length(content) % 400) || '%' WHEN 2 THEN 'NaN' WHEN 3 THEN regexp_extract(content, '[A-Za-z]+') ELSE '-' || (length(content) % 7) || ' % ' END) AS pct FROM files_v)"


@query(f"WITH {_SHARES_OF}, n AS (SELECT *, try_cast(rtrim(pct, '% ') AS double) AS n FROM shares) SELECT repo_id, era_index, label, CASE WHEN NOT isnan(n) THEN least(greatest(n, 0.0::double), 100.0::double) END AS share FROM n")
def profile_shares(spark, d):
    n, word, k = F.length("content"), F.regexp_extract("content", "[A-Za-z]+", 0), F.col("doc_id") % 5
    pct = F.when(k == 0, (n % 100).cast("string")).when(k == 1, F.concat((n % 400).cast("string"), F.lit("%"))).when(k == 2, "NaN").when(k == 3, word).otherwise(F.concat(F.lit("-"), (n % 7).cast("string"), F.lit(" % ")))
    return replies.profile_shares(v.files(spark, d).select("repo_id", F.col("doc_id").alias("era_index"), word.alias("label"), pct.alias("pct")))


#: Parsed replies from the texts: names and chapters are words, one file is the document's own or none, a month or what is not one.
_PARSED = r"""said AS (SELECT repo_id, doc_id AS prompt_id, path, content, length(content) AS n, regexp_extract_all(content, '[A-Za-z]{3,}') AS ws FROM files_v),
parsed AS (SELECT repo_id, prompt_id, ws[:3] AS names, CASE WHEN n % 3 = 0 THEN list_reverse(ws[:3]) WHEN n % 3 = 1 THEN ws[:4] ELSE ws[:2] END AS chapters, CASE WHEN n % 5 = 0 THEN path || '.gone' ELSE path END AS file, CASE n % 4 WHEN 0 THEN '2024-05' WHEN 1 THEN '2024' WHEN 2 THEN regexp_extract(content, '[0-9]{4}-[0-9]{2}') ELSE '1999-12' END AS month FROM said)"""


@query(f"""WITH {_PARSED} SELECT repo_id, prompt_id, 'empty' AS rule FROM parsed WHERE len(names) = 0 UNION ALL SELECT repo_id, prompt_id, 'not_unique' FROM parsed WHERE len(list_distinct(names)) < len(names)
UNION ALL SELECT repo_id, prompt_id, 'names_differ' FROM parsed WHERE NOT (list_has_all(names, chapters) AND list_has_all(chapters, names)) UNION ALL SELECT repo_id, prompt_id, 'bad_month' FROM parsed WHERE NOT regexp_full_match(month, '[0-9]{{4}}-[0-9]{{2}}')
UNION ALL SELECT p.repo_id, prompt_id, 'unknown_file' FROM parsed p WHERE NOT EXISTS (SELECT 1 FROM files_v f WHERE f.repo_id = p.repo_id AND f.path = p.file)""")
def validate_reply(spark, d):
    f = v.files(spark, d)
    n, ws = F.length("content"), F.regexp_extract_all("content", F.lit("[A-Za-z]{3,}"), F.lit(0))
    first = lambda k: F.slice("ws", 1, k)
    chapters = F.when(F.col("n") % 3 == 0, F.reverse(first(3))).when(F.col("n") % 3 == 1, first(4)).otherwise(first(2))
    month = F.when(F.col("n") % 4 == 0, "2024-05").when(F.col("n") % 4 == 1, "2024").when(F.col("n") % 4 == 2, F.regexp_extract("content", "[0-9]{4}-[0-9]{2}", 0)).otherwise("1999-12")
    file = F.when(F.col("n") % 5 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    parsed = f.select("repo_id", F.col("doc_id").alias("prompt_id"), "path", "content", n.alias("n"), ws.alias("ws")).select("repo_id", "prompt_id", first(3).alias("names"), chapters.alias("chapters"), F.array(file).alias("files"), month.alias("month"))
    return replies.validate_reply(parsed, f)


@query(f"WITH {_CARDS}, w AS (SELECT repo_id, prompt_id, card, list(body) OVER (PARTITION BY repo_id, prompt_id ORDER BY card ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM cards) SELECT repo_id, prompt_id, card, md5(CASE WHEN coalesce(len(before), 0) = 0 THEN '{C.FIRST_CHAPTER}' ELSE array_to_string(before, chr(10) || chr(10) || '---' || chr(10) || chr(10)) END) AS context_md5 FROM w")
def chapter_context(spark, d):
    return replies.chapter_context(replies.split_cards(v.replies(spark, d))).select("repo_id", "prompt_id", "card", F.md5("context").alias("context_md5"))


# ---- usage

_PRICE = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', {a} / 1e6, {b} / 1e6, {c} / 1e6, {e} / 1e6, {t})" for p, m, a, b, c, e, t in C.PRICES) + ") t(provider, model, input, output, cache_read, cache_write, max_input))"
_COST = "costed AS (SELECT u.*, input_tokens * input + output_tokens * output + cache_read_tokens * cache_read + cache_write_tokens * cache_write AS cost FROM usage_v u LEFT JOIN prices USING (provider, model))"


def _costed(spark, d):
    return usage.usage_cost(usage.price_for(v.llm_usage(spark, d), v.prices(spark)))


@query(f"WITH {_PRICE} SELECT run_id, provider, model, count(*) AS records, CASE WHEN provider = 'gemini' THEN 1e-6 ELSE any_value(input) END AS p_input, CASE WHEN provider = 'gemini' THEN 0.0 ELSE any_value(output) END AS p_output FROM usage_v LEFT JOIN prices USING (provider, model) GROUP BY 1, 2, 3")
def price_for(spark, d):
    priced = usage.price_for(v.llm_usage(spark, d), v.prices(spark), usage.override_table(spark, v.OVERRIDES))
    return priced.groupBy("run_id", "provider", "model").agg(F.count("*").alias("records"), F.first("p_input").alias("p_input"), F.first("p_output").alias("p_output"))


@query(f"WITH {_PRICE}, {_COST} SELECT run_id, input_tokens, round(cost, 9) AS cost FROM costed")
def usage_cost(spark, d):
    return _costed(spark, d).select("run_id", "input_tokens", F.round("cost", 9).alias("cost"))


@query(f"WITH {_PRICE}, {_COST} SELECT run_id, sum(input_tokens)::bigint AS input_tokens, sum(output_tokens)::bigint AS output_tokens, sum(cache_read_tokens)::bigint AS cache_read_tokens, sum(cache_write_tokens)::bigint AS cache_write_tokens, sum(duration_s) AS api_seconds, round(CASE WHEN count(*) = count(cost) THEN sum(cost) END, 9) AS cost FROM costed GROUP BY 1")
def session_summary(spark, d):
    return usage.session_summary(_costed(spark, d))


@query(f"WITH {_PRICE}, {_COST} SELECT provider, model, day, grouping_id(provider, model, day)::int AS level, count(*) AS records, sum(input_tokens)::bigint AS input_tokens, sum(output_tokens)::bigint AS output_tokens, round(sum(cost), 6) AS cost FROM costed GROUP BY ROLLUP (provider, model, day)")
def cost_rollup(spark, d):
    return usage.cost_rollup(_costed(spark, d))


_BODY = "body AS (SELECT repo_id, sum(length(content))::bigint AS body_chars, max(length(content))::bigint AS largest, count(*) FILTER (starts_with(path, 'db/migrations/')) AS migrations FROM files_v GROUP BY 1)"
_SHARES = {"bundle": 1.0, "manifest": 0.5, "head": 0.25, "names": 0.125, "survey": 0.0625, "stream": 0.25, "diff": 0.125}
_PLAN = rf"""filled AS (SELECT *, replace(text, '{{house_style}}', CASE WHEN part IS NULL THEN {v._lit(v.HOUSE)} ELSE {v._lit(v.HOUSE)} || chr(10) || chr(10) || {v._lit(v.EVIDENCE)} END) AS whole FROM templates_v),
shells AS (SELECT *, length(whole) - coalesce(list_sum(list_transform(list_distinct(regexp_extract_all(whole, '\{{([a-z_][a-z0-9_]*)\}}', 1)), lambda x: length(x) + 2)), 0) AS shell_chars FROM filled),
plan AS (SELECT repo_id, analysis, template, shell_chars::int AS shell_chars, CASE WHEN part IS NULL THEN 0 ELSE floor(body_chars * CASE part {' '.join(f"WHEN '{p}' THEN {w}" for p, w in _SHARES.items())} END)::bigint END AS body_chars,
  CASE WHEN analysis = 'tour' AND part = 'bundle' THEN body_chars + largest END AS body_max_chars, CASE WHEN template = 'migration-acts.md' AND migrations < 4 THEN 0 ELSE calls_low END AS calls_low, CASE WHEN template = 'migration-acts.md' AND migrations < 4 THEN 0 ELSE calls_high END AS calls_high, note FROM body, shells)"""


def _plan(spark, d):
    """Every part of a preview is a share of the repository's characters here; templates are texts of a table."""
    body = v.files(spark, d).groupBy("repo_id").agg(F.sum(F.length("content")).alias("whole"), F.max(F.length("content")).cast("long").alias("largest"), F.count_if(F.col("path").startswith("db/migrations/")).alias("migrations"))
    parts = F.array(*(F.struct(F.lit(a).alias("analysis"), F.lit(p).alias("part"), F.lit(_SHARES[p]).alias("share")) for a, p in sorted({(a, p) for a, _, p, *_ in C.PROMPTS})))
    most = F.when((F.col("analysis") == "tour") & (F.col("part") == "bundle"), F.col("whole") + F.col("largest"))
    given = body.select("*", F.inline(parts)).select("repo_id", "analysis", "part", F.floor(F.col("whole") * F.col("share")).alias("body_chars"), most.alias("body_max_chars"), "migrations")
    return usage.prompt_plan(given, v.templates(spark, d), v.HOUSE, v.EVIDENCE)


@query(f"WITH {_BODY}, {_PLAN} SELECT * FROM plan")
def prompt_plan(spark, d):
    return _plan(spark, d)


@query(f"""WITH {_PRICE}, {_BODY}, {_PLAN}, p AS (SELECT *, shell_chars + body_chars AS chars, shell_chars + coalesce(body_max_chars, body_chars) AS most FROM plan), e AS (SELECT repo_id, (sum(chars * calls_low) // 4)::bigint AS input_low, (sum(chars * calls_high) // 4)::bigint AS input_high, (sum(calls_high) * 16384)::bigint AS output_high, max(floor(most / 2.5::double))::bigint AS largest_prompt, string_agg(DISTINCT template || ': ' || note, '|' ORDER BY template || ': ' || note) FILTER (note <> '') AS notes FROM p GROUP BY 1)
SELECT repo_id, input_low, input_high, output_high, largest_prompt, round(input_low * input, 6) AS cost_low, round(input_high * input + output_high * output, 6) AS cost_high, largest_prompt > max_input AS over_ceiling, notes FROM e, prices WHERE provider = 'openai'""")
def estimate_run(spark, d):
    return usage.estimate_run(_plan(spark, d), v.prices(spark), "openai", "gpt-5.6-terra").withColumn("notes", F.array_join("notes", "|"))


@query(f"""WITH w AS (SELECT repo_id, path, length(content) AS len, row_number() OVER (PARTITION BY repo_id ORDER BY {_WALK}) AS ord FROM files_v WHERE {_KEPT}), p AS (SELECT *, len + length(path) + 131 AS block FROM w WHERE ord <= 30),
b AS (SELECT repo_id, count(*) AS previewed, count(len) AS readable, sum(block) AS whole, avg(block) AS mean, max(block) AS largest FROM p GROUP BY 1), t AS (SELECT *, least(least(50, greatest(20, previewed // 20)), readable) AS target FROM b)
SELECT repo_id, previewed, readable, CASE WHEN readable = 0 THEN 0 ELSE floor(least(20000.0::double, whole, target * mean * CASE WHEN target < readable THEN 2.0 ELSE 1.0 END))::bigint END AS likely, CASE WHEN readable = 0 THEN 0 ELSE least(whole, 20000 + largest)::bigint END AS most FROM t""")
def codebase_size_estimate(spark, d):
    return usage.codebase_size_estimate(v.files(spark, d), 20_000, 24_000)


@query("""WITH k AS (SELECT run_id, sha256(concat_ws('|', provider, model, '4096', text)) AS key, input_tokens FROM usage_v), r AS (SELECT DISTINCT key FROM k WHERE input_tokens % 2 = 0) SELECT run_id, count(*) AS calls, count(r.key) AS hits, count(r.key) / count(*)::double AS hit_rate, sum(CASE WHEN r.key IS NULL THEN input_tokens ELSE 0 END)::bigint AS input_tokens FROM k LEFT JOIN r USING (key) GROUP BY 1""")
def cache_hits(spark, d):
    calls = v.llm_usage(spark, d).select("run_id", "provider", "model", F.lit(4096).alias("max_out"), F.concat(F.lit("<<<CACHE_BREAKPOINT>>>"), "text").alias("prompt"), "input_tokens")
    return usage.cache_hits(calls, calls.where("input_tokens % 2 = 0").select(usage.cache_key().alias("key")))


@query("""WITH s AS (SELECT run_id, 'tour' AS analysis, 'repo' || (run_id % 7) AS repo_id, day || 'T00:00:00Z' AS sent_at, CASE WHEN input_tokens % 2 = 0 THEN 'file' ELSE 'commit' END AS kind, 'n' || (input_tokens % 50) AS name FROM usage_v),
w AS (SELECT run_id, min(analysis) AS analysis, min(repo_id) AS repo_id, min(sent_at) AS sent_at, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'file'), '') AS files, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'commit'), '') AS commits FROM s GROUP BY 1)
SELECT u.*, analysis, repo_id, sent_at, files, commits FROM (SELECT run_id, coalesce(string_agg(DISTINCT provider || ':' || model, ',' ORDER BY provider || ':' || model) FILTER (NOT cached), '') AS models, count(*) FILTER (cached) AS cached_calls, count(*) AS calls FROM usage_v GROUP BY 1) u LEFT JOIN w USING (run_id)""")
def run_manifest(spark, d):
    calls = v.llm_usage(spark, d)
    kind = F.when(F.col("input_tokens") % 2 == 0, "file").otherwise("commit")
    sent = calls.select("run_id", F.lit("tour").alias("analysis"), F.concat(F.lit("repo"), (F.col("run_id") % 7).cast("string")).alias("repo_id"), F.concat("day", F.lit("T00:00:00Z")).alias("sent_at"), kind.alias("kind"), F.concat(F.lit("n"), (F.col("input_tokens") % 50).cast("string")).alias("name"))
    return usage.run_manifest(calls, sent).withColumn("files", F.array_join("files", ",")).withColumn("commits", F.array_join("commits", ","))


# ---- previews of the seven analyses

_ABORTS = "(VALUES " + ", ".join(f"({v._lit(a)}, {v._lit(C.ABORT_PREFIX + r)})" for a, r in C.ABORT_REASONS.items()) + ") t(analysis, stop)"
#: The lists and the characters of each analysis, with small budgets.
_PREVIEWS = rf"""{_FAIR}, {_EVIDENCE}, {_SURFACE}, {_SCHEMA}, {_bulk_sql("D", 3)}, {_bulk_sql("A", 4).split("),\n", 1)[1].replace("per AS", "per_a AS").replace("bulk AS", "bulk_a AS").replace("FROM per JOIN", "FROM per_a JOIN")},
listed AS (SELECT repo_id, path, content, length(content) AS len, row_number() OVER (PARTITION BY repo_id ORDER BY {_WALK}) AS ord FROM files_v WHERE {_KEPT}),
fit AS (SELECT repo_id, 0::bigint AS n, 20000::bigint AS rest, false AS taken FROM listed GROUP BY 1 UNION ALL SELECT f.repo_id, w.ord, f.rest - CASE WHEN w.len + length(w.path) + 131 <= f.rest THEN w.len + length(w.path) + 131 ELSE 0 END, w.len + length(w.path) + 131 <= f.rest FROM fit f JOIN listed w ON w.repo_id = f.repo_id AND w.ord = f.n + 1),
ranked_surface AS (SELECT s.repo_id, s.path, row_number() OVER (PARTITION BY s.repo_id ORDER BY tier, CASE WHEN tier = 1 THEN -weight ELSE 0 END, s.path) AS ord, length(content) + length(s.path) + 130 AS cost, regexp_matches(content, '\S') AS full FROM surface s JOIN files_v f ON f.repo_id = s.repo_id AND f.path = s.path),
reads AS (SELECT repo_id, 0::bigint AS n, 9000::bigint AS rest, false AS taken FROM ranked_surface GROUP BY 1 UNION ALL SELECT f.repo_id, w.ord, f.rest - CASE WHEN w.full AND w.cost <= f.rest THEN w.cost ELSE 0 END, w.full AND w.cost <= f.rest FROM reads f JOIN ranked_surface w ON w.repo_id = f.repo_id AND w.ord = f.n + 1),
lists AS (SELECT repo_id, 'tour' AS analysis, ord <= 30 AS included, path, length('  [' || (ord - 1) || '] ' || path || chr(10) || chr(10)) + least(len, 800) + 1 AS chars FROM listed
  UNION ALL SELECT q.repo_id, 'backend', f.path IS NOT NULL, q.path, q.len + length(chr(10) || '===== LAYER ' || q.layer || ': ' || q.path || ' =====' || chr(10) || chr(10)) FROM queue q LEFT JOIN fair f ON f.repo_id = q.repo_id AND f.path = q.path
  UNION ALL SELECT repo_id, 'architecture', start < 900, path, 0 FROM disclosed
  UNION ALL SELECT w.repo_id, 'interfaces', f.taken, w.path, w.cost + 1 FROM ranked_surface w JOIN reads f ON f.repo_id = w.repo_id AND f.n = w.ord
  UNION ALL SELECT repo_id, 'schema', state = 'kept', path, 1 FROM schema WHERE state = 'kept' OR kind IN ('models', 'embedded-sql')
  UNION ALL SELECT w.repo_id, 'product_intent', f.taken, w.path, w.len + length(w.path) + 131 FROM listed w JOIN fit f ON f.repo_id = w.repo_id AND f.n = w.ord)"""
_ROLL = rf"""WITH RECURSIVE {_PREVIEWS}, repos AS (SELECT DISTINCT repo_id FROM files_v UNION SELECT repo_id FROM commits_v),
sums AS (SELECT r.repo_id, a.analysis, CASE WHEN a.analysis <> 'history' THEN (SELECT count(*) FROM lists l WHERE l.repo_id = r.repo_id AND l.analysis = a.analysis AND included) END AS included, CASE WHEN a.analysis <> 'history' THEN (SELECT count(*) FROM lists l WHERE l.repo_id = r.repo_id AND l.analysis = a.analysis AND NOT included) END AS dropped,
  coalesce((SELECT sum(chars) FROM lists l WHERE l.repo_id = r.repo_id AND l.analysis = a.analysis AND included), 0) AS chars, stop FROM repos r, {_ABORTS.replace(" t(", " a(")}),
sized AS (SELECT s.* EXCLUDE (chars), CASE analysis WHEN 'history' THEN NULL WHEN 'architecture' THEN coalesce(length(b.bundle), 0) WHEN 'backend' THEN CASE WHEN chars > 0 THEN chars + 60000 - st.rest ELSE 0 END WHEN 'schema' THEN chars ELSE greatest(chars - 1, 0) END::bigint AS assembled_chars, (SELECT count(*) FROM commits_v c WHERE c.repo_id = s.repo_id) AS commits
  FROM sums s LEFT JOIN bundle b ON b.repo_id = s.repo_id LEFT JOIN start st ON st.repo_id = s.repo_id)
SELECT repo_id, analysis, included, dropped, assembled_chars, CASE WHEN analysis = 'history' THEN commits = 0 ELSE assembled_chars = 0 END AS stops, CASE WHEN CASE WHEN analysis = 'history' THEN commits = 0 ELSE assembled_chars = 0 END THEN stop ELSE '' END AS stop,
  CASE WHEN analysis = 'tour' AND dropped > 0 THEN dropped || ' of ' || (included + dropped) || ' source files never reach the file-selection prompt: it holds ' || included || ' at 800 chars each. The model cannot pick a file it never saw.' WHEN analysis = 'interfaces' AND dropped > 0 THEN dropped || ' of ' || (included + dropped) || ' surface files did not reach the bundle: empty, or past the budget.' ELSE '' END AS dropped_note,
  CASE analysis WHEN 'history' THEN commits WHEN 'tour' THEN included + dropped WHEN 'interfaces' THEN included WHEN 'product_intent' THEN dropped WHEN 'backend' THEN coalesce((SELECT route FROM layer_counts x WHERE x.repo_id = sized.repo_id), 0) WHEN 'architecture' THEN coalesce((SELECT deps FROM stats x WHERE x.repo_id = sized.repo_id), 0) ELSE included END AS one_count FROM sized"""


def _previews(spark, d):
    f, c = v.files(spark, d), v.commits(spark, d)
    parts = {
        "tour": previews.tour(f, 24_000), "backend": previews.backend(f, 60_000), "architecture": previews.architecture(f, 900), "interfaces": previews.interfaces(f, 9_000), "schema": previews.schema(f),
        "history": previews.git_history(c, _bulk(spark, d, "A", 4), _bulk(spark, d)), "product_intent": previews.product_intent(f, 20_000),
    }
    return f.select("repo_id").unionByName(c.select("repo_id")), parts


@query(_ROLL)
def preview_rollup(spark, d):
    """Every repository and analysis, with the note that stops a run, the note on what was left out, and one of its counts."""
    rows = previews.preview_rollup(*_previews(spark, d))
    key = F.element_at(F.create_map(*[F.lit(x) for pair in {"tour": "source files found", "backend": "matched as route", "architecture": "dependencies declared", "interfaces": "surface files read", "schema": "schema files read", "history": "commits", "product_intent": "dropped by the budget"}.items() for x in pair]), F.col("analysis"))
    said = lambda word: F.array_join(F.filter("notes", lambda n: n.contains(word)), "|")
    stop = F.array_join(F.filter("notes", lambda n: n.startswith(C.ABORT_PREFIX)), "|")
    dropped = F.regexp_replace(F.concat(said("never reach"), said("did not reach")), r"(?<=\d),(?=\d{3})", "")  # the notes group thousands, this column has plain digits
    return rows.select("repo_id", "analysis", "included", "dropped", "assembled_chars", (stop != "").alias("stops"), stop.alias("stop"), dropped.alias("dropped_note"), F.element_at("counts", key).alias("one_count"))


@query(f"WITH RECURSIVE {_PREVIEWS} SELECT repo_id, analysis, CASE WHEN included THEN 'included' ELSE 'dropped' END AS label, row_number() OVER (PARTITION BY repo_id, analysis, included ORDER BY {_WALK}) AS n, path FROM lists")
def preview_files(spark, d):
    return previews.preview_files(_previews(spark, d)[1])
