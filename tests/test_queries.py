"""Every query against its SQL on the smallest tables."""

import hashlib
import re

import pytest

from quarry.plans import registry
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def documents(spark, folder, texts):
    """Documents of one source; a document's number decides which file it is."""
    spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_schema_queries_read_whole_files(spark, tmp_path):
    prose = "create " + "word " * 20_000  # no stack is used for the words between CREATE and TABLE
    texts = {12: f"{prose}\nCREATE TABLE late_a (id int);", 13: "x\n" * 50 + "CREATE TEMP TABLE IF NOT EXISTS s.Late_B (id int);\ncreate create unlogged table late_c (", 14: "def f(): pass\n\nclass LateD(models.Model):\n    pass", 15: "CREATE TABLE of_no_schema (id int);"}
    d = documents(spark, tmp_path, texts)
    want = {"t12", "late_a", "orders13", "users", "late_b", "late_c", "order14", "lated"}
    assert {r["name"] for r in registry.queries()["schema_tables"](spark, d).collect()} == want
    batches = registry.queries()["table_batches"](spark, d).collect()
    assert ",".join(r["names"] for r in sorted(batches, key=lambda r: r["batch"])) == ",".join(sorted(want))


def test_reply_queries_read_whole_texts(spark, tmp_path):
    text = "word " * 5_000 + "\n## Late\n### `users` view\n### Last (4 endpoints)\n**Owner:** late\n```json\n{\"late\": 1}\n```\n  users ||--o{ users : self\n"
    d = documents(spark, tmp_path, {1: text, 13: "short"})
    ask = lambda name: [r for r in registry.queries()[name](spark, d).collect() if r["prompt_id"] == 1]
    cards = [m.strip() for m in re.findall(r"(?m)^### (.*)$", text)] + ["Orders (1 endpoints)", "`users` (1 routes)", "Tail (1)", "No size (x 3)"]
    assert [r["title"] for r in sorted(ask("split_cards"), key=lambda r: r["card"])] == cards
    contexts = [r["context_md5"] for r in sorted(ask("chapter_context"), key=lambda r: r["card"])]
    assert contexts[0] == hashlib.md5(b"(This is the first chapter.)").hexdigest() and contexts[1] == hashlib.md5(b"").hexdigest() != contexts[2]
    assert sorted(r["section"] for r in ask("split_sections")) == ["cards", "late", "overview"]
    assert [r["value"] for r in ask("reply_values")] == ['{"late": 1}'] and [r["owner"] for r in ask("labelled_field")] == ["late"]
    assert {r["name"]: r["n"] for r in ask("feature_group_sizes")} == {"Last": 4, "Orders": 1, "`users`": 1, "Tail": 1}
    assert [r["name"] for r in ask("reply_tables")] == ["users"]


def test_every_document_reaches_python_imports_and_pyproject(spark, tmp_path):
    say = "\nfrom pkg.m1 import thing\n"
    d = documents(spark, tmp_path, {1: "", 0: "", 14: say, 22: say, 24: say, 23: say})  # 14 models.py, 22 a client, 24 a serializer, 23 no Python
    got = {(r["from_path"], r["to_path"]) for r in registry.queries()["resolve_python"](spark, d).collect()}
    assert got == {(p, "pkg/m1.py") for p in ("app14/models.py", "app-store/integrations/slack22/client.py", "src/serializers/s24.py", "pkg/m1.py")}  # the last one imports itself
    d = documents(spark, tmp_path / "more", {25: "", 52: "", 26: ""})  # two pyproject files, and one that does not parse
    assert {(r["manifest_path"], r["name"], r["version"]) for r in registry.queries()["deps_pyproject"](spark, d).collect()} == {(f"p{k}/pyproject.toml", n, c) for k in (25, 52) for n, c in (("numpy", ">=2"), (f"lib{k}", "==2"), ("pytest", ""))}


def test_notes_on_thousands_of_files(spark, tmp_path, monkeypatch):
    import duckdb

    from quarry.operators import previews
    from quarry.plans import standins as v

    d = documents(spark, tmp_path, {k: "x" for k in range(2_000)})
    parts = {"tour": previews.tour(v.files(spark, d), 24_000)}
    (note,) = (r["note"] for r in parts["tour"].notes.collect())
    most = parts["tour"].counts.where("repo_id = 's'").collect()[0]["source files found"]
    assert most > 1_030 and note.startswith(f"{most - 30:,} of {most:,} source files never reach")  # the reference groups thousands
    monkeypatch.setattr(registry, "_previews", lambda spark, d: (v.files(spark, d).select("repo_id").unionByName(v.commits(spark, SF).select("repo_id")), parts))
    got = registry.queries()["preview_rollup"](spark, d).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL["preview_rollup"]).df()
    assert rows(got) == rows(want[want["analysis"] == "tour"]) and len(got) == 9  # two repositories of files, seven of commits
