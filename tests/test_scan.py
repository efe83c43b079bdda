"""The scanner on small modules: reachability, guards, receivers, SQL, suppression, files that can't be read."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachlight.functions.extract import extract
from reachlight.operators import reports
from reachlight.operators.findings import gate, most_exposed, summary
from reachlight.plans.scan import contents, repositories, scan
from reachlight.sources import tree

SHELL = "    subprocess.run(cmd)\n"
TOOL = "@tool\ndef f(cmd, who):\n"


def guard(before, sink=SHELL, head=TOOL, after=""):
    return f"import subprocess\n{head}{before}{sink}{after}"


#: path: (source, [(rule, severity)] of findings that aren't suppressed)
MODULES = {
    "plain.py": (guard(""), [("EXEC-SHELL", "high")]),
    "undecorated.py": (guard("", head="def f(cmd, who):\n"), []),
    "main.py": ("import subprocess\nif __name__ == '__main__':\n    subprocess.run('x')\n", []),
    "asserted.py": (guard("    authorize(cmd)\n"), []),
    "used.py": (guard("    if not has_permission(cmd):\n        raise ValueError\n"), []),
    "discarded.py": (guard("    check_permission(cmd)\n"), [("EXEC-SHELL-WEAK", "low")]),
    "unbound.py": (guard("    ok = has_permission(who)\n"), [("EXEC-SHELL-UNBOUND", "medium")]),
    "aliased.py": (guard("    x = cmd\n    ok = has_permission(x)\n"), []),
    "counterfeit.py": (guard("    a = 'n'\n    authorize(a)\n"), [("EXEC-SHELL-UNBOUND", "medium")]),
    "dead.py": (guard("    if 0:\n        authorize(cmd)\n"), [("EXEC-SHELL", "high")]),
    "split.py": (guard("    if who:\n        authorize(cmd)\n"), [("EXEC-SHELL", "high")]),
    "same_branch.py": (guard("    if who:\n        authorize(cmd)\n", sink="        subprocess.run(cmd)\n"), []),
    "after.py": (guard("", after="    authorize(cmd)\n"), [("EXEC-SHELL", "high")]),
    "swallowed.py": (guard("    try:\n        authorize(cmd)\n    except Exception:\n        pass\n"), [("EXEC-SHELL", "high")]),
    "reraised.py": (guard("    try:\n        authorize(cmd)\n    except Exception:\n        raise\n"), []),
    "nested.py": (guard("    def g():\n        authorize(cmd)\n"), [("EXEC-SHELL", "high")]),
    "local_bool.py": (guard("    authorize(cmd)\n", after="\ndef authorize(x):\n    return bool(x)\n"), [("EXEC-SHELL-WEAK", "low")]),
    "decorated.py": (guard("", head="@tool\n@login_required\ndef f(cmd, who):\n"), []),
    "approved.py": (guard("", head="@tool(external_execution=True)\ndef f(cmd, who):\n"), []),
    "dotted.py": (guard("", head="@mcp.tool()\ndef f(cmd, who):\n"), [("EXEC-SHELL", "high")]),
    "route.py": (guard("", head="@app.post('/x')\ndef f(cmd, who):\n"), [("EXEC-SHELL", "high")]),
    "base.py": ("class A(BaseTool):\n    def _run(self, u):\n        os.system(u)\n", [("EXEC-SHELL", "high")]),
    "wrapped.py": ("def f(u):\n    os.system(u)\nTool.from_function(f)\n", [("EXEC-SHELL", "high")]),
    "listed.py": ("def f(u):\n    os.system(u)\nAgent(tools=[f])\n", [("EXEC-SHELL", "high")]),
    "schema.py": ("T = [{'type': 'function', 'function': {'name': 'go', 'parameters': {}}}]\ndef d(name, a):\n    if name == 'go':\n        os.system(a)\n", [("EXEC-SHELL", "high")]),
    "action.py": ("def h(action: CmdRunAction):\n    os.system(action.command)\n", [("EXEC-SHELL", "high")]),
    "declared.py": ("class A(BaseTool):\n    requires_auth = True\n    def _run(self, u):\n        os.system(u)\n", []),
    "inherited.py": ("class A(BaseTool):\n    requires_auth = True\nclass B(A, BaseTool):\n    def _run(self, u):\n        os.system(u)\n", []),
    "sql_literal.py": ("@tool\ndef q(x):\n    cursor.execute('DELETE FROM t')\n", [("DATA-DELETE-SQL", "high")]),
    "sql_select.py": ("@tool\ndef q(x):\n    cursor.execute('SELECT 1')\n", []),
    "sql_insert.py": ("@tool\ndef q(x):\n    cursor.execute('INSERT INTO t VALUES (1)')\n", [("DATABASE-MUTATE", "high")]),
    "sql_any.py": ("@tool\ndef q(x):\n    cursor.execute(x)\n", [("DATA-DELETE-SQL", "high")]),
    "sql_chain.py": ("import psycopg2 as pg\n@tool\ndef q(x):\n    pg.connect('d').cursor().execute(x)\n", [("DATA-DELETE-SQL", "high")]),
    "sql_step.py": ("@tool\ndef q(step):\n    step.execute(1)\n", []),
    "sql_text.py": ("@tool\ndef q():\n    query = 'DROP TABLE t'\n", [("DATA-DELETE-SQL-RAW", "high")]),
    "open_w.py": ("@tool\ndef w(p):\n    open(p, 'w')\n", [("FILE-OPEN-WRITE", "high")]),
    "open_r.py": ("@tool\ndef w(p):\n    open(p)\n    open(p, 'rb')\n", []),
    "egress.py": ("@tool\ndef w(url):\n    requests.post(url)\n", [("NET-EGRESS", "high")]),
    "egress_fixed.py": ("@tool\ndef w(url):\n    requests.post('https://a.example')\n", [("NET-EGRESS", "medium")]),
    "rest.py": ("@tool\ndef w(r):\n    requests.put(f'https://api.github.com/repos/{r}/contents/x')\n", [("GITHUB-REST-MUTATION", "high")]),
    "typed.py": ("from pathlib import Path\n@tool\ndef w(s):\n    p = Path(s)\n    p.write_text('x')\n", [("FILE-WRITE", "high")]),
    "boto.py": ("@tool\ndef w(k):\n    boto3.client('s3').delete_object(k)\n", [("PROVIDER-SDK-CALL", "medium")]),
    "stripe.py": ("@tool\ndef w(k):\n    stripe.Refund.create(k)\n", [("PAY-STRIPE-REFUND", "high")]),
    "agent_mail.py": ("@tool\ndef w(k):\n    c = A2AClient()\n    c.send_message(k)\n", []),
    "mail.py": ("@tool\ndef w(k):\n    smtp.send_message(k)\n", [("COMMUNICATION-SEND", "medium")]),
    "gated_no.py": ("@tool\ndef w(k):\n    thing.send(k)\n", []),
    "gated.py": ("@tool\ndef w(k):\n    sg = SendGridAPIClient(k)\n    sg.send(k)\n", [("EMAIL-PROVIDER-SEND", "medium")]),
    "cleanup.py": ("import tempfile\n@tool\ndef w(k):\n    p = tempfile.mkstemp()\n    try:\n        pass\n    finally:\n        os.remove(p)\n", []),
    "ignored.py": (guard("") + "# reachlight: ignore[EXEC-SHELL]\n", []),
    "broken.py": ("def f(:\n", []),
    "__init__.py": (guard(""), [("EXEC-SHELL", "high")]),
}


@pytest.fixture(scope="module")
def scanned(spark):
    table = spark.createDataFrame([("r", p, s) for p, (s, _) in MODULES.items()] + [("r", "x.rb", "puts 1")], "repo string, path string, source string")
    return scan(tree.from_table(table, "repo", "path", "source"))


@pytest.fixture(scope="module")
def found(scanned):
    out = {}
    for r in scanned.findings.where("NOT suppressed").collect():
        out.setdefault(r.path, []).append((r.rule_id, r.effective_severity))
    return out


@pytest.mark.parametrize("path", sorted(MODULES))
def test_module(found, path):
    assert sorted(found.get(path, [])) == sorted(MODULES[path][1])


def test_nothing_disappears(scanned):
    assert [r.path for r in scanned.errors.collect()] == ["broken.py"]
    assert [tuple(r) for r in scanned.unsupported.select("path", "language").collect()] == [("x.rb", "ruby")]
    row = repositories(scanned).first()
    assert row.files_scanned == len(MODULES) and row.errors == 1
    assert scanned.findings.where("path = 'ignored.py'").first().suppression_reason == "inline"


def test_reports(scanned):
    doc = reports.document(scanned, "r")
    assert doc["findings"] == len(doc["findings_list"]) == sum(len(f) for _, f in MODULES.values())
    assert doc["unsupported"]["by_language"] == {"ruby": 1} and not doc["statement"]
    log = reports.sarif(scanned, "r")["runs"][0]
    assert len(log["results"]) == doc["findings"] and len({r["id"] for r in log["tool"]["driver"]["rules"]}) == len(log["tool"]["driver"]["rules"])
    assert "plain.py" in reports.text(scanned, "r") and "| high |" in reports.markdown(scanned, "r") and reports.dumps(doc)
    assert summary(scanned.capabilities).first().capabilities == doc["capabilities"]
    assert gate(scanned.findings, "high").first().failed
    assert most_exposed(scanned.findings).count() == 1
    (one,) = reports.explain(scanned, "r", "egress.py", 3)
    assert one["controlled"] == ["url"] and one["rule_id"] == "NET-EGRESS"


def test_method_is_the_last_call_outside_parentheses(spark):
    from reachlight.operators.findings import by_consequence

    calls = ["connect().cursor().execute(x)", "os.system(f(g(1), h()))", "run", "a.b (c)", "sub(run)"]
    rows = [("r", f"{i}.py", i, "EXEC-SHELL", "shell_execution", "high", "high", c, False) for i, c in enumerate(calls)]
    got = by_consequence(spark.createDataFrame(rows, "repo string, path string, line int, rule_id string, category string, effective_severity string, confidence string, call_text string, suppressed boolean")).first()
    assert set(got.methods) == {"execute", "system", "run", "b", "sub"} and got.findings == 5 and got.rule_ids == ["EXEC-SHELL"]


def test_baseline(spark, scanned, tmp_path):
    reports.write_baseline(scanned, str(tmp_path / "b"))
    again = scan(scanned.files, baseline=spark.read.json(str(tmp_path / "b")))
    assert again.findings.where("NOT suppressed").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "_priv").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"__init__.py": b"\xef\xbb\xbfx = 1", "_priv/a.py": b"y = 2", "bad.py": b"\xff\xfe\x00", "node_modules/n.py": b"z", "test_a.py": b"t", "b.go": b"package b", "readme.md": b"-"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in tree.files(spark, {"r": str(tmp_path)}).collect()}
    assert sorted(rows) == ["__init__.py", "_priv/a.py", "b.go", "bad.py"]
    assert rows["__init__.py"].source == "x = 1" and "UnicodeDecodeError" in rows["bad.py"].error
    assert [r.path for r in scan(tree.files(spark, {"r": str(tmp_path)})).errors.collect()] == ["bad.py"]
    assert tree.files(spark, {"r": str(tmp_path)}, exclude=["_priv/**"], only=["_priv/a.py", "bad.py"]).count() == 1


def test_a_content_is_analysed_once(spark, tmp_path):
    """However many files hold it; each of them has its rows, a path that is there twice too, and its own tier."""
    sources = [MODULES["plain.py"][0], MODULES["broken.py"][0], MODULES["ignored.py"][0]]
    paths = [*(f"{i}.py" for i in range(300)), "docs/a.py", "x.go"]
    table = spark.createDataFrame([(r, p, s) for r in "ab" for p in paths for s in sources], "repo string, path string, source string")
    files = tree.from_table(table, "repo", "path", "source").withColumn("tier", F.when(F.col("path").startswith("docs/"), "example").otherwise("production"))
    assert contents(files).count() == 6
    first = scan(files, store=str(tmp_path / "facts"))
    again = scan(files, known=first.facts)
    for s in (first, again):
        assert s.facts.count() == s.facts.where("repo IN ('a', 'b')").count() == 2 * 302 * 3
        rows = {(r.rule_id, r.tier, r.suppressed): r.n for r in s.findings.groupBy("rule_id", "tier", "suppressed").agg(F.count("*").alias("n")).collect()}
        assert rows == {("EXEC-SHELL", t, x): n for t, n in (("production", 600), ("example", 2)) for x in (False, True)}
        assert s.errors.where("path LIKE '%.py'").count() == 2 * 301


def test_cached_facts_give_the_same(spark, scanned):
    again = scan(scanned.files, known=scanned.facts)
    key = ["path", "line", "rule_id", "suppressed"]
    assert sorted(map(str, again.findings.select(*key).collect())) == sorted(map(str, scanned.findings.select(*key).collect()))


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/*.py", "a/b.py", True), ("*.py", "a/b.py", True), ("docs/**", "docs/x/y.py", True), ("docs/**", "a/docs/y.py", True), ("**/tests/**", "tests/a.py", True), ("**/x.py", "x.py", True), ("a/*.py", "a/b/c.py", True), ("a/*.py", "b/a/c.py", False), ("docs/**", "docs2/a.py", False)],
)
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(tree.excluded(F.lit(path), [glob]).alias("x")).first().x is hit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["f(x)", "a.b(c)(d)", "g(h(i()))", "[j(k) for k in l()]", "x = lambda: m()", "@n()\ndef o(): p()", "class Q(r()): s()", "print(f'{t()}')"]), max_size=8))
def test_every_call_is_a_fact(lines):
    source = "\n".join(lines)
    assert len(extract(source)["calls"]) == sum(isinstance(n, ast.Call) for n in ast.walk(ast.parse(source)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_source_gives_facts_or_an_error(source):
    got = extract(source)
    assert got["error"] or ast.parse(source)


def test_stream_of_changes(spark, tmp_path):
    from reachlight.streaming.changes import scan_changes

    spark.createDataFrame([("r", "a.py", "x = 1", 1), ("r", "a.py", MODULES["plain.py"][0], 2)], "repo string, path string, source string, ts long").write.parquet(str(tmp_path / "in"))
    got = []
    q = scan_changes(spark.readStream.schema("repo string, path string, source string, ts long").parquet(str(tmp_path / "in")), lambda s, n: got.extend(s.findings.collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert [r.rule_id for r in got] == ["EXEC-SHELL"]
