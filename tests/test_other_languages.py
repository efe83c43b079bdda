"""TypeScript and Go modules: calls, functions, reachability, guards, and modules that can't be read."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reachlight.functions.braces import extract_braces
from reachlight.plans.scan import scan
from reachlight.sources import tree

TS = "server.tool('x', async (args) => {\n%s});\n"
GO = 'package m\nimport "github.com/mark3labs/mcp-go/server"\nfunc run(cmd string, who string) error {\n%s\treturn nil\n}\n'
SINK, GSINK = "  execSync(args.cmd);\n", "\texec.Command(cmd)\n"

MODULES = {
    "plain.ts": (TS % SINK, [("EXEC-SHELL", "high")]),
    "helper.ts": ("function f(args) {\n  execSync(args.cmd);\n}\n", []),
    "named.ts": ("function f(args) {\n  execSync(args.cmd);\n}\nserver.tool('x', f);\n", [("EXEC-SHELL", "high")]),
    "asserted.ts": (TS % ("  authorize(args.cmd);\n" + SINK), []),
    "used.ts": (TS % ("  if (!hasPermission(args.cmd)) { throw new Error('no'); }\n" + SINK), []),
    "assigned.ts": (TS % ("  const ok = checkPermission(args.cmd);\n  if (!ok) return;\n" + SINK), []),
    "discarded.ts": (TS % ("  checkPermission(args.cmd);\n" + SINK), [("EXEC-SHELL-WEAK", "low")]),
    "thrown_away.ts": (TS % ("  void authorize(args.cmd);\n" + SINK), [("EXEC-SHELL-WEAK", "low")]),
    "unbound.ts": (TS % ("  if (!hasPermission(who)) { return; }\n" + SINK), [("EXEC-SHELL-UNBOUND", "medium")]),
    "dead.ts": (TS % ("  if (false) {\n    authorize(args.cmd);\n  }\n" + SINK), [("EXEC-SHELL", "high")]),
    "split.ts": (TS % ("  if (x) {\n    authorize(args.cmd);\n  } else {\n    y();\n  }\n" + SINK), [("EXEC-SHELL", "high")]),
    "after.ts": (TS % (SINK + "  authorize(args.cmd);\n"), [("EXEC-SHELL", "high")]),
    "swallowed.ts": (TS % ("  try {\n    authorize(args.cmd);\n  } catch (e) {\n    log(e);\n  }\n" + SINK), [("EXEC-SHELL", "high")]),
    "rethrown.ts": (TS % ("  try {\n    authorize(args.cmd);\n  } catch (e) {\n    throw e;\n  }\n" + SINK), []),
    "local_bool.ts": (TS % ("  authorize(args.cmd);\n" + SINK) + "function authorize(x) {\n  return !!x;\n}\n", [("EXEC-SHELL-WEAK", "low")]),
    "regexp.ts": (TS % "  /a(b/.exec(args.x);\n  pool.exec(args.x);\n", []),
    "cp.ts": ("import * as proc from 'child_process';\n" + TS % "  proc.exec(args.x);\n", [("EXEC-SHELL", "high")]),
    "fs.ts": (TS % "  fs.promises.writeFile(args.p, `a ${b(c)} )`);\n", [("FILE-WRITE", "medium")]),
    "fetch.ts": (TS % "  await fetch(args.url);\n  client.fetch(args.url);\n", [("NET-EGRESS", "medium")]),
    "command.ts": (TS % "  await client.send(new DeleteObjectCommand(args));\n", [("PROVIDER-SDK-CALL", "high")]),
    "class.ts": ("class Store {\n  save(p: string): void {\n    fs.unlinkSync(p);\n  }\n}\nconst s = new Store();\nserver.registerTool('x', {}, () => s.save('a'));\n", [("DATA-DELETE-FILE", "high")]),
    "module.ts": ("setRequestHandler(S, h);\nfs.rmSync('a');\n", [("DATA-DELETE-FILE", "high")]),
    "module_tool.ts": ("tool('a', h);\nfs.rmSync('a');\n", []),
    "ignored.ts": (TS % SINK + "// reachlight: ignore[EXEC-SHELL]\n", []),
    "plain.go": (GO % GSINK, [("EXEC-SHELL-GO", "high")]),
    "helper.go": (GO.replace("mark3labs", "other") % GSINK, []),
    "handler.go": ("package m\nfunc run(cmd string) {\n\texec.Command(cmd)\n}\nfunc main() {\n\ts.AddTool(t, run)\n}\n", [("EXEC-SHELL-GO", "high")]),
    "asserted.go": (GO % ("\tauthorize(cmd)\n" + GSINK), []),
    "used.go": (GO % ("\tif err := checkPermission(cmd); err != nil {\n\t\treturn err\n\t}\n" + GSINK), []),
    "discarded.go": (GO % ("\tcheckPermission(cmd)\n" + GSINK), [("EXEC-SHELL-GO-WEAK", "low")]),
    "blank.go": (GO % ("\t_ = authorize(cmd)\n" + GSINK), [("EXEC-SHELL-GO-WEAK", "low")]),
    "unbound.go": (GO % ("\tif !hasPermission(who) {\n\t\treturn nil\n\t}\n" + GSINK), [("EXEC-SHELL-GO-UNBOUND", "medium")]),
    "dead.go": (GO % ("\tif false {\n\t\tauthorize(cmd)\n\t}\n" + GSINK), [("EXEC-SHELL-GO", "high")]),
    "nested.go": (GO % ("\tf := func() {\n\t\tauthorize(cmd)\n\t}\n" + GSINK), [("EXEC-SHELL-GO", "high")]),
    "sql_select.go": (GO % '\tdb.Query("SELECT 1")\n', []),
    "sql_delete.go": (GO % '\tdb.Exec("DELETE FROM t")\n', [("DATA-DELETE-SQL-GO", "high")]),
    "sql_any.go": (GO % "\ttx.Exec(cmd)\n", [("DATA-DELETE-SQL-GO", "high")]),
    "receiver.go": (GO % "\tthing.Refund(cmd)\n\tpayments.Refund(cmd)\n", [("PAY-GENERIC-REFUND-GO", "high")]),
    "temporary.go": (GO % '\tf, _ := os.CreateTemp("", "x")\n\tn := f.Name()\n\tos.Remove(n)\n\tos.Remove(cmd)\n', [("DATA-DELETE-OS-GO", "high")]),
    "setup.go": (GO % "\tos.OpenFile(cfg.LogFilePath, 1, 2)\n\tos.Create(cmd)\n", [("FILE-WRITE-GO", "medium")]),
    "returned.go": (GO % "\turl, _ := client.Actions.Logs(cmd)\n\thttp.Get(url)\n\thttp.Get(cmd)\n", [("NET-EGRESS-GO", "medium")]),
    "broken.go": ("func f( {\n", []),
    "broken.ts": ("f('a\n", []),
}


@pytest.fixture(scope="module")
def scanned(spark):
    return scan(tree.from_table(spark.createDataFrame([("r", p, s) for p, (s, _) in MODULES.items()], "repo string, path string, source string"), "repo", "path", "source"))


@pytest.fixture(scope="module")
def found(scanned):
    out = {}
    for r in scanned.findings.where("NOT suppressed").collect():
        out.setdefault(r.path, []).append((r.rule_id, r.effective_severity))
    return out


@pytest.mark.parametrize("path", sorted(MODULES))
def test_module(found, path):
    assert sorted(found.get(path, [])) == sorted(MODULES[path][1])


def test_what_cannot_be_read_is_an_error(scanned):
    assert sorted(r.path for r in scanned.errors.collect()) == ["broken.go", "broken.ts"]


def test_language_of_capabilities(scanned):
    assert {r.language for r in scanned.capabilities.select("language").distinct().collect()} == {"go", "typescript"}


@settings(max_examples=200, deadline=None)
@given(st.text("abc(){}[]=>:;,.\"'`/!&|\n func return if else try catch", max_size=60), st.sampled_from(["go", "typescript"]))
def test_any_source_gives_facts_or_an_error(source, language):
    got = extract_braces(source, language)
    assert set(got) >= {"calls", "functions", "error"}


def test_calls_and_functions():
    got = extract_braces("class A {\n  async go(x: string): Promise<void> {\n    a.b(c(x), 'd').e();\n  }\n}\nconst f = (y) => g(y);\nfunction h() { return 1; }\n", "typescript")
    assert [c["callee"] for c in got["calls"]] == ["a.b", "c", "a.b.e", "g"]
    assert sorted(f["name"] for f in got["functions"]) == ["f", "go", "h"]
    assert [c["line"] for c in got["calls"]] == [3, 3, 3, 6]
    got = extract_braces("package m\nfunc (s *T) Do(a int) (x int, err error) {\n\tif f(a) {\n\t\tg(func() { h() })\n\t}\n\treturn\n}\n", "go")
    assert [c["callee"] for c in got["calls"]] == ["f", "g", "h"] and [f["name"] for f in got["functions"]] == ["Do", ""]
