"""Sources, extraction and streams over small inputs of our own."""

import json
import os
import subprocess
import textwrap

import pytest
from pyspark.sql import functions as F

from plumbline.extract import lexical, python_ast, tables
from plumbline.sources import files, gitlog, manifests
from plumbline.streaming import edits

LEDGER = textwrap.dedent('''
    import decimal
    from bank.rates import daily

    def total(rows):
        return sum(r.amount for r in rows)

    def label(balance, limit):
        text = "ok"
        while balance > limit and limit:
            balance -= limit
            if not balance:
                text = "even"
        return text

    def post(entry, book, day, rate, fee, note, user):
        with book.lock:
            for part in entry:
                if part.amount > 0:
                    book.add(part)

    def settle(a, b):
        return a if a else (b or 0)

    class Account(Holder):
        def __init__(self, number: int, owner: Person, currency: str):
            self.number = number
            self.owner = owner

        def charge(self, rate: float) -> float:
            try:
                due = self.owner and daily(rate)
            except ArithmeticError:
                pass
            self.number += 1
            return branch.fees + self.check(due)
''')


def test_python_functions():
    f = {x["function"]: x for x in python_ast.extract(LEDGER).functions}
    assert [f[k]["args"] for k in ("total", "label", "post", "settle")] == [1, 2, 7, 2]
    assert [f[k]["nesting"] for k in ("total", "label", "post")] == [0, 2, 3]
    # a with counts as a branch, a boolean of a loop's condition does not
    assert (f["total"]["cc"], f["label"]["cc"], f["post"]["cc"]) == (1, 3, 4)
    made = f["Account.__init__"]
    assert made["is_ctor"] and (made["args"], made["typed"], made["primitive"]) == (3, 3, 2)
    charge = f["Account.charge"]
    assert charge["empty_catch"] == 1 and charge["parent"] == "Holder" and {"number", "owner"} <= set(charge["fields"]) and ("branch", "fees") in charge["foreign"]
    facts = python_ast.extract(LEDGER)
    assert facts.imports == [("decimal", 2), ("bank.rates", 3)] and facts.module["functions"] == 6
    assert any(c["callee"] == "check" and c["receiver_type"] == "Account" for c in facts.calls)


def test_python_invariants():
    one = python_ast.extract("def f(a):\n    if a:\n        return a + 1\n").functions[0]
    renamed = python_ast.extract("def f(bb):\n    if bb:\n\n        return bb + 7\n").functions[0]
    assert one["structural_hash"] == renamed["structural_hash"] and one["cc"] == renamed["cc"]
    more = python_ast.extract("def f(a):\n    if a:\n        return a + 1\n    if a > 2:\n        return 3\n").functions[0]
    assert more["cc"] == one["cc"] + 1 and more["structural_hash"] != one["structural_hash"]
    elif_ = python_ast.extract("def f(a, b):\n    if a:\n        pass\n    elif a and b:\n        pass\n").functions[0]
    assert elif_["cc"] == 5  # booleans of an elif count twice


@pytest.mark.parametrize("text", ["", "\ufeff", "def f(", "class", "x = (" * 50, "\0", "def f():\n" + "".join("    " * (i + 1) + "if a:\n" for i in range(90)) + "    " * 91 + "pass\n"])
def test_adversarial_python(text):
    facts = python_ast.extract(text)
    assert facts is None or all(f["cc"] >= 1 and f["end_line"] >= f["start_line"] and f["nesting"] <= 2000 for f in facts.functions)


def test_dataflow_and_taint():
    code = "def f(a):\n    x = 1\n    x = a\n    for i in a:\n        y = i\n        if y:\n            break\n            z = 2\n    return x\n    w = 4\n"
    assert python_ast.unreachable_lines(code) == [("f", 8), ("f", 10)]
    assert ("f", "x", 2) in python_ast.dead_stores(code) and not any(n == "y" for _, n, _ in python_ast.dead_stores(code))
    code = "def g():\n    q = input()\n    ok = clean(q)\n    run(q)\n    run(ok)\n    q = 'x'\n    run(q)\n"
    assert python_ast.taint(code, {"input"}, {"run"}, {"clean"}) == [("g", "run", 4)]


SAMPLES = {
    "javascript": "import x from 'lib';\nfunction pick(a, b) {\n  if (a && b) { return 1; }\n  for (;;) { }\n}\n", "typescript": "import { y } from './m';\nfunction pick(a: number, b: string): void {\n  if (a && b) { return; }\n  while (a) { }\n}\n",
    "rust": "use std::io;\nfn pick(a: i32, b: bool) -> i32 {\n  if a > 1 && b { return 1; }\n  while b { }\n  0\n}\n", "c": "#include <stdio.h>\nint pick(int a, int b) {\n  if (a && b) return 1;\n  for (;;) { }\n}\n", "cpp": "#include <vector>\nint pick(int a, int b) {\n  if (a && b) return 1;\n  for (;;) { }\n}\n",
    "java": "import java.util.List;\nclass A {\n int pick(int a, boolean b) {\n  if (a > 1 && b) { return 1; }\n  for (;;) { }\n }\n}\n", "csharp": "using System;\nclass A {\n int pick(int a, bool b) {\n  if (a > 1 && b) { return 1; }\n  for (;;) { }\n }\n}\n", "go": 'import "fmt"\nfunc pick(a int, b bool) int {\n  if a > 1 && b { return 1 }\n  for { }\n}\n',
    "swift": "import Foundation\nfunc pick(a: Int, b: Bool) -> Int {\n  if a > 1 && b { return 1 }\n  while b { }\n}\n", "zig": 'const s = @import("std");\nfn pick(a: i32, b: bool) i32 {\n  if (a > 1 and b) { return 1; }\n  while (b) { }\n}\n', "kotlin": "import a.b\nfun pick(a: Int, b: Boolean): Int {\n  if (a > 1 && b) { return 1 }\n  for (i in 1..2) { }\n}\n",
    "php": "<?php\nuse App\\X;\nfunction pick($a, $b) {\n  if ($a && $b) { return 1; }\n  while ($b) { }\n}\n", "d": "import std.stdio;\nint pick(int a, bool b) {\n  if (a && b) { return 1; }\n  while (b) { }\n}\n", "groovy": "import a.B\ndef pick(a, b) {\n  if (a && b) { return 1 }\n  while (b) { }\n}\n",
    "tcl": "package require http\nproc pick {a b} {\n  if {$a && $b} { return 1 }\n  while {$b} { }\n}\n", "r": "library(dplyr)\npick <- function(a, b) {\n  if (a && b) { return(1) }\n  while (b) { }\n}\n", "ruby": "require 'json'\ndef pick(a, b)\n  if a && b\n    return 1\n  end\n  while b\n  end\nend\n",
    "lua": 'local x = require("m")\nfunction pick(a, b)\n  if a and b then return 1 end\n  while b do end\nend\n', "objectivec": '#import "A.h"\n- (int)pick:(int)a with:(int)b {\n  if (a && b) { return 1; }\n  while (b) { }\n}\n',
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_other_languages(lang):
    facts = lexical.extract(SAMPLES[lang], lang)
    f = facts.functions[0]
    assert f["function"].lstrip("-").startswith("pick") and f["cc"] == 4 and f["end_line"] >= f["start_line"] + 2 and len(facts.imports) == 1


def test_every_language_has_a_profile():
    from plumbline.functions.paths import LANGUAGES

    assert set(LANGUAGES.values()) - {"python"} <= set(lexical.PROFILES) and lexical.extract("x", "klingon") is None
    assert lexical.extract("module A where\nimport Data.List\nf x | x > 1 = 2\n", "haskell").imports == [("Data.List", 2)]
    assert lexical.extract("       MAIN-PARA.\n           IF A AND B\n           END-IF.\n", "cobol").functions[0]["cc"] >= 2


def test_tree_to_findings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/shapes.py").write_text(LEDGER)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00x")
    (tmp_path / "src/long.py").write_text("x = '" + "a" * 200_001 + "'")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/a.js").write_text("x")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/test_a.py").write_text("x = 1")
    (tmp_path / "src/a.go").write_text(SAMPLES["go"])
    (tmp_path / "src/h.c").write_text("#if A\n#endif\n" * 41)
    found, skipped = files.source_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in found.collect()) == ["src/a.go", "src/h.c", "src/shapes.py"]
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"src/bad.py": "encoding", "src/long.py": "line_bytes"}
    f = tables.functions(found)
    assert f.filter("lang = 'python'").count() == 6 and f.filter("lang = 'go'").first()["cc"] == 4
    assert tables.modules(found).filter("lang = 'python'").first()["sum_cc"] > 10
    assert sorted(r["target"] for r in tables.imports(found).collect()) == ["bank.rates", "decimal", "fmt"]
    assert tables.calls(found).filter("callee = 'check'").count() == 1 and tables.dataflow(found).count() >= 0
    assert tables.ifdef_density(found).first()["conditionals"] == 41


def test_git(spark, tmp_path):
    text = "__COMMIT__\nh1\na@x\n100\nf1\nf2\n\n__COMMIT__\nh2\nb@x\n200\nf1\n\n__COMMIT__\nh3\nb@x\n300\n"
    (tmp_path / "log.txt").write_text(text)
    want = [("h1", "a@x", 100, "f1"), ("h1", "a@x", 100, "f2"), ("h2", "b@x", 200, "f1")]
    assert sorted(map(tuple, gitlog.parse_log(spark, str(tmp_path / "log.txt")).collect())) == want
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(2):
        (repo / "a.py").write_text(f"x = {i}\n")
        (repo / f"b{i}.py").write_text("y\n")
        git("add", ".")
        git("commit", "-qm", f"c{i}")
    gitlog.register(spark)
    log = spark.read.format("git").option("path", str(repo)).load().collect()
    assert sorted(r["file"] for r in log) == ["a.py", "a.py", "b0.py", "b1.py"]
    snapshot = spark.read.format("git").option("path", str(repo)).option("table", "snapshot").load().collect()
    assert {r["path"]: r["source"] for r in snapshot}["a.py"] == "x = 1\n"


MANIFESTS = {
    "Cargo.toml": ('[package]\nname = "me"\nversion = "1.0"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ntempfile = { version = "3" }\n', {("me", True), ("serde", False), ("tempfile", False)}),
    "package.json": ('{"name": "me", "dependencies": {"left-pad": "^1"}, "devDependencies": {"jest": "*"}}', {("me", True), ("left-pad", False), ("jest", False)}),
    "pyproject.toml": ('[project]\nname = "me"\ndependencies = ["numpy>=1", "requests[x]==2; python_version > \'3\'"]\n', {("me", True), ("numpy", False), ("requests", False)}),
    "requirements.txt": ("# c\nflask==1.0\n-r other\nclick\n", {("flask", False), ("click", False)}),
    "go.mod": ("module me\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire x.org/y v0.1.0\n", {("me", True), ("github.com/a/b", False), ("x.org/y", False)}),
    "Gemfile": ("gem 'rails', '~> 6'\ngroup :test do\n  gem 'rspec'\nend\n", {("rails", False), ("rspec", False)}),
    "Package.swift": ('.package(url: "https://x.org/Foo.git", from: "1.0.0")', {("Foo", False)}),
    "composer.json": ('{"name": "v/me", "require": {"php": "8", "a/b": "1"}}', {("v/me", True), ("a/b", False)}),
    "pom.xml": ('<project xmlns="http://m"><groupId>g</groupId><artifactId>me</artifactId><dependencies><dependency><groupId>a</groupId><artifactId>b</artifactId><version>1</version></dependency></dependencies></project>', {("g:me", True), ("a:b", False)}),
    "build.gradle": ("dependencies {\n  implementation 'a.b:c:1.0'\n  testImplementation(\"d:e:2\")\n}", {("a.b:c", False), ("d:e", False)}),
    "x.csproj": ('<PackageReference Include="Newtonsoft.Json" Version="13" />', {("Newtonsoft.Json", False)}),
    "build.zig.zon": ('.{ .dependencies = .{ .zap = .{ .url = "https://z" } } }', {("zap", False)}),
}


@pytest.mark.parametrize("name", sorted(MANIFESTS))
def test_manifests(name):
    source, want = MANIFESTS[name]
    assert {(r[1], r[4]) for r in manifests.parse(f"a/{name}", source)} == want
    assert manifests.parse(f"a/{name}", "{ not [ valid") == [] or name not in ("Cargo.toml", "package.json")


def test_manifest_scan(spark, tmp_path):
    for name, (source, _) in MANIFESTS.items():
        (tmp_path / name).write_text(source)
    (tmp_path / "Cargo.lock").write_text('[[package]]\nname = "serde"\nversion = "1.0.1"\n')
    declared, locked = manifests.read(spark, str(tmp_path))
    assert declared.filter("own").count() == 6 and {tuple(r)[1:] for r in locked.collect()} == {("serde", "1.0.1")}
    assert manifests.workspace_members('[workspace]\nmembers = ["crates/*"]') == ["crates/*"] and manifests.workspace_members('{"workspaces": ["p/*"]}') == ["p/*"]
    assert manifests.declared_test_roots('[tool.pytest.ini_options]\ntestpaths = ["t"]', "[pytest]\ntestpaths = a b\n") == ["t", "a", "b"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"directory": "/d", "file": "a.c", "command": "cc -DX=1 -I inc -Iother a.c"}]))
    r = files.compile_commands(spark, str(tmp_path / "c.json")).first()
    assert r["defines"] == ["X=1"] and sorted(r["includes"]) == ["inc", "other"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/1.json").write_text(json.dumps({"session_id": "s", "tool_input": {"file_path": "a.py", "old_string": "x", "new_string": "y"}, "tool_response": {"originalFile": "x", "structuredPatch": [{"newStart": 3, "newLines": 2}, {"newStart": 9, "newLines": 1}]}}) + "\n" + json.dumps({"session_id": "s", "file_path": "a.py", "edit_range": [4, 6]}) + "\n")
    assert sorted((r["first_line"], r["last_line"]) for r in files.hooks(spark, str(tmp_path / "h")).collect()) == [(3, 9), (4, 6)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/p.json").write_text(json.dumps({"packageKey": {"name": "p"}, "versions": [{"versionKey": {"version": "1"}, "publishedAt": "2020-01-01T00:00:00Z", "advisoryKeys": [{"id": "A"}]}]}))
    versions, advisories = files.package_registry(spark, str(tmp_path / "r"))
    assert tuple(versions.first()) == ("p", "1", "2020-01-01T00:00:00Z") and advisories.first()["advisory"] == "A"


def run_stream(df, tmp_path, mode="append"):
    q = edits.start(df, str(tmp_path / "out"), str(tmp_path / "check"), mode)
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def test_stream_of_edits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps({"session_id": "s", "file_path": "a.py", "edit_range": [1, 2]}) + "\n" for _ in range(3)))
    out = run_stream(edits.edit_counts(edits.hook_stream(spark, str(tmp_path / "in"), 1)), tmp_path).collect()
    assert sorted((r["edit"], r["checkpoint"]) for r in out) == [(1, False), (2, True), (3, False), (4, False), (5, True), (6, False)]


def test_stream_of_counts_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, n in enumerate((3, 2, 5)):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"session": "s", "path": "p", "smell": "x", "n": n}))
        os.utime(tmp_path / f"in/{k}.json", (1_000_000 + k, 1_000_000 + k))
    src = spark.readStream.schema("session string, path string, smell string, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert [(r["n"], r["base"]) for r in run_stream(edits.regressions(src), tmp_path).collect()] == [(5, 3)]
    ev = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:05:00", "a")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    assert sorted(r["events"] for r in edits.windowed(ev, "t", "1 minute", "1 minute", ["k"]).collect()) == [1, 2]
    assert sorted(r["events"] for r in edits.sessions(ev, "t", "1 minute", "1 minute", ["k"]).collect()) == [1, 2]


def test_commands(spark, tmp_path, capsys):
    from plumbline import cli

    (tmp_path / "app").mkdir()
    branches = "".join(f"    if a == {i}:\n        b += {i}\n" for i in range(12))
    (tmp_path / "app/a.py").write_text(f"import app.b\n\ndef f(a, b):\n{branches}    return b\n")
    (tmp_path / "app/b.py").write_text("from app.a import f\n")
    for k in range(3):
        (tmp_path / f"app/c{k}.py").write_text(f"x = {k}\n")
    assert cli.main(["check", str(tmp_path)]) == 1 and "app/a.py:3 complex_method (f) 13" in capsys.readouterr().out
    (tmp_path / "plumbline.toml").write_text("[thresholds.function]\ncc_warning = 14\ncogc_warning = 99\n")
    assert cli.main(["check", str(tmp_path), "--json"]) == 0
    assert cli.main(["audit", str(tmp_path)]) == 1 and "import_cycle" in capsys.readouterr().out
    assert cli.main(["calibrate", str(tmp_path)]) == 0 and "cc_warning = 14" in capsys.readouterr().out
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(4):
        (tmp_path / "app/a.py").write_text(f"# {i}\n" + (tmp_path / "app/a.py").read_text())
        git("add", ".")
        git("commit", "-qm", f"c{i}")
    assert cli.main(["history", str(tmp_path)]) == 1 and "hotspot" in capsys.readouterr().out
