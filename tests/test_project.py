"""Facts and gates of a whole project."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from plumbline import cli, config
from plumbline.operators import project
from plumbline.sources import stdlib


def sources(spark, own):
    return spark.createDataFrame([(p, lang, s) for (p, lang), s in own.items()], "path string, lang string, source string")


def test_abstractness(spark):
    own = {
        ("a.java", "java"): "interface A {}\n// interface No {}\nclass B {}\nenum C {}\nString s = \"class x\";",
        ("b.rs", "rust"): "trait T {}\nstruct S;\n/* enum E {} */", ("c.ts", "typescript"): "abstract class A {}\nclass B {}\nexport type X = 1",
        ("d.py", "python"): "class A:\n  pass\n# class B", ("e.go", "go"): "type R interface {\n}\n", ("f.py", "python"): "x = 1", ("g.cob", "cobol"): "class",
    }
    got = {r["path"]: (r["abstractness"] and round(r["abstractness"], 3), r["confidence"]) for r in project.abstractness(sources(spark, own)).collect()}
    assert got == {"a.java": (0.333, 4), "b.rs": (0.5, 4), "c.ts": (0.333, 4), "d.py": (0.0, 3), "e.go": (0.5, 3), "f.py": (None, 3), "g.cob": (None, None)}


def test_strictness(spark):
    loose = "\n\nlet a: any;\n" + "f(x as any, y<any>);\n" * 4
    df = sources(spark, {("a.ts", "typescript"): loose, ("b.ts", "typescript"): "let any = 1; // : any\n" * 20, ("c.js", "javascript"): loose})
    assert [tuple(r) for r in project.strictness(df, "{}").collect()] == [("a.ts", 9, 3)]
    for config_ in (None, '{"strict" : true}', '{"compilerOptions": {"noImplicitAny": true}}'):
        assert project.strictness(df, config_).count() == 0


def test_floor_and_gate(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, 9.0), (3, 5, 0.4)], "id int, distinct_kinds int, branching_factor double")
    assert [r["id"] for r in project.complexity_floor(df).collect()] == [1]
    assert [project.package_gate(n, df.filter(c)) for n, c in ((4, "true"), (5, "false"), (5, "true"))] == ["too_few", "zero_edges", "measured"]


def test_a_finding_belongs_to_the_deepest_thresholds(spark):
    rows = spark.createDataFrame([("a.py", 7), ("x/b.py", 7), ("x/y/c.py", 7), ("x/y/d.py", 20), ("z/e.py", 2), ("xx/f.py", 4)], "file string, value int")
    found = project.by_stratum(lambda t: rows.filter(F.col("value") > t.most), SimpleNamespace(most=5), {"x": SimpleNamespace(most=9), "x/y": SimpleNamespace(most=1), "z": SimpleNamespace(most=1)})
    assert sorted(r["file"] for r in found.collect()) == ["a.py", "x/y/c.py", "x/y/d.py", "z/e.py"]


def test_stdlib(spark):
    df = spark.createDataFrame([("python", "json"), ("python", "numpy"), ("javascript", "node:fs"), ("typescript", "react"), ("go", "net/http"), ("go", "github.com/x/y"), ("csharp", "System.Text"), ("rust", "std"), ("cobol", "x"), (None, "json")], "lang string, root string")
    assert [r[0] for r in df.select(stdlib.is_stdlib(F.col("lang"), F.col("root"))).collect()] == [True, False, True, False, True, False, True, True, False, False]
    assert stdlib.names(spark).filter("lang = 'python' and name = 'sys'").count() == 1


def test_census_is_apart_for_tests_and_without_fixtures(spark):
    functions = spark.createDataFrame([("a.py", "python", 3), ("a.py", "python", 3), ("tests/b.py", "python", 1), ("x/fixtures/c.py", "python", 9)], "path string, lang string, cc int")
    files = sources(spark, {("a.py", "python"): "x", ("tests/b.py", "python"): "y", ("x/fixtures/c.py", "python"): "z"})
    assert {(r["is_test"], r["value"], r["n"]) for r in project.census(functions, files, ["cc"]).collect()} == {(False, 3, 2), (True, 1, 1)}


def test_audit_of_a_small_project(spark, tmp_path):
    for k in range(6):
        body = "".join(f"    if a > {i} and b:\n        total = total + helper(a, {i})\n" for i in range(6))
        (tmp_path / f"m{k}.py").write_text(f"import m{(k + 1) % 6}\n\ndef first(a, b):\n    total = 0\n{body}    return total\n\ndef second(b, a):\n    total = 0\n{body}    return total\n")
    kinds = {r["kind"] for r in cli.audit(spark, str(tmp_path), config.Config()).collect()}
    assert {"import_cycle", "exact_clone"} <= kinds
    for k in range(2, 6):
        (tmp_path / f"m{k}.py").unlink()
    assert "import_cycle" not in {r["kind"] for r in cli.audit(spark, str(tmp_path), config.Config()).collect()}
