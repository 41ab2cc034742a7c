"""Extraction as operators: files to function, module, import and call rows, in parallel and without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.extract import lexical, python_ast

FUNCTION_SCHEMA = """path string, lang string, function string, class string, parent string, is_ctor boolean, start_line int, end_line int, loc int, cc int, cogc int, nesting int, bumps int, compound int,
  embedded_loc int, empty_catch int, args int, typed int, primitive int, max_same int, short_vars int, match_arms int, asserts int, assert_hash long, structural_hash long, skeleton_hash long, distinct_kinds int,
  fields array<string>, foreign array<struct<recv:string,field:string>>"""
MODULE_SCHEMA = "path string, lang string, loc int, functions int, sum_cc int, declarations int, global_conditionals int, global_nesting int"
_FIELDS = [x.strip().split()[0] for x in re.sub(r"<[^<>]*(<[^<>]*>)*[^<>]*>", "", FUNCTION_SCHEMA).split(",")]


def _facts(lang: str, source: str):
    return python_ast.extract(source) if lang == "python" else lexical.extract(source, lang)


def _each(files: DataFrame, schema: str, names: list[str], rows_of) -> DataFrame:
    """One row generator over files; repartitioned by file count, for parsing costs more than bytes tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, lang, source in zip(b["path"], b["lang"], b["source"]):
                facts = _facts(lang, source)
                if facts is not None:
                    rows += rows_of(path, lang, source, facts)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "lang", "source").mapInPandas(run, schema)


def functions(files: DataFrame) -> DataFrame:
    def rows(path, lang, source, facts):
        return [tuple({"path": path, "lang": lang, **f}.get(c) if c != "foreign" else [{"recv": r, "field": x} for r, x in f.get("foreign", [])] for c in _FIELDS) for f in facts.functions]

    return _each(files, FUNCTION_SCHEMA, _FIELDS, rows)


def modules(files: DataFrame) -> DataFrame:
    names = [x.strip().split()[0] for x in MODULE_SCHEMA.split(",")]
    return _each(files, MODULE_SCHEMA, names, lambda path, lang, source, facts: [tuple({"path": path, "lang": lang, **facts.module}.get(c) for c in names)])


def imports(files: DataFrame) -> DataFrame:
    return _each(files, "path string, lang string, target string, line int", ["path", "lang", "target", "line"], lambda path, lang, source, facts: [(path, lang, t, n) for t, n in facts.imports])


def calls(files: DataFrame) -> DataFrame:
    names = ["path", "caller", "class", "callee", "receiver_type", "line"]
    return _each(files, "path string, caller string, class string, callee string, receiver_type string, line int", names, lambda path, lang, source, facts: [(path, *(c[k] for k in names[1:])) for c in facts.calls])


def dataflow(files: DataFrame) -> DataFrame:
    """(path, kind, function, subject, line): unreachable code and dead stores of Python functions."""

    def rows(path, lang, source, facts):
        if lang != "python":
            return []
        return [(path, "unreachable_code", f, None, n) for f, n in python_ast.unreachable_lines(source)] + [(path, "dead_store", f, name, n) for f, name, n in python_ast.dead_stores(source)]

    return _each(files, "path string, kind string, function string, subject string, line int", ["path", "kind", "function", "subject", "line"], rows)


def taints(files: DataFrame, sources: set[str], sinks: set[str], sanitizers: set[str], most: int = 50) -> DataFrame:
    """(path, function, sink, line), the first `most` in order of path and line."""

    def rows(path, lang, source, facts):
        return [(path, *x) for x in python_ast.taint(source, sources, sinks, sanitizers)] if lang == "python" else []

    return _each(files, "path string, function string, sink string, line int", ["path", "function", "sink", "line"], rows).orderBy("path", "line").limit(most)


def ifdef_density(files: DataFrame, least: int = 40, most: int = 12) -> DataFrame:
    """(path, conditionals, first_line) of C-family files with many preprocessor conditionals."""
    lines = files.filter(F.col("lang").isin("c", "cpp", "objectivec")).select("path", F.posexplode(F.split("source", "\n")).alias("n", "line"))
    hit = lines.filter(F.col("line").rlike(r"^\s*#\s*(if|ifdef|ifndef|elif)\b"))
    out = hit.groupBy("path").agg(F.count(F.lit(1)).alias("conditionals"), (F.min("n") + 1).alias("first_line"))
    return out.filter(F.col("conditionals") >= least).orderBy(F.desc("conditionals"), "path").limit(most)


def _candidates(path: str, lang: str, target: str) -> list[str]:
    """Files that an import may mean, the likeliest first."""
    here = path.rsplit("/", 1)[0] if "/" in path else ""
    join = lambda a, b: "/".join(x for x in (a, b) if x)
    if lang == "python":
        rest = target.lstrip(".")
        up = len(target) - len(rest)
        base = rest.replace(".", "/")
        if up:
            folder = here
            for _ in range(up - 1):
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
            base = join(folder, base)
            return [f"{base}.py", join(base, "__init__.py")]
        return [f"{base}.py", f"{base}/__init__.py", join(here, f"{base}.py")] + ([f"{base.rsplit('/', 1)[0]}.py"] if "/" in base else [])
    if lang in ("typescript", "javascript"):
        if not target.startswith("."):
            return []
        parts: list[str] = here.split("/") if here else []
        for p in target.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p != ".":
                parts.append(p)
        base = "/".join(parts)
        return [base, *[f"{base}.{e}" for e in ("ts", "tsx", "js", "jsx")], f"{base}/index.ts", f"{base}/index.js"]
    base = re.sub(r"::|\\|\.(?=\w+(?:\.|$)(?!h\b|hpp\b))", "/", target).strip("/")
    ext = path.rsplit(".", 1)[-1]
    return [join(here, target), target, f"{base}.{ext}", join(here, f"{base}.{ext}")]


def import_candidates(files: DataFrame) -> DataFrame:
    """(src, target, priority, candidate) of all imports, for deps.resolve_imports."""

    def rows(path, lang, source, facts):
        return [(path, t, k, c) for t, _ in facts.imports for k, c in enumerate(_candidates(path, lang, t))]

    return _each(files, "src string, target string, priority int, candidate string", ["src", "target", "priority", "candidate"], rows)
