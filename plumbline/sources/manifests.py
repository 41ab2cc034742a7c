"""Package manifests and lockfiles of eleven ecosystems as rows."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
MAX_BYTES = 8 << 20
MANIFESTS = ["Cargo.toml", "package.json", "pyproject.toml", "requirements.txt", "go.mod", "Gemfile", "Package.swift", "composer.json", "pom.xml", "build.zig.zon", "build.gradle", "build.gradle.kts", "setup.cfg", "Pipfile", "dub.json"]
LOCKS = ["Cargo.lock", "package-lock.json", "poetry.lock", "go.sum", "Gemfile.lock", "composer.lock"]

DECLARED = "path string, ecosystem string, name string, constraint string, scope string, own boolean"
Row = tuple[str, str, str, str, bool]


def _toml_table(table: dict, eco: str, scope: str) -> Iterator[Row]:
    for name, spec in (table or {}).items():
        yield eco, name, spec if isinstance(spec, str) else str(spec.get("version", "")) if isinstance(spec, dict) else "", scope, False


def cargo(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    if name := data.get("package", {}).get("name"):
        yield "cargo", name, str(data["package"].get("version", "")), "deploy", True
    tables = [data, *data.get("target", {}).values(), {"dependencies": data.get("workspace", {}).get("dependencies", {})}]
    for t in tables:
        for key, scope in (("dependencies", "deploy"), ("dev-dependencies", "test"), ("build-dependencies", "build")):
            yield from _toml_table(t.get(key, {}), "cargo", scope)


def npm(text: str) -> Iterator[Row]:
    data = json.loads(text)
    if data.get("name"):
        yield "npm", data["name"], data.get("version", ""), "deploy", True
    for key, scope in (("dependencies", "deploy"), ("devDependencies", "test"), ("peerDependencies", "deploy"), ("optionalDependencies", "deploy")):
        for name, c in (data.get(key) or {}).items():
            yield "npm", name, str(c), scope, False


_REQ = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")


def _requirement(line: str, scope: str) -> Iterator[Row]:
    if (m := _REQ.match(line)) and not line.lstrip().startswith(("-", "#")):
        yield "pypi", m[1], m[2].strip(), scope, False


def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        yield from _requirement(line, "deploy")


def pyproject(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    project = data.get("project", {})
    if project.get("name"):
        yield "pypi", project["name"], project.get("version", ""), "deploy", True
    for line in project.get("dependencies", []):
        yield from _requirement(line, "deploy")
    for extra, lines in {**project.get("optional-dependencies", {}), **data.get("dependency-groups", {})}.items():
        for line in lines:
            if isinstance(line, str):
                yield from _requirement(line, "test" if extra in ("dev", "test", "tests") else "deploy")
    poetry = data.get("tool", {}).get("poetry", {})
    yield from (r for r in _toml_table(poetry.get("dependencies", {}), "pypi", "deploy") if r[1] != "python")
    yield from _toml_table(poetry.get("dev-dependencies", {}), "pypi", "test")
    for group in poetry.get("group", {}).values():
        yield from _toml_table(group.get("dependencies", {}), "pypi", "test")


def go_mod(text: str) -> Iterator[Row]:
    block = False
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if line.startswith("module "):
            yield "go", line.split()[1], "", "deploy", True
        elif line.startswith("require ("):
            block = True
        elif line == ")":
            block = False
        elif block and len(line.split()) >= 2 or line.startswith("require "):
            name, version = line.removeprefix("require ").split()[:2]
            yield "go", name, version, "deploy", False


def gemfile(text: str) -> Iterator[Row]:
    scope = "deploy"
    for line in text.splitlines():
        if m := re.match(r"\s*group\s+(.*?)\s+do", line):
            scope = "test" if re.search(r":(test|development)", m[1]) else "deploy"
        elif re.match(r"\s*end\b", line):
            scope = "deploy"
        elif m := re.match(r"""\s*gem\s+["']([^"']+)["']\s*(?:,\s*["']([^"']*)["'])?""", line):
            yield "rubygems", m[1], m[2] or "", scope, False


def swift(text: str) -> Iterator[Row]:
    for m in re.finditer(r'\.package\s*\(\s*(?:name:\s*"[^"]*",\s*)?url:\s*"([^"]+)"\s*,\s*([^)]*)\)', text):
        yield "swiftpm", m[1].rstrip("/").removesuffix(".git").rsplit("/", 1)[-1], m[2].strip(), "deploy", False


def composer(text: str) -> Iterator[Row]:
    data = json.loads(text)
    if data.get("name"):
        yield "composer", data["name"], data.get("version", ""), "deploy", True
    for key, scope in (("require", "deploy"), ("require-dev", "test")):
        for name, c in (data.get(key) or {}).items():
            if "/" in name:
                yield "composer", name, str(c), scope, False


def maven(text: str) -> Iterator[Row]:
    root = ET.fromstring(text)
    ns = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    get = lambda e, k: (e.findtext(ns + k) or "").strip()
    if get(root, "artifactId"):
        yield "maven", f"{get(root, 'groupId')}:{get(root, 'artifactId')}", get(root, "version"), "deploy", True
    for e in root.iter(ns + "dependency"):
        yield "maven", f"{get(e, 'groupId')}:{get(e, 'artifactId')}", get(e, "version"), "test" if get(e, "scope") == "test" else "deploy", False


def gradle(text: str) -> Iterator[Row]:
    for m in re.finditer(r"""^\s*(\w*[iI]mplementation|api|compileOnly|runtimeOnly|testRuntimeOnly|kapt)\s*\(?\s*["']([^:"']+):([^:"']+)(?::([^"']+))?["']""", text, re.M):
        yield "maven", f"{m[2]}:{m[3]}", m[4] or "", "test" if m[1].startswith("test") else "deploy", False


def csproj(text: str) -> Iterator[Row]:
    for m in re.finditer(r'<PackageReference\s+[^>]*Include="([^"]+)"(?:[^>]*Version="([^"]*)")?', text):
        yield "nuget", m[1], m[2] or "", "deploy", False


def zig(text: str) -> Iterator[Row]:
    if m := re.search(r"\.dependencies\s*=\s*\.\{(.*)\}", text, re.S):
        for d in re.finditer(r'\.(?:@"([^"]+)"|(\w+))\s*=\s*\.\{([^{}]*)\}', m[1]):
            url = re.search(r'\.url\s*=\s*"([^"]*)"', d[3])
            yield "zig", d[1] or d[2], url[1] if url else "", "deploy", False


PARSERS = {"Cargo.toml": cargo, "package.json": npm, "pyproject.toml": pyproject, "requirements.txt": requirements, "go.mod": go_mod, "Gemfile": gemfile, "Package.swift": swift, "composer.json": composer, "pom.xml": maven, "build.gradle": gradle, "build.gradle.kts": gradle, "build.zig.zon": zig}


def parse(path: str, text: str) -> list[Row]:
    """The rows of a manifest; one that can't be read gives none."""
    name = path.rsplit("/", 1)[-1]
    parser = PARSERS.get(name) or (csproj if name.endswith(".csproj") else None)
    try:
        return list(parser(text)) if parser else []
    except (ValueError, KeyError, AttributeError, TypeError, ET.ParseError, RecursionError):
        return []


def _locked(path: str, text: str) -> list[tuple[str, str]]:
    name = path.rsplit("/", 1)[-1]
    try:
        if name in ("Cargo.lock", "poetry.lock"):
            return [(p["name"], p["version"]) for p in tomllib.loads(text).get("package", [])]
        if name == "package-lock.json":
            return [(k.rsplit("node_modules/", 1)[-1], v.get("version", "")) for k, v in json.loads(text).get("packages", {}).items() if k]
        if name == "composer.lock":
            data = json.loads(text)
            return [(p["name"], p["version"]) for key in ("packages", "packages-dev") for p in data.get(key, [])]
        if name == "go.sum":
            return sorted({(x.split()[0], x.split()[1].removesuffix("/go.mod")) for x in text.splitlines() if len(x.split()) >= 2})
        if name == "Gemfile.lock":
            return [(m[1], m[2]) for m in re.finditer(r"^    (\S+) \(([^)]+)\)$", text, re.M)]
    except (ValueError, KeyError, AttributeError, TypeError):
        pass
    return []


def workspace_members(text: str) -> list[str]:
    """Patterns of member directories that a root manifest names."""
    try:
        if text.lstrip().startswith("{"):
            w = json.loads(text).get("workspaces", [])
            return list(w.get("packages", []) if isinstance(w, dict) else w)
        return list(tomllib.loads(text).get("workspace", {}).get("members", []))
    except (ValueError, AttributeError):
        return []


def declared_test_roots(pyproject_text: str = "", ini_text: str = "") -> list[str]:
    """The folders that pytest's settings name."""
    try:
        found = tomllib.loads(pyproject_text).get("tool", {}).get("pytest", {}).get("ini_options", {}).get("testpaths", [])
    except ValueError:
        found = []
    found = found.split() if isinstance(found, str) else list(found)
    if m := re.search(r"^testpaths\s*=\s*(.*(?:\n[ \t]+\S.*)*)", ini_text, re.M):
        found += m[1].split()
    return found


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(declared, locked) of all manifests and lockfiles under a folder."""
    names = F.regexp_extract("path", r"([^/]+)$", 1)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= MAX_BYTES).filter(~F.contains("path", F.lit("/node_modules/")))
    texts = raw.filter(names.isin(MANIFESTS + LOCKS) | F.endswith("path", F.lit(".csproj"))).select("path", F.try_validate_utf8("content").alias("text")).filter("text is not null")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(b["path"], b["text"]) for r in parse(p, t)], columns=["path", "ecosystem", "name", "constraint", "scope", "own"])

    def locks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(b["path"], b["text"]) for r in _locked(p, t)], columns=["path", "name", "version"])

    return texts.mapInPandas(rows, DECLARED), texts.mapInPandas(locks, "path string, name string, version string")
