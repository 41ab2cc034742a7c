"""Paths: languages, tests, fixtures and ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp", "go": "go",
    "swift": "swift", "zig": "zig", "rb": "ruby", "m": "objectivec", "tcl": "tcl", "kt": "kotlin", "kts": "kotlin", "hs": "haskell",
    "lua": "lua", "r": "r", "R": "r", "php": "php", "cob": "cobol", "cbl": "cobol", "d": "d", "groovy": "groovy", "gradle": "groovy",
}

#: Directories that a source walk passes over.
SKIPPED_DIRS = ["node_modules", "target", "vendor", "build", "dist", "__pycache__"]


def language(path: Column) -> Column:
    """The language of a path's extension, or null; case matters."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


#: Directories of tests, what a test's name holds, and the beginnings and whole stems that are a language's habit.
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs", "Tests", "Test", "Spec", "Specs"]
TEST_INFIXES = ["_test.", ".test.", "_tests.", ".tests.", "_spec.", ".spec.", "_specs.", ".specs.", ".e2e.", ".cy."]
TEST_STEMS = {"python": r"^(test_.*|tests|conftest)$", "c": "^[tT]est_", "cpp": "^[tT]est_", "r": "^test[-_]", "lua": "^(test|spec)_", "zig": "^test_", "d": "^test_"}
#: Languages whose test classes end in Test, Tests, Spec or Specs.
TEST_SUFFIXED = ["java", "csharp", "kotlin", "swift", "php", "objectivec", "groovy", "haskell"]


def is_test(path: Column) -> Column:
    """Whether a path is a test's by its directory, an infix of its name, or its language's habit. Backslashes separate like slashes."""
    path = F.translate(path, "\\", "/")
    name, lang = F.regexp_extract(path, r"([^/]*)$", 1), language(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    in_dir = path.rlike("(^|/)(" + "|".join(TEST_DIRS) + ")/")
    infix = name.rlike("|".join(map(re.escape, TEST_INFIXES)))
    habit = F.lit(False)
    for one, pattern in TEST_STEMS.items():
        habit = habit | (lang == one) & stem.rlike(pattern)
    suffixed = lang.isin(TEST_SUFFIXED) & stem.rlike(r"(^|[\p{L}\p{N}])(Tests?|Specs?)$")
    return in_dir | infix | F.coalesce(habit | suffixed, F.lit(False))


def is_fixture(path: Column) -> Column:
    return F.contains(path, F.lit("/fixtures/"))


def is_skipped(path: Column) -> Column:
    """Whether a directory of the path begins with a dot or is one of SKIPPED_DIRS."""
    return path.rlike(r"(^|/)(\.[^/]+|" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")


def glob_regex(pattern: str, whole_paths: bool = True) -> str:
    """A regular expression for a glob: * and ? stay within a path's part, ** does not. A bare name also covers what is below it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + ("[^/]*" if whole_paths else ".*"), i + 1
        elif pattern[i] == "?":
            out, i = out + ("[^/]" if whole_paths else "."), i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}(?:/.*)?$" if whole_paths else f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(glob_regex(p.rstrip("/")) for p in patterns))
