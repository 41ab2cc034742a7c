"""Facts and gates of a whole project: abstractness, strictness, strata of thresholds, gates and the census."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths as P
from plumbline.operators.graph import nearest_owner
from plumbline.operators.stats import histogram, vendored

#: How a language declares abstract and concrete types, and how sure that is (1: best effort, 3: medium, 4: high).
TYPES = {
    "java": (r"\binterface\s+\w", r"\b(?:class|enum|record)\s+\w", 4),
    "csharp": (r"\binterface\s+\w", r"\b(?:class|struct|enum|record)\s+\w", 4),
    "kotlin": (r"\binterface\s+\w", r"\b(?:class|object)\s+\w", 4),
    "swift": (r"\bprotocol\s+\w", r"\b(?:class|struct|enum)\s+\w", 4),
    "rust": (r"\btrait\s+\w", r"\b(?:struct|enum|union)\s+\w", 4),
    "go": (r"\binterface\s*\{", r"(?m)\bstruct\s*\{|^\s*type\s+\w", 3),
    "haskell": (r"(?m)^class\s+\w", r"(?m)^(?:data|newtype)\s+\w", 4),
    "typescript": (r"\binterface\s+\w|\babstract\s+class\s+\w", r"(?m)(?<!abstract )\bclass\s+\w|^\s*(?:export\s+)?type\s+\w+", 4),
    "javascript": ("", r"\bclass\s+\w", 1),
    "php": (r"\binterface\s+\w", r"\bclass\s+\w", 4),
    "ruby": (r"(?m)^\s*module\s+\w", r"(?m)^\s*class\s+\w", 3),
    "python": ("", r"(?m)^\s*class\s+\w", 3),
    "objectivec": (r"@protocol\s+\w", r"@(?:implementation|interface)\s+\w", 3),
    "d": (r"\binterface\s+\w", r"\b(?:class|struct|enum)\s+\w", 4),
    "groovy": (r"\binterface\s+\w", r"\b(?:class|enum)\s+\w", 3),
    "cpp": ("", r"\b(?:class|struct)\s+\w+\s*[:{]", 1),
    "c": ("", r"\b(?:struct|union|enum)\s+\w+\s*\{", 1),
    "zig": ("", r"\bstruct\s*\{", 1),
}

#: Extractable modules that package metrics need, uses of `any` that are a debt, and the least kinds and branching of a pattern.
MIN_MODULES, MIN_ANY, MIN_KINDS, MIN_BRANCHING = 5, 8, 2, 0.5


def _code(source: Column) -> Column:
    """A source without comments and strings, best effort."""
    bare = F.regexp_replace(source, r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', '""')
    return F.regexp_replace(bare, r"(?s)/\*.*?\*/|//[^\n]*", " ")


def abstractness(files: DataFrame) -> DataFrame:
    """(path, abstractness, confidence): abstract over all type declarations of a file; null without any, and for languages without a table."""
    code = F.when(F.col("lang").isin("python", "ruby"), F.regexp_replace("source", r"#[^\n]*", " ")).otherwise(_code(F.col("source")))
    rows = files.select("path", "lang", code.alias("code"))

    def pick(k: int) -> Column:
        out = F.lit(None).cast("int")
        for lang, own in TYPES.items():
            value = F.lit(own[2]) if k == 2 else F.regexp_count("code", F.lit(own[k])) if own[k] else F.lit(0)
            out = F.when(F.col("lang") == lang, value).otherwise(out)
        return out

    rows = rows.select("path", pick(0).alias("a"), pick(1).alias("c"), pick(2).alias("confidence"))
    return rows.select("path", F.when(F.col("a") + F.col("c") > 0, F.col("a") / (F.col("a") + F.col("c"))).alias("abstractness"), "confidence")


def strictness(files: DataFrame, tsconfig: str | None, least: int = MIN_ANY) -> DataFrame:
    """(path, any_count, first_line) of TypeScript files with many `any`s in a project whose tsconfig asks for neither strict nor noImplicitAny; without a tsconfig none."""
    import re

    if tsconfig is None or any(re.search(rf'"{k}"\s*:\s*true', tsconfig) for k in ("strict", "noImplicitAny")):
        return files.select("path", F.lit(0).alias("any_count"), F.lit(0).alias("first_line")).filter("false")
    typed = r"(?:[:<|,]\s*|\bas\s+)any\b"
    rows = files.filter("lang = 'typescript'").select("path", _code(F.col("source")).alias("code"))
    rows = rows.withColumn("any_count", F.regexp_count("code", F.lit(typed)))
    before = F.split("code", typed, 2)[0]
    return rows.filter(F.col("any_count") >= least).select("path", "any_count", (F.size(F.split(before, "\n", -1))).alias("first_line"))


def complexity_floor(patterns: DataFrame, kinds: int = MIN_KINDS, branching: float = MIN_BRANCHING) -> DataFrame:
    """Patterns with enough distinct kinds and branching. patterns: distinct_kinds, branching_factor and others."""
    return patterns.filter((F.col("distinct_kinds") >= kinds) & (F.col("branching_factor") >= branching))


def package_gate(modules: int, edges: DataFrame) -> str:
    """Whether packages can be judged: too_few (fewer than MIN_MODULES modules), zero_edges (no import was resolved, which is a finding of its own), or measured."""
    return "too_few" if modules < MIN_MODULES else "zero_edges" if edges.isEmpty() else "measured"


def by_stratum(detect: Callable[[Any], DataFrame], root: Any, strata: dict[str, Any], file: str = "file") -> DataFrame:
    """Findings of a detector under each directory's own thresholds: a finding belongs to the deepest directory with thresholds above its file, else to the root's.

    detect is run once for each set of thresholds; strata: directory to thresholds.
    """
    base = detect(root)
    owners = base.sparkSession.createDataFrame([("",), *[(x,) for x in strata]], "owner string")

    def of(found: DataFrame, directory: str) -> DataFrame:
        own = nearest_owner(found.select(F.col(file).alias("path")).distinct(), owners).filter(F.col("owner") == directory)
        return found.join(own.select(F.col("path").alias(file)), file, "left_semi").select(*base.columns)

    return reduce(DataFrame.unionByName, [of(base, ""), *[of(detect(t), d) for d, t in strata.items()]])


def census(functions: DataFrame, files: DataFrame, metrics: list[str]) -> DataFrame:
    """(is_test, lang, metric, value, n, weight): histograms of functions' metrics, apart for tests and languages; fixtures and vendored files are left out.

    functions: path, lang and metrics; files: path, lang, source.
    """
    features = files.select("path", "lang", F.octet_length("source").alias("bytes"), F.size(F.split("source", r"\s+")).cast("double").alias("words"), F.size(F.split("source", "\n")).cast("double").alias("lines"), (F.length("source") / F.size(F.split("source", "\n"))).alias("mean"))
    foreign = vendored(features, ["words", "lines", "mean"], ["lang"]).select("path")
    own = functions.filter(~P.is_fixture(F.col("path"))).join(foreign, "path", "left_anti").withColumn("is_test", P.is_test(F.col("path")))
    return histogram(own, ["is_test", "lang"], metrics)
