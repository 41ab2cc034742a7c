"""Declared against imported and locked dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Mining


def normalised(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def bloated(declared: DataFrame, imports: DataFrame, mentions: DataFrame) -> DataFrame:
    """Deployed dependencies that nothing imports or mentions. declared: name, scope, own; imports, mentions: name."""
    rows = declared.filter("scope = 'deploy' and not own").withColumn("__n", normalised(F.col("name")))
    for used in (imports, mentions):
        rows = rows.join(used.select(normalised(F.col("name")).alias("__n")).distinct(), "__n", "left_anti")
    return rows.drop("__n")


def phantom(imports: DataFrame, declared: DataFrame, locked: DataFrame, stdlib: DataFrame) -> DataFrame:
    """Imported roots that are locked but not declared, and of no standard library."""
    rows = imports.select(normalised(F.col("name")).alias("name")).distinct()
    for known in (declared, stdlib):
        rows = rows.join(known.select(normalised(F.col("name")).alias("name")).distinct(), "name", "left_anti")
    return rows.join(locked.select(normalised(F.col("name")).alias("name")).distinct(), "name", "left_semi")


def by_prefix(imports: DataFrame, modules: DataFrame, separator: str = "/") -> DataFrame:
    """(target, module): the longest module that is the target or a prefix of it at a separator. All prefixes are joined by equality."""
    parts = F.split("target", separator)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), separator).alias("module")))
    found = imports.select("target", F.explode(ups).alias("u")).select("target", "u.*").join(modules.select("module").distinct(), "module")
    return found.groupBy("target").agg(F.max_by("module", "depth").alias("module"))


def by_suffix(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """(target, path): the least path that ends in /target. All suffixes of the paths are joined by equality."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return targets.join(paths.select("path", F.explode(ends).alias("target")), "target").groupBy("target").agg(F.min("path").alias("path"))


def resolve_imports(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): of the candidate paths of each import the first that is a file; otherwise the least file with that suffix. candidates: src, target, priority, candidate; files: path."""
    hit = candidates.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("src", "target").agg(F.min_by("candidate", "priority").alias("dst"))
    rest = candidates.select("src", "target").distinct().join(hit, ["src", "target"], "left_anti")
    tail = by_suffix(rest.select("target").distinct(), files).withColumnRenamed("path", "dst")
    return hit.select("src", "dst").union(rest.join(tail, "target").select("src", "dst")).distinct()


def constraint_smells(declared: DataFrame, locked: DataFrame, has_lock: bool) -> DataFrame:
    """(name, kind): wildcards; pins that differ from the lockfile; all pinned without a lockfile. declared: name, constraint."""
    c = F.trim("constraint")
    wild = declared.filter((c == "*") | (c == "latest") | (c == "")).select("name", F.lit("wildcard").alias("kind"))
    pin = F.regexp_extract(c, r"^={0,3}\s*v?(\d+(?:\.\d+)*[A-Za-z0-9.+-]*)$", 1)
    pins = declared.withColumn("pin", pin).filter("pin <> ''")
    differs = pins.join(locked.select(F.col("name"), "version"), "name").filter("pin <> version").select("name", F.lit("pin_differs_from_lock").alias("kind"))
    out = wild.union(differs)
    if not has_lock:
        total = declared.agg(F.count(F.lit(1)).alias("n"), F.count_if(pin != "").alias("p")).filter("n >= 3 and n = p")
        out = out.union(total.select(F.lit("*").alias("name"), F.lit("all_pinned_without_lock").alias("kind")))
    return out


def freshness(locked: DataFrame, versions: DataFrame, now: str, t: Mining = DEFAULTS.mining) -> DataFrame:
    """Dependencies that missed many versions or whose last one is years old.

    versions: name, version, published (RFC 3339 text, which compares by its
    letters; empty: not known, neither missed nor the last) and perhaps
    is_default, which tells the last version (the youngest, if of several). A
    dependency of no known last version is left out.
    """
    default = F.col("is_default") if "is_default" in versions.columns else F.lit(False)
    dated = F.when(F.col("published") != "", F.col("published"))
    known = versions.select("name", "version", dated.alias("p"), default.alias("d"), "published")
    mine = locked.join(known, ["name", "version"]).select("name", "version", F.col("p").alias("since"))
    # one row a package and date before it meets the locked versions
    dates = known.groupBy("name", "p").agg(F.count(F.lit(1)).alias("n"))
    last = known.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("d"), F.col("published"))), F.max("p")).alias("latest")).filter("latest is not null")
    later = mine.join(dates, "name").groupBy("name", "version").agg(F.sum(F.when(F.col("p") > F.col("since"), F.col("n")).otherwise(0)).alias("missed")).join(last, "name")
    years = F.lit(int(now[:4])) - F.substring("latest", 1, 4).try_cast("int")
    out = later.withColumn("years", years).filter((F.col("missed") >= t.freshness_missed) | (F.col("years") >= t.freshness_years)).select("name", "version", "missed", "latest", "years")
    return out.orderBy(F.desc("missed"), "name").limit(t.freshness_top)


def vulnerable(locked: DataFrame, advisories: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, version, advisory, reachable): locked versions with an advisory, and whether anything imports them."""
    used = imports.select(normalised(F.col("name")).alias("__n")).distinct().withColumn("__used", F.lit(True))
    out = locked.join(advisories, ["name", "version"]).withColumn("__n", normalised(F.col("name"))).join(used, "__n", "left")
    return out.select("name", "version", "advisory", F.coalesce("__used", F.lit(False)).alias("reachable"))


def cross_validated(findings: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Confidence of findings after history: medium (3) becomes high (4) if the file's changes scatter too, and what is lower stays; other files have low (2) at most. Without a history (null) nothing changes."""
    if changed is None:
        return findings
    seen = changed.select("file").distinct().withColumn("__seen", F.lit(True))
    raised = F.when(F.col("confidence") >= 3, 4).otherwise(F.col("confidence"))
    out = findings.join(seen, "file", "left").withColumn("confidence", F.when(F.col("__seen"), raised).otherwise(F.least("confidence", F.lit(2))))
    return out.drop("__seen")


def suppressed(findings: DataFrame, slugs: list[str], categories: list[str], globs: list[str]) -> DataFrame:
    """Findings without those suppressed by kind, category or glob of the snippet."""
    from plumbline.functions.paths import glob_regex

    out = findings.filter(~F.col("kind").isin(slugs) & ~F.coalesce(F.col("category").isin(categories), F.lit(False)))
    for g in globs:
        out = out.filter(~F.coalesce(F.col("snippet").rlike(glob_regex(g, whole_paths=False)), F.lit(False)))
    return out
