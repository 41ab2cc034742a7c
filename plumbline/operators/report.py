"""Findings for people and programs: JSON, text, calibration files, logs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PILLARS = {
    "structure": ["martin_distance", "import_cycle", "unstable_dependency", "hub_like", "god_component", "zero_edges", "over_fragmented", "remodularize", "move", "compound"],
    "design": ["god_class", "feature_envy", "shotgun_surgery", "divergent_change", "parallel_inheritance", "refused_bequest", "low_cohesion", "anomaly"],
    "duplication": ["exact_clone", "similar_clone", "pattern", "clone_cluster", "vulnerable_sibling"],
    "dependencies": ["bloated", "phantom", "constraint", "reflexion", "freshness", "vulnerable"],
    "history": ["drift", "build_co_change", "hotspot", "fragmentation", "file_blob", "change_shotgun", "defect_prone", "catalyst", "decay"],
}

#: What to do about a finding, joined in by its kind.
ACTIONS = {
    "god_method": "extract cohesive parts into functions", "complex_method": "split the conditions", "large_method": "extract functions", "deep_nested_complexity": "return early", "complex_conditional": "name the condition",
    "excess_arguments": "group arguments in an object", "constructor_over_injection": "split the class", "primitive_obsession": "introduce types", "empty_error_handler": "handle or pass on the error", "file_too_large": "split the file",
}


def unify(findings: dict[str, DataFrame], confidence: dict[str, str] | None = None) -> DataFrame:
    """(kind, pillar, confidence, evidence): typed findings of all kinds in one table, the evidence as JSON."""
    of = {k: p for p, kinds in PILLARS.items() for k in kinds}
    out = None
    for kind, df in findings.items():
        row = df.select(F.lit(kind).alias("kind"), F.lit(of.get(kind, "files")).alias("pillar"), F.lit((confidence or {}).get(kind, "medium")).alias("confidence"), F.to_json(F.struct(*df.columns)).alias("evidence"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no findings given")
    return out


def with_actions(findings: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return findings.withColumn("action", F.try_element_at(table, F.col("smell")))


def as_text(findings: DataFrame) -> DataFrame:
    """One line a finding: path:line smell (function) value."""
    place = F.concat_ws(":", F.col("path").cast("string"), F.col("start_line").cast("string"))
    return findings.select(F.format_string("%s %s (%s) %s", place, F.col("smell"), F.coalesce("function", F.lit("module")), F.col("value").cast("string")).alias("line"))


def summary(unified: DataFrame) -> DataFrame:
    return unified.groupBy("pillar", "kind", "confidence").agg(F.count(F.lit(1)).alias("findings"))


def cap_locations(locations: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, locations, more): the first `most` places of each finding and how many are left out. locations: key, path, line."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("path", "line")
    rows = locations.withColumns({"__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))}).filter(F.col("__r") <= most)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "path", "line"))), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"))).alias("locations"), F.greatest(F.first("__n") - most, F.lit(0)).alias("more"))


def write_json(findings: DataFrame, path: str) -> bool:
    """Writes the findings as JSON lines; true if there is any, which is the exit code's meaning."""
    findings.write.mode("overwrite").json(path)
    return not findings.limit(1).isEmpty()


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, key: list[str]) -> None:
    """A baseline snapshot for later joins on `key`, clustered by it."""
    df.repartition(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def calibration_toml(estimates: DataFrame, language: str | None = None) -> str:
    """Threshold lines of a configuration file from (metric, warning, alert); one row a metric, so this is small."""
    head = f"[languages.{language}.function]" if language else "[thresholds.function]"
    lines = [head]
    for r in estimates.orderBy("metric").collect():
        lines += [f"{r['metric']}_warning = {r['warning']}", f"{r['metric']}_alert = {r['alert']}"]
    return "\n".join(lines) + "\n"


def reuse_cached(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows, files to analyse): rows of a cache keyed by content and extractor version are used again. cache: content, version and results."""
    keyed = files.withColumn("content", F.sha2("source", 256))
    own = cache.filter(F.col("version") == version)
    return keyed.join(own, "content"), keyed.join(own.select("content").distinct(), "content", "left_anti")
