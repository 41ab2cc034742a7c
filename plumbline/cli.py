"""python -m plumbline check|audit|history|calibrate PATH [--json]: the operators strung together over a source tree or repository."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config
from plumbline.extract import tables
from plumbline.operators import classes, clones, deps, graph, history, project, report, smells, stats
from plumbline.session import session, written
from plumbline.sources import files, gitlog


def _config(root: str) -> config.Config:
    path = Path(root) / "plumbline.toml"
    return config.load(path.read_text()) if path.is_file() else config.Config()


def check(spark: SparkSession, root: str, cfg: config.Config) -> DataFrame:
    """Function and module findings of a source tree."""
    found, _ = files.source_tree(spark, root, ignore=list(cfg.ignore))
    functions, modules = written(tables.functions(found), "functions"), tables.modules(found)
    t = cfg.thresholds
    own = smells.subsume(smells.function_findings(functions, t.function, cfg.disabled))
    whole = smells.module_findings(modules, functions, t.module, t.function).filter(~F.col("smell").isin([*cfg.disabled, ""]))
    return own.unionByName(whole, allowMissingColumns=True)


def audit(spark: SparkSession, root: str, cfg: config.Config) -> DataFrame:
    """Findings across files: packages and cycles (from MIN_MODULES modules on), classes and calls, clones, debts."""
    t = cfg.thresholds
    found = written(files.source_tree(spark, root, ignore=list(cfg.ignore))[0], "files")
    functions = written(tables.functions(found).withColumn("id", F.xxhash64("path", "function", "start_line")), "functions")
    edges = written(deps.resolve_imports(tables.import_candidates(found), found).filter("src <> dst"), "edges")
    modules = tables.modules(found).join(project.abstractness(found), "path", "left")
    members = written(modules.select(F.col("path").alias("file"), F.regexp_replace("path", "/?[^/]*$", "").alias("component"), "loc", "abstractness"), "members")

    def packages() -> dict[str, DataFrame]:
        components, cross = graph.component_graph(edges, members)
        groups = graph.communities(edges.withColumn("weight", F.lit(1.0)), t.graph)
        return {
            "martin_distance": graph.martin(edges, members.select(F.col("file").alias("node"), "abstractness"), t.graph),
            "import_cycle": graph.cycles(edges, graph.pagerank(edges, t.graph)),
            "unstable_dependency": graph.unstable_dependencies(components, cross, t.graph),
            "hub_like": graph.hub_like(components, t.graph),
            "god_component": graph.god_components(components, t.graph),
            "over_fragmented": graph.over_fragmented(edges, members, t.graph),
            "remodularize": graph.remodularize(groups, members, t.graph),
            "move": graph.moves(groups, members),
        }

    gate = project.package_gate(found.count(), edges)
    out = packages() if gate == "measured" else {"zero_edges": spark.createDataFrame([(root,)], "root string")} if gate == "zero_edges" else {}

    methods = functions.select("id", F.col("path").alias("file"), "class", F.regexp_replace("function", r"^.*\.", "").alias("name"), "cc", "fields", "foreign", "is_ctor")
    calls = tables.calls(found).join(functions.select("id", "path", F.col("function").alias("caller")), ["path", "caller"])
    calls = written(calls.select(F.col("id").alias("src"), F.col("class").alias("src_class"), "callee", "receiver_type", F.lit(None).cast("string").alias("hint_class")), "calls")
    call_edges = written(classes.resolve_calls(calls, methods, t.named), "call_edges")
    parents = functions.filter("parent is not null and class is not null").select("class", "parent").distinct()
    named = functions.withColumn("name", F.regexp_replace("function", r"^.*\.", ""))
    tsconfig = Path(root) / "tsconfig.json"
    out |= {
        "god_class": classes.god_classes(methods, t.named),
        "feature_envy": classes.feature_envy(methods, call_edges, t.named),
        "shotgun_surgery": classes.shotgun_surgery(methods, call_edges, t.named),
        "divergent_change": classes.divergent_change(methods, call_edges, t.named),
        "parallel_inheritance": classes.parallel_inheritance(parents, t.named),
        "refused_bequest": classes.refused_bequest(methods, calls, parents.withColumn("concrete", F.lit(True)), t.named),
        "exact_clone": clones.exact_groups(named, t.module),
        "similar_clone": clones.similar_groups(named, t.module),
        "ifdef_density": tables.ifdef_density(found),
        "strictness_debt": project.strictness(found, tsconfig.read_text() if tsconfig.is_file() else None),
    }
    return report.unify(out)


def mine(spark: SparkSession, root: str, cfg: config.Config) -> DataFrame:
    """Findings of a repository's history."""
    t = cfg.thresholds.history
    gitlog.register(spark)
    commits = written(spark.read.format("git").option("path", root).load(), "commits")
    found = written(files.source_tree(spark, root, ignore=list(cfg.ignore))[0], "files")
    typed = found.select(F.col("path").alias("file"))
    edges = deps.resolve_imports(tables.import_candidates(found), found)
    modules = tables.modules(found).select(F.col("path").alias("file"), "sum_cc")
    return report.unify({"drift": history.drift(commits, edges, typed, t), "hotspot": history.hotspots(commits, modules, t), "fragmentation": history.fragmentation(commits, typed, t), "file_blob": history.file_blobs(commits, typed, t), "change_shotgun": history.change_shotgun(commits, typed.withColumn("package", F.regexp_replace("file", "/?[^/]*$", "")), t)})


def calibrate(spark: SparkSession, root: str, cfg: config.Config) -> str:
    """Threshold lines from the quantiles of a source tree, never below the defaults."""
    t = cfg.thresholds.function
    functions = tables.functions(files.source_tree(spark, root, ignore=list(cfg.ignore))[0])
    corpus = stats.quantiles(stats.histogram(functions, [], ["cc", "cogc", "loc"]), ["metric"], (0.75, 0.95))
    corpus = corpus.groupBy("metric").agg(F.max(F.when(F.col("p") == 0.75, F.col("v"))).alias("p75"), F.max(F.when(F.col("p") == 0.95, F.col("v"))).alias("p95"))
    editorial = spark.createDataFrame([("cc", t.cc_warning, t.cc_alert), ("cogc", t.cogc_warning, t.cogc_alert), ("loc", t.loc_warning, t.loc_alert)], "metric string, warning long, alert long")
    return report.calibration_toml(stats.estimate(corpus, editorial))


def main(args: list[str] | None = None) -> int:
    """1 if there are findings."""
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("verb", choices=["check", "audit", "history", "calibrate"])
    p.add_argument("path")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    spark, cfg = session(), _config(a.path)
    if a.verb == "calibrate":
        print(calibrate(spark, a.path, cfg), end="")
        return 0
    found = {"check": check, "audit": audit, "history": mine}[a.verb](spark, a.path, cfg)
    if a.json:
        lines = found.select(F.to_json(F.struct(*found.columns)).alias("line"))
    elif a.verb == "check":
        lines = report.as_text(found)
    else:
        lines = found.select(F.concat_ws(" ", "pillar", "kind", "evidence").alias("line"))
    n = 0
    for r in lines.toLocalIterator():
        print(r["line"])
        n += 1
    return int(n > 0)


if __name__ == "__main__":
    sys.exit(main())
