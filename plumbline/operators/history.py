"""Mining of version history: co-change, drift, hotspots, ownership, defect-prone functions.

commit_files: hash, author, ts (long, seconds), file; one row a file of a commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, History


def in_scope(commit_files: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Files of commits that are not too large. The sizes are pre-aggregated; no commit's rows are gathered."""
    sizes = commit_files.groupBy("hash").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") <= t.max_commit_files)
    return commit_files.join(sizes.select("hash"), "hash", "left_semi")


def revisions(commit_files: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """(file, revisions) over commits in scope."""
    return in_scope(commit_files, t).groupBy("file").agg(F.count(F.lit(1)).alias("revisions"))


def co_change_pairs(commit_files: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """(file_a, file_b, support, last_seen, distinct_authors) of unordered pairs; a commit gives at most max_commit_files^2/2 of them."""
    rows = in_scope(commit_files, t)
    a = rows.select("hash", "author", "ts", F.col("file").alias("file_a"))
    b = rows.select("hash", F.col("file").alias("file_b"))
    return a.join(b, "hash").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("support"), F.max("ts").alias("last_seen"), F.count_distinct("author").alias("distinct_authors"))


def _with_revisions(pairs: DataFrame, revs: DataFrame) -> DataFrame:
    """Revisions of both files, at least the pair's support."""
    for end in ("a", "b"):
        pairs = pairs.join(revs.select(F.col("file").alias(f"file_{end}"), F.col("revisions").alias(f"rev_{end}")), f"file_{end}", "left")
        pairs = pairs.withColumn(f"rev_{end}", F.greatest(F.coalesce(f"rev_{end}", "support"), "support"))
    return pairs


def drift(commit_files: DataFrame, edges: DataFrame, typed: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Pairs of typed files that change together without an import either way, best first.

    edges: src, dst; typed: file. Confidence counts from min_confidence on, lift only above min_lift.
    """
    pairs = co_change_pairs(commit_files, t).filter(F.col("support") >= t.min_support)
    for end in ("a", "b"):
        pairs = pairs.join(typed.select(F.col("file").alias(f"file_{end}")).distinct(), f"file_{end}", "left_semi")
    linked = edges.select(F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    pairs = _with_revisions(pairs.join(linked, ["file_a", "file_b"], "left_anti"), revisions(commit_files, t))
    total = in_scope(commit_files, t).agg(F.count_distinct("hash").alias("commits"))
    pairs = pairs.join(F.broadcast(total))
    s, ra, rb = (F.col(c).cast("double") for c in ("support", "rev_a", "rev_b"))
    pairs = pairs.withColumns({"confidence": F.least(s / ra, s / rb), "lift": s * F.col("commits") / (ra * rb), "jaccard": F.when(ra + rb - s > 0, s / (ra + rb - s)).otherwise(0.0)})
    pairs = pairs.filter((F.col("confidence") >= t.min_confidence) & (F.col("lift") > t.min_lift))
    return pairs.orderBy(F.desc("confidence"), F.desc("lift"), "file_a", "file_b").limit(t.top)


def build_drift(commit_files: DataFrame, build_files: DataFrame, sources: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Sources whose changes often need a change of a build file. build_files, sources: file."""
    pairs = co_change_pairs(commit_files, t).filter(F.col("support") >= t.min_support)
    build = build_files.select(F.col("file").alias("__b")).distinct()
    pairs = pairs.join(build.withColumnRenamed("__b", "file_a").withColumn("__ba", F.lit(True)), "file_a", "left")
    pairs = pairs.join(build.withColumnRenamed("__b", "file_b").withColumn("__bb", F.lit(True)), "file_b", "left")
    pairs = pairs.filter(F.coalesce("__ba", F.lit(False)) != F.coalesce("__bb", F.lit(False)))
    is_a = F.coalesce("__ba", F.lit(False))
    pairs = pairs.select(F.when(is_a, F.col("file_a")).otherwise(F.col("file_b")).alias("build_file"), F.when(is_a, F.col("file_b")).otherwise(F.col("file_a")).alias("source_file"), "support", "last_seen", "distinct_authors")
    pairs = pairs.join(sources.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi")
    revs = revisions(commit_files, t).withColumnRenamed("file", "source_file")
    pairs = pairs.join(revs, "source_file", "left").withColumn("source_revisions", F.greatest(F.coalesce("revisions", "support"), "support")).drop("revisions")
    pairs = pairs.withColumn("ratio", F.col("support").cast("double") / F.col("source_revisions")).filter(F.col("ratio") >= t.build_min_ratio)
    return pairs.orderBy(F.desc("ratio"), F.desc("support"), "build_file", "source_file").limit(t.top)


def hotspots(commit_files: DataFrame, modules: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """(file, revisions, sum_cc, score): often changed and complex; all commits count. modules: file, sum_cc."""
    revs = commit_files.groupBy("file").agg(F.count(F.lit(1)).alias("revisions")).filter(F.col("revisions") >= t.hotspot_min_revisions)
    scored = revs.join(modules.select("file", "sum_cc"), "file").withColumn("score", (F.col("revisions") * F.col("sum_cc")).cast("long"))
    return scored.filter(F.col("score") >= t.hotspot_min_score).orderBy(F.desc("score"), "file").limit(t.hotspot_top)


def fragmentation(commit_files: DataFrame, typed: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Files with many authors of a small share each, and the first five of these."""
    own = commit_files.join(typed.select("file").distinct(), "file", "left_semi").groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    per_file = own.groupBy("file").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("total_contributors")).filter(F.col("total") >= t.min_total_commits)
    minor = own.join(per_file, "file").filter(F.col("n") / F.col("total") < t.minor_pct / 100.0)
    # an author's list is bounded by the file's contributors
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "author"))), 1, 5), lambda x: x["author"])
    out = minor.groupBy("file").agg(F.first("total_contributors").alias("total_contributors"), F.count(F.lit(1)).alias("minor_contributor_count"), names.alias("top_minor_authors"))
    out = out.filter(F.col("minor_contributor_count") >= t.min_minor_authors).withColumn("minor_contributor_pct", F.col("minor_contributor_count") / F.col("total_contributors"))
    return out.orderBy(F.desc("minor_contributor_count"), "file").limit(t.top)


def file_blobs(commit_files: DataFrame, typed: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Files that take part in a large share of the commits of several files."""
    sizes = commit_files.groupBy("hash").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n").between(2, t.max_commit_files))
    total = sizes.agg(F.count(F.lit(1)).alias("total_multi_file_commits"))
    per_file = commit_files.join(sizes.select("hash"), "hash", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("multi_file_commits"))
    per_file = per_file.join(typed.select("file").distinct(), "file", "left_semi").join(F.broadcast(total))
    per_file = per_file.withColumn("blob_ratio", F.col("multi_file_commits") / F.col("total_multi_file_commits"))
    return per_file.filter(F.col("blob_ratio") > t.blob_commit_pct).orderBy(F.desc("blob_ratio"), "file").limit(t.top)


def change_shotgun(commit_files: DataFrame, packages: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Files whose change nearly always brings changes in many packages. packages: file, package."""
    pairs = co_change_pairs(commit_files, t).filter(F.col("support") >= t.min_support)
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "support").union(pairs.select("file_b", "file_a", "support"))
    both = both.join(revisions(commit_files, t), "file").filter(F.col("support") / F.col("revisions") >= t.shotgun_confidence)
    both = both.join(packages.select(F.col("file").alias("partner"), "package"), "partner")
    out = both.groupBy("file").agg(F.count(F.lit(1)).alias("partner_count"), F.count_distinct("package").alias("distinct_packages"))
    return out.filter(F.col("distinct_packages") > t.shotgun_packages).orderBy(F.desc("distinct_packages"), F.desc("partner_count"), "file").limit(t.top)


def line_ranges(lines: DataFrame, keys: list[str], line: str = "line", most: int = 40) -> DataFrame:
    """keys, start, end: runs of consecutive line numbers, at most the first `most` of each key."""
    own = Window.partitionBy(*keys)
    runs = lines.select(*keys, line).distinct().withColumn("__island", F.col(line) - F.row_number().over(own.orderBy(line)))
    runs = runs.groupBy(*keys, "__island").agg(F.min(line).alias("start"), F.max(line).alias("end"))
    return runs.withColumn("__n", F.row_number().over(own.orderBy("start"))).filter(F.col("__n") <= most).drop("__n", "__island")


def innermost(lines: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the span (name, start, end) that holds them and begins last; lines outside all spans go."""
    met = lines.join(spans.filter("name <> ''"), keys).filter("line between start and end")
    return met.groupBy(*lines.columns).agg(F.max_by("name", F.struct("start", "end")).alias("function"))


def is_fix(subject: Column) -> Column:
    """Whether a commit's subject has a word that tells of a repair."""
    return F.lower(subject).rlike(r"(^|[^a-z0-9])(fix|fixes|fixed|bug|bugfix|hotfix|defect|regression)([^a-z0-9]|$)")


def defect_prone(blames: DataFrame, cosmetic: DataFrame, t: History = DEFAULTS.history) -> DataFrame:
    """Functions that several fixes repaired. blames: fix, path, function, introducer; cosmetic: introducer, path of changes that left the code as it was."""
    real = blames.join(cosmetic, ["introducer", "path"], "left_anti")
    out = real.groupBy("path", "function").agg(F.count_distinct("fix").alias("fix_count"), F.count_distinct("introducer").alias("introducer_count"))
    return out.filter(F.col("fix_count") >= t.szz_min_inducing).orderBy(F.desc("fix_count"), "path", "function").limit(t.top)


def quintiles(values: DataFrame, value: str) -> DataFrame:
    """Nearest-rank p20, p50 and p80; no rows: null."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double")
    return values.agg(at(0.2).alias("p20"), at(0.5).alias("p50"), at(0.8).alias("p80"))


def age_days(commit_files: DataFrame, now: int) -> DataFrame:
    """(file, age_days) since the last commit, never negative, within 32 bits of seconds."""
    last = commit_files.groupBy("file").agg(F.max("ts").alias("ts"))
    return last.select("file", (F.least(F.greatest(F.lit(now) - F.col("ts"), F.lit(0)), F.lit(2**31 - 1)) / 86_400.0).alias("age_days"))


def diffusion_entropy(changes: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """(keys, entropy): bits of the spread of changed lines over files; fewer than two changed files: no row."""
    live = changes.filter(F.col(amount) > 0)
    total = live.groupBy(*keys).agg(F.sum(amount).alias("__total"), F.count(F.lit(1)).alias("__n")).filter("__n >= 2")
    p = F.col(amount) / F.col("__total")
    return live.join(total, keys).groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("entropy"))


def cycle_trend(before: DataFrame, now: DataFrame) -> DataFrame:
    """(cycle, size, trend, previous): catalysts, cycles that share no member with an earlier one, and decay, cycles that hold a smaller earlier one whole; previous is the size of the largest of these. before, now: cycle (id), member."""
    now, before = now.select("cycle", "member").distinct(), before.select(F.col("cycle").alias("old"), "member").distinct()
    sizes = now.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"))
    old = before.groupBy("old").agg(F.count(F.lit(1)).alias("old_size"))
    shared = now.join(before, "member").groupBy("cycle", "old").agg(F.count(F.lit(1)).alias("common")).join(old, "old").join(sizes, "cycle")
    held = (F.col("common") == F.col("old_size")) & (F.col("old_size") < F.col("size"))
    met = shared.groupBy("cycle").agg(F.max(F.when(held, F.col("old_size"))).alias("previous"), F.lit(True).alias("met"))
    out = sizes.join(met, "cycle", "left")
    trend = F.when(F.col("met").isNull(), "catalyst").when(F.col("previous").isNotNull(), "decay")
    return out.select("cycle", "size", trend.alias("trend"), "previous").filter("trend is not null")
