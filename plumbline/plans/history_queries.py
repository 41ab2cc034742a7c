"""History operators over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.operators import history as H
from plumbline.plans.bindings import COMMIT_FILES, PAIRS, commit_files, table

#: The tables' orders repeat few pairs, so the floors of the bindings are low.
LOW = replace(DEFAULTS.history, min_support=2, min_confidence=0.05)
LOW_SHOTGUN = replace(DEFAULTS.history, min_support=1, shotgun_confidence=0.05)
LOW_BLOB = replace(DEFAULTS.history, blob_commit_pct=0.0015)


def _parts(s, d):
    return table(s, d, "part")


def co_change_pairs(s, d):
    return H.co_change_pairs(commit_files(s, d))


def revisions(s, d):
    return H.revisions(commit_files(s, d))


def architectural_drift(s, d):
    parts = _parts(s, d)
    edges = parts.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst"))
    typed = parts.filter("p_size <= 45").select(F.col("p_partkey").alias("file"))
    return H.drift(commit_files(s, d), edges, typed, LOW).select("file_a", "file_b", "support", "rev_a", "rev_b", "commits", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"), F.round("jaccard", 6).alias("jaccard"), "last_seen", "distinct_authors")


DRIFT_SQL = f"""
WITH {PAIRS},
typed AS (SELECT p_partkey AS file FROM part WHERE p_size <= 45),
imports AS (SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part WHERE p_partkey % 7 <> 0),
linked AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM imports),
total AS (SELECT count(DISTINCT hash) AS commits FROM scoped),
kept AS (
  SELECT p.*, greatest(ra.revisions, support) AS rev_a, greatest(rb.revisions, support) AS rev_b, commits
  FROM pairs p JOIN revs ra ON p.file_a = ra.file JOIN revs rb ON p.file_b = rb.file CROSS JOIN total
  WHERE support >= 2 AND file_a IN (SELECT file FROM typed) AND file_b IN (SELECT file FROM typed)
    AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.a = p.file_a AND l.b = p.file_b)),
scored AS (
  SELECT *, least(support / rev_a, support / rev_b) AS c, support * commits / CAST(rev_a * rev_b AS DOUBLE) AS l, support / (rev_a + rev_b - support) AS j FROM kept)
SELECT file_a, file_b, support, rev_a, rev_b, commits, round(c, 6) AS confidence, round(l, 6) AS lift, round(j, 6) AS jaccard, last_seen, distinct_authors
FROM scored WHERE c >= 0.05 AND l > 1 ORDER BY c DESC, l DESC, file_a, file_b LIMIT 20"""


def build_co_change(s, d):
    parts = _parts(s, d)
    build = parts.filter("p_size <= 5").select(F.col("p_partkey").alias("file"))
    source = parts.filter("p_size > 5").select(F.col("p_partkey").alias("file"))
    out = H.build_drift(commit_files(s, d), build, source, replace(LOW, build_min_ratio=0.05))
    return out.select("build_file", "source_file", "support", "source_revisions", F.round("ratio", 6).alias("ratio"), "last_seen", "distinct_authors")


BUILD_SQL = f"""
WITH {PAIRS},
build AS (SELECT p_partkey AS file FROM part WHERE p_size <= 5),
mixed AS (
  SELECT CASE WHEN file_a IN (SELECT file FROM build) THEN file_a ELSE file_b END AS build_file,
         CASE WHEN file_a IN (SELECT file FROM build) THEN file_b ELSE file_a END AS source_file, support, last_seen, distinct_authors
  FROM pairs WHERE support >= 2 AND (file_a IN (SELECT file FROM build)) <> (file_b IN (SELECT file FROM build))),
scored AS (SELECT m.*, greatest(revisions, support) AS source_revisions, support / greatest(revisions, support) AS r FROM mixed m JOIN revs ON source_file = file)
SELECT build_file, source_file, support, source_revisions, round(r, 6) AS ratio, last_seen, distinct_authors
FROM scored WHERE r >= 0.05 ORDER BY r DESC, support DESC, build_file, source_file LIMIT 20"""


def hotspots(s, d):
    modules = _parts(s, d).select(F.col("p_partkey").alias("file"), F.col("p_size").alias("sum_cc"))
    return H.hotspots(commit_files(s, d), modules)


def knowledge_fragmentation(s, d):
    supp = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    files = supp.select(F.col("l_orderkey").alias("hash"), F.col("c_nationkey").alias("author"), F.col("l_suppkey").alias("file"))
    out = H.fragmentation(files, table(s, d, "supplier").select(F.col("s_suppkey").alias("file")))
    return out.select("file", "total_contributors", "minor_contributor_count", F.round("minor_contributor_pct", 6).alias("minor_contributor_pct"), F.concat_ws(",", "top_minor_authors").alias("top_minor_authors"))


FRAGMENT_SQL = """
WITH own AS (
  SELECT l_suppkey AS file, c_nationkey AS author, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
totals AS (SELECT file, sum(n) AS total, count(*) AS total_contributors FROM own GROUP BY file),
minors AS (
  SELECT o.file, author, n, total_contributors, row_number() OVER (PARTITION BY o.file ORDER BY n DESC, author) AS r
  FROM own o JOIN totals t ON o.file = t.file WHERE total >= 5 AND n / total < 0.05)
SELECT file, any_value(total_contributors) AS total_contributors, count(*) AS minor_contributor_count,
  round(count(*) / any_value(total_contributors), 6) AS minor_contributor_pct,
  string_agg(CAST(author AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS top_minor_authors
FROM minors GROUP BY file HAVING count(*) >= 3 ORDER BY minor_contributor_count DESC, file LIMIT 20"""


def file_blobs(s, d):
    typed = _parts(s, d).select(F.col("p_partkey").alias("file"))
    out = H.file_blobs(commit_files(s, d), typed, LOW_BLOB)
    return out.withColumn("blob_ratio", F.round("blob_ratio", 6))


BLOB_SQL = f"""
WITH {COMMIT_FILES},
sizes AS (SELECT hash FROM commit_files GROUP BY hash HAVING count(*) BETWEEN 2 AND 40),
total AS (SELECT count(*) AS total_multi_file_commits FROM sizes)
SELECT file, count(*) AS multi_file_commits, any_value(total_multi_file_commits) AS total_multi_file_commits, round(count(*) / any_value(total_multi_file_commits), 6) AS blob_ratio
FROM commit_files JOIN sizes USING (hash) CROSS JOIN total GROUP BY file
HAVING count(*) / any_value(total_multi_file_commits) > 0.0015 ORDER BY count(*) DESC, file LIMIT 20"""


def change_shotgun(s, d):
    packages = _parts(s, d).select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("package"))
    return H.change_shotgun(commit_files(s, d), packages, LOW_SHOTGUN)


SHOTGUN_SQL = f"""
WITH {PAIRS},
both_ways AS (SELECT file_a AS file, file_b AS partner, support FROM pairs UNION ALL SELECT file_b, file_a, support FROM pairs)
SELECT b.file, count(*) AS partner_count, count(DISTINCT p_brand) AS distinct_packages
FROM both_ways b JOIN revs r ON b.file = r.file JOIN part ON partner = p_partkey WHERE support / revisions >= 0.05
GROUP BY b.file HAVING count(DISTINCT p_brand) > 3 ORDER BY distinct_packages DESC, partner_count DESC, b.file LIMIT 20"""


def deleted_line_ranges(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("fix"), F.col("l_quantity").cast("long").alias("line"))
    return H.line_ranges(lines, ["fix"])


RANGES_SQL = """
WITH lines AS (SELECT DISTINCT l_orderkey AS fix, CAST(l_quantity AS BIGINT) AS line FROM lineitem),
runs AS (SELECT *, line - row_number() OVER (PARTITION BY fix ORDER BY line) AS island FROM lines),
ranges AS (SELECT fix, min(line) AS start, max(line) AS "end" FROM runs GROUP BY fix, island)
SELECT fix, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY fix ORDER BY start) AS n FROM ranges) WHERE n <= 40"""


def defect_prone_functions(s, d):
    lines = table(s, d, "lineitem")
    blames = lines.select(F.col("l_orderkey").alias("fix"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("function"), F.col("l_partkey").alias("introducer"))
    # of the pairs of such a part and such a supplier those that a blame has; all of them would be a product of two tables
    cosmetic = blames.select("introducer", "path").distinct()
    cosmetic = cosmetic.join(_parts(s, d).filter("p_size % 3 = 0").select(F.col("p_partkey").alias("introducer")), "introducer", "left_semi")
    cosmetic = cosmetic.join(table(s, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("path")), "path", "left_semi")
    return H.defect_prone(blames, cosmetic)


DEFECT_SQL = """
SELECT l_suppkey AS path, l_linenumber AS function, count(DISTINCT l_orderkey) AS fix_count, count(DISTINCT l_partkey) AS introducer_count
FROM lineitem WHERE NOT (l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0))
GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 3 ORDER BY fix_count DESC, path, function LIMIT 20"""


def innermost_function(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_quantity").cast("int").alias("line"))
    spans = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("name"), (F.col("l_linenumber") * 5).alias("start"), (F.col("l_linenumber") * 5 + 12).alias("end"))
    return H.innermost(lines.distinct(), spans, ["path"])


INNERMOST_SQL = """
WITH lines AS (SELECT DISTINCT l_orderkey AS path, CAST(l_quantity AS INT) AS line FROM lineitem),
spans AS (SELECT l_orderkey AS path, 'f' || l_linenumber AS name, l_linenumber * 5 AS s, l_linenumber * 5 + 12 AS e FROM lineitem)
SELECT path, line, name AS function FROM (
  SELECT l.path, line, name, row_number() OVER (PARTITION BY l.path, line ORDER BY s DESC, e DESC) AS r
  FROM lines l JOIN spans p ON l.path = p.path AND line BETWEEN s AND e) WHERE r = 1"""


def jit_quintiles(s, d):
    ages = H.age_days(commit_files(s, d), 1_000_000_000)
    return H.quintiles(ages, "age_days").select(*[F.round(c, 6).alias(c) for c in ("p20", "p50", "p80")])


JIT_SQL = f"""
WITH {COMMIT_FILES},
ages AS (SELECT file, least(greatest(1000000000 - max(ts), 0), 2147483647) / 86400.0 AS a FROM commit_files GROUP BY file)
SELECT round(percentile_disc(0.2) WITHIN GROUP (ORDER BY a), 6) AS p20, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY a), 6) AS p50, round(percentile_disc(0.8) WITHIN GROUP (ORDER BY a), 6) AS p80 FROM ages"""


def diffusion_entropy(s, d):
    changes = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").alias("lines"))
    return H.diffusion_entropy(changes, ["commit"], "lines").withColumn("entropy", F.round("entropy", 6))


ENTROPY_SQL = """
WITH c AS (SELECT l_orderkey AS "commit", l_partkey, sum(l_quantity) AS n FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0),
t AS (SELECT "commit", sum(n) AS total FROM c GROUP BY ALL HAVING count(*) >= 2)
SELECT c."commit" AS "commit", round(sum(-(n / total) * log2(n / total)), 6) AS entropy FROM c JOIN t ON c."commit" = t."commit" GROUP BY c."commit" """

def cycle_trends(s, d):
    """Suppliers in rings: by thirties now, by sixties without every seventh before."""
    k = F.col("s_suppkey")
    supp = table(s, d, "supplier")
    now = supp.select((k % 30).alias("cycle"), k.alias("member"))
    before = supp.filter("s_suppkey % 30 not in (3, 5)").select(F.when(k % 30 < 8, (k - 1) % 11).otherwise(k % 60 + 100).alias("cycle"), k.alias("member"))
    return H.cycle_trend(before, now)


TREND_SQL = """
WITH now AS (SELECT s_suppkey % 30 AS cycle, s_suppkey AS member FROM supplier),
before AS (SELECT CASE WHEN s_suppkey % 30 < 8 THEN (s_suppkey - 1) % 11 ELSE s_suppkey % 60 + 100 END AS old, s_suppkey AS member FROM supplier WHERE s_suppkey % 30 NOT IN (3, 5)),
n AS (SELECT cycle, list(member) AS m FROM now GROUP BY cycle), b AS (SELECT old, list(member) AS m FROM before GROUP BY old),
j AS (SELECT n.cycle, len(n.m) AS size, coalesce(bool_or(list_has_any(n.m, b.m)), false) AS met, max(len(b.m)) FILTER (len(b.m) < len(n.m) AND list_has_all(n.m, b.m)) AS previous FROM n LEFT JOIN b ON true GROUP BY n.cycle, n.m)
SELECT cycle, size, CASE WHEN NOT met THEN 'catalyst' ELSE 'decay' END AS trend, CASE WHEN met THEN previous END AS previous FROM j WHERE NOT met OR previous IS NOT NULL"""

QUERIES = {
    "cycle_trends": (cycle_trends, TREND_SQL),
    "co_change_pairs": (co_change_pairs, f"WITH {PAIRS} SELECT * FROM pairs"),
    "revisions_in_scope": (revisions, f"WITH {PAIRS} SELECT * FROM revs"),
    "architectural_drift": (architectural_drift, DRIFT_SQL),
    "build_co_change": (build_co_change, BUILD_SQL),
    "hotspots": (hotspots, f"WITH {COMMIT_FILES} SELECT file, count(*) AS revisions, any_value(p_size) AS sum_cc, CAST(count(*) * any_value(p_size) AS BIGINT) AS score FROM commit_files JOIN part ON file = p_partkey GROUP BY file HAVING count(*) >= 3 AND count(*) * any_value(p_size) >= 30 ORDER BY score DESC, file LIMIT 10"),
    "knowledge_fragmentation": (knowledge_fragmentation, FRAGMENT_SQL),
    "file_blobs": (file_blobs, BLOB_SQL),
    "change_shotgun": (change_shotgun, SHOTGUN_SQL),
    "deleted_line_ranges": (deleted_line_ranges, RANGES_SQL),
    "defect_prone_functions": (defect_prone_functions, DEFECT_SQL),
    "innermost_function": (innermost_function, INNERMOST_SQL),
    "jit_quintiles": (jit_quintiles, JIT_SQL),
    "diffusion_entropy": (diffusion_entropy, ENTROPY_SQL),
}
