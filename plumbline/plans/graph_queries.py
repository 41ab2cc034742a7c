"""Graph operators over the flow of goods between nations and over other edges of the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.operators import graph as G
from plumbline.plans.bindings import NATION_EDGES, nation_edges, table

STEPS = 8
LOW = replace(DEFAULTS.graph, distance_warning=0.3, distance_alert=0.6, min_coupling=2, min_split_files=2, fragment_files=4, fragment_density=0.2, fragment_loc=10_000_000)

DEGREES = "degrees AS (SELECT node, sum(i) AS afferent, sum(o) AS efferent FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"


def import_degrees(s, d):
    return G.degrees(nation_edges(s, d))


def martin_distance(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.when(F.col("n_nationkey") % 5 != 4, (F.col("n_nationkey") % 5) / 4.0).alias("abstractness"))
    return G.martin(nation_edges(s, d), n, LOW).select("node", "afferent", "efferent", F.round("instability", 6).alias("instability"), F.round("distance", 6).alias("distance"), "severity")


MARTIN_SQL = f"""
WITH {NATION_EDGES}, {DEGREES},
m AS (
  SELECT node, afferent, efferent, efferent / (afferent + efferent) AS i, CASE WHEN n_nationkey % 5 <> 4 THEN (n_nationkey % 5) / 4.0 END AS a
  FROM degrees JOIN nation ON node = n_nationkey)
SELECT node, CAST(afferent AS BIGINT) AS afferent, CAST(efferent AS BIGINT) AS efferent, round(i, 6) AS instability, round(abs(a + i - 1), 6) AS distance,
  CASE WHEN abs(a + i - 1) >= 0.6 THEN 'alert' ELSE 'warning' END AS severity
FROM m WHERE a IS NOT NULL AND afferent + efferent >= 2 AND abs(a + i - 1) >= 0.3"""


def pagerank(s, d):
    return G.pagerank(nation_edges(s, d), iterations=STEPS).select("node", F.round("rank", 8).alias("rank"))


def _rank_steps() -> str:
    steps = [
        "links AS (SELECT DISTINCT src, dst FROM edges), nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), out AS (SELECT src, count(*) AS o FROM links GROUP BY src)",
        "r0 AS (SELECT node, 1 / n AS rank FROM nodes, n)",
    ]
    for k in range(1, STEPS + 1):
        steps.append(f"d{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE node NOT IN (SELECT src FROM out))")
        steps.append(f"g{k} AS (SELECT dst, sum(rank / o) AS got FROM links JOIN r{k - 1} ON src = node JOIN out USING (src) GROUP BY dst)")
        steps.append(f"r{k} AS (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM nodes LEFT JOIN g{k} ON node = dst, n, d{k})")
    return ", ".join(steps)


def _pagerank_sql() -> str:
    return f"WITH {NATION_EDGES}, {_rank_steps()} SELECT node, round(rank, 8) AS rank FROM r{STEPS}"


def transitive_imports(s, d):
    return G.reachable(nation_edges(s, d))


REACH = f"WITH RECURSIVE {NATION_EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


def import_cycles(s, d):
    ranks = G.pagerank(nation_edges(s, d), iterations=STEPS).withColumn("rank", F.round("rank", 8))
    return G.cycles(nation_edges(s, d), ranks).withColumn("severity", F.round("severity", 6))


CYCLES_SQL = (
    REACH
    + ", "
    + _rank_steps()
    + """,
mutual AS (SELECT a.src AS node, min(a.dst) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
sizes AS (SELECT cycle, count(*) AS n FROM mutual GROUP BY cycle),
inner_edges AS (SELECT m.cycle, e.src, e.dst FROM edges e JOIN mutual m ON e.src = m.node JOIN mutual k ON e.dst = k.node AND k.cycle = m.cycle WHERE e.src <> e.dst),
counts AS (SELECT cycle, count(*) AS m FROM inner_edges GROUP BY cycle),
deg AS (SELECT cycle, max(d) AS d FROM (SELECT cycle, x, count(*) AS d FROM (SELECT cycle, src AS x FROM inner_edges UNION ALL SELECT cycle, dst FROM inner_edges) GROUP BY ALL) GROUP BY cycle),
shaped AS (
SELECT s.cycle, CAST(n AS INT) AS size, CAST(m AS INT) AS edges,
  CASE WHEN n <= 2 THEN 'Tiny' WHEN m / (n * (n - 1)) >= 0.75 THEN 'Clique' WHEN d / (2 * m) >= 0.4 THEN 'Star' WHEN m <= n + n // 4 THEN 'Circle' ELSE 'Chain' END AS shape
FROM sizes s JOIN counts c ON s.cycle = c.cycle JOIN deg g ON s.cycle = g.cycle),
ranks AS (SELECT node, round(rank, 8) AS r FROM r8),
most AS (SELECT cycle, max(r) AS r FROM mutual JOIN ranks ON mutual.node = ranks.node GROUP BY cycle),
cuts AS (SELECT i.cycle, i.src, i.dst, row_number() OVER (PARTITION BY i.cycle ORDER BY a.r + b.r, i.src, i.dst) AS k FROM inner_edges i JOIN ranks a ON i.src = a.node JOIN ranks b ON i.dst = b.node)
SELECT x.cycle AS cycle, size, edges, shape, round(CASE shape WHEN 'Clique' THEN 1.0 WHEN 'Star' THEN 0.7 WHEN 'Chain' THEN 0.5 WHEN 'Tiny' THEN 0.4 ELSE 0.3 END::DOUBLE * r * size, 6) AS severity, src AS cut_src, dst AS cut_dst
FROM shaped x JOIN most ON x.cycle = most.cycle JOIN cuts ON x.cycle = cuts.cycle AND k = 1"""
)


def weak_components(s, d):
    p = table(s, d, "part")
    return G.weak_components(p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst")))


WEAK_SQL = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM reach r JOIN b ON r.seen = b.src)
SELECT node, min(seen) AS component FROM reach GROUP BY node"""


def communities(s, d):
    return G.communities(nation_edges(s, d)).select("node", "community", F.round("modularity", 6).alias("modularity"))


def _members(s, d):
    supp = table(s, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("loc"))
    n = table(s, d, "nation").join(supp, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select(F.col("n_nationkey").cast("long").alias("file"), F.col("n_regionkey").cast("long").alias("component"), (F.coalesce("loc", F.lit(0)) * F.col("n_nationkey")).alias("loc"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 24.0).alias("abstractness"))


MEMBERS = """
members AS (
  SELECT CAST(n_nationkey AS BIGINT) AS file, CAST(n_regionkey AS BIGINT) AS component, coalesce(c, 0) * n_nationkey AS loc, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 24.0 END AS abstractness
  FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey)"""
COMPONENTS = (
    NATION_EDGES
    + ","
    + MEMBERS
    + """,
cross_edges AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges JOIN members a ON src = a.file JOIN members b ON dst = b.file WHERE a.component <> b.component),
comps AS (
  SELECT component, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS loc, coalesce(avg(abstractness), 0) AS abstractness,
    (SELECT count(*) FROM cross_edges x WHERE x.dst = m.component) AS afferent, (SELECT count(*) FROM cross_edges x WHERE x.src = m.component) AS efferent
  FROM members m GROUP BY component),
components AS (SELECT *, CASE WHEN afferent + efferent = 0 THEN 0 ELSE efferent / (afferent + efferent) END AS instability FROM comps)"""
)


def component_metrics(s, d):
    out, _ = G.component_graph(nation_edges(s, d), _members(s, d))
    return out.withColumns({"abstractness": F.round("abstractness", 6), "instability": F.round("instability", 6)})


def unstable_dependencies(s, d):
    comps, cross = G.component_graph(nation_edges(s, d, 3), _members(s, d))
    return G.unstable_dependencies(comps, cross).select("component", F.round("instability", 6).alias("instability"), "total_deps", "unstable_deps", F.round("strength", 6).alias("strength"), F.round("gap", 6).alias("gap"))


UNSTABLE_SQL = f"""
WITH {COMPONENTS.replace("r <= 2", "r <= 3")},
pairs AS (SELECT a.component, a.instability AS own, b.instability AS theirs FROM cross_edges JOIN components a ON src = a.component JOIN components b ON dst = b.component)
SELECT component, round(any_value(own), 6) AS instability, count(*) AS total_deps, count(*) FILTER (theirs > own) AS unstable_deps,
  round(count(*) FILTER (theirs > own) / count(*), 6) AS strength, round(any_value(own) - avg(theirs) FILTER (theirs > own), 6) AS gap
FROM pairs GROUP BY component HAVING count(*) >= 2 AND count(*) FILTER (theirs > own) > 0 AND count(*) FILTER (theirs > own) / count(*) >= 0.3"""


def _part_graph(s, d):
    p = table(s, d, "part")
    edges = p.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.col("p_size") % 23 + 1).cast("string")).alias("dst")).filter("src <> dst").distinct()
    sizes = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("file_count"), F.sum("p_size").cast("long").alias("loc"))
    return edges, sizes


def hub_like(s, d):
    edges, _ = _part_graph(s, d)
    return G.hub_like(G.degrees(edges).withColumnRenamed("node", "component"))


HUB_SQL = """
WITH edges AS (SELECT DISTINCT p_brand AS src, 'Brand#' || (p_size % 23 + 1) AS dst FROM part WHERE p_brand <> 'Brand#' || (p_size % 23 + 1)),
deg AS (SELECT component, sum(i) AS a, sum(o) AS e FROM (SELECT src AS component, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY component),
med AS (SELECT median(a) AS ma, median(e) AS me FROM deg)
SELECT component, CAST(a AS BIGINT) AS afferent, CAST(e AS BIGINT) AS efferent, CAST(abs(a - e) AS BIGINT) AS imbalance FROM deg, med WHERE a > ma AND e > me AND abs(a - e) < 0.25 * (a + e)"""


def god_components(s, d):
    _, sizes = _part_graph(s, d)
    return G.god_components(sizes.withColumnRenamed("p_brand", "component")).withColumn("density", F.round("density", 6))


def compound_smells(s, d):
    e = table(s, d, "events").filter("value > 0").select(F.col("user_id").alias("component"), F.col("event_type").alias("kind"), F.round("value", 2).cast("decimal(18,2)").alias("severity"))
    out = G.compound_smells(e)
    return out.select("component", "kinds", F.col("severity").cast("double").alias("severity"), "names")


def over_fragmented(s, d):
    return G.over_fragmented(nation_edges(s, d, 6), _members(s, d), LOW).select("component", "files", "loc", "internal_edges", F.round("density", 6).alias("density"), "avg_loc")


FRAGMENTED_SQL = f"""
WITH {NATION_EDGES.replace("r <= 2", "r <= 6")}, {MEMBERS},
inner_edges AS (SELECT a.component, count(*) AS n FROM (SELECT DISTINCT src, dst FROM edges) JOIN members a ON src = a.file JOIN members b ON dst = b.file WHERE a.component = b.component AND src <> dst GROUP BY a.component),
sizes AS (SELECT component, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM members GROUP BY component)
SELECT s.component, files, loc, n AS internal_edges, round(n / files, 6) AS density, loc // files AS avg_loc FROM sizes s JOIN inner_edges i ON s.component = i.component WHERE files >= 4 AND n / files >= 0.2"""


def _by_hand(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") % 4).alias("community"))


def remodularize(s, d):
    return G.remodularize(_by_hand(s, d), _members(s, d), LOW)


REMOD_SQL = """
WITH b AS (SELECT CAST(n_regionkey AS BIGINT) AS component, n_nationkey % 4 AS community, count(*) AS n FROM nation GROUP BY ALL),
dirs AS (SELECT 'split' AS kind, CAST(component AS VARCHAR) AS subject, CAST(sum(n) AS BIGINT) AS files, count(*) AS parts, max(n) AS most FROM b GROUP BY component),
comms AS (SELECT 'merge' AS kind, CAST(community AS VARCHAR) AS subject, CAST(sum(n) AS BIGINT) AS files, count(*) AS parts, max(n) AS most FROM b GROUP BY community)
SELECT kind, subject, files, parts FROM (SELECT * FROM dirs UNION ALL SELECT * FROM comms) WHERE files >= 2 AND parts > 1 AND most / files < 0.6"""


def move_suggestions(s, d):
    return G.moves(_by_hand(s, d), _members(s, d))


MOVES_SQL = """
WITH r AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS component, n_nationkey % 4 AS community FROM nation),
b AS (SELECT community, component, count(*) AS n FROM r GROUP BY ALL),
home AS (SELECT community, component AS home FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, component) AS k FROM b) WHERE k = 1)
SELECT node, component, home FROM r JOIN home USING (community) WHERE component <> home"""


def nearest_owner(s, d):
    paths = table(s, d, "part").select(F.concat_ws("/", F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("path")).distinct()
    owners = table(s, d, "part").filter("p_size % 4 = 0").select(F.concat_ws("/", F.col("p_brand"), F.col("p_size").cast("string")).alias("owner")).union(table(s, d, "part").filter("p_size > 25").select("p_brand")).union(s.sql("select ''"))
    return G.nearest_owner(paths, owners)


OWNER_SQL = """
WITH o AS (SELECT DISTINCT p_brand || '/' || p_size AS owner FROM part WHERE p_size % 4 = 0 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 25 UNION SELECT ''),
p AS (SELECT DISTINCT p_brand || '/' || p_size || '/' || p_partkey AS path FROM part)
SELECT path, owner FROM (SELECT path, owner, row_number() OVER (PARTITION BY path ORDER BY length(owner) DESC) AS k FROM p JOIN o ON owner = '' OR starts_with(path, owner || '/')) WHERE k = 1"""


def reflexion(s, d):
    n = table(s, d, "nation")
    a, b = n.select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").cast("long").alias("dst"), F.col("n_regionkey").alias("rb"))
    declared = a.join(b, F.col("ra") == F.col("rb")).filter("src < dst")
    return G.reflexion(declared, nation_edges(s, d))


REFLEXION_SQL = f"""
WITH {NATION_EDGES},
declared AS (SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
actual AS (SELECT DISTINCT src, dst FROM edges)
SELECT src, dst, 'undeclared' AS kind FROM (FROM actual EXCEPT FROM declared) UNION ALL SELECT src, dst, 'unused' FROM (FROM declared EXCEPT FROM actual)"""

QUERIES = {
    "import_degrees": (import_degrees, f"WITH {NATION_EDGES}, {DEGREES} SELECT node, CAST(afferent AS BIGINT) AS afferent, CAST(efferent AS BIGINT) AS efferent FROM degrees"),
    "martin_distance": (martin_distance, MARTIN_SQL),
    "pagerank": (pagerank, _pagerank_sql()),
    "transitive_imports": (transitive_imports, REACH + " SELECT DISTINCT src, dst FROM reach"),
    "import_cycles": (import_cycles, CYCLES_SQL),
    "weak_components": (weak_components, WEAK_SQL),
    "communities": (communities, None),
    "component_metrics": (component_metrics, f"WITH {COMPONENTS} SELECT component, file_count, loc, round(abstractness, 6) AS abstractness, afferent, efferent, round(instability, 6) AS instability FROM components"),
    "unstable_dependencies": (unstable_dependencies, UNSTABLE_SQL),
    "hub_like": (hub_like, HUB_SQL),
    "god_components": (god_components, "WITH c AS (SELECT p_brand AS component, count(*) AS file_count, CAST(sum(p_size) AS BIGINT) AS loc FROM part GROUP BY p_brand), q AS (SELECT quantile_cont(loc, 0.9) AS cutoff FROM c) SELECT component, loc, file_count, round(loc / file_count, 6) AS density FROM c, q WHERE loc > cutoff"),
    "compound_smells": (compound_smells, "SELECT user_id AS component, count(DISTINCT event_type) AS kinds, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS severity, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events WHERE value > 0 GROUP BY user_id HAVING count(DISTINCT event_type) >= 2"),
    "over_fragmented": (over_fragmented, FRAGMENTED_SQL),
    "remodularize": (remodularize, REMOD_SQL),
    "move_suggestions": (move_suggestions, MOVES_SQL),
    "nearest_owner": (nearest_owner, OWNER_SQL),
    "reflexion_edges": (reflexion, REFLEXION_SQL),
}
