"""Graph kernels: degrees, distances, ranks, cycles, communities, components.

Facts stay DataFrames; the kernels that depend on an order of steps (communities,
strong components of a directed graph) run on the driver over a module graph of
checked size, as their input is one row a module edge and not data.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructField, StructType

from plumbline.config import DEFAULTS, Graph
from plumbline.session import written

#: Edges that a driver-side kernel takes; more are an error rather than a stalled driver.
DRIVER_EDGES = 2_000_000
#: Edges of a graph that is ranked on the driver.
DRIVER_LINKS = 200_000


def unique_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst); self-loops stay."""
    return edges.select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, afferent, efferent) of every node that an edge names."""
    e = unique_edges(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("afferent"), F.sum("o").cast("long").alias("efferent"))


def instability(afferent: Column, efferent: Column) -> Column:
    return F.when(afferent + efferent == 0, F.lit(0.0)).otherwise(efferent / (afferent + efferent))


def martin(edges: DataFrame, abstractness: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Distance from the main sequence. abstractness: node, abstractness (null: not measured, no distance)."""
    d = degrees(edges).withColumn("instability", instability(F.col("afferent"), F.col("efferent")))
    d = d.join(abstractness, "node").filter("abstractness is not null").withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    d = d.filter((F.col("afferent") + F.col("efferent") >= t.min_coupling) & (F.col("distance") >= t.distance_warning))
    return d.withColumn("severity", F.when(F.col("distance") >= t.distance_alert, "alert").otherwise("warning"))


def pagerank(edges: DataFrame, t: Graph = DEFAULTS.graph, iterations: int | None = None) -> DataFrame:
    """(node, rank) by power iteration; the mass of nodes without out-edges is spread evenly.

    Stops after `iterations` steps if given, else when the change is below
    epsilon. A module graph of up to DRIVER_LINKS edges is ranked on the driver.
    Beyond that the ranks of each step are a written table, so the plan of a
    step does not grow with the steps before it.
    """
    e = unique_edges(edges)
    rows = [tuple(r) for r in e.limit(DRIVER_LINKS + 1).collect()]
    if len(rows) <= DRIVER_LINKS:
        return _small_pagerank(edges, rows, t, iterations)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = written(e.join(out, "src"), "links")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = written(nodes.join(out.select(F.col("src").alias("node"), "out"), "node", "left"), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range((iterations or t.max_iterations) if n else 0):
        lost = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        value = F.lit((1 - t.damping) / n) + F.lit(t.damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        ranks = written(ranks.join(got, "node", "left").select("node", "out", F.col("rank").alias("old"), value.alias("rank")), "ranks")
        if iterations is None and ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < t.epsilon:
            break
    return ranks.select("node", "rank")


def _small_pagerank(edges: DataFrame, rows: list[tuple], t: Graph, iterations: int | None) -> DataFrame:
    nodes = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(nodes)}
    src, dst = (np.array([at[r[k]] for r in rows], dtype=np.int64) for k in (0, 1))
    n, out = len(nodes), np.bincount(src, minlength=len(nodes))
    rank = np.full(n, 1.0 / max(n, 1))
    for _ in range((iterations or t.max_iterations) if n else 0):
        got = np.bincount(dst, (rank / np.maximum(out, 1))[src], n)
        new = (1 - t.damping) / n + t.damping * (got + rank[out == 0].sum() / n)
        moved, rank = np.abs(new - rank).sum(), new
        if iterations is None and moved < t.epsilon:
            break
    return edges.sparkSession.createDataFrame(list(zip(nodes, rank.tolist())), f"node {dict(edges.dtypes)['src']}, rank double")


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) of all paths of one edge or more. Known paths are joined to themselves, so the steps grow with the logarithm of the longest path."""
    paths, n = written(unique_edges(edges), "paths"), -1
    while (now := paths.count()) != n:
        n = now
        longer = paths.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        paths = written(paths.union(longer).distinct(), "paths")
    return paths


def _collected(edges: DataFrame, columns: Iterable[str] = ("src", "dst")) -> list[tuple]:
    rows = [tuple(r) for r in edges.select(*columns).limit(DRIVER_EDGES + 1).collect()]
    if len(rows) > DRIVER_EDGES:
        raise ValueError("the module graph is too large for a kernel on the driver")
    return rows


def strong_components(pairs: list[tuple]) -> list[list]:
    """Strongly connected components of two nodes or more, and single nodes with a loop; sorted."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    # two depth-first passes: by finishing order, then over reversed edges
    order, seen = [], set()
    for root in sorted(after):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(after[root]))]
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(after[x])))
                    break
            else:
                order.append(node)
                stack.pop()
    before: dict = {x: [] for x in after}
    for a, b in pairs:
        before[b].append(a)
    done, out, loops = set(), [], {a for a, b in pairs if a == b}
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        own, todo = [], [root]
        while todo:
            x = todo.pop()
            own.append(x)
            for y in before[x]:
                if y not in done:
                    done.add(y)
                    todo.append(y)
        if len(own) > 1 or root in loops:
            out.append(sorted(own))
    return sorted(out)


def cycle_shape(n: int, pairs: set[tuple]) -> str:
    """The shape of a cycle of n nodes by its inner edges, without loops."""
    m = len(pairs)
    if n <= 2:
        return "Tiny"
    degree: dict = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    if m / (n * (n - 1)) >= 0.75:
        return "Clique"
    if m and max(degree.values()) / (2 * m) >= 0.4:
        return "Star"
    return "Circle" if m <= n + n // 4 else "Chain"


#: How much a shape weighs in a cycle's severity.
SHAPE_WEIGHT = {"Clique": 1.0, "Star": 0.7, "Chain": 0.5, "Tiny": 0.4, "Circle": 0.3}


def cycles(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(cycle, size, edges, shape, severity, cut_src, cut_dst): the strong components, and of each the edge whose ends have the least centrality."""
    spark = edges.sparkSession
    pairs = sorted(set(_collected(edges)))
    rank = {r["node"]: r["rank"] for r in ranks.collect()} if ranks is not None else {}
    rows, found = [], strong_components(pairs)
    of = {x: k for k, own in enumerate(found) for x in own}
    inside: list[set] = [set() for _ in found]
    for a, b in pairs:
        if a != b and a in of and of[a] == of.get(b):
            inside[of[a]].add((a, b))
    for own, inner in zip(found, inside):
        shape = cycle_shape(len(own), inner)
        cut = min(inner, key=lambda e: (rank.get(e[0], 0.0) + rank.get(e[1], 0.0), e), default=(own[0], own[0]))
        rows.append((own[0], len(own), len(inner), shape, SHAPE_WEIGHT[shape] * max((rank.get(x, 0.0) for x in own), default=0.0) * len(own), cut[0], cut[1]))
    kind = dict(edges.dtypes)["src"]
    return spark.createDataFrame(rows, f"cycle {kind}, size int, edges int, shape string, severity double, cut_src {kind}, cut_dst {kind}")


def louvain(pairs: list[tuple], resolution: float = 1.0, passes: int = 20) -> tuple[dict, float]:
    """Communities by local moving only, and the modularity. pairs: (a, b, weight), undirected; nodes are visited in order of first appearance, ties keep the lowest community."""
    nodes: dict = {}
    near: list[dict[int, float]] = []
    total = 0.0
    for a, b, w in pairs:
        for x in (a, b):
            if x not in nodes:
                nodes[x] = len(nodes)
                near.append({})
        i, j = nodes[a], nodes[b]
        if i == j:
            continue
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
        total += w
    strength = [sum(x.values()) for x in near]
    of, held = list(range(len(near))), strength[:]
    for _ in range(passes if total else 0):
        moved = False
        for i, own in enumerate(near):
            held[of[i]] -= strength[i]
            to: dict[int, float] = {of[i]: 0.0}
            for j, w in own.items():
                to[of[j]] = to.get(of[j], 0.0) + w
            gain = {c: k - resolution * strength[i] * held[c] / (2 * total) for c, k in to.items()}
            best = of[i]
            for c in sorted(gain):
                if gain[c] > gain[best] + 1e-12 or abs(gain[c] - gain[best]) <= 1e-12 and c < best and c != of[i] and best != of[i]:
                    best = c
            held[best] += strength[i]
            if best != of[i]:
                of[i], moved = best, True
        if not moved:
            break
    inner = sum(w for i, own in enumerate(near) for j, w in own.items() if of[i] == of[j]) / 2
    by: dict[int, float] = {}
    for i, s in enumerate(strength):
        by[of[i]] = by.get(of[i], 0.0) + s
    q = inner / total - resolution * sum((s / (2 * total)) ** 2 for s in by.values()) if total else 0.0
    first: dict[int, int] = {}
    for c in of:
        first.setdefault(c, len(first))
    return {x: first[of[i]] for x, i in nodes.items()}, q


def communities(edges: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """(node, community, modularity) of a module graph with weights, edges in sorted order."""
    rows = sorted(_collected(edges, ("src", "dst", "weight")))
    found, q = louvain([(a, b, float(w)) for a, b, w in rows], t.resolution, t.passes)
    return edges.sparkSession.createDataFrame([(x, c, q) for x, c in found.items()], f"node {dict(edges.dtypes)['src']}, community int, modularity double")


def _driver_roots(links: DataFrame) -> DataFrame:
    """(node, head) of every node of links (src, dst), a head for each component. Each root hooks on to the least root beside it, so that half of them go in a step."""
    table = links.toArrow()
    names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], type=table["src"].type).combine_chunks().dictionary_encode()
    a, b = np.split(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
    root = np.arange(len(names.dictionary))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((further := root[root]) != root).any():
            root = further
    node = links.schema["src"].dataType
    schema = StructType([StructField("node", node), StructField("head", node)])
    return links.sparkSession.createDataFrame(pa.table({"node": names.dictionary, "head": names.dictionary.take(pa.array(root))}), schema)


def weak_components(edges: DataFrame, few: int = DRIVER_EDGES) -> DataFrame:
    """(node, component): the least node that can be reached over edges in either direction.

    In each round every node becomes the one of least hash among itself and its
    neighbours, and the graph is that of the nodes which are left: half of a
    path, less of denser graphs. Hashes are new in each round, so no numbering
    makes rounds many. A graph of at most `few` edges is ended on the driver.
    """
    e = unique_edges(edges)
    links = e.filter("src <> dst")
    links, heads = written(links.union(links.select("dst", "src")).distinct(), "links"), []
    driver = few if isinstance(links.schema["src"].dataType, AtomicType) else 0
    while (n := links.count() // 2) > driver:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(heads)), c).alias("hash"), F.col(c).alias("node"))
        near = links.groupBy("src").agg(F.min(order("dst")).alias("near"))
        heads.append(written(near.select(F.col("src").alias("node"), F.least(order("src"), "near")["node"].alias("head")), "heads"))
        own = links.join(heads[-1].select(F.col("node").alias("src"), F.col("head").alias("a")), "src")
        own = own.join(heads[-1].select(F.col("node").alias("dst"), F.col("head").alias("b")), "dst")
        links = written(own.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
    if n:
        heads.append(written(_driver_roots(links.filter("src < dst")), "heads"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).filter("node is not null").distinct()
    roots = None
    for h in [*reversed(heads), nodes.withColumn("head", F.col("node"))]:
        if roots is not None:
            h = h.join(roots.select(F.col("node").alias("head"), F.col("head").alias("root")), "head", "left").select("node", F.coalesce("root", "head").alias("head"))
        roots = written(h, "roots")
    least = roots.groupBy("head").agg(F.min("node").alias("component"))
    return written(roots.join(least, "head").select("node", "component"), "labels")


def component_graph(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directories as components: (component, file_count, loc, abstractness, afferent, efferent, instability), and their edges.

    members: file, component, loc, abstractness (null: not measured; a component without a measure has 0).
    """
    m = members.select(F.col("file").alias("src"), F.col("component").alias("a"))
    cross = edges.join(m, "src").join(members.select(F.col("file").alias("dst"), F.col("component").alias("b")), "dst")
    cross = cross.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("file_count"), F.sum("loc").cast("long").alias("loc"), F.coalesce(F.avg("abstractness"), F.lit(0.0)).alias("abstractness"))
    out = sizes.join(degrees(cross).withColumnRenamed("node", "component"), "component", "left").na.fill(0, ["afferent", "efferent"])
    return out.withColumn("instability", instability(F.col("afferent"), F.col("efferent"))), cross


def unstable_dependencies(components: DataFrame, edges: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Components that lean on less stable ones."""
    i = components.select("component", "instability")
    pairs = edges.join(i.withColumnsRenamed({"component": "src", "instability": "own"}), "src").join(i.withColumnsRenamed({"component": "dst", "instability": "theirs"}), "dst")
    worse = F.col("theirs") > F.col("own")
    out = pairs.groupBy(F.col("src").alias("component")).agg(F.first("own").alias("instability"), F.count(F.lit(1)).alias("total_deps"), F.count_if(worse).alias("unstable_deps"), F.avg(F.when(worse, F.col("theirs"))).alias("mean"))
    out = out.filter("total_deps >= 2").withColumns({"strength": F.col("unstable_deps") / F.col("total_deps"), "gap": F.col("instability") - F.col("mean")})
    return out.filter((F.col("strength") >= t.unstable_strength) & (F.col("unstable_deps") > 0)).drop("mean")


def hub_like(components: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Components above the median both ways with balanced degrees."""
    medians = components.agg(F.median("afferent").alias("mi"), F.median("efferent").alias("mo"))
    total, gap = F.col("afferent") + F.col("efferent"), F.abs(F.col("afferent") - F.col("efferent"))
    out = components.join(F.broadcast(medians)).filter((F.col("afferent") > F.col("mi")) & (F.col("efferent") > F.col("mo")) & (gap < t.hub_imbalance * total))
    return out.select("component", "afferent", "efferent", gap.alias("imbalance"))


def god_components(components: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Components of more lines than the percentile, if there are three at least."""
    cut = components.agg(F.percentile("loc", F.lit(t.god_percentile)).alias("cutoff"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    out = components.join(F.broadcast(cut)).filter("loc > cutoff")
    return out.select("component", "loc", "file_count", (F.col("loc") / F.col("file_count")).alias("density"))


def compound_smells(findings: DataFrame) -> DataFrame:
    """Components with two kinds of findings or more. findings: component, kind, severity."""
    out = findings.groupBy("component").agg(F.count_distinct("kind").alias("kinds"), F.sum("severity").alias("severity"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("names"))
    return out.filter("kinds >= 2")


def over_fragmented(edges: DataFrame, members: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Directories of many small files that hang together."""
    m = members.select(F.col("file").alias("src"), F.col("component").alias("a"))
    inner = unique_edges(edges).join(m, "src").join(members.select(F.col("file").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b and src <> dst")
    inner = inner.groupBy(F.col("a").alias("component")).agg(F.count(F.lit(1)).alias("internal_edges"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    out = sizes.join(inner, "component").withColumns({"density": F.col("internal_edges") / F.col("files"), "avg_loc": F.expr("cast(loc div files as long)")})
    return out.filter((F.col("files") >= t.fragment_files) & (F.col("density") >= t.fragment_density) & (F.col("avg_loc") <= t.fragment_loc))


def remodularize(communities: DataFrame, members: DataFrame, t: Graph = DEFAULTS.graph) -> DataFrame:
    """Directories whose files belong to several communities (split), and communities over several directories (merge), by share. communities: node, community."""
    rows = members.select(F.col("file").alias("node"), "component").join(communities.select("node", "community"), "node")
    both = rows.groupBy("component", "community").agg(F.count(F.lit(1)).alias("n"))
    per_dir = both.groupBy("component").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"))
    split = per_dir.filter((F.col("files") >= t.min_split_files) & (F.col("parts") > 1) & (F.col("most") / F.col("files") < t.split_cohesion)).select(F.lit("split").alias("kind"), F.col("component").cast("string").alias("subject"), "files", "parts")
    per_comm = both.groupBy("community").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"))
    merge = per_comm.filter((F.col("files") >= t.min_split_files) & (F.col("parts") > 1) & (F.col("most") / F.col("files") < t.split_cohesion)).select(F.lit("merge").alias("kind"), F.col("community").cast("string").alias("subject"), "files", "parts")
    return split.union(merge)


def moves(communities: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component, home): files whose community is at home, by most of its files, in another directory."""
    rows = members.select(F.col("file").alias("node"), "component").join(communities.select("node", "community"), "node")
    both = rows.groupBy("community", "component").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("community").orderBy(F.desc("n"), "component")
    home = both.withColumn("r", F.row_number().over(top)).filter("r = 1").select("community", F.col("component").alias("home"))
    return rows.join(home, "community").filter("component <> home").select("node", "component", "home")


def nearest_owner(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest directory of owners that is above the path ('' is above all). All ancestors are joined, so nothing is compared pairwise."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("owner")))
    found = paths.select("path", F.explode(ups).alias("u")).select("path", "u.*").join(owners.select("owner").distinct(), "owner")
    return found.groupBy("path").agg(F.max_by("owner", "depth").alias("owner"))


def reflexion(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(src, dst, kind): edges that exist without being declared, and declared ones that do not exist."""
    a, d = unique_edges(actual).filter("src <> dst"), unique_edges(declared)
    return a.join(d, ["src", "dst"], "left_anti").withColumn("kind", F.lit("undeclared")).union(d.join(a, ["src", "dst"], "left_anti").withColumn("kind", F.lit("unused")))
