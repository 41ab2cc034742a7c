"""Smells, class detectors and dependency checks over columns of the driver's tables that have the facts' shape."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions import paths as P
from plumbline.operators import classes as C
from plumbline.operators import deps as D
from plumbline.operators import smells as M
from plumbline.plans.bindings import table


def _functions(s, d):
    """A line item is a function of its order's file."""
    x = table(s, d, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    return x.select(
        F.col("l_orderkey").alias("path"), F.concat(F.lit("f"), n).alias("function"), (n * 100).alias("start_line"), (n * 100 + q).alias("end_line"),
        (q % 21).alias("cc"), (q % 29).alias("cogc"), (q * 3).alias("loc"), (q % 4).alias("bumps"), (q % 6).alias("nesting"), (n % 5).alias("compound"), (q % 11).alias("args"),
        (q % 19).alias("embedded_loc"), (q % 7).alias("typed"), (q % 5).alias("primitive"), (q % 3).alias("max_same"), (q % 13).alias("asserts"), (q % 2).alias("empty_catch"), (n % 6).alias("short_vars"), (q % 8).alias("match_arms"),
        (n == 1).alias("is_ctor"), (q > 25).alias("di_framework"),
    )


FUNCTIONS = """
fn AS (
  SELECT l_orderkey AS path, 'f' || l_linenumber AS function, l_linenumber * 100 AS start_line, l_linenumber * 100 + q AS end_line, q % 21 AS cc, q % 29 AS cogc, q * 3 AS loc, q % 4 AS bumps, q % 6 AS nesting, l_linenumber % 5 AS compound, q % 11 AS args,
    q % 19 AS embedded_loc, q % 7 AS typed, q % 5 AS prim, q % 3 AS max_same, q % 13 AS asserts, q % 2 AS empty_catch, l_linenumber % 6 AS short_vars, q % 8 AS match_arms, l_linenumber = 1 AS is_ctor, q > 25 AS di
  FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem))"""

RULES = [
    ("god_method", "(cc >= 9 OR cogc >= 15) AND loc >= 65", "loc", "true"),
    ("complex_method", "(cc >= 9 OR cogc >= 15) AND loc < 65", "cc", "cc > 18 OR cogc > 25"),
    ("large_method", "loc >= 65 AND NOT (cc >= 9 OR cogc >= 15)", "loc", "loc > 100"),
    ("nested_conditional_chunks", "bumps >= 2", "bumps", "false"),
    ("deep_nested_complexity", "nesting >= 4", "nesting", "false"),
    ("complex_conditional", "compound > 2", "compound", "false"),
    ("excess_arguments", "NOT is_ctor AND args > 5", "args", "false"),
    ("constructor_over_injection", "is_ctor AND (args > 8 OR greatest(typed - prim, 0) >= CASE WHEN di THEN 8 ELSE 4 END)", "args", "false"),
    ("large_embedded_block", "embedded_loc > 15", "embedded_loc", "false"),
    ("primitive_obsession", "typed >= 4 AND prim > 0 AND max_same >= 2 AND prim::FLOAT / typed::FLOAT >= 0.7::FLOAT", "prim", "false"),
    ("large_assertion_block", "asserts > 10", "asserts", "false"),
    ("empty_error_handler", "empty_catch > 0", "empty_catch", "false"),
    ("short_variable_names", "loc >= 15 AND short_vars > 3", "short_vars", "false"),
    ("stringly_typed_switch", "match_arms > 5", "match_arms", "false"),
]
FINDINGS = FUNCTIONS + ", findings AS (" + " UNION ALL ".join(f"SELECT path, function, start_line, end_line, '{n}' AS smell, CAST({v} AS BIGINT) AS value, {a} AS alert FROM fn WHERE {p}" for n, p, v, a in RULES) + ")"


def function_smells(s, d):
    return M.function_findings(_functions(s, d))


def subsumed_smells(s, d):
    return M.subsume(M.function_findings(_functions(s, d))).select("path", "function", "smell", "value")


SUBSUMED_SQL = f"""
WITH {FINDINGS},
god AS (SELECT DISTINCT path, function, start_line FROM findings WHERE smell = 'god_method')
SELECT f.path AS path, f.function AS function, smell, value FROM findings f LEFT JOIN god g ON g.path = f.path AND g.function = f.function AND g.start_line = f.start_line
WHERE g.path IS NULL OR smell NOT IN ('complex_method', 'large_method', 'deep_nested_complexity')"""


def edit_range_smells(s, d):
    edits = table(s, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 500).cast("int").alias("first_line"), (F.col("o_custkey") % 500 + 40).cast("int").alias("last_line"))
    return M.in_edit_range(M.function_findings(_functions(s, d)), edits).select("path", "function", "smell").distinct()


EDIT_SQL = f"WITH {FINDINGS} SELECT DISTINCT path, function, smell FROM findings JOIN orders ON path = o_orderkey WHERE start_line <= o_custkey % 500 + 40 AND end_line >= o_custkey % 500"


def _modules(s, d):
    f = _functions(s, d)
    return f.groupBy("path").agg((F.sum("loc") * 2).cast("int").alias("loc"), (F.count(F.lit(1)) * 5).cast("int").alias("functions"), (F.sum("cc") * 3).cast("int").alias("sum_cc"), F.max("args").alias("declarations"), F.max("bumps").alias("global_conditionals"), F.max("nesting").alias("global_nesting"), F.min("nesting").alias("lcom4"))


MODULE_RULES = [
    ("file_too_large", "loc >= 500", "loc", "loc > 700"),
    ("too_many_functions", "n > 20", "n", "false"),
    ("overall_complexity", "sum_cc > 100", "sum_cc", "false"),
    ("excessive_declarations", "declarations > 20", "declarations", "false"),
    ("god_class", "loc >= 500 AND n > 20 AND god", "n", "true"),
    ("global_conditionals", "gc > 0", "gc", "false"),
    ("deep_global_nesting", "gn >= 3", "gn", "false"),
    ("overall_function_size", "large >= 3", "large", "false"),
    ("low_cohesion", "lcom >= 3", "lcom", "false"),
]
MODULE_SQL = (
    f"WITH {FUNCTIONS}, m AS (SELECT path, sum(loc) * 2 AS loc, count(*) * 5 AS n, sum(cc) * 3 AS sum_cc, max(args) AS declarations, max(bumps) AS gc, max(nesting) AS gn, min(nesting) AS lcom, bool_or((cc >= 9 OR cogc >= 15) AND loc >= 65) AS god, count(*) FILTER (loc >= 40) AS large FROM fn GROUP BY path) "
    + " UNION ALL ".join(f"SELECT path, '{n}' AS smell, CAST({v} AS BIGINT) AS value, {a} AS alert FROM m WHERE {p}" for n, p, v, a in MODULE_RULES)
)


def module_smells(s, d):
    return M.module_findings(_modules(s, d), _functions(s, d))


def large_structs(s, d):
    sizes = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).cast("int").alias("count"))
    m = sizes.groupBy(F.col("p_brand").alias("path")).agg(F.collect_list(F.struct(F.col("p_type").alias("name"), "count")).alias("struct_fields"))
    return M.large_structs(m)


def duplicated_assertions(s, d):
    f = _functions(s, d).withColumns({"function": F.concat(F.lit("test_"), "function"), "assert_hash": F.col("asserts") * 2})
    return M.duplicated_assertions(f)


def code_lines(s, d):
    return table(s, d, "documents").select("doc_id", M.code_lines(F.col("text"), ["The", "De", "La"]).alias("code_lines"))


def _methods(s, d):
    """A customer's order is a method: its nation is the class, its segment the file."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    f = lambda m: F.concat(F.lit("g"), (k % m).cast("string"))
    foreign = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: F.struct(F.when(i % 4 == 3, F.lit("?")).otherwise(F.concat(F.lit("N"), ((F.col("c_nationkey") + 1 + (i % 2) * (k % 3)) % 25).cast("string"))).alias("recv"), F.concat(F.lit("x"), i.cast("string")).alias("field")))
    return o.select(k.alias("id"), "o_custkey", F.col("c_mktsegment").alias("file"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("class"), F.concat(F.lit("m"), (k % 97).cast("string")).alias("name"), (k % 5 + 1).alias("cc"), F.array(f(40), f(37)).alias("fields"), foreign.alias("foreign"), (k % 50 == 0).alias("is_ctor"))


METHODS = """
me AS MATERIALIZED (
  SELECT o_orderkey AS id, o_custkey AS custkey, c_mktsegment AS file, 'N' || c_nationkey AS class, c_nationkey AS nk, 'm' || o_orderkey % 97 AS name, o_orderkey % 5 + 1 AS cc, ['g' || o_orderkey % 40, 'g' || o_orderkey % 37] AS fields, o_orderkey % 50 = 0 AS is_ctor
  FROM orders JOIN customer ON o_custkey = c_custkey),
foreign_use AS (SELECT id, file, class, CASE WHEN i % 4 = 3 THEN '?' ELSE 'N' || (nk + 1 + (i % 2) * (id % 3)) % 25 END AS recv, 'x' || i AS field FROM (SELECT *, unnest(range(0, id % 9 + 1)) AS i FROM me))"""


def _calls(s, d):
    ids = table(s, d, "orders").select("o_orderkey")
    e = ids.select(F.col("o_orderkey").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("src", F.floor(F.col("src") * F.col("i") / 7).cast("long").alias("dst"))
    return e.join(ids.withColumnRenamed("o_orderkey", "dst"), "dst", "left_semi").distinct().withColumn("confidence", F.lit(3))


CALLS = """
calls AS (
  SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, CAST(floor(o_orderkey * i / 7) AS BIGINT) AS dst FROM orders, (SELECT unnest([1, 2, 3]) AS i))
  WHERE dst IN (SELECT o_orderkey FROM orders))"""


def class_metrics(s, d):
    return C.classes(_methods(s, d))


CLASSES_SQL = f"""
WITH {METHODS}, a AS (SELECT file, class, count(DISTINCT (recv, field)) AS atfd FROM foreign_use WHERE recv <> '?' GROUP BY ALL)
SELECT m.file AS file, m.class AS class, count(*) AS method_count, CAST(sum(cc) AS BIGINT) AS wmc, CAST(coalesce(any_value(atfd), 0) AS BIGINT) AS atfd, bool_and(is_ctor) AS stateless
FROM me m LEFT JOIN a ON m.file = a.file AND m.class = a.class GROUP BY m.file, m.class"""


def tight_cohesion(s, d):
    return C.tcc(_methods(s, d)).withColumn("tcc", F.round("tcc", 6))


TCC = """
plain AS (SELECT * FROM me WHERE NOT is_ctor),
tcc AS (
  SELECT n.file, n.class, CASE WHEN n > 1 THEN coalesce(met, 0) / (n * (n - 1) / 2) ELSE 0 END AS tcc
  FROM (SELECT file, class, count(*) AS n FROM plain GROUP BY ALL) n
  LEFT JOIN (SELECT a.file, a.class, count(*) AS met FROM plain a JOIN plain b ON a.file = b.file AND a.class = b.class AND a.id < b.id AND list_has_any(a.fields, b.fields) GROUP BY ALL) p ON n.file = p.file AND n.class = p.class)"""


def god_classes(s, d):
    return C.god_classes(_methods(s, d), replace(DEFAULTS.named, god_tcc=0.9)).withColumn("tcc", F.round("tcc", 6))


GOD_SQL = f"""
WITH {METHODS}, {TCC}, a AS (SELECT file, class, count(DISTINCT (recv, field)) AS atfd FROM foreign_use WHERE recv <> '?' GROUP BY ALL),
c AS (SELECT file, class, count(*) AS method_count, CAST(sum(cc) AS BIGINT) AS wmc, bool_and(is_ctor) AS stateless FROM me GROUP BY ALL)
SELECT c.file AS file, c.class AS class, method_count, wmc, atfd, round(tcc, 6) AS tcc FROM c JOIN a ON c.file = a.file AND c.class = a.class JOIN tcc t ON c.file = t.file AND c.class = t.class
WHERE method_count >= 3 AND wmc > 47 AND tcc < 0.9 AND atfd > 5 AND NOT stateless ORDER BY wmc DESC, c.file, c.class LIMIT 50"""


def feature_envy(s, d):
    return C.feature_envy(_methods(s, d), _calls(s, d), replace(DEFAULTS.named, envy_atfd=2, top=1000))


ENVY_SQL = f"""
WITH {METHODS}, {CALLS},
per AS (SELECT id, class, recv, count(*) AS n FROM foreign_use WHERE recv <> '?' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, recv) AS r, sum(n) OVER (PARTITION BY id) AS atfd FROM per),
c AS (SELECT a.id, count(*) FILTER (a.class = b.class) AS intra_calls, count(*) FILTER (a.class <> b.class) AS foreign_calls FROM calls JOIN me a ON src = a.id JOIN me b ON dst = b.id GROUP BY a.id)
SELECT t.id AS id, class, recv AS envied_class, CAST(atfd AS BIGINT) AS atfd, intra_calls, foreign_calls FROM top t JOIN c ON t.id = c.id
WHERE r = 1 AND atfd > 2 AND n / atfd >= 0.5 AND recv <> class AND foreign_calls / (foreign_calls + intra_calls) > 0.6 ORDER BY atfd DESC, t.id LIMIT 1000"""

LOW = replace(DEFAULTS.named, shotgun_classes=2, shotgun_methods=2, shotgun_fanout=2, divergent_classes=30, divergent_fanout=30, top=1000)


def shotgun_surgery(s, d):
    return C.shotgun_surgery(_methods(s, d), _calls(s, d), LOW).drop("folded")


SHOTGUN_SQL = f"""
WITH {METHODS}, {CALLS},
i AS (SELECT dst AS id, count(DISTINCT (a.file, a.class)) AS changing_classes, count(*) AS changing_methods, list_sort(list(DISTINCT src)) AS callers FROM calls JOIN me a ON src = a.id GROUP BY dst),
o AS (SELECT src AS id, count(DISTINCT dst) AS fanout FROM calls GROUP BY src)
SELECT name, min(i.id) AS id, any_value(changing_classes) AS changing_classes, any_value(changing_methods) AS changing_methods, max(fanout) AS fanout
FROM i JOIN o ON i.id = o.id JOIN me ON i.id = me.id WHERE changing_classes > 2 AND changing_methods > 2 AND fanout > 2 GROUP BY name, callers ORDER BY changing_methods DESC, min(i.id) LIMIT 1000"""


def divergent_change(s, d):
    return C.divergent_change(_methods(s, d), _calls(s, d), LOW)


DIVERGENT_SQL = f"""
WITH {METHODS}, {CALLS},
e AS (SELECT (a.file, a.class) AS a, (b.file, b.class) AS b FROM calls JOIN me a ON src = a.id JOIN me b ON dst = b.id WHERE a.file <> b.file OR a.class <> b.class),
i AS (SELECT b AS c, count(DISTINCT a) AS in_classes FROM e GROUP BY b), o AS (SELECT a AS c, count(DISTINCT b) AS out_classes FROM e GROUP BY a),
n AS (SELECT file, class, (file, class) AS c, count(*) AS methods FROM me GROUP BY ALL)
SELECT file, class, in_classes, out_classes, methods FROM n JOIN i ON n.c = i.c JOIN o ON n.c = o.c WHERE in_classes > 30 AND out_classes > 30 AND methods > 5 ORDER BY in_classes DESC, file, class LIMIT 1000"""


def call_resolution(s, d):
    m = _methods(s, d).select("id", "class", "name")
    k = F.col("o_orderkey")
    calls = table(s, d, "orders").select(
        k.alias("call"), k.alias("src"), F.when(k % 3 == 0, F.concat(F.lit("N"), (k % 25).cast("string"))).alias("receiver_type"), F.concat(F.lit("N"), (k % 24).cast("string")).alias("src_class"),
        F.when(k % 8 == 0, F.concat(F.lit("N"), (k % 23).cast("string"))).alias("hint_class"), F.concat(F.lit("m"), (k % 101).cast("string")).alias("callee"),
    )
    return C.resolve_calls(calls, m, replace(DEFAULTS.named, call_targets=20))


RESOLVE_SQL = f"""
WITH {METHODS},
c AS (
  SELECT o_orderkey AS call, CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_orderkey % 25 END AS r, 'N' || o_orderkey % 24 AS s, CASE WHEN o_orderkey % 8 = 0 THEN 'N' || o_orderkey % 23 END AS h, 'm' || o_orderkey % 101 AS callee FROM orders),
spread AS (SELECT name, count(DISTINCT class) AS classes FROM me GROUP BY name),
f AS (
  SELECT call, id, 0 AS way, 1 AS classes FROM c JOIN me ON r = class AND callee = name UNION ALL SELECT call, id, 1, 1 FROM c JOIN me ON s = class AND callee = name
  UNION ALL SELECT call, id, 2, 1 FROM c JOIN me ON h = class AND callee = name UNION ALL SELECT call, id, 3, classes FROM c JOIN me ON callee = me.name JOIN spread p ON p.name = callee WHERE classes <= 20),
b AS (SELECT call, min(way) AS best FROM f GROUP BY call)
SELECT f.call AS src, id AS dst, max(CASE WHEN way <= 1 THEN 4 WHEN way = 2 THEN 3 WHEN classes = 1 THEN 3 ELSE 2 END) AS confidence FROM f JOIN b ON f.call = b.call AND way = best GROUP BY ALL"""


def lcom4(s, d):
    return C.lcom4(_methods(s, d))


LCOM_SQL = f"""
WITH RECURSIVE {METHODS},
n AS (SELECT file, class, count(*) AS methods, count(*) FILTER (NOT is_ctor) AS plain FROM me GROUP BY ALL),
u AS (SELECT DISTINCT file, class, id, unnest(fields) AS field FROM me WHERE NOT is_ctor),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM u a JOIN u b ON a.file = b.file AND a.class = b.class AND a.field = b.field),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
g AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
k AS (SELECT file, class, count(DISTINCT root) AS parts FROM me JOIN g ON id = x GROUP BY ALL)
SELECT n.file AS file, n.class AS class, CAST(CASE WHEN methods < 3 OR plain < 2 THEN 1 ELSE parts END AS INT) AS lcom4 FROM n LEFT JOIN k ON n.file = k.file AND n.class = k.class"""


def anomalies(s, d):
    lines = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.log(F.count(F.lit(1)) + 1).alias("a"), F.avg("l_discount").alias("b"), F.log(F.sum("l_quantity") + 1).alias("c"), F.log(F.count_distinct("l_partkey") + 1).alias("e"))
    return C.anomalies(lines.withColumn("project", F.lit(1)), "l_suppkey", ["a", "b", "c", "e"], "project", replace(DEFAULTS.named, anomaly_distance=8.0)).withColumn("distance", F.round("distance", 4))


def parallel_inheritance(s, d):
    return C.parallel_inheritance(_parents(s, d))


def _parents(s, d):
    p = table(s, d, "part").select(F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("V"), (F.col("p_partkey") % 9).cast("string")).alias("class"), F.regexp_replace("p_brand", "#", "").alias("parent")).distinct()
    return p


PARALLEL_SQL = """
WITH p AS (SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') || 'V' || p_partkey % 9 AS class, replace(p_brand, '#', '') AS parent FROM part),
w AS (SELECT parent AS root, string_split(regexp_replace(class, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ') AS w FROM p),
t AS (SELECT DISTINCT root, unnest(['^' || w[1], w[-1] || '$']) AS token FROM w)
SELECT a.root AS root_a, b.root AS root_b, count(*) AS overlap FROM t a JOIN t b ON a.token = b.token AND a.root < b.root GROUP BY ALL HAVING count(*) >= 3"""


def refused_bequest(s, d):
    m = _methods(s, d).withColumn("name", F.concat(F.lit("m"), (F.col("o_custkey") % 2000).cast("string")))
    parents = s.range(25).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("class"), F.concat(F.lit("N"), ((F.col("id") + 1) % 25).cast("string")).alias("parent"), (F.col("id") % 4 != 0).alias("concrete"))
    calls = table(s, d, "part").select(F.concat(F.lit("N"), (F.col("p_partkey") % 25).cast("string")).alias("src_class"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("callee"))
    out = C.refused_bequest(m, calls, parents, replace(DEFAULTS.named, bequest_ratio=0.65))
    return out.select("class", "parent", "parent_methods", "used", "overridden", F.round("used_ratio", 6).alias("used_ratio"), F.round("override_ratio", 6).alias("override_ratio"))


BEQUEST_SQL = f"""
WITH {METHODS}, own AS (SELECT DISTINCT class, 'm' || custkey % 2000 AS name FROM me WHERE NOT is_ctor),
p AS (SELECT 'N' || i AS class, 'N' || (i + 1) % 25 AS parent FROM (SELECT unnest(range(25)) AS i) WHERE i % 4 <> 0),
given AS (SELECT p.class, p.parent, name FROM p JOIN own ON own.class = p.parent),
c AS (SELECT DISTINCT 'N' || p_partkey % 25 AS class, 'm' || p_size AS name FROM part),
r AS (SELECT g.class, g.parent, count(*) AS parent_methods, count(*) FILTER ((g.class, g.name) IN (SELECT (class, name) FROM own) OR (g.class, g.name) IN (SELECT (class, name) FROM c)) AS used, count(*) FILTER ((g.class, g.name) IN (SELECT (class, name) FROM own)) AS overridden FROM given g GROUP BY ALL)
SELECT class, parent, parent_methods, used, overridden, round(used / parent_methods, 6) AS used_ratio, round(overridden / parent_methods, 6) AS override_ratio FROM r WHERE parent_methods >= 3 AND used / parent_methods < 0.65"""


def _declared(s, d):
    return table(s, d, "part").select(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("-"), (F.col("p_partkey") % 13).cast("string")).alias("name"), F.when(F.col("p_size") % 3 == 0, "test").otherwise("deploy").alias("scope"), (F.col("p_size") == 50).alias("own")).distinct()


def _imports(s, d):
    return table(s, d, "part").filter("p_retailprice > 950").select(F.initcap(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("_"), (F.col("p_partkey") % 11).cast("string"))).alias("name")).distinct()


DEPS = """
declared AS (SELECT DISTINCT replace(p_name, ' ', '_') || '-' || p_partkey % 13 AS name, CASE WHEN p_size % 3 = 0 THEN 'test' ELSE 'deploy' END AS scope, p_size = 50 AS own FROM part),
imported AS (SELECT DISTINCT lower(replace(replace(p_name, ' ', '-') || '_' || p_partkey % 11, '_', '-')) AS name FROM part WHERE p_retailprice > 950)"""


def bloated_dependencies(s, d):
    mentions = table(s, d, "part").filter("p_size = 7").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-3")).alias("name"))
    return D.bloated(_declared(s, d), _imports(s, d), mentions)


BLOATED_SQL = f"WITH {DEPS} SELECT name, scope, own FROM declared WHERE scope = 'deploy' AND NOT own AND replace(lower(name), '_', '-') NOT IN (FROM imported) AND replace(lower(name), '_', '-') NOT IN (SELECT replace(lower(replace(p_name, ' ', '-') || '-3'), '_', '-') FROM part WHERE p_size = 7)"


def phantom_dependencies(s, d):
    locked = table(s, d, "part").filter("p_size > 10").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), (F.col("p_partkey") % 11).cast("string")).alias("name"))
    stdlib = table(s, d, "part").filter("p_size = 11").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-1")).alias("name"))
    return D.phantom(_imports(s, d), _declared(s, d).filter("name like '%-3' or name like '%-7'"), locked, stdlib)


PHANTOM_SQL = f"""
WITH {DEPS}
SELECT name FROM imported WHERE name NOT IN (SELECT replace(lower(name), '_', '-') FROM declared WHERE name LIKE '%-3' OR name LIKE '%-7') AND name NOT IN (SELECT replace(lower(replace(p_name, ' ', '-') || '-1'), '_', '-') FROM part WHERE p_size = 11)
  AND name IN (SELECT replace(lower(replace(p_name, ' ', '-') || '-' || p_partkey % 11), '_', '-') FROM part WHERE p_size > 10)"""


def module_by_prefix(s, d):
    targets = table(s, d, "part").select(F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("target")).distinct()
    modules = table(s, d, "part").filter("p_size % 5 = 0").select(F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.col("p_size").cast("string")).alias("module")).union(s.sql("select 'Brand1'"))
    return D.by_prefix(targets, modules)


PREFIX_SQL = """
WITH m AS (SELECT DISTINCT replace(p_brand, '#', '') || '/' || p_size AS module FROM part WHERE p_size % 5 = 0 UNION SELECT 'Brand1'),
t AS (SELECT DISTINCT replace(p_brand, '#', '') || '/' || p_size || '/' || p_partkey AS target FROM part)
SELECT target, module FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY length(module) DESC) AS r FROM t JOIN m ON target = module OR starts_with(target, module || '/')) WHERE r = 1"""


def import_resolution(s, d):
    p = table(s, d, "part")
    files = p.filter("p_size % 2 = 0").select(F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.concat(F.col("p_size").cast("string"), F.lit(".py"))).alias("path")).distinct()
    target = F.concat((F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit(".py"))
    c = p.select(F.col("p_partkey").alias("src"), target.alias("target"), F.explode(F.array(F.struct(F.lit(0).alias("priority"), F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), target).alias("candidate")), F.struct(F.lit(1).alias("priority"), F.concat(F.lit("Brand3/"), target).alias("candidate")))).alias("c")).select("src", "target", "c.*")
    return D.resolve_imports(c, files)


IMPORT_SQL = """
WITH f AS (SELECT DISTINCT replace(p_brand, '#', '') || '/' || p_size || '.py' AS path FROM part WHERE p_size % 2 = 0),
c AS (SELECT p_partkey AS src, replace(p_brand, '#', '') AS b, (p_size + p_partkey % 2) || '.py' AS target FROM part)
SELECT src, dst FROM (
  SELECT src, coalesce((SELECT path FROM f WHERE path = b || '/' || target), (SELECT path FROM f WHERE path = 'Brand3/' || target), (SELECT min(path) FROM f WHERE ends_with(path, '/' || target))) AS dst FROM c) WHERE dst IS NOT NULL"""


def constraint_smells(s, d):
    p = table(s, d, "part")
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 5).cast("string"))
    declared = p.select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") % 4 == 0, "*").when(F.col("p_size") % 4 == 1, F.concat(F.lit("=="), version)).otherwise(F.concat(F.lit("^"), version)).alias("constraint"))
    locked = p.select(F.col("p_partkey").cast("string").alias("name"), F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 4).cast("string")).alias("version"))
    return D.constraint_smells(declared, locked, True)


CONSTRAINT_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS name, 'wildcard' AS kind FROM part WHERE p_size % 4 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'pin_differs_from_lock' FROM part WHERE p_size % 4 = 1 AND p_partkey % 5 <> p_partkey % 4"""


def _versions(s, d):
    return table(s, d, "orders").select((F.col("o_custkey") % 300).cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("version"), F.when(F.col("o_orderkey") % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("").alias("published"), (F.col("o_orderkey") % 13 == 5).alias("is_default"))


def dependency_freshness(s, d):
    locked = _versions(s, d).groupBy("name").agg(F.min("version").alias("version"))
    return D.freshness(locked, _versions(s, d), "1999-06-01T00:00:00Z")


FRESH_SQL = """
WITH v AS (SELECT CAST(o_custkey % 300 AS VARCHAR) AS name, CAST(o_orderkey AS VARCHAR) AS version, CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS published, o_orderkey % 13 = 5 AS is_default FROM orders),
l AS (SELECT name, min(version) AS version FROM v GROUP BY name),
m AS (SELECT l.name, l.version, v.published AS since FROM l JOIN v ON l.name = v.name AND l.version = v.version),
y AS (SELECT name, coalesce(max(published) FILTER (is_default), max(published) FILTER (published <> '')) AS latest FROM v GROUP BY name),
x AS (SELECT m.name, m.version, count(*) FILTER (v.published <> '' AND since <> '' AND v.published > since) AS missed FROM m JOIN v ON m.name = v.name GROUP BY ALL),
z AS (SELECT x.*, latest, 1999 - TRY_CAST(latest[1:4] AS INT) AS years FROM x JOIN y ON x.name = y.name WHERE latest IS NOT NULL)
SELECT name, version, missed, latest, years FROM z WHERE missed >= 5 OR years >= 2 ORDER BY missed DESC, name LIMIT 30"""


def vulnerable_dependencies(s, d):
    locked = _versions(s, d).select("name", "version")
    adv = table(s, d, "orders").filter("o_totalprice > 200000").select((F.col("o_custkey") % 300).cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("version"), F.concat(F.lit("A-"), F.col("o_orderkey").cast("string")).alias("advisory"))
    return D.vulnerable(locked, adv, s.range(0, 300, 7).select(F.col("id").cast("string").alias("name")))


VULNERABLE_SQL = "SELECT CAST(o_custkey % 300 AS VARCHAR) AS name, CAST(o_orderkey AS VARCHAR) AS version, 'A-' || o_orderkey AS advisory, (o_custkey % 300) % 7 = 0 AS reachable FROM orders WHERE o_totalprice > 200000"


def cross_validation(s, d):
    f = table(s, d, "part").select(F.col("p_brand").alias("file"), "p_partkey", (F.col("p_size") % 5).alias("confidence"))
    return D.cross_validated(f, table(s, d, "part").filter("p_size = 9 and p_partkey % 3 = 0").select(F.col("p_brand").alias("file")))


def suppression(s, d):
    f = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("category"), F.col("p_name").alias("snippet"))
    return D.suppressed(f, ["Brand#3", "Brand#4"], ["ECONOMY"], ["*o*red*"]).select("p_partkey")


SUPPRESSION_SQL = "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#4') AND NOT (p_size > 9 AND p_type = 'ECONOMY') AND NOT regexp_full_match(p_name, '.*o.*red.*')"


def ignored_paths(s, d):
    path = F.concat_ws("/", F.split("url", "/")[2], F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""))
    return table(s, d, "pages").select("page_id", P.ignored(path, ["*.com/en", "**/7*"]).alias("ignored"))


IGNORED_SQL = r"""
WITH p AS (SELECT page_id, string_split(url, '/')[3] || '/' || regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path FROM pages)
SELECT page_id, regexp_matches(path, '^[^/]*\.com/en(?:/.*)?$') OR regexp_matches(path, '^(?:.*/)?7[^/]*(?:/.*)?$') AS ignored FROM p"""

NAMES = ["test_a.py", "tests.py", "conftest.py", "contest.py", "a_test.go", "b.spec.ts", "UserTest.java", "Latest.java", "Test_x.c", "test-y.R", "spec_z.lua", "run_Tests.cs", "q.e2e.js", "IT.java", "test_k.rs", "m_specs.rb", "OtherSpecs.kt", "plain.tcl"]


def test_paths(s, d):
    """Paths of pages with names of many habits."""
    names = F.array(*[F.lit(x) for x in NAMES])
    path = F.concat(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), F.when(F.col("page_id") % 17 == 3, "/Tests/").when(F.col("page_id") % 17 == 5, "/contests/").when(F.col("page_id") % 17 == 9, "\\spec\\").otherwise("/"), F.get(names, (F.col("page_id") % len(NAMES)).cast("int")))
    return table(s, d, "pages").select("page_id", path.alias("path"), P.is_test(path).alias("is_test"))


TEST_SQL = f"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') || CASE page_id % 17 WHEN 3 THEN '/Tests/' WHEN 5 THEN '/contests/' WHEN 9 THEN '\\spec\\' ELSE '/' END || {NAMES}[page_id % {len(NAMES)} + 1] AS path FROM pages),
n AS (SELECT *, replace(path, '\\', '/') AS q FROM p),
k AS (SELECT *, string_split(q, '/')[-1] AS name FROM n),
m AS (SELECT *, string_split(name, '.')[-1] AS ext, regexp_replace(name, '[.][^.]*$', '') AS stem FROM k)
SELECT page_id, path,
  len(list_intersect(string_split(q, '/')[:-2], ['tests', 'test', '__tests__', 'spec', 'specs', 'Tests', 'Test', 'Spec', 'Specs'])) > 0
  OR len(list_filter(['_test.', '.test.', '_tests.', '.tests.', '_spec.', '.spec.', '_specs.', '.specs.', '.e2e.', '.cy.'], lambda x: contains(name, x))) > 0
  OR ext = 'py' AND (starts_with(stem, 'test_') OR stem IN ('tests', 'conftest')) OR ext = 'c' AND lower(stem[1:1]) || stem[2:5] = 'test_' OR ext = 'R' AND stem[1:5] IN ('test-', 'test_') OR ext = 'lua' AND stem[1:5] IN ('test_', 'spec_')
  OR ext IN ('java', 'cs', 'kt') AND regexp_matches(stem, '(^|[A-Za-z0-9])(Tests|Test|Specs|Spec)$') AS is_test
FROM m"""

QUERIES = {
    "test_paths": (test_paths, TEST_SQL),
    "function_smells": (function_smells, f"WITH {FINDINGS} SELECT * FROM findings"),
    "subsumed_smells": (subsumed_smells, SUBSUMED_SQL),
    "edit_range_smells": (edit_range_smells, EDIT_SQL),
    "module_smells": (module_smells, MODULE_SQL),
    "large_structs": (large_structs, "SELECT p_brand AS path, p_type AS struct, CAST(count(*) AS INT) AS fields FROM part GROUP BY ALL HAVING count(*) > 12"),
    "duplicated_assertions": (duplicated_assertions, f"WITH {FUNCTIONS} SELECT path, asserts * 2 AS assert_hash, count(*) AS members FROM fn WHERE asserts >= 6 GROUP BY ALL HAVING count(*) >= 2"),
    "code_lines": (code_lines, "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT (starts_with(ltrim(x), 'The') OR starts_with(ltrim(x), 'De') OR starts_with(ltrim(x), 'La')))) AS BIGINT) AS code_lines FROM documents"),
    "class_metrics": (class_metrics, CLASSES_SQL),
    "tight_cohesion": (tight_cohesion, f"WITH {METHODS}, {TCC} SELECT file, class, round(tcc, 6) AS tcc FROM tcc"),
    "god_classes": (god_classes, GOD_SQL),
    "feature_envy": (feature_envy, ENVY_SQL),
    "shotgun_surgery": (shotgun_surgery, SHOTGUN_SQL),
    "divergent_change": (divergent_change, DIVERGENT_SQL),
    "call_resolution": (call_resolution, RESOLVE_SQL),
    "lcom4": (lcom4, LCOM_SQL),
    "anomalous_classes": (anomalies, None),
    "parallel_inheritance": (parallel_inheritance, PARALLEL_SQL),
    "refused_bequest": (refused_bequest, BEQUEST_SQL),
    "bloated_dependencies": (bloated_dependencies, BLOATED_SQL),
    "phantom_dependencies": (phantom_dependencies, PHANTOM_SQL),
    "module_by_prefix": (module_by_prefix, PREFIX_SQL),
    "import_resolution": (import_resolution, IMPORT_SQL),
    "constraint_smells": (constraint_smells, CONSTRAINT_SQL),
    "dependency_freshness": (dependency_freshness, FRESH_SQL),
    "vulnerable_dependencies": (vulnerable_dependencies, VULNERABLE_SQL),
    "cross_validation": (cross_validation, "SELECT p_brand AS file, p_partkey, CASE WHEN p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 9 AND p_partkey % 3 = 0) THEN least(p_size % 5, 2) WHEN p_size % 5 >= 3 THEN 4 ELSE p_size % 5 END AS confidence FROM part"),
    "suppression": (suppression, SUPPRESSION_SQL),
    "ignored_paths": (ignored_paths, IGNORED_SQL),
}
