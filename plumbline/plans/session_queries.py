"""Session operators over the events of users: a user is a session, an event's type its smell or path."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import session_state as S
from plumbline.plans.bindings import table


def _events(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("path"), "ts", F.col("event_id").alias("seq"), "value", (F.col("event_id") % 40).alias("hash"))


def first_touch(s, d):
    return S.first_touch(_events(s, d)).select("session", "path", "seq")


def edit_checkpoints(s, d):
    return S.edit_counts(_events(s, d)).select("session", "path", "seq", "edit", "checkpoint")


CHECK_SQL = """
WITH e AS (SELECT user_id AS session, event_type AS path, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS edit FROM events)
SELECT *, CASE WHEN edit <= 2 THEN edit % 2 = 0 ELSE edit % 5 = 0 END AS checkpoint FROM e"""


def _findings(s, d, keep):
    e = _events(s, d).filter(keep)
    return e.groupBy("session", "path", F.concat(F.lit("s"), (F.col("seq") % 3).cast("string")).alias("smell")).agg(F.count(F.lit(1)).alias("n"))


def module_regressions(s, d):
    return S.module_regressions(_findings(s, d, "value > 20"), _findings(s, d, "value <= 20"))


REGRESS_SQL = """
WITH f AS (SELECT user_id AS session, event_type AS path, 's' || event_id % 3 AS smell, count(*) FILTER (value > 20) AS n, count(*) FILTER (value <= 20) AS base FROM events GROUP BY ALL)
SELECT * FROM f WHERE n > base"""


def _magnitudes(s, d, keep):
    smell = F.element_at(F.array(*[F.lit(x) for x in ["god_method", "complex_method", "large_method", "short_variable_names"]]), (F.col("seq") % 4 + 1).cast("int"))
    e = _events(s, d).filter(keep)
    return e.groupBy("session", "path", F.concat(F.lit("f"), (F.col("seq") % 5).cast("string")).alias("function"), smell.alias("smell")).agg(F.max(F.round("value").cast("long")).alias("m1"), F.max("seq").alias("m2"), F.lit(0).alias("m3"), F.count(F.lit(1)).alias("n"), (F.max("hash") % 4).alias("hash"))


def worsened(s, d):
    now, base = _magnitudes(s, d, "seq % 2 = 0"), _magnitudes(s, d, "seq % 2 = 1 and seq % 5 <> 3")
    return S.worsened(now, base, now.select("session", "path", "function")).select("session", "path", "function", "smell", "m1", "n")


WORSENED_SQL = """
WITH e AS (SELECT user_id AS session, event_type AS path, 'f' || event_id % 5 AS function, ['god_method', 'complex_method', 'large_method', 'short_variable_names'][event_id % 4 + 1] AS smell, event_id AS seq, CAST(round_even(value, 0) AS BIGINT) AS v, event_id % 40 AS h, CAST(round(value) AS BIGINT) AS r FROM events),
now_ AS (SELECT session, path, function, smell, max(r) AS m1, max(seq) AS m2, count(*) AS n, max(h) % 4 AS hash FROM e WHERE seq % 2 = 0 GROUP BY ALL),
base AS (SELECT session, path, function, smell, max(r) AS m1, max(seq) AS m2, count(*) AS n, max(h) % 4 AS hash FROM e WHERE seq % 2 = 1 AND seq % 5 <> 3 GROUP BY ALL),
c AS (
  SELECT a.session, a.path, a.function, a.smell, b.function AS bf, b.m1 AS b1, b.m2 AS b2, b.n AS bn,
    CASE WHEN b.smell = a.smell THEN 0 ELSE list_position(['god_method', 'complex_method', 'large_method'], b.smell) * 2 END + CASE WHEN a.function = b.function THEN 0 ELSE 1 END AS way
  FROM now_ a JOIN base b ON a.session = b.session AND a.path = b.path AND (a.smell = b.smell OR (a.smell <> 'short_variable_names' AND b.smell <> 'short_variable_names'))
    AND (a.function = b.function OR (a.hash = b.hash AND a.hash <> 0 AND NOT EXISTS (SELECT 1 FROM now_ x WHERE x.session = b.session AND x.path = b.path AND x.function = b.function)))),
r AS (SELECT *, row_number() OVER (PARTITION BY session, path, function, smell ORDER BY way, bf) AS k FROM c)
SELECT a.session AS session, a.path AS path, a.function AS function, a.smell AS smell, a.m1 AS m1, a.n AS n
FROM now_ a LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON a.session = r.session AND a.path = r.path AND a.function = r.function AND a.smell = r.smell
WHERE r.session IS NULL OR a.m1 > b1 OR a.m2 > b2 OR a.n > bn"""


def session_clones(s, d):
    e = _events(s, d).withColumn("function", F.concat(F.lit("f"), (F.col("seq") % 7).cast("string")))
    return S.session_clones(e)


CLONES_SQL = """
WITH e AS (SELECT user_id AS session, event_type AS path, ts, event_id AS seq, event_id % 40 AS hash, 'f' || event_id % 7 AS function FROM events WHERE event_id % 40 <> 0),
first_ AS (SELECT session, hash, path AS other_path, min((ts, seq)) AS f FROM e GROUP BY ALL),
m AS (SELECT e.session, e.path, function, other_path, f, row_number() OVER (PARTITION BY e.session, e.path, function ORDER BY f) AS k FROM e JOIN first_ x ON e.session = x.session AND e.hash = x.hash AND e.path <> other_path AND f < (e.ts, e.seq))
SELECT session, path, function, other_path FROM m WHERE k = 1"""


def hallucinated_imports(s, d):
    e = _events(s, d).select("session", F.concat(F.col("path"), F.lit("-"), (F.col("seq") % 50).cast("string")).alias("root")).distinct()
    types = table(s, d, "events").select("event_type").distinct()
    known = [types.select(F.concat("event_type", F.lit(f"-{k}")).alias("root")) for k in (1, 7, 20)]
    return S.hallucinated_imports(e, known)


def unused_added(s, d):
    docs = table(s, d, "documents")
    added = docs.select("doc_id", F.regexp_extract("text", r"^([A-Za-z0-9_]+)", 1).alias("name"), ).filter("name <> ''")
    return S.unused_added(added, docs.select("text"))


UNUSED_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract(text, '^([A-Za-z0-9_]+)', 1) AS name FROM documents),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS word FROM documents) GROUP BY word)
SELECT doc_id, name FROM a JOIN w ON name = word WHERE name <> '' AND n = 1"""


def turn_backstop(s, d):
    e = _events(s, d)
    changed = e.select("session", F.concat("path", (F.col("seq") % 300).cast("string")).alias("path")).distinct()
    checked = e.select("session", F.concat("path", (F.col("seq") % 7).cast("string")).alias("path")).distinct()
    return S.backstop(changed, checked, 10)


BACKSTOP_SQL = """
WITH c AS (SELECT DISTINCT user_id AS session, event_type || event_id % 300 AS path FROM events EXCEPT SELECT DISTINCT user_id, event_type || event_id % 7 FROM events)
SELECT session, path FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY path) AS k FROM c) WHERE k <= 10"""


def finding_outcomes(s, d):
    e = _events(s, d).withColumns({"path": F.col("session"), "function": F.concat(F.lit("f"), (F.col("seq") % 9).cast("string")), "smell": F.col("path")})
    final = e.filter("value > 60")
    funcs = e.filter("seq % 6 = 1").select("path", "function", F.col("hash"))
    return S.outcomes(e.select("path", "function", "smell", (F.col("hash") * F.col("path") % 997).alias("hash"), "ts", "seq"), final, funcs)


OUTCOME_SQL = """
WITH e AS (SELECT user_id AS path, 'f' || event_id % 9 AS function, event_type AS smell, (event_id % 40) * user_id % 997 AS hash, ts, event_id AS seq, value, event_id % 40 AS h FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, function, smell ORDER BY ts, seq) AS k FROM e) WHERE k = 1),
fn AS (SELECT DISTINCT path, function, h FROM e WHERE seq % 6 = 1)
SELECT path, function, smell, CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.value > 60 AND x.path = f.path AND x.function = f.function AND x.smell = f.smell) THEN 'ignored'
  WHEN EXISTS (SELECT 1 FROM fn WHERE fn.path = f.path AND fn.function = f.function) THEN 'addressed' WHEN f.hash IN (SELECT h FROM fn) THEN 'moved' ELSE 'removed' END AS outcome FROM f"""


def redistributed_bodies(s, d):
    lines = table(s, d, "lineitem")
    return S.redistributed(lines.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("line")), lines.filter("l_orderkey % 2 = 1 and l_quantity > 45").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("line"))).withColumn("matched", F.round("matched", 6))


REDIST_SQL = """
WITH a AS (SELECT l_orderkey AS id, l_partkey AS line, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_partkey AS line, count(*) AS m FROM lineitem WHERE l_orderkey % 2 = 1 AND l_quantity > 45 GROUP BY ALL)
SELECT id, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS matched FROM a LEFT JOIN b ON a.line = b.line GROUP BY id HAVING sum(least(n, coalesce(m, 0))) / sum(n) >= 0.8"""


def ordered_taint(s, d):
    e = _events(s, d)
    out = S.last_value_taint(e, "session", F.col("path") == "error", F.col("path") == "view", F.col("path") == "purchase")
    return out.select("session", "seq")


TAINT_SQL = """
WITH e AS (SELECT user_id AS session, event_id AS seq, event_type, last_value(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM events)
SELECT session, seq FROM e WHERE event_type = 'purchase' AND state = 1"""

QUERIES = {
    "first_touch": (first_touch, "SELECT session, path, seq FROM (SELECT user_id AS session, event_type AS path, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1"),
    "edit_checkpoints": (edit_checkpoints, CHECK_SQL),
    "module_regressions": (module_regressions, REGRESS_SQL),
    "worsened_findings": (worsened, WORSENED_SQL),
    "session_clones": (session_clones, CLONES_SQL),
    "hallucinated_imports": (hallucinated_imports, "SELECT DISTINCT user_id AS session, event_type || '-' || event_id % 50 AS root FROM events WHERE event_id % 50 NOT IN (1, 7, 20)"),
    "unused_added": (unused_added, UNUSED_SQL),
    "turn_backstop": (turn_backstop, BACKSTOP_SQL),
    "finding_outcomes": (finding_outcomes, OUTCOME_SQL),
    "redistributed_bodies": (redistributed_bodies, REDIST_SQL),
    "ordered_taint": (ordered_taint, TAINT_SQL),
}
