"""Statistics, clones and text operators over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.operators import clones as C
from plumbline.operators import stats as S
from plumbline.operators import text as T
from plumbline.plans.bindings import table
from plumbline.session import written

KEYS = ["l_returnflag", "l_linestatus"]
#: 15 hexadecimal digits of an MD5 as a number, the same in Spark and SQL.
MD5 = "cast(conv(substr(md5({0}), 1, 15), 16, 10) as bigint)"


def _metrics(s, d):
    lines = table(s, d, "lineitem")
    return lines.select(*KEYS, F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.col("l_linenumber").cast("long").alias("line"))


HIST = """
long AS (
  SELECT l_returnflag, l_linestatus, 'quantity' AS metric, CAST(l_quantity AS BIGINT) AS value FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'discount', CAST(round(l_discount * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'line', CAST(l_linenumber AS BIGINT) FROM lineitem),
hist AS (SELECT l_returnflag, l_linestatus, metric, value, count(*) AS n FROM long GROUP BY ALL)"""


def metric_histogram(s, d):
    return S.histogram(_metrics(s, d), KEYS, ["quantity", "discount", "line"]).select(*KEYS, "metric", "value", "n", "weight")


def metric_quantiles(s, d):
    return S.quantiles(S.histogram(_metrics(s, d), KEYS, ["quantity", "discount", "line"]), [*KEYS, "metric"])


QUANTILES_SQL = f"""
WITH {HIST},
mass AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus, metric ORDER BY value) AS upto, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus, metric) AS total FROM hist),
probes AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999])::DOUBLE AS p)
SELECT l_returnflag, l_linestatus, metric, p, min(value) AS v FROM mass, probes WHERE upto >= p * total GROUP BY ALL"""


def weighted_quantiles(s, d):
    lines = table(s, d, "lineitem").select(*KEYS, F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("w"))
    return S.quantiles(S.histogram(lines, KEYS, ["line"], F.col("w")), [*KEYS, "metric"], (0.5, 0.75, 0.95), "weight")


WEIGHTED_SQL = """
WITH hist AS (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS value, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
mass AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY value) AS upto, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM hist),
probes AS (SELECT unnest([0.5, 0.75, 0.95])::DOUBLE AS p)
SELECT l_returnflag, l_linestatus, 'line' AS metric, p, min(value) AS v FROM mass, probes WHERE upto >= p * total GROUP BY ALL"""


def firing_rates(s, d):
    out = S.firing_rate(S.histogram(_metrics(s, d), KEYS, ["quantity"]), [*KEYS, "metric"], F.lit(38))
    return out.select(*KEYS, F.round("cdf", 6).alias("cdf"), F.round("firing_rate", 6).alias("firing_rate"))


def interpolated_prior(s, d):
    probes = S.quantiles(S.histogram(_metrics(s, d), KEYS, ["quantity"]), [*KEYS, "metric"])
    return S.interpolate(probes, KEYS, 0.85).select(*KEYS, F.round("value", 6).alias("value"))


INTERPOLATED_SQL = f"""
WITH {HIST},
mass AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY value) AS upto, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM hist WHERE metric = 'quantity'),
q AS (SELECT l_returnflag, l_linestatus, min(value) FILTER (upto >= 0.75 * total) AS lo, min(value) FILTER (upto >= 0.9 * total) AS hi FROM mass GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(lo + (0.85 - 0.75) / (0.9 - 0.75) * (hi - lo), 6) AS value FROM q"""


def threshold_estimate(s, d):
    metric = F.concat("l_returnflag", "l_linestatus")
    corpus = S.quantiles(S.histogram(_metrics(s, d), KEYS, ["quantity"]), KEYS, (0.75, 0.95)).groupBy(metric.alias("metric")).agg(F.max(F.when(F.col("p") == 0.75, F.col("v"))).alias("p75"), F.max(F.when(F.col("p") == 0.95, F.col("v"))).alias("p95"))
    editorial = table(s, d, "lineitem").select(metric.alias("metric")).distinct().select("metric", (F.ascii("metric") - 40).cast("long").alias("warning"), F.lit(41).cast("long").alias("alert"))
    return S.estimate(corpus, editorial)


ESTIMATE_SQL = f"""
WITH {HIST},
mass AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY value) AS upto, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM hist WHERE metric = 'quantity'),
q AS (SELECT l_returnflag || l_linestatus AS metric, min(value) FILTER (upto >= 0.75 * total) AS p75, min(value) FILTER (upto >= 0.95 * total) AS p95 FROM mass GROUP BY ALL),
w AS (SELECT metric, greatest(ascii(metric) - 40, p75) AS warning, p95 FROM q)
SELECT metric, CAST(warning AS BIGINT) AS warning, CAST(greatest(41, p95, warning + 1) AS BIGINT) AS alert FROM w"""


def intensity_ranking(s, d):
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    out = S.rank_by_intensity(rows, {"size": (20.0, 45.0), "price": (950.0, 990.0)}, ["p_partkey"])
    return out.select("p_partkey", F.round("intensity", 6).alias("intensity"))


INTENSITY_SQL = """
WITH x AS (SELECT p_partkey, CASE WHEN p_size >= 20 THEN greatest(0, least(10, (p_size - 20) / 25.0 * 10)) END AS a, CASE WHEN p_retailprice >= 950 THEN greatest(0, least(10, (p_retailprice - 950) / 40.0 * 10)) END AS b FROM part)
SELECT p_partkey, round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) AS intensity FROM x WHERE a IS NOT NULL OR b IS NOT NULL"""


def upper_medians(s, d):
    return S.upper_median(_metrics(s, d), KEYS, "quantity").join(S.mid_median(_metrics(s, d), KEYS, "quantity"), KEYS)


UPPER_SQL = """
WITH v AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_returnflag, l_linestatus, list_sort(list(q))[count(*) // 2 + 1] AS upper_median, CAST(median(q) AS DOUBLE) AS mid_median FROM v GROUP BY ALL"""


def god_percentile(s, d):
    return S.linear_percentile(table(s, d, "part"), ["p_brand"], "p_size", 0.9).withColumn("percentile", F.round("percentile", 6))


def robust_z(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"))
    out = S.robust_z(rows, ["lang"], ["chars", "words"])
    return out.select("doc_id", "lang", F.round("z_chars", 6).alias("z_chars"), F.round("z_words", 6).alias("z_words"))


ROBUST_SQL = """
WITH r AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words FROM documents),
m AS (SELECT lang, median(chars) AS mc, median(words) AS mw FROM r GROUP BY lang),
d AS (SELECT r.lang, any_value(mc) AS mc, any_value(mw) AS mw, median(abs(chars - mc)) AS dc, median(abs(words - mw)) AS dw FROM r JOIN m ON r.lang = m.lang GROUP BY r.lang)
SELECT doc_id, r.lang AS lang, round(CASE WHEN dc > 0 THEN 0.6745 * abs(chars - mc) / dc ELSE 0 END, 6) AS z_chars, round(CASE WHEN dw > 0 THEN 0.6745 * abs(words - mw) / dw ELSE 0 END, 6) AS z_words
FROM r JOIN d ON r.lang = d.lang"""


def _kinds(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def kl_to_median(s, d):
    return S.kl_to_median(_kinds(s, d)).withColumn("kl_to_median", F.round("kl_to_median", 6))


KL_SQL = """
WITH h AS (SELECT l_suppkey AS id, l_returnflag || l_linenumber AS kind, count(*) AS n FROM lineitem GROUP BY ALL),
ids AS (SELECT DISTINCT id FROM h), kinds AS (SELECT DISTINCT kind FROM h),
g AS (SELECT i.id, k.kind, coalesce(h.n, 0) AS n FROM ids i CROSS JOIN kinds k LEFT JOIN h ON h.id = i.id AND h.kind = k.kind),
med AS (SELECT kind, list_sort(list(n))[count(*) // 2 + 1] AS m FROM g GROUP BY kind),
t AS (SELECT id, sum(n) AS total FROM g GROUP BY id), ms AS (SELECT sum(m) AS ms, count(*) AS k FROM med)
SELECT g.id, round(sum((n + 1) / (total + k) * ln(((n + 1) / (total + k)) / ((m + 1) / (ms + k)))), 6) AS kl_to_median
FROM g JOIN med ON g.kind = med.kind JOIN t ON g.id = t.id CROSS JOIN ms GROUP BY g.id"""


def vendored_files(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.length("text") / F.size(F.split("text", " "))).alias("mean"))
    return S.vendored(rows, ["words", "lines", "mean"], ["lang"]).select("doc_id", "features_failed")


VENDORED_SQL = """
WITH r AS (SELECT doc_id, lang, CAST(len(string_split(text, ' ')) AS DOUBLE) AS a, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS b, length(text) / len(string_split(text, ' ')) AS c FROM documents WHERE strlen(text) >= 200),
m AS (SELECT lang, median(a) AS ma, median(b) AS mb, median(c) AS mc FROM r GROUP BY lang),
x AS (SELECT r.lang, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, median(abs(a - ma)) AS da, median(abs(b - mb)) AS db, median(abs(c - mc)) AS dc FROM r JOIN m ON r.lang = m.lang GROUP BY r.lang),
f AS (SELECT doc_id, (da > 0 AND 0.6745 * abs(a - ma) / da >= 3)::INT + (db > 0 AND 0.6745 * abs(b - mb) / db >= 3)::INT + (dc > 0 AND 0.6745 * abs(c - mc) / dc >= 3)::INT AS features_failed FROM r JOIN x ON r.lang = x.lang)
SELECT doc_id, features_failed FROM f WHERE features_failed >= 2"""


def locality_entropy(s, d):
    return S.locality_entropy(table(s, d, "lineitem"), "l_partkey", "l_suppkey").withColumn("locality_entropy", F.round("locality_entropy", 6))


LOCALITY_SQL = """
WITH o AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_partkey, sum(n) AS total FROM o GROUP BY ALL)
SELECT o.l_partkey AS l_partkey, round(abs(sum(-(n / total) * log2(n / total))), 6) AS locality_entropy FROM o JOIN t ON o.l_partkey = t.l_partkey GROUP BY o.l_partkey"""


def exact_clones(s, d):
    docs = table(s, d, "documents")
    rows = docs.select(F.col("source").alias("path"), F.lit("f").alias("name"), F.expr(MD5.format("lower(trim(text))")).alias("structural_hash"), F.size(F.split("text", " ")).alias("loc"), F.lit(3).alias("distinct_kinds"))
    return C.exact_groups(rows).select("path", "members", "min_loc", "max_loc", F.col("structural_hash"))


EXACT_SQL = """
SELECT source AS path, count(*) AS members, CAST(min(len(string_split(text, ' '))) AS INT) AS min_loc, CAST(max(len(string_split(text, ' '))) AS INT) AS max_loc, ('0x' || substr(md5(lower(trim(text))), 1, 15))::BIGINT AS structural_hash
FROM documents WHERE len(string_split(text, ' ')) >= 6 GROUP BY source, md5(lower(trim(text))) HAVING count(*) >= 2"""


def _tokens(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("w"))
    return docs.select("id", F.explode("w").alias("token"))


def token_simhash(s, d):
    return C.token_simhash(_tokens(s, d), F.expr(MD5.format("token")))


SIMHASH_SQL = (
    "WITH t AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS token FROM documents), h AS (SELECT id, ('0x' || substr(md5(token), 1, 15))::BIGINT AS h FROM t) SELECT id, CAST("
    + " + ".join(f"(CASE WHEN sum((h >> {k}) & 1) * 2 > count(*) THEN {1 << k}::BIGINT ELSE 0 END)" for k in range(60))
    + " AS BIGINT) AS word FROM h GROUP BY id"
)


def _items(s, d):
    words = C.token_simhash(_tokens(s, d), F.expr(MD5.format("token")))
    loc = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.size(F.split("text", " ")).alias("loc"))
    return written(words.join(loc, "id"), "items")


def near_duplicate_pairs(s, d):
    return C.near_pairs(_items(s, d))


NEAR_SQL = f"""
WITH words AS ({SIMHASH_SQL}),
items AS (SELECT id, word, CAST(len(string_split(text, ' ')) AS INT) AS loc FROM words JOIN documents ON id = doc_id WHERE len(string_split(text, ' ')) >= 6)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.word, b.word)) AS INT) AS distance
FROM items a JOIN items b ON a.id < b.id AND greatest(a.loc, b.loc) * 100 <= least(a.loc, b.loc) * 130
WHERE bit_count(xor(a.word, b.word)) <= least(12, 7 + (least(a.loc, b.loc) - 6) // 3)"""


def clone_clusters(s, d):
    return C.clusters(_items(s, d))


CLUSTERS_SQL = f"""
WITH RECURSIVE pairs AS ({NEAR_SQL.strip()}),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS seen FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT id, min(seen) AS cluster FROM reach GROUP BY id"""


def vulnerable_siblings(s, d):
    lines = table(s, d, "lineitem")
    members = lines.select((F.col("l_partkey") % 100).alias("cluster"), F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 9).alias("end")).distinct()
    sinks = lines.filter("l_discount > 0.09").select(F.col("l_suppkey").alias("path"), F.col("l_quantity").cast("int").alias("line")).distinct()
    return C.vulnerable_siblings(members, sinks)


SIBLINGS_SQL = """
WITH m AS (SELECT DISTINCT l_partkey % 100 AS cluster, l_suppkey AS path, l_linenumber * 10 AS start, l_linenumber * 10 + 9 AS "end" FROM lineitem),
s AS (SELECT DISTINCT l_suppkey AS path, CAST(l_quantity AS INT) AS line FROM lineitem WHERE l_discount > 0.09),
h AS (SELECT DISTINCT m.* FROM m JOIN s ON m.path = s.path AND line BETWEEN start AND "end")
SELECT * FROM m WHERE cluster IN (SELECT cluster FROM h) EXCEPT SELECT * FROM h"""


def identifier_words(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat("p_type", F.initcap("p_name"), F.lit("_"), "p_brand").alias("name"))
    return p.select("p_partkey", F.explode(T.words_of(F.col("name"))).alias("word"))


WORDS_SQL = r"""
WITH n AS (SELECT p_partkey, p_type || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || '_' || p_brand AS name FROM part)
SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(lower(trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ')) AS word FROM n) WHERE length(word) >= 3"""


def _vocabulary(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("class"), F.col("doc_id").alias("method"), F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word"))
    return docs.filter(F.length("word") >= 3)


def conceptual_cohesion(s, d):
    out = T.conceptual_cohesion(_vocabulary(s, d))
    return out.withColumn("cohesion", F.round("cohesion", 5))


COHESION_SQL = """
WITH v AS (SELECT class, method, word FROM (SELECT source AS class, doc_id AS method, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) >= 3),
n AS (SELECT class, count(DISTINCT method) AS methods FROM v GROUP BY class),
tf AS (SELECT class, method, word, count(*) AS tf FROM v GROUP BY ALL),
df AS (SELECT class, word, count(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT tf.class, method, tf.word, tf * (ln((1 + methods) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.class = df.class AND tf.word = df.word JOIN n ON tf.class = n.class),
u AS (SELECT class, method, word, x / sqrt(sum(x * x) OVER (PARTITION BY class, method)) AS u FROM x),
s AS (SELECT class, sum(p) AS square, count(*) AS terms FROM (SELECT class, word, sum(u) ** 2 AS p FROM u GROUP BY ALL) GROUP BY class)
SELECT s.class AS class, methods, terms, round((square - methods) / (methods * (methods - 1)), 5) AS cohesion FROM s JOIN n ON s.class = n.class"""


def ngram_counts(s, d):
    docs = table(s, d, "documents").select("lang", F.split("text", " ").alias("tokens"))
    return T.ngrams(docs, 3, ["lang"])


NGRAM_SQL = """
WITH t AS (SELECT lang, string_split(text, ' ') AS w FROM documents),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM t WHERE len(w) >= 3)
SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL"""


def naturalness(s, d):
    conv = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("group"), F.split("text", " ").alias("tokens"))
    return T.naturalness(conv, replace(DEFAULTS.mining, ngram_order=3)).withColumn("entropy", F.round("entropy", 6))


def _natural_sql(orders: int = 3, gamma: float = 1.0, cache: int = 5000, least: int = 20) -> str:
    p = " , ".join(f"max(CASE WHEN o = {o} AND ac > oc THEN (a - own) / (ac - oc) END) AS p{o}" for o in range(1, orders + 1))
    prob = "(1 / v)"
    for o in range(1, orders + 1):
        prob = f"(CASE WHEN p{o} IS NULL THEN {prob} ELSE 0.5 * p{o} + 0.5 * {prob} END)"
    grams = " UNION ALL ".join(f"SELECT id, grp, i, {o} AS o, array_to_string(w[i - {o} + 2 : i], chr(1)) AS context, w[i + 1] AS token FROM f WHERE i >= {o} - 1" for o in range(1, orders + 1))
    return f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, role AS grp, string_split(text, ' ') AS w FROM conversations),
f AS (SELECT *, unnest(range(len(w))) AS i FROM t WHERE len(w) >= {least}),
p AS ({grams}),
v AS (SELECT grp, count(DISTINCT token) AS v FROM p GROUP BY grp),
c AS (
  SELECT *, count(*) OVER (PARTITION BY grp, o, context, token) AS a, count(*) OVER (PARTITION BY grp, o, context) AS ac,
    count(*) OVER (PARTITION BY id, o, context, token) AS own, count(*) OVER (PARTITION BY id, o, context) AS oc, row_number() OVER (PARTITION BY id, o, context, token ORDER BY i) - 1 AS again FROM p),
q AS (SELECT id, grp, i, max(CASE WHEN o = 1 THEN again END) AS again, {p} FROM c GROUP BY ALL),
m AS (SELECT id, q.grp, least(i, {cache}) AS seen, again, {prob} AS prob FROM q JOIN v ON q.grp = v.grp),
s AS (SELECT id, grp, {gamma} / ({gamma} + seen) AS share, prob, CASE WHEN seen > 0 THEN again / seen ELSE 0 END AS cached FROM m)
SELECT id, grp AS "group", count(*) AS tokens, round(avg(-log2(greatest(share * prob + (1 - share) * cached, 1e-12))), 6) AS entropy FROM s GROUP BY ALL"""


def frequent_patterns(s, d):
    p = table(s, d, "part").select(F.col("p_type").alias("pattern"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("parent"), (F.col("p_partkey") % 50).alias("place"))
    up = table(s, d, "part").select(F.col("p_brand").alias("pattern"), F.lit(None).cast("string").alias("parent"), (F.col("p_partkey") % 50).alias("place"))
    return T.frequent_patterns(p.union(up))


PATTERNS_SQL = """
WITH t AS (SELECT p_type AS pattern, CASE WHEN p_size > 3 THEN p_brand END AS parent, p_partkey % 50 AS place FROM part UNION ALL SELECT p_brand, NULL, p_partkey % 50 FROM part),
s AS (SELECT pattern, count(*) AS support, count(DISTINCT place) AS files FROM t GROUP BY pattern HAVING count(*) >= 5),
a AS (SELECT t.pattern, t.parent FROM t JOIN s ON t.pattern = s.pattern WHERE parent IS NOT NULL GROUP BY t.pattern, t.parent HAVING count(*) = any_value(support))
SELECT * FROM s WHERE pattern NOT IN (SELECT a.pattern FROM a JOIN s c ON a.pattern = c.pattern JOIN s p ON a.parent = p.pattern WHERE p.support = c.support)"""


def mdl_gain(s, d):
    own = table(s, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("usage"), F.max(F.length("p_type")).alias("size"))
    total = table(s, d, "part").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("p_type").alias("vocabulary"))
    out = own.join(F.broadcast(total))
    return out.select("p_type", F.round(T.mdl_gain(F.col("usage"), F.col("size"), F.col("vocabulary"), F.col("total")), 5).alias("gain"))


MDL_SQL = """
WITH o AS (SELECT p_type, count(*) AS u, max(length(p_type)) AS s FROM part GROUP BY p_type), t AS (SELECT count(*) AS n, log2(greatest(count(DISTINCT p_type), 2)) AS b FROM part)
SELECT p_type, round(u * (s - 1) * b - s * b - u * (log2(n) - log2(u)), 5) AS gain FROM o, t"""


def pattern_categories(s, d):
    rules = {"PROMO|ECONOMY": "cheap", "BRASS$|STEEL$": "metal", "^STANDARD": "plain"}
    return table(s, d, "part").select("p_partkey", T.categorise(F.col("p_type"), rules).alias("category"))


CATEGORY_SQL = "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'PROMO|ECONOMY') THEN 'cheap' WHEN regexp_matches(p_type, 'BRASS$|STEEL$') THEN 'metal' WHEN regexp_matches(p_type, '^STANDARD') THEN 'plain' ELSE 'other' END AS category FROM part"

QUERIES = {
    "metric_histogram": (metric_histogram, f"WITH {HIST} SELECT *, CAST(n AS DOUBLE) AS weight FROM hist"),
    "metric_quantiles": (metric_quantiles, QUANTILES_SQL),
    "weighted_quantiles": (weighted_quantiles, WEIGHTED_SQL),
    "firing_rates": (firing_rates, "SELECT l_returnflag, l_linestatus, round(avg((CAST(l_quantity AS BIGINT) <= 38)::INT), 6) AS cdf, round(1 - avg((CAST(l_quantity AS BIGINT) <= 38)::INT), 6) AS firing_rate FROM lineitem GROUP BY ALL"),
    "interpolated_prior": (interpolated_prior, INTERPOLATED_SQL),
    "threshold_estimate": (threshold_estimate, ESTIMATE_SQL),
    "intensity_ranking": (intensity_ranking, INTENSITY_SQL),
    "upper_medians": (upper_medians, UPPER_SQL),
    "god_percentile": (god_percentile, "SELECT p_brand, round(quantile_cont(p_size, 0.9), 6) AS percentile FROM part GROUP BY p_brand"),
    "robust_z": (robust_z, ROBUST_SQL),
    "kl_to_median": (kl_to_median, KL_SQL),
    "vendored_files": (vendored_files, VENDORED_SQL),
    "locality_entropy": (locality_entropy, LOCALITY_SQL),
    "exact_clones": (exact_clones, EXACT_SQL),
    "token_simhash": (token_simhash, SIMHASH_SQL),
    "near_duplicate_pairs": (near_duplicate_pairs, NEAR_SQL),
    "clone_clusters": (clone_clusters, CLUSTERS_SQL),
    "vulnerable_siblings": (vulnerable_siblings, SIBLINGS_SQL),
    "identifier_words": (identifier_words, WORDS_SQL),
    "conceptual_cohesion": (conceptual_cohesion, COHESION_SQL),
    "ngram_counts": (ngram_counts, NGRAM_SQL),
    "naturalness": (naturalness, _natural_sql()),
    "frequent_patterns": (frequent_patterns, PATTERNS_SQL),
    "mdl_gain": (mdl_gain, MDL_SQL),
    "pattern_categories": (pattern_categories, CATEGORY_SQL),
}
